"""Oracles that show something: each has rows, and more than constants, unless it is listed here."""

import duckdb
import pytest

from sparkloom.registry import all_oracles
from sparkloom.session import TABLES

SF = "/root/testdata/sf0.01"
# One row of constants by their nature: system values, and what has a known answer.
CONSTANT = {"fn2_system", "fd1_now"}
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_has_rows(duck, name):
    rows = duck.execute(ORACLES[name]).fetchmany(1000)
    assert rows and any(v is not None for r in rows for v in r)
    if name not in CONSTANT:
        assert len(rows) > 1 or any(not isinstance(v, bool) for v in rows[0])
