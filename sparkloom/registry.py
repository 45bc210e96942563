"""Registered queries: each operator adds its name, its query and, where SQL can say it, the oracle's SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
PLANS: tuple[str, ...] = ("tpch", "relational", "analytics", "functions", "sources")


def operator(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``; ``oracle`` is the same query as SQL."""

    def add(query: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = query
        if oracle:
            _oracles[name] = oracle
        return query

    return add


def _load() -> None:
    for plan in PLANS:
        importlib.import_module(f"sparkloom.plans.{plan}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)


def sql_operator(name: str, sql: str, oracle: str | None = "") -> None:
    """Registers a query given as Spark SQL over the tables; its oracle is the same text unless another is given."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sparkloom.session import TABLES, register_views

        register_views(spark, sf_dir, tuple(t for t in TABLES if re.search(rf"\b{t}\b", sql)))
        return spark.sql(sql)

    operator(name, sql if oracle == "" else oracle)(query)
