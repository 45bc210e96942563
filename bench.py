"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times into a no-op sink; its figure is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkloom.registry import all_oracles, all_queries  # noqa: E402
from sparkloom.session import TABLES, build_session  # noqa: E402

HEADLINE = (
    "a3_tpch_q1", "j10_tpch_q3", "j10_tpch_q5", "a2_tpch_q6", "sc1_full_scan", "sc2_filtered_scan", "sc3_point_lookup", "sc3_range_scan",
    "j1_inner_chain", "j2_left_join", "j5_hash_join", "j12_as_of_join", "a1_count", "a7_rollup", "a8_cube", "w1_row_number", "w11_rows_frame",
    "pr6_distinct", "pr7_distinct_on", "so3_top_k", "so4_top_k_per_group", "so5_knn_l2", "ft4_bm25", "fd7_time_bucket", "fj2_json_facts",
    "sq4_scalar_where", "sq7_recursive_fibonacci", "se3_intersect", "g4_neighbors", "in1_column_stats", "st4_continuous_aggregate",
)


def single_node(sf: str, cpus: int) -> dict[str, float]:
    """Median seconds of the same queries, as their SQL, in an engine of one process on the same files and cores."""
    import duckdb

    con, out = duckdb.connect(config={"threads": cpus}), {}
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in HEADLINE:
        if name in all_oracles():
            runs = []
            for _ in range(4):
                began = time.perf_counter()
                con.execute(all_oracles()[name]).fetchall()
                runs.append(time.perf_counter() - began)
            out[name] = round(statistics.median(runs[1:]), 4)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    home = tempfile.mkdtemp(prefix="sparkloom-bench-")
    conf = {"spark__sql__shuffle__partitions": cpus, "spark__driver__memory": "8g", "spark__sql__warehouse__dir": f"{home}/warehouse", "spark__local__dir": f"{home}/local"}
    spark = build_session(f"local[{cpus}]", "bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = all_queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    beside = single_node(sf, int(cpus))
    print(json.dumps({"metric": "headline queries, sum of median seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "duckdb": beside, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
