"""Decision-support queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.registry import operator
from sparkloom.session import read_table


@operator(
    "a3_tpch_q1",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        read_table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@operator(
    "j10_tpch_q3",
    """SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1995-03-15").cast("timestamp_ntz")
    customers = read_table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = read_table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < day)
    lines = read_table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") > day)
    joined = lines.join(orders.join(customers, F.col("c_custkey") == F.col("o_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return joined.groupBy("l_orderkey", "o_orderdate").agg(revenue).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@operator(
    "j10_tpch_q5",
    """SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""",
)
def local_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: read_table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    year = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    places = t["nation"].join(t["region"].filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    sellers = t["supplier"].join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    bought = t["orders"].filter(year).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    lines = t["lineitem"].join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return lines.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@operator(
    "a2_tpch_q6",
    """SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
       AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24""",
)
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    rows = read_table(spark, sf_dir, "lineitem").filter(year & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count("*").alias("n"))
