"""Scans, projections, predicates, subqueries, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import relational as R
from sparkloom.registry import operator, sql_operator
from sparkloom.session import read_table

# Scans
sql_operator("sc1_full_scan", "SELECT * FROM lineitem")
sql_operator("sc2_filtered_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
sql_operator("sc3_range_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
sql_operator("sc3_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
sql_operator("sc6_columnar_aggregate", "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS total, MIN(l_discount) AS low, MAX(l_discount) AS high FROM lineitem")
sql_operator("sc8_from_less", "SELECT 1 + 1 AS two, 'x' AS letter, CAST(7 AS BIGINT) % 3 AS rest")


@operator("sc7_inheritance", "SELECT n_nationkey AS k, n_name AS label FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def inheritance(spark, sf_dir):
    parent = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"))
    child = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("label"), F.lit(1).alias("extra"))
    return R.inherited(parent, child)


@operator("sc7_from_only", "SELECT n_nationkey AS k, n_name AS label FROM nation")
def from_only(spark, sf_dir):
    return R.inherited(read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label")))


@operator("sc9_tablesample_all", "SELECT COUNT(*) AS n FROM lineitem")
def tablesample_all(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").sample(fraction=1.0, seed=7).agg(F.count("*").alias("n"))


@operator("sc9_tablesample")
def tablesample(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").sample(fraction=0.1, seed=7).select("o_orderkey")


# Projection and expressions
sql_operator("pr1_projection", "SELECT c_custkey, c_name FROM customer")
sql_operator("pr2_items", "SELECT o.*, UPPER(o_orderpriority) AS prio, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size_class FROM orders o")
sql_operator("pr3_arithmetic", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, l_quantity / 2 AS half, l_linenumber - 1 AS before FROM lineitem")
sql_operator("pr4_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS standing, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS building FROM customer")
sql_operator("pr5_cast", "SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR(20)) AS text_key, CAST(CAST(o_custkey AS VARCHAR(20)) AS DOUBLE) AS nested, TRY_CAST(o_orderstatus AS INT) AS failed FROM orders", "SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS text_key, CAST(CAST(o_custkey AS VARCHAR) AS DOUBLE) AS nested, TRY_CAST(o_orderstatus AS INT) AS failed FROM orders")
sql_operator("pr6_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


@operator("pr7_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    return R.distinct_on(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


sql_operator("pr8_aliases", "SELECT n.n_name AS nation_name, r.r_name AS region_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey")

# Predicates
sql_operator("fi1_comparisons", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 30 AND p_size <> 20 AND p_retailprice <= 1500 AND p_brand != 'Brand#11'")
sql_operator("fi2_and_or", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 9000) AND NOT (c_nationkey = 3 OR c_nationkey = 7)")
sql_operator("fi3_in_list", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
sql_operator("fi4_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 100 AND 200")
sql_operator("fi5_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S_A%'")
sql_operator("fi6_regexp", "SELECT page_id FROM pages WHERE url RLIKE '^https://.*[0-9]$'", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https://.*[0-9]$')")
sql_operator("fi6_not_regexp", "SELECT page_id FROM pages WHERE NOT url RLIKE 'blog'", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, 'blog')")
sql_operator("fi7_null_tests", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.toxic IS NOT NULL")
sql_operator("fi8_function_predicate", "SELECT o_orderkey FROM orders WHERE YEAR(o_orderdate) = 1995 AND LENGTH(o_orderpriority) > 5")
sql_operator("fi10_having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 3 AND SUM(o_totalprice) > 100000")


@operator("fi11_row_security", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'F'")
def row_security(spark, sf_dir):
    return R.row_filtered(read_table(spark, sf_dir, "orders"), (F.col("o_custkey") == 7) | (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_custkey")


# Subqueries and CTEs
sql_operator("sq1_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sql_operator("sq2_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
sql_operator("sq3_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20)")
sql_operator("sq3_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
sql_operator("sq4_scalar_where", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT AVG(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_operator("sq5_scalar_select", "SELECT c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c")
sql_operator("sq6_cte", "WITH totals AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), rich AS (SELECT * FROM totals WHERE t > 500000) SELECT c_name, ROUND(t, 2) AS total FROM rich JOIN customer ON o_custkey = c_custkey")
sql_operator("sq7_recursive_fibonacci", "WITH RECURSIVE fib(n, a, b) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM fib WHERE n < 40) SELECT n, a FROM fib")
sql_operator("sq8_derived_table", "SELECT s.f, s.n FROM (SELECT l_returnflag AS f, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag) s WHERE s.n > 10")
sql_operator("sq9_lateral", "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")

# Joins
sql_operator("j1_inner_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sql_operator("j2_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
sql_operator("j2_right_join", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
sql_operator("j2_full_join", "SELECT l.doc_id AS labelled, d.doc_id AS document FROM (SELECT doc_id FROM labels WHERE quality = 1) l FULL JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id")
sql_operator("j3_cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region")
sql_operator("j4_self_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql_operator("j5_hash_join", "SELECT /*+ SHUFFLE_HASH(customer) */ o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
sql_operator("j6_merge_join", "SELECT /*+ MERGE(customer) */ o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
sql_operator("j7_nested_loop", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
sql_operator("j8_indexed_lookup_join", "SELECT /*+ BROADCAST(nation) */ s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
sql_operator("j10_join_group", "SELECT n_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY n_name")
sql_operator("j10_join_count", "SELECT COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
sql_operator("j11_semi_join", "SELECT d.doc_id FROM documents d LEFT SEMI JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1", "SELECT d.doc_id FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
sql_operator("j11_anti_join", "SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
sql_operator("j12_multi_key_join", "SELECT COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity <= b.l_quantity")
sql_operator("j13_natural", "SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels")
sql_operator("j13_using", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")


@operator("j12_as_of_join", """SELECT v.event_id, v.user_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'view') v
    ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON v.user_id = p.user_id AND v.ts >= p.ts""")
def as_of(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return R.as_of_join(views, bought, ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "user_id", "last_value")


@operator("j12_range_join", """SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal AS low, s_acctbal + 5 * POWER(10, s_suppkey % 4) AS high FROM supplier) s ON p_retailprice >= low AND p_retailprice < high""")
def range_join(spark, sf_dir):
    ranges = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 5 * F.pow(F.lit(10.0), F.col("s_suppkey") % 4)).alias("high"))
    return R.bucketed_range_join(read_table(spark, sf_dir, "part"), ranges, "p_retailprice", "low", "high", 10.0).select("p_partkey", "s_suppkey")


# Sort, limit, sets
sql_operator("so1_order_by", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey")
sql_operator("so2_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
sql_operator("so3_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")


@operator("so4_top_k_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def top_k(spark, sf_dir):
    return R.top_k_per_group(read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


sql_operator("se1_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_operator("se2_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT r_regionkey + 100 FROM region")
sql_operator("se3_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
sql_operator("se3_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql_operator("se4_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
sql_operator("se4_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
