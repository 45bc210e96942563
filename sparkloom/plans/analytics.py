"""Aggregation, grouping sets, windows, time series, search, vectors, graphs and recursion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import timeseries as T
from sparkloom.functions import vector as V
from sparkloom.operators import graph as G
from sparkloom.operators import profile as P
from sparkloom.operators import ranks as K
from sparkloom.operators import relational as R
from sparkloom.operators import search as S
from sparkloom.registry import operator, sql_operator
from sparkloom.session import read_table

sql_operator("a1_count", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 300000")
sql_operator("a2_global_aggregates", "SELECT ROUND(SUM(c_acctbal), 2) AS total, ROUND(AVG(c_acctbal), 4) AS mean, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high, MIN(c_name) AS first_name FROM customer")
sql_operator("a3_group_by", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_operator("a5_grouped_aggregates", "SELECT c_nationkey, COUNT(c_name) AS n, ROUND(SUM(c_acctbal), 2) AS total, ROUND(AVG(c_acctbal), 4) AS mean, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high FROM customer GROUP BY c_nationkey")
sql_operator("a6_having", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment HAVING AVG(c_acctbal) > 0")
sql_operator("a7_rollup", "SELECT n_regionkey, c_mktsegment, COUNT(*) AS n, CAST(GROUPING(n_regionkey) AS INT) AS g1, CAST(GROUPING(c_mktsegment) AS INT) AS g2 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP(n_regionkey, c_mktsegment)")
sql_operator("a8_cube", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
sql_operator("a9_grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
sql_operator("a10_array_agg", "SELECT n_regionkey, ARRAY_JOIN(SORT_ARRAY(COLLECT_LIST(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, ARRAY_TO_STRING(LIST(n_name ORDER BY n_name), '|') AS names FROM nation GROUP BY n_regionkey")
@operator("a10_array_agg_nulls", "SELECT lang, LEN(LIST(quality)) AS n, LEN(LIST(quality) FILTER (WHERE quality IS NULL)) AS nulls, ARRAY_TO_STRING(LIST(COALESCE(CAST(quality AS VARCHAR), '?') ORDER BY quality NULLS FIRST), '') AS items FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def array_agg_nulls(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    items = rows.groupBy("lang").agg(R.array_agg("quality").alias("q"))
    shown = F.array_join(F.transform(F.array_sort("q", lambda a, b: F.coalesce(a, F.lit(-1)) - F.coalesce(b, F.lit(-1))), lambda x: x.cast("string")), "", "?")
    return items.select("lang", F.size("q").cast("long").alias("n"), F.size(F.filter("q", F.isnull)).cast("long").alias("nulls"), shown.alias("items"))


sql_operator("a10_string_agg", "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_operator("a11_first_last", "SELECT user_id, MIN_BY(value, STRUCT(ts, event_id)) AS first_value, MAX_BY(value, STRUCT(ts, event_id)) AS last_value FROM events GROUP BY user_id", "SELECT user_id, ARG_MIN(value, ROW(ts, event_id)) AS first_value, ARG_MAX(value, ROW(ts, event_id)) AS last_value FROM events GROUP BY user_id")


@operator("a4_group_by_bucket", "SELECT TIME_BUCKET(INTERVAL '1 hour', ts) AS bucket, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1")
def group_by_bucket(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy(T.time_bucket(1, "hour", F.col("ts")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@operator("a12_index_weighted_avg", """WITH p AS (SELECT user_id, value, LEAD(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx, event_id FROM events)
    SELECT user_id, ROUND(COALESCE(AVG(CASE WHEN nx IS NOT NULL THEN (value + nx) / 2 END), MIN(value)), 6) AS twa FROM p GROUP BY user_id""")
def index_weighted(spark, sf_dir):
    return T.index_weighted_avg(read_table(spark, sf_dir, "events"), ["user_id"], "value", ["ts", "event_id"]).withColumn("twa", F.round("twa", 6))


@operator("a12_time_weighted_avg", """WITH p AS (SELECT user_id, value, LEAD(value) OVER w AS nx, (epoch_us(LEAD(ts) OVER w) - epoch_us(ts)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, ROUND(COALESCE(CASE WHEN SUM(s) > 0 THEN SUM((value + nx) / 2 * s) / SUM(s) END, AVG(value)), 6) AS twa FROM p GROUP BY user_id""")
def time_weighted(spark, sf_dir):
    return T.time_weighted_avg(read_table(spark, sf_dir, "events"), ["user_id"], "value", "ts", "event_id").withColumn("twa", F.round("twa", 6))


@operator("a13_vector_avg", "SELECT label, pos, ROUND(AVG(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, UNNEST(embedding) AS x, UNNEST(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos")
def vector_avg(spark, sf_dir):
    exploded = read_table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return exploded.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


sql_operator("a16_order_by_aggregate", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY COUNT(*) DESC, l_suppkey LIMIT 15")
sql_operator("a17_distinct_filter_stddev", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS big, ROUND(STDDEV_SAMP(o_totalprice), 4) AS sd FROM orders GROUP BY o_orderstatus")
sql_operator("a17_percentile", "SELECT o_orderpriority, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, ROUND(QUANTILE_CONT(o_totalprice, 0.5), 4) AS med FROM orders GROUP BY o_orderpriority")
sql_operator("a17_json_aggregate", "SELECT n_regionkey, TO_JSON(SORT_ARRAY(COLLECT_LIST(n_nationkey))) AS js FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(TO_JSON(LIST(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS js FROM nation GROUP BY n_regionkey")
sql_operator("a17_approx_distinct", "SELECT APPROX_COUNT_DISTINCT(l_partkey) AS n FROM lineitem", None)

# Windows
OVER = "(PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"
TIES = "(PARTITION BY l_returnflag ORDER BY l_quantity)"
for _id, _call in (("w1_row_number", "ROW_NUMBER()"), ("w6_ntile", "NTILE(4)"), ("w4_percent_rank", "ROUND(PERCENT_RANK()"), ("w5_cume_dist", "ROUND(CUME_DIST()")):
    _end = ", 8)" if _call.startswith("ROUND") else ""
    _wrap = f"{_call} OVER {OVER}{_end}" if _end else f"CAST({_call} OVER {OVER} AS BIGINT)"
    sql_operator(_id, f"SELECT c_custkey, {_wrap} AS w FROM customer")
sql_operator("w2_rank", f"SELECT l_orderkey, l_linenumber, CAST(RANK() OVER {TIES} AS BIGINT) AS w FROM lineitem")
sql_operator("w3_dense_rank", f"SELECT l_orderkey, l_linenumber, CAST(DENSE_RANK() OVER {TIES} AS BIGINT) AS w FROM lineitem")
sql_operator("w7_lag_lead", "SELECT event_id, LAG(value, 1, 0.0) OVER w AS before, LEAD(value, 2, -1.0) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql_operator("w8_first_value", "SELECT event_id, FIRST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM events")
sql_operator("w9_last_value", "SELECT event_id, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM events")
sql_operator("w10_partition_aggregates", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER p, 2) AS total, ROUND(AVG(o_totalprice) OVER p, 7) AS mean, COUNT(*) OVER p AS n, MIN(o_totalprice) OVER p AS low, MAX(o_totalprice) OVER p AS high FROM orders WINDOW p AS (PARTITION BY o_custkey)")
sql_operator("w11_rows_frame", "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS moving, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 7) AS running FROM events")
sql_operator("w12_frame_bounds", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) AS back FROM events")
sql_operator("w12_range_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM orders")
sql_operator("w13_multi_column_window", "SELECT l_orderkey, l_linenumber, CAST(ROW_NUMBER() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS BIGINT) AS w FROM lineitem")


@operator("w14_mixed_items", "SELECT o_orderkey, UPPER(o_orderpriority) AS p, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS big, CAST(RANK() OVER (ORDER BY o_totalprice DESC) AS BIGINT) AS price_rank, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders")
def mixed_items(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    rows = K.ranked(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_totalprice"], "price_rank")
    prev = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return rows.select("o_orderkey", F.upper("o_orderpriority").alias("p"), (F.col("o_totalprice") > 100000).cast("int").alias("big"), "price_rank", prev.alias("prev"))


@operator("w6_ntile_whole_table", "SELECT c_custkey, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY c_acctbal, c_custkey) - 1) * 10 / (SELECT COUNT(*) FROM customer)) + 1 AS INT) AS w FROM customer")
def whole_tiles(spark, sf_dir):
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return K.tiles(customers, 10, [F.col("c_acctbal"), F.col("c_custkey")], "w").select("c_custkey", "w")


@operator("w6_reference_ntile", "SELECT c_custkey, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 4.0 / COUNT(*) OVER (PARTITION BY c_nationkey)) + 1 AS INT) AS w FROM customer")
def reference_ntile(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", R.reference_ntile(4, [F.col("c_custkey")], ["c_nationkey"]).alias("w"))


# Nearest neighbours
def _nearest(distance, name, oracle_distance):
    oracle = f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, ROUND({oracle_distance}, 5) AS d FROM embeddings, q ORDER BY {oracle_distance}, vec_id LIMIT 10"

    def query(spark, sf_dir):
        vectors = read_table(spark, sf_dir, "embeddings")
        probe = vectors.filter("vec_id = 0").select(F.col("embedding").alias("e")).limit(1)  # a row
        ranked = vectors.crossJoin(F.broadcast(probe)).select("vec_id", distance(F.col("embedding"), F.col("e")).alias("d")).orderBy("d", "vec_id").limit(10)
        return ranked.withColumn("d", F.round("d", 5))

    operator(name, oracle)(query)


_nearest(V.l2_distance, "so5_knn_l2", "SQRT(list_sum(list_transform(list_zip(embedding, e), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))))")
_nearest(V.cosine_distance, "so5_knn_cosine", "(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])))")
_nearest(V.inner_product_distance, "so5_knn_inner_product", "(-list_inner_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])))")

# Full-text search; the stop words stand here as the survey lists them
STOP = ", ".join(f"'{w}'" for w in "der die das und oder in ist ein eine the a an of to and or is for with mit fuer fur von auf im zu".split())
TOKENS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9+]+'), lambda w: w <> '' AND w NOT IN ({STOP}))"


@operator("ft1_tokens", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def text_tokens(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.tokens(F.col("text")), " ").alias("tokens"))


@operator("ft2_inverted_index", f"SELECT term, COUNT(*) AS postings, CAST(SUM(tf) AS BIGINT) AS total FROM (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, UNNEST({TOKENS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def inverted(spark, sf_dir):
    return S.inverted_index(read_table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("postings"), F.sum("tf").alias("total"))


QUERY = "tion hend ereat"


@operator("ft3_match_any", f"SELECT doc_id FROM documents WHERE list_has_any({TOKENS}, ['tion', 'hend', 'ereat'])")
def match_any(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").filter(S.matches_any(F.col("text"), QUERY)).select("doc_id")


BM25 = f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), l AS (SELECT doc_id, w, GREATEST(len(w), 1) AS n FROM t),
    c AS (SELECT COUNT(*) AS total, AVG(n) AS mean FROM l), q AS (SELECT UNNEST(['tion', 'hend', 'ereat']) AS term),
    f AS (SELECT l.doc_id, q.term, l.n, len(list_filter(l.w, lambda x: x = q.term)) AS tf FROM l, q), d AS (SELECT term, COUNT(*) AS df FROM f WHERE tf > 0 GROUP BY term)
    SELECT doc_id, ROUND(SUM(ln((total - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM f JOIN d USING (term), c WHERE tf > 0 GROUP BY doc_id"""


@operator("ft4_bm25", BM25)
def bm25(spark, sf_dir):
    return S.bm25(read_table(spark, sf_dir, "documents"), QUERY, "doc_id", "text").withColumn("score", F.round("score", 6))


@operator("ft5_boolean", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND NOT contains(lower(text), 'idiot') AND contains(lower(text), 'of the')")
def boolean(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").filter(S.matches_boolean(F.col("text"), '+tion -idiot +"of the"')).select("doc_id")


@operator("ft6_match_score", f"SELECT d.doc_id, COALESCE(s.score, 0) AS score FROM documents d LEFT JOIN ({BM25}) s ON d.doc_id = s.doc_id")
def match_score(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id").join(S.bm25(docs, QUERY, "doc_id", "text"), "doc_id", "left").select("doc_id", F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score"))


# Graphs: every user of the events is a node; each event links its user to another, wherever the ids end
EDGES = "SELECT DISTINCT user_id AS src, CAST(FLOOR(user_id / 2) AS BIGINT) AS dst, event_type AS type FROM events"
NODES = "SELECT DISTINCT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM events"


def _graph(spark, sf_dir):
    read_table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(NODES), spark.sql(EDGES)


@operator("g2_match_hop", f"WITH n AS ({NODES}), e AS ({EDGES}) SELECT e.src AS a, e.type, e.dst AS b FROM e JOIN n x ON x.id = e.src AND x.label = 'even' JOIN n y ON y.id = e.dst AND y.label = 'odd' WHERE e.type = 'view'")
def match_hop(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.match_hop(nodes, edges, "even", "view", "odd")


REACH = f"""WITH RECURSIVE e AS ({EDGES}), u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
    r(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.id WHERE r.depth < DEPTH),
    d AS (SELECT id, MIN(depth) AS depth FROM r GROUP BY id)"""


@operator("g4_neighbors", REACH.replace("DEPTH", "4") + " SELECT id, depth FROM d WHERE id <> 1")
def graph_neighbors(spark, sf_dir):
    return G.neighbors(_graph(spark, sf_dir)[1], 1, 4)


PATH = REACH.replace("DEPTH", "40") + """, up AS (SELECT d.id, MIN(u.src) AS parent FROM d JOIN u ON u.dst = d.id JOIN d b ON b.id = u.src AND b.depth = d.depth - 1 GROUP BY d.id),
    p(id, n, path) AS (SELECT MAX(user_id), 0, CAST(MAX(user_id) AS VARCHAR) FROM events UNION ALL SELECT up.parent, n + 1, up.parent || ',' || path FROM p JOIN up ON up.id = p.id)
    SELECT CAST(1 AS BIGINT) AS source, (SELECT MAX(user_id) FROM events) AS target, n AS length, path FROM p WHERE id = 1"""


@operator("g3_shortest_path", PATH)
def graph_path(spark, sf_dir):
    target = read_table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]
    return G.shortest_path(_graph(spark, sf_dir)[1], 1, target).withColumn("path", F.array_join("path", ","))


# Time series and profiles
@operator("st5_retention", "SELECT event_id FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    return T.retained(read_table(spark, sf_dir, "events"), "ts", 7).select("event_id")


@operator("st7b_partition_status", "SELECT DATE_TRUNC('week', ts)::TIMESTAMP AS part, COUNT(*) AS n FROM events GROUP BY 1")
def partition_status(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy(T.time_bucket(1, "week", F.col("ts")).alias("part")).agg(F.count("*").alias("n"))


@operator("in1_column_stats", " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 6) AS null_frac, COUNT(DISTINCT {c}) AS ndv, MIN(CAST({c} AS VARCHAR)) AS min_value, MAX(CAST({c} AS VARCHAR)) AS max_value, ROUND(AVG(LENGTH(CAST({c} AS VARCHAR))), 6) AS avg_width FROM customer" for c in ("c_name", "c_mktsegment", "c_nationkey")))
def column_stats(spark, sf_dir):
    return P.column_stats(read_table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"])


@operator("in2_most_common", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 10")
def most_common(spark, sf_dir):
    return P.most_common(read_table(spark, sf_dir, "customer"), "c_mktsegment")


@operator("in3_equi_depth", "SELECT UNNEST(range(11)) AS bucket, UNNEST(QUANTILE_DISC(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS bound FROM orders")
def equi_depth(spark, sf_dir):
    bounds = P.equi_depth(read_table(spark, sf_dir, "orders"), "o_totalprice", accuracy=1_000_000)
    return bounds.select(F.posexplode("bounds").alias("bucket", "bound")).withColumn("bucket", F.col("bucket").cast("long"))


@operator("w15_sessions", """WITH g AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts - LAG(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, CAST(n AS BIGINT) AS session, COUNT(*) AS events FROM s GROUP BY 1, 2""")
def sessions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 6 HOURS")), 1).otherwise(0)
    numbered = read_table(spark, sf_dir, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"))
