"""Scalar functions by family, over the tables' columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import extensions as E
from sparkloom.functions import jsons as J
from sparkloom.functions import spatial as G
from sparkloom.functions import text as X
from sparkloom.functions import timeseries as T
from sparkloom.functions import vector as V
from sparkloom.operators import documents as D
from sparkloom.registry import operator, sql_operator
from sparkloom.session import read_table

# Strings
sql_operator("fs1_case_length", "SELECT p_partkey, UPPER(p_name) AS up, LOWER(p_brand) AS low, LENGTH(p_name) AS n, CHAR_LENGTH(p_type) AS m, OCTET_LENGTH(p_type) AS bytes FROM part", "SELECT p_partkey, UPPER(p_name) AS up, LOWER(p_brand) AS low, LENGTH(p_name)::INT AS n, LENGTH(p_type)::INT AS m, OCTET_LENGTH(encode(p_type))::INT AS bytes FROM part")
sql_operator("fs2_concat", "SELECT c_custkey, CONCAT(c_name, '-', c_mktsegment) AS a, CONCAT_WS('/', c_name, NULLIF(c_mktsegment, 'BUILDING'), 'x') AS b FROM customer", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, CONCAT_WS('/', c_name, NULLIF(c_mktsegment, 'BUILDING'), 'x') AS b FROM customer")
sql_operator("fs3_substring", "SELECT p_partkey, SUBSTRING(p_name, 2, 4) AS a, SUBSTR(p_type, 3) AS b, LEFT(p_name, 3) AS l, RIGHT(p_name, 3) AS r FROM part")
sql_operator("fs4_trim_replace", "SELECT p_partkey, BTRIM(CONCAT(' \t', p_name, ' '), ' \t') AS a, REPLACE(p_type, 'E', '_') AS b FROM part", "SELECT p_partkey, TRIM(' \t' || p_name || ' ', ' \t') AS a, REPLACE(p_type, 'E', '_') AS b FROM part")
sql_operator("fs5_locate", "SELECT p_partkey, LOCATE('a', p_name) AS a, INSTR(p_type, 'E') AS b FROM part", "SELECT p_partkey, STRPOS(p_name, 'a')::INT AS a, INSTR(p_type, 'E')::INT AS b FROM part")
sql_operator("fs6_reverse_repeat", "SELECT r_regionkey, REVERSE(r_name) AS a, REPEAT(r_name, 2) AS b, CONCAT(REPEAT(' ', 3), r_name) AS c FROM region")
sql_operator("fs7_pad", "SELECT n_nationkey, LPAD(n_name, 10, '*') AS a, RPAD(n_name, 4, '-') AS b FROM nation")
sql_operator("fs8_ascii", "SELECT n_nationkey, ASCII(n_name) AS a FROM nation")
sql_operator("fs9_regexp", "SELECT page_id, REGEXP_REPLACE(url, '[0-9]+', '#') AS a, REGEXP_EXTRACT(url, '[a-z]+://[^/]+', 0) AS b FROM pages", "SELECT page_id, REGEXP_REPLACE(url, '[0-9]+', '#', 'g') AS a, REGEXP_EXTRACT(url, '[a-z]+://[^/]+') AS b FROM pages")
sql_operator("fs10_levenshtein", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, LEVENSHTEIN(a.n_name, b.n_name) AS d FROM nation a CROSS JOIN nation b", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, LEVENSHTEIN(a.n_name, b.n_name)::INT AS d FROM nation a CROSS JOIN nation b")
SOUND = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', '0123012-02245501262301-2020'"
sql_operator("fs11_soundex", "SELECT n_nationkey, SOUNDEX(n_name) AS s FROM nation", f"""SELECT n_nationkey, rpad(left(n_name, 1) || left(array_to_string(list_transform(list_filter(range(2, len(c) + 1), lambda i: c[i] <> '0' AND c[i] <> c[i - 1]), lambda i: c[i]), ''), 3), 4, '0') AS s
    FROM (SELECT n_nationkey, n_name, list_prepend(translate(left(n_name, 1), {SOUND}), string_split(replace(translate(regexp_replace(substring(n_name, 2), '[^A-Z]', ' ', 'g'), {SOUND}), '-', ''), '')) AS c FROM nation)""")
sql_operator("fs12_initcap", "SELECT p_partkey, INITCAP(p_name) AS a FROM part", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') AS a FROM part")
sql_operator("fs18_positions", "SELECT p_partkey, LOCATE('E', p_type, 4) AS a, SUBSTRING(p_name, -3) AS b, SUBSTRING(p_name, 0, 2) AS c, p_type ILIKE '%steel' AS d, p_name LIKE '%#%' ESCAPE '!' AS e FROM part", "SELECT p_partkey, CASE WHEN strpos(substring(p_type, 4), 'E') > 0 THEN strpos(substring(p_type, 4), 'E') + 3 ELSE 0 END::INT AS a, right(p_name, 3) AS b, left(p_name, 2) AS c, p_type ILIKE '%steel' AS d, contains(p_name, '#') AS e FROM part")
sql_operator("fs13_hashes", "SELECT n_nationkey, MD5(n_name) AS m, SHA1(n_name) AS s1, SHA2(n_name, 256) AS s2 FROM nation", "SELECT n_nationkey, MD5(n_name) AS m, SHA1(n_name) AS s1, SHA256(n_name) AS s2 FROM nation")
sql_operator("fs14_base64", "SELECT n_nationkey, BASE64(CAST(n_name AS BINARY)) AS e, CAST(UNBASE64(BASE64(CAST(n_name AS BINARY))) AS STRING) AS d FROM nation", "SELECT n_nationkey, BASE64(encode(n_name)) AS e, n_name AS d FROM nation")
sql_operator("fs15_uuid", "SELECT n_nationkey, UUID() RLIKE '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$' AS valid FROM nation", "SELECT n_nationkey, TRUE AS valid FROM nation")
MARKED = "substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-' || substring(m, 13, 4) || '-' || substring(m, 17, 4) || '-' || substring(m, 21)"


@operator("fs19_extensions", f"""SELECT n_nationkey, SHA256(n_name) AS hash, TRUE AS made, n_nationkey % 2 = 0 AS valid, '1' AS version, CASE WHEN n_nationkey % 3 > 0 THEN 100 % (n_nationkey % 3) END AS rest FROM nation""")
def extensions(spark, sf_dir):
    """Packages loaded by name: identifiers made and checked, digests, a remainder that is null for a divisor of 0."""
    for package in E.PACKAGES:
        E.load(spark, package)
    read_table(spark, sf_dir, "nation").selectExpr("*", "md5(n_name) AS m").createOrReplaceTempView("marked")
    return spark.sql(f"""SELECT n_nationkey, sha256(n_name) AS hash, is_valid_uuid(gen_random_uuid()) AND is_valid_uuid(uuid_generate_v1()) AS made,
        is_valid_uuid(CASE WHEN n_nationkey % 2 = 0 THEN {MARKED} ELSE m END) AS valid, substring(uuid_generate_v1(), 15, 1) AS version, CAST(safe_mod(100, n_nationkey % 3) AS INT) AS rest FROM marked""")


sql_operator("fs16_substring_index", "SELECT page_id, SUBSTRING_INDEX(url, '/', 3) AS host FROM pages", "SELECT page_id, array_to_string(string_split(url, '/')[1:3], '/') AS host FROM pages")


@operator("fs17_similarity", """WITH g AS (SELECT n_nationkey, list_transform(range(1, length(' ' || n_name || ' ') - 1), lambda i: substring(' ' || n_name || ' ', i::INT, 3)) AS x,
    list_transform(range(1, length(' ARGENTINA ') - 1), lambda i: substring(' ARGENTINA ', i::INT, 3)) AS y FROM nation)
    SELECT n_nationkey, ROUND(2.0 * list_sum(list_transform(list_distinct(x), lambda t: LEAST(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))) / (len(x) + len(y)), 6) AS s FROM g""")
def similarity(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.round(X.similarity(F.col("n_name"), F.lit("ARGENTINA")), 6).alias("s"))


@operator("ft7_snippet", """SELECT doc_id, CASE WHEN a > 1 THEN '...' ELSE '' END || substring(text, a, 60) || CASE WHEN a + 59 < length(text) THEN '...' ELSE '' END AS s
    FROM (SELECT doc_id, text, GREATEST(1, COALESCE(NULLIF(LEAST(CASE strpos(lower(text), 'tion') WHEN 0 THEN 1000000000 ELSE strpos(lower(text), 'tion') END, CASE strpos(lower(text), 'zz') WHEN 0 THEN 1000000000 ELSE strpos(lower(text), 'zz') END), 1000000000), 1) - 30)::INT AS a FROM documents)""")
def snippet(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), "+tion -zz", 60).alias("s"))


# Numbers
sql_operator("fm1_rounding", "SELECT c_custkey, ABS(c_acctbal) AS a, CAST(CEIL(c_acctbal) AS BIGINT) AS c, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, ROUND(c_acctbal, 1) AS r, CAST(SIGN(c_acctbal) AS INT) AS s FROM customer")


@operator("fm2_truncate", "SELECT c_custkey, ROUND(TRUNC(c_acctbal * 10) / 10, 4) AS t FROM customer")
def truncate(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.round(X.truncate(F.col("c_acctbal"), 1), 4).alias("t"))


sql_operator("fm3_mod_power", "SELECT p_partkey, MOD(p_partkey, 7) AS m, MOD(-p_partkey, 7) AS neg, CAST(POWER(p_size, 2) AS DOUBLE) AS p, ROUND(SQRT(p_retailprice), 6) AS s, ROUND(PI(), 10) AS pi FROM part")
sql_operator("fm4_greatest_least", "SELECT l_orderkey, l_linenumber, GREATEST(l_quantity, l_discount * 100, 5) AS g, LEAST(l_quantity, l_tax) AS l FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(GREATEST(l_quantity, l_discount * 100, 5) AS DOUBLE) AS g, LEAST(l_quantity, l_tax) AS l FROM lineitem")
sql_operator("fm5_transcendental", "SELECT p_partkey, ROUND(EXP(p_size / 50.0), 6) AS e, ROUND(LN(p_size), 6) AS l, ROUND(LOG10(p_size), 6) AS l10, ROUND(SIN(p_size), 6) AS s, ROUND(COS(p_size), 6) AS c, ROUND(TAN(p_size), 5) AS t, ROUND(RADIANS(p_size), 6) AS r, ROUND(DEGREES(p_size), 6) AS d FROM part")
sql_operator("fm6_factorial", "SELECT n_nationkey, FACTORIAL(CAST(n_nationkey % 15 AS INT)) AS f FROM nation", "SELECT n_nationkey, CAST(FACTORIAL(n_nationkey % 15) AS BIGINT) AS f FROM nation")

# Nulls, conditions, system
sql_operator("fn1_null_functions", "SELECT d.doc_id, IFNULL(l.quality, -1) AS a, COALESCE(l.toxic, l.quality, 9) AS b, NULLIF(d.lang, 'en') AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sql_operator("fn2_system", "SELECT CURRENT_USER() IS NOT NULL AS u, VERSION() IS NOT NULL AS v, CURRENT_DATABASE() IS NOT NULL AS d", "SELECT TRUE AS u, TRUE AS v, TRUE AS d")

# Dates
sql_operator("fd1_now", "SELECT NOW() IS NOT NULL AS n, CURRENT_DATE() = CAST(NOW() AS DATE) AS d, LENGTH(DATE_FORMAT(NOW(), 'HH:mm:ss')) AS t", "SELECT TRUE AS n, TRUE AS d, 8 AS t")
sql_operator("fd2_parts", "SELECT event_id, YEAR(ts) AS y, MONTH(ts) AS m, DAY(ts) AS d, HOUR(ts) AS h, MINUTE(ts) AS i, SECOND(ts) AS s FROM events", "SELECT event_id, YEAR(ts)::INT AS y, MONTH(ts)::INT AS m, DAY(ts)::INT AS d, HOUR(ts)::INT AS h, MINUTE(ts)::INT AS i, SECOND(ts)::INT AS s FROM events")
sql_operator("fd3_date_time", "SELECT event_id, CAST(ts AS DATE) AS d, DATE_FORMAT(ts, 'HH:mm:ss') AS t FROM events", "SELECT event_id, CAST(ts AS DATE) AS d, STRFTIME(ts, '%H:%M:%S') AS t FROM events")
sql_operator("fd4_datediff", "SELECT o_orderkey, DATEDIFF(o_orderdate, TIMESTAMP_NTZ '1995-01-01 00:00:00') AS n FROM orders", "SELECT o_orderkey, CAST(DATE_DIFF('day', TIMESTAMP '1995-01-01', o_orderdate) AS INT) AS n FROM orders")
sql_operator("fd5_date_add", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAYS AS d, o_orderdate + INTERVAL 2 MONTHS AS m, o_orderdate - INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 5 HOURS AS h FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS d, o_orderdate + INTERVAL 2 MONTH AS m, o_orderdate - INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 5 HOUR AS h FROM orders")


@operator("fd6_date_format", "SELECT event_id, STRFTIME(ts, '%Y/%m/%d at %H:%M:%S, %j %A %a %B %b %%') AS f FROM events")
def date_format(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", X.mysql_date_format(F.col("ts"), "%Y/%m/%d at %H:%i:%s, %j %W %a %M %b %%").alias("f"))


@operator("fd6_date_format_short", "SELECT event_id, STRFTIME(ts, '%-m.%-d.%y %I:%M %p') AS f FROM events")
def date_format_short(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", X.mysql_date_format(F.col("ts"), "%c.%e.%y %h:%i %p").alias("f"))


@operator("fd7_time_bucket", "SELECT event_id, TIME_BUCKET(INTERVAL '15 minutes', ts) AS q, TIME_BUCKET(INTERVAL '6 hours', ts) AS h, DATE_TRUNC('day', ts)::TIMESTAMP AS d, DATE_TRUNC('week', ts)::TIMESTAMP AS w, DATE_TRUNC('month', ts)::TIMESTAMP AS m FROM events")
def time_bucket(spark, sf_dir):
    ts = F.col("ts")
    return read_table(spark, sf_dir, "events").select("event_id", T.time_bucket(15, "minute", ts).alias("q"), T.time_bucket(6, "hour", ts).alias("h"), T.time_bucket(1, "day", ts).alias("d"), T.time_bucket(1, "week", ts).alias("w"), T.time_bucket(1, "month", ts).alias("m"))


# JSON
sql_operator("fj1_json_extract", "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")


@operator("fj2_json_facts", "SELECT event_id, json_type(props) AS t, json_valid(props) AS v, CAST(len(json_keys(props)) AS INT) AS n, array_to_string(json_keys(props), ',') AS ks, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'INTEGER' END AS kt FROM events")
def json_facts(spark, sf_dir):
    p = F.col("props")
    return read_table(spark, sf_dir, "events").select("event_id", J.json_type(p).alias("t"), J.json_valid(p).alias("v"), J.json_length(p).alias("n"), F.array_join(F.json_object_keys(p), ",").alias("ks"), J.json_type(F.get_json_object(p, "$.k")).alias("kt"))


@operator("fj3_json_set", """SELECT event_id, CAST(json_merge_patch(CAST(json_object('k', CAST(json_extract_string(props, '$.k') AS BIGINT)) AS JSON), '{"z":{"w":[1,"two",null],"y":true}}') AS VARCHAR) AS j,
    '{"k":"new"}' AS own, props AS same FROM (SELECT event_id, json_object('k', CAST(json_extract_string(props, '$.k') AS BIGINT))::VARCHAR AS props FROM events)""")
def json_set(spark, sf_dir):
    plain = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")))
    deep = J.json_set(J.json_set(J.json_set(plain, "$.z", '{"w":[1,2,null]}'), "$.z.w[1]", "two"), "$.z.y", "true")
    nowhere = J.json_set(J.json_set(plain, "$.a.b", "1"), "$.k[0]", "1")
    return read_table(spark, sf_dir, "events").select("event_id", deep.alias("j"), J.json_set(plain, "$.k", "new").alias("own"), nowhere.alias("same"))


@operator("fj4_json_contains", "SELECT event_id, COALESCE(json_extract_string(props, '$.k') = '5', FALSE) AS c FROM events")
def json_contains(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", J.json_contains(F.col("props"), "5", "$.k").alias("c"))


NESTED = "'{\"a\":{\"b\":[' || n_nationkey || ',{\"c\":\"' || n_name || '\"}]},\"n\":null}'"
sql_operator("fj5_nested_paths", f"SELECT n_nationkey, GET_JSON_OBJECT(j, '$.a.b[0]') AS x, GET_JSON_OBJECT(j, '$.a.b[1].c') AS y, GET_JSON_OBJECT(j, '$.a.z') AS z FROM (SELECT n_nationkey, {NESTED} AS j FROM nation)", f"SELECT n_nationkey, json_extract_string(j, '$.a.b[0]') AS x, json_extract_string(j, '$.a.b[1].c') AS y, json_extract_string(j, '$.a.z') AS z FROM (SELECT n_nationkey, {NESTED} AS j FROM nation)")

# Arrays
sql_operator("fa3_unnest_empty", "SELECT p_partkey, EXPLODE(FILTER(SPLIT(p_type, ' '), w -> CONTAINS(w, 'A'))) AS word FROM part", "SELECT p_partkey, UNNEST(list_filter(string_split(p_type, ' '), lambda w: contains(w, 'A'))) AS word FROM part")
sql_operator("fa1_array_functions", "SELECT p_partkey, SIZE(a) AS n, ARRAY_JOIN(ARRAY_APPEND(a, 'x'), ',') AS app, ARRAY_JOIN(ARRAY_REMOVE(a, 'STEEL'), ',') AS rem, ARRAY_CONTAINS(a, 'STEEL') AS has, TRY_ELEMENT_AT(a, 2) AS second, TRY_ELEMENT_AT(a, 9) AS ninth FROM (SELECT p_partkey, SPLIT(p_type, ' ') AS a FROM part)", "SELECT p_partkey, len(a)::INT AS n, array_to_string(list_append(a, 'x'), ',') AS app, array_to_string(list_filter(a, lambda x: x <> 'STEEL'), ',') AS rem, list_contains(a, 'STEEL') AS has, a[2] AS second, a[9] AS ninth FROM (SELECT p_partkey, string_split(p_type, ' ') AS a FROM part)")
sql_operator("fa2_unnest", "SELECT p_partkey, EXPLODE_OUTER(SPLIT(p_type, ' ')) AS word FROM part", "SELECT p_partkey, UNNEST(string_split(p_type, ' ')) AS word FROM part")

# Vectors
D64 = "CAST(embedding AS DOUBLE[])"


@operator("fv1_vector_functions", f"SELECT vec_id, len(embedding)::INT AS n, ROUND(SQRT(list_inner_product({D64}, {D64})), 5) AS norm, ROUND(list_inner_product({D64}, {D64}) * 2, 5) AS ip2, 0.0::DOUBLE AS self, 1.0::DOUBLE AS cos FROM embeddings")
def vector_functions(spark, sf_dir):
    e = F.col("embedding")
    return read_table(spark, sf_dir, "embeddings").select("vec_id", V.dims(e).alias("n"), F.round(V.norm(e), 5).alias("norm"), F.round(V.inner_product(e, V.add(e, e)), 5).alias("ip2"), F.round(V.norm(V.subtract(V.scale(e, 1.0), e)), 5).alias("self"), F.round(V.cosine_similarity(e, V.scale(e, 3.0)), 5).alias("cos"))


@operator("fv2_vector_arithmetic", "SELECT vec_id, UNNEST(range(len(embedding))) AS pos, UNNEST(list_transform(embedding, lambda x, i: ROUND(CAST(x AS DOUBLE) * 3 - CAST(embedding[len(embedding) + 1 - i] AS DOUBLE), 5))) AS x FROM embeddings")
def vector_arithmetic(spark, sf_dir):
    e = F.col("embedding")
    found = V.subtract(V.add(e, V.scale(e, 2.0)), F.reverse(e))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(found).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


# Places: keys of customers make points
POINTS = "SELECT c_custkey, (c_custkey * 7 % 160) - 80.0 AS lat, (c_custkey * 13 % 340) - 170.0 AS lng FROM customer"
HAVERSINE = "2 * 6371.0 * ASIN(LEAST(1.0, SQRT(POW(SIN(RADIANS(52.52 - lat) / 2), 2) + COS(RADIANS(lat)) * COS(RADIANS(52.52)) * POW(SIN(RADIANS(13.405 - lng) / 2), 2))))"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(k, ((k * 7) % 160 - 80.0).alias("lat"), ((k * 13) % 340 - 170.0).alias("lng"))


@operator("fg1_distance", f"SELECT c_custkey, ROUND({HAVERSINE}, 4) AS km, {HAVERSINE} <= 5000 AS near, ROUND(CAST(((DEGREES(ATAN2(SIN(RADIANS(13.405 - lng)) * COS(RADIANS(52.52)), COS(RADIANS(lat)) * SIN(RADIANS(52.52)) - SIN(RADIANS(lat)) * COS(RADIANS(52.52)) * COS(RADIANS(13.405 - lng)))) + 360) % 360) AS DOUBLE), 4) AS course FROM ({POINTS})")
def distances(spark, sf_dir):
    here = (F.col("lat"), F.col("lng"), F.lit(52.52), F.lit(13.405))
    return _points(spark, sf_dir).select("c_custkey", F.round(G.haversine_km(*here), 4).alias("km"), G.within_km(*here, 5000).alias("near"), F.round(G.bearing(*here), 4).alias("course"))


@operator("fg2_bbox", f"SELECT c_custkey, ROUND(lat - 100 / 6371.0 * 57.29577951308232, 6) AS low, ROUND(lng + 100 / 6371.0 * 57.29577951308232 / COS(RADIANS(lat)), 6) AS east, ROUND(lat + 100 / 6371.0 * 57.29577951308232, 6) AS high, ROUND(lng - 100 / 6371.0 * 57.29577951308232 / COS(RADIANS(lat)), 6) AS west FROM ({POINTS})")
def boxes(spark, sf_dir):
    box = G.bbox(F.col("lat"), F.col("lng"), 100.0)
    return _points(spark, sf_dir).select("c_custkey", F.round(box["min_lat"], 6).alias("low"), F.round(box["max_lng"], 6).alias("east"), F.round(box["max_lat"], 6).alias("high"), F.round(box["min_lng"], 6).alias("west"))


@operator("fg3_destination", f"SELECT c_custkey, ROUND(DEGREES(ASIN(SIN(RADIANS(lat)) * COS(500 / 6371.0) + COS(RADIANS(lat)) * SIN(500 / 6371.0) * COS(RADIANS(45)))), 6) AS lat2, ROUND(lng + DEGREES(ATAN2(SIN(RADIANS(45)) * SIN(500 / 6371.0) * COS(RADIANS(lat)), COS(500 / 6371.0) - SIN(RADIANS(lat)) * (SIN(RADIANS(lat)) * COS(500 / 6371.0) + COS(RADIANS(lat)) * SIN(500 / 6371.0) * COS(RADIANS(45))))), 6) AS lng2 FROM ({POINTS})")
def destinations(spark, sf_dir):
    there = G.destination(F.col("lat"), F.col("lng"), 500.0, 45.0)
    return _points(spark, sf_dir).select("c_custkey", F.round(there["lat"], 6).alias("lat2"), F.round(there["lng"], 6).alias("lng2"))


@operator("fg4_geohash", f"""SELECT c_custkey, array_to_string(list_transform(range(6), lambda d: substring('0123456789bcdefghjkmnpqrstuvwxyz', 1 + CAST(list_sum(list_transform(range(5), lambda i:
    (CASE WHEN (d * 5 + i) % 2 = 0 THEN x >> (14 - (d * 5 + i) // 2) ELSE y >> (14 - (d * 5 + i) // 2) END & 1) << (4 - i))) AS INT), 1)), '') AS hash, 'POINT(' || CAST(CAST(lat AS DOUBLE) AS VARCHAR) || ' ' || CAST(CAST(lng AS DOUBLE) AS VARCHAR) || ')' AS point
    FROM (SELECT c_custkey, lat, lng, CAST(FLOOR((lng + 180) / 360 * 32768) AS BIGINT) AS x, CAST(FLOOR((lat + 90) / 180 * 32768) AS BIGINT) AS y FROM ({POINTS}))""")
def geohashes(spark, sf_dir):
    return _points(spark, sf_dir).select("c_custkey", G.geohash(F.col("lat"), F.col("lng"), 6).alias("hash"), G.as_text(F.col("lat"), F.col("lng")).alias("point"))


# Documents
FOUND = {"=": "= 50", "!=": "<> 50", ">": "> 50", ">=": ">= 50", "<": "< 50", "<=": "<= 50"}
K = "json_extract_string(props, '$.k')"


@operator("do2_find", " UNION ALL ".join(f"SELECT '{op}' AS op, event_id AS _id FROM events WHERE CAST({K} AS DOUBLE) {how}" for op, how in FOUND.items()) + f" UNION ALL SELECT 'CONTAINS', event_id FROM events WHERE contains({K}, '5')")
def find(spark, sf_dir):
    docs = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.col("props").alias("json"))
    parts = [D.find(docs, "k", op, 50 if op != "CONTAINS" else "5").select(F.lit(op).alias("op"), "_id") for op in (*FOUND, "CONTAINS")]
    return reduce(DataFrame.unionByName, parts)


@operator("do3_replace_delete", """SELECT event_id AS _id, CASE WHEN json_extract_string(props, '$.k') = '7' THEN '{"_id":' || event_id || ', "n":[1]}' ELSE props END AS json FROM events WHERE NOT contains(json_extract_string(props, '$.k'), '9')""")
def replace_delete(spark, sf_dir):
    docs = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.col("props").alias("json"))
    return D.replace(D.delete(docs, D.condition("k", "CONTAINS", "9")), D.condition("k", "=", "7"), '{"n":[1]}')


@operator("do1_insert_documents", """SELECT n_nationkey AS _id, '{"_id":' || n_nationkey || ', "name":"' || n_name || '","place":{"region":' || n_regionkey || '}}' AS json FROM nation""")
def insert_documents(spark, sf_dir):
    place = F.struct(F.col("n_regionkey").alias("region"))
    docs = read_table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), place.alias("place"))).alias("json"))
    return D.with_ids(docs, "n_nationkey")
