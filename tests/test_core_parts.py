"""Policies, ranks, cursors, catalog tables, aggregates, packages, JSON updates, search and vectors at their edges."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import extensions, jsons, text, vector
from sparkloom.functions.aggregates import user_aggregate
from sparkloom.operators import documents, profile, ranks, relational, search
from sparkloom.sources.catalogs import INFORMATION, PG, Catalog
from sparkloom.sources.security import Denied, Policy, SecuredTable
from sparkloom.sources.snapshots import SnapshotTable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_policies(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), "notes", "id int, owner string")
    table.insert(spark.createDataFrame([(1, "ann"), (2, "bob"), (3, None), (4, "o'neil")], "id int, owner string"))
    ann = SecuredTable(table, "ann", [Policy("own", "owner = current_user_id()")])
    assert [r.id for r in ann.read().collect()] == [1]
    assert [r.id for r in SecuredTable(table, "o'neil", [Policy("own", "owner = CURRENT_USER")]).read().collect()] == [4]
    with pytest.raises(Denied):
        ann.insert(spark.createDataFrame([(5, "bob")], "id int, owner string"))
    with pytest.raises(Denied):
        ann.update("true", {"owner": "'bob'"})
    ann.insert(spark.createDataFrame([(5, "ann")], "id int, owner string"))
    ann.delete("id < 9")
    assert sorted(r.id for r in table.read().collect()) == [2, 3, 4] and not table.triggers
    with pytest.raises(Denied):
        SecuredTable(table, "bob", [], {"select"}).delete("true")
    assert SecuredTable(table, "bob", [Policy("w", "true", command="insert")]).read().count() == 0


def test_numbers_and_ranks(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(100)] + [(200, None)], "k int, v int").repartition(7)
    got = {r.k: (r.row_number, r.rank) for r in ranks.ranked(ranks.numbered(rows, [F.col("v"), F.col("k")]), [F.col("v"), F.col("k")], ["v"]).collect()}
    assert got[200] == (1, 1) and all(got[i] == (i + 2, i // 3 * 3 + 2) for i in range(100))
    assert sorted(r.tile for r in ranks.tiles(rows, 4, [F.col("k")]).collect()) == sorted(i * 4 // 101 + 1 for i in range(101))
    assert ranks.numbered(rows.limit(0), [F.col("k")]).count() == 0


def test_cursor(spark):
    cursor = ranks.Cursor(spark.range(10).repartition(4), [F.col("id")])
    ids = lambda page: [r.id for r in page.collect()]
    assert [ids(cursor.next(2)), ids(cursor.next()), ids(cursor.prior()), ids(cursor.absolute(-1)), ids(cursor.next()), ids(cursor.next())] == [[0, 1], [2], [1], [9], [], []]
    assert [ids(cursor.prior()), ids(cursor.relative(-4)), ids(cursor.first()), ids(cursor.prior()), ids(cursor.next(99)), ids(cursor.last()), ids(cursor.absolute(0))] == [[9], [5], [0], [], list(range(10)), [9], []]


def test_catalog_tables(spark):
    spark.range(3).selectExpr("id AS k", "'x' AS name").createOrReplaceTempView("cat_a")
    catalog = Catalog(spark, {"cat_a": ["k"]}, [("cat_a", "by_name", "name", False)], [("t", "INSERT", "cat_a", "AFTER", "...")], [("p", "PROCEDURE", "...")], [("cat_a", "p0", "HASH", "k % 2")], [("e", "SELECT 1", "1 day", "ENABLED")], [("ann", "cat_a", "SELECT")], {"cat_v": "SELECT 1"})
    for name in INFORMATION:
        assert catalog.information_schema(name).count() >= 1 or name == "views"
    for name in PG:
        assert catalog.pg_catalog(name).count() >= 1
    mine = catalog.information_schema("columns").filter("TABLE_NAME = 'cat_a'").orderBy("ORDINAL_POSITION").collect()
    assert [(r.COLUMN_NAME, r.COLUMN_KEY) for r in mine] == [("k", "PRI"), ("name", "")]
    assert catalog.information_schema("partitions").first().TABLE_ROWS == 3
    assert sorted(r.usename for r in catalog.pg_catalog("pg_user").collect()) == ["ann", "root"]
    spark.catalog.dropTempView("cat_a")


def test_user_aggregate(spark):
    rows = spark.createDataFrame([(i % 3, float(i)) for i in range(300)] + [(None, 5.0)], "k int, x double").repartition(5)
    found = user_aggregate(rows, ["k"], "total double, n long", lambda g: {"total": g.x.sum(), "n": len(g)}, lambda s: {"total": s.total.sum(), "n": s.n.sum()}, "mean double", lambda s: {"mean": s["total"] / s["n"]})
    assert {r.k: r.mean for r in found.collect()} == {0: 148.5, 1: 149.5, 2: 150.5, None: 5.0}


def test_packages(spark):
    assert "is_valid_uuid" in extensions.load(spark, "uuid") and "uuid" in extensions.loaded(spark)
    assert spark.sql("SELECT is_valid_uuid(uuid_generate_v1()) AND NOT is_valid_uuid('x') AND NOT is_valid_uuid(NULL)").first()[0]
    extensions.drop(spark, "uuid")
    assert "uuid" not in extensions.loaded(spark)


@pytest.mark.parametrize(("path", "value", "want"), [
    ("$.a.b[1]", "9", '{"a":{"b":[1,9]},"c":"x"}'), ("$.a.n", "null", '{"a":{"b":[1,2.5],"n":null},"c":"x"}'), ("$.c", "word", '{"a":{"b":[1,2.5]},"c":"word"}'),
    ("$.q.r", "1", '{"a":{"b":[1,2.5]},"c":"x"}'), ("$.a.b[7]", "1", '{"a":{"b":[1,2.5]},"c":"x"}'), ("$", "[true]", "[true]"),
])
def test_json_set(spark, path, value, want):
    assert one(spark, jsons.json_set(F.lit('{"c":"x","a":{"b":[1,2.5]}}'), path, value)) == want


def test_json_set_of_what_is_no_json(spark):
    assert one(spark, jsons.json_set(F.lit("no json"), "$.a", "1")) == "no json"
    assert one(spark, jsons.json_set(F.lit(None).cast("string"), "$.a", "1")) is None


def test_documents_keep_their_ids(spark):
    docs = spark.createDataFrame([(1, '{"a":1.50,"_id":9}'), (2, "{}"), (3, '{"a":{"b":"x"}}'), (4, "[1]"), (5, None)], "k int, json string")
    made = documents.with_ids(docs, "k")
    assert [r.json for r in made.orderBy("_id").collect()] == ['{"a":1.50,"_id":9}', '{"_id":2}', '{"_id":3, "a":{"b":"x"}}', "[1]", None]
    changed = documents.replace(made, documents.condition("a.b", "=", "x"), '{"z":1}')
    assert [r.json for r in changed.orderBy("_id").collect()][2] == '{"_id":3, "z":1}'


def test_snippets(spark):
    long = "x" * 50 + " needle " + "y" * 200
    assert one(spark, text.snippet(F.lit(long), "+needle", 40)) == "..." + long[21:61] + "..."
    assert one(spark, text.snippet(F.lit("short needle"), "other", 40)) == "short needle"


def test_stop_words_leave_no_tokens(spark):
    assert one(spark, F.array_join(search.tokens(F.lit("Oder im Haus, on the C++ table")), " ")) == "haus on c++ table"


def test_distances_of_unequal_vectors(spark):
    a, b = vector.literal([1.0, 0.0]), vector.literal([1.0])
    assert [one(spark, f(a, b)) for f in (vector.l2_distance, vector.inner_product_distance, vector.cosine_distance)] == [1e9, 1e9, 1.0]
    assert one(spark, vector.l2_distance(a, F.lit(None).cast("array<double>"))) is None


def test_profiles_and_ranges(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, s string")
    found = {r.column_name: (r.row_count, r.ndv, r.min_value) for r in profile.column_stats(rows, ["k", "s"]).collect()}
    assert found == {"k": (3, 2, "1"), "s": (3, 2, "a")} and profile.column_stats(rows, ["k"], exact=False).first().ndv == 2
    points = spark.createDataFrame([(float(i),) for i in range(-5, 60)], "p double")
    spans = spark.createDataFrame([(0.0, 1.0), (2.0, 50.0), (-4.5, 1e9), (7.0, 7.0), (9.0, 8.0)], "a double, b double")
    got = sorted((r.p, r.a) for r in relational.bucketed_range_join(points, spans, "p", "a", "b", 1.0).collect())
    assert got == sorted((float(p), a) for p in range(-5, 60) for a, b in [(0, 1), (2, 50), (-4.5, 1e9)] if a <= p < b)
    assert relational.bucketed_range_join(points, spans.limit(0), "p", "a", "b", 1.0).count() == 0


def test_crowded_ranges_come_in_blocks(spark):
    """All points lie in one bucket of all ranges, whose pairs are more than one task's share."""
    points = spark.range(3000).selectExpr("id AS p", "900 + (id % 100) * 1D AS v")
    spans = spark.range(300).selectExpr("id AS s", "id * 1D AS a", "id + 700D AS b").unionByName(spark.createDataFrame([(-1, 950.0, 950.5), (None, None, 1e9)], "s long, a double, b double"))
    joined = relational.bucketed_range_join(points, spans, "v", "a", "b", 10.0, 256, 32)
    want = sorted((p, s) for p in range(3000) for s, a, b in [(-1, 950, 950.5), *((s, s, s + 700) for s in range(300))] if a <= 900 + p % 100 < b)
    assert sorted((r.p, r.s) for r in joined.collect()) == want


def test_a_crowded_bucket_is_shared_by_tasks(spark):
    points = spark.range(0, 200_000, 1, 1).selectExpr("900 + id % 100 * 1D AS v")  # one small file, so to say
    joined = relational.bucketed_range_join(points, spark.range(20).selectExpr("id * 1D AS a", "id + 5000D AS b"), "v", "a", "b", 10.0)
    made = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 200_000 * 20 and max(made) < sum(made) / 2


def test_wide_ranges_are_not_broadcast(spark):
    joined = relational.bucketed_range_join(spark.range(50).selectExpr("id * 1D AS v"), spark.range(50).selectExpr("id * 1D AS a", "id + 9D AS b"), "v", "a", "b", 1.0)
    assert joined.count() == sum(a <= v < a + 9 for v in range(50) for a in range(50))
    joined.collect()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_estimates_are_near(spark):
    """What no SQL can repeat: a sample's size and an estimated number of distinct values, within five standard errors."""
    from sparkloom.registry import all_queries

    sf = "/root/testdata/sf0.01"
    orders, lines = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    n, sampled = orders.count(), all_queries()["sc9_tablesample"](spark, sf)
    assert abs(sampled.count() - n / 10) <= 5 * (n * 0.09) ** 0.5
    assert sampled.distinct().join(orders, "o_orderkey", "left_semi").count() == sampled.count()
    true = lines.select("l_partkey").distinct().count()
    assert abs(all_queries()["a17_approx_distinct"](spark, sf).first().n - true) <= 5 * 0.05 * true


def test_filters_reach_the_scan(spark):
    from sparkloom.registry import all_queries

    plans = {r.mode: r.pushed for r in all_queries()["in4_explain"](spark, "/root/testdata/sf0.001").collect()}
    assert len(plans) == 5 and plans["FORMATTED"]
