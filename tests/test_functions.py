"""Known values of functions and operators on small literals."""

import datetime
import math

from pyspark.sql import functions as F

from sparkloom.functions import jsons, spatial, text, timeseries, vector
from sparkloom.operators import relational, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vectors(spark):
    a, b = vector.literal([1, 0, 0]), vector.literal([0, 0, 1])
    assert abs(one(spark, vector.l2_distance(a, b)) - math.sqrt(2)) < 1e-12
    assert one(spark, vector.cosine_distance(a, b)) == 1
    assert one(spark, vector.cosine_similarity(a, vector.literal([0, 0, 0]))) == 0


def test_geohash_and_distance(spark):
    assert one(spark, spatial.geohash(F.lit(57.64911), F.lit(10.40744), 11)) == "u4pruydqqvj"
    berlin, munich = (F.lit(52.52), F.lit(13.405)), (F.lit(48.1351), F.lit(11.582))
    assert abs(one(spark, spatial.haversine_km(*berlin, *munich)) - 504.4) < 1


def test_time_bucket(spark):
    ts = F.lit("2026-01-01 08:17:31").cast("timestamp_ntz")
    assert one(spark, timeseries.time_bucket(1, "HOUR", ts)) == datetime.datetime(2026, 1, 1, 8)
    assert one(spark, timeseries.time_bucket(1, "week", ts)) == datetime.datetime(2025, 12, 29)
    assert one(spark, timeseries.time_bucket(3, "month", ts)) == datetime.datetime(2026, 1, 1)


def test_text(spark):
    assert one(spark, text.similarity(F.lit("abc"), F.lit("abc"))) == 1
    assert one(spark, text.similarity(F.lit(""), F.lit(""))) == 0
    assert one(spark, text.truncate(F.lit(-1.29), 1)) == -1.2
    assert one(spark, text.mysql_date_format(F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"), "it's %d.%m.%Y 100%%")) == "it's 02.01.2026 100%"
    assert one(spark, F.md5(F.lit("hello"))) == "5d41402abc4b2a76b9719d911017c592"


def test_json(spark):
    got = [one(spark, jsons.json_type(F.lit(j))) for j in ('{"a":1}', "[1]", '"s"', "1", "1.5", "true", "null", "{")]
    assert got == ["OBJECT", "ARRAY", "STRING", "INTEGER", "DOUBLE", "BOOLEAN", "NULL", None]
    assert [one(spark, jsons.json_length(F.lit(j))) for j in ('{"a":1,"b":2}', "[1,2,3]", '"abcd"', "7")] == [2, 3, 4, 1]


def test_rollup_total(spark):
    df = spark.createDataFrame([("East", 100), ("East", 200), ("West", 150), ("West", 250), ("East", 50)], "region string, amount long")
    assert {tuple(r) for r in df.rollup("region").agg(F.sum("amount")).collect()} == {("East", 350), ("West", 400), (None, 750)}


def test_boolean_search(spark):
    df = spark.createDataFrame([(1, "Advanced SQL guide"), (2, "NoSQL guide"), (3, "basics")], "id int, t string")
    ids = lambda q: sorted(r.id for r in df.filter(search.matches_boolean(F.col("t"), q)).collect())
    assert ids("+sql -nosql") == [1] and ids("basics guide") == [1, 2, 3] and ids('"sql guide"') == [1, 2] and ids("-guide") == []


def test_as_of_over_slices(spark):
    day = lambda d, h=0: datetime.datetime(2026, 1, d, h)
    left = spark.createDataFrame([("a", day(1)), ("a", day(3, 5)), ("a", day(9)), ("b", day(2))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", day(2), 1), ("a", day(3, 5), 2)], "k string, s timestamp_ntz, v int")
    got = {(r.k, r.t): r.v for r in relational.as_of_join(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert got == {("a", day(1)): None, ("a", day(3, 5)): 2, ("a", day(9)): 2, ("b", day(2)): None}
