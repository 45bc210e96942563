"""Sources, sinks, catalogs, updates and streams, each run through files and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.aggregates import user_aggregate
from sparkloom.operators.ranks import Cursor
from sparkloom.registry import operator, sql_operator
from sparkloom.session import read_table, register_views
from sparkloom.sources import tables as S
from sparkloom.sources.catalogs import Catalog
from sparkloom.sources.security import Policy, SecuredTable
from sparkloom.sources.snapshots import Constraints, SnapshotTable, diff, signal_if
from sparkloom.storage import work_folder
from sparkloom.streaming import windows as St


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


NATION = "n_nationkey int, n_name string, n_regionkey int"


@operator("sc10_csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path = S.export_csv(read_table(spark, sf_dir, "nation"), _folder(spark, "csv"), ";")
    return S.load_csv(spark, path, NATION)


@operator("sc12_copy_binary", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def copy_binary(spark, sf_dir):
    return spark.read.parquet(S.copy_to(read_table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name"), _folder(spark, "copy"), "binary"))


@operator("sc13_foreign_csv", "SELECT n_name, n_regionkey, CAST(NULL AS DOUBLE) AS missing FROM nation")
def foreign_csv(spark, sf_dir):
    path = S.export_csv(read_table(spark, sf_dir, "nation"), _folder(spark, "foreign"))
    return S.foreign_csv(spark, path, {"n_name": "string", "n_regionkey": "int", "missing": "double"})


@operator("sc14_foreign_json_array", "SELECT r_regionkey, r_name FROM region")
def foreign_json_array(spark, sf_dir):
    """All objects in one array, as a web service gives them."""
    path = _folder(spark, "array")
    one = read_table(spark, sf_dir, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))
    one.write.text(path)
    return S.foreign_json(spark, path, "r_regionkey int, r_name string", array=True)


@operator("sc12_copy_csv", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def copy_csv(spark, sf_dir):
    """COPY (SELECT ...) TO with a delimiter and a header, and COPY FROM into a table."""
    rows = read_table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name")
    path = S.copy_to(rows, _folder(spark, "copy"), "csv", delimiter="|", header=True)
    table = SnapshotTable(spark, _folder(spark, "dml"), "supplier", "s_suppkey int, s_name string")
    table.insert(S.load_csv(spark, path, "s_suppkey int, s_name string", "|"))
    return table.read()


@operator("sc14_foreign_json", "SELECT r_regionkey, r_name FROM region")
def foreign_json(spark, sf_dir):
    path = _folder(spark, "json")
    read_table(spark, sf_dir, "region").write.json(path)
    return S.foreign_json(spark, path, "r_regionkey int, r_name string")


@operator("sc15_federated", "SELECT c_nationkey AS k, 'customer' AS origin FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def federated(spark, sf_dir):
    return S.federated(read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("origin")), read_table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_nationkey").alias("k")))


@operator("sc16_range_partitions", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'top' END AS part FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000")
def range_partitions(spark, sf_dir):
    part = S.range_partition(F.col("o_totalprice"), [("low", 100_000), ("mid", 300_000), ("top", None)])
    path = S.write_partitioned(read_table(spark, sf_dir, "orders"), _folder(spark, "parts"), part)
    return spark.read.parquet(path).filter("part = 'mid'").select("o_orderkey", "part")


@operator("sc16_written_partitions", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'light' END AS part, 'p' || (c_custkey % 4) AS h FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 4 = 1")
def written_partitions(spark, sf_dir):
    """LIST, and HASH below it, as folders: the filters read one folder of eight."""
    others = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
    rows = read_table(spark, sf_dir, "customer").withColumn("h", S.hash_partition(F.col("c_custkey"), 4)).withColumn("part", S.list_partition(F.col("c_mktsegment"), {"heavy": ["BUILDING", "MACHINERY"], "light": others}))
    path = _folder(spark, "parts")
    rows.repartition("part", "h").write.partitionBy("part", "h").parquet(path)
    return spark.read.parquet(path).filter("part = 'heavy' AND h = 'p1'").select("c_custkey", "part", "h")


@operator("sc16_list_hash_partitions", "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'light' END AS l, 'p' || (c_custkey % 4) AS h, COUNT(*) AS n FROM customer GROUP BY 1, 2")
def list_hash(spark, sf_dir):
    others = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
    l = S.list_partition(F.col("c_mktsegment"), {"heavy": ["BUILDING", "MACHINERY"], "light": others})  # noqa: E741
    return read_table(spark, sf_dir, "customer").groupBy(l.alias("l"), S.hash_partition(F.col("c_custkey"), 4).alias("h")).agg(F.count("*").alias("n"))


@operator("sc17_view", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def view(spark, sf_dir):
    read_table(spark, sf_dir, "nation").filter("n_regionkey = 1").createOrReplaceTempView("v_region_one")
    return spark.sql("SELECT n_name FROM v_region_one")


@operator("sc17_materialized_view", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def materialized(spark, sf_dir):
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return S.materialized_view(spark, "mv_status", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", work_folder(spark))


LISTED = ("nation", "region", "orders", "events")


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    register_views(spark, sf_dir, LISTED)
    return Catalog(spark, keys={"nation": ["n_nationkey"]}, indexes=[("orders", "by_customer", "o_custkey", False)])


@operator("sc18_information_schema", "SELECT table_name, column_name, CAST(ordinal_position AS INT) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('nation', 'region')")
def information_schema(spark, sf_dir):
    found = _catalog(spark, sf_dir).information_schema("columns").filter(F.col("TABLE_NAME").isin("nation", "region"))
    return found.select(F.col("TABLE_NAME").alias("table_name"), F.col("COLUMN_NAME").alias("column_name"), F.col("ORDINAL_POSITION").alias("ordinal_position"))


@operator("sc18_table_rows", "SELECT 'nation' AS t, COUNT(*) AS n FROM nation UNION ALL SELECT 'region', COUNT(*) FROM region UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'events', COUNT(*) FROM events")
def table_rows(spark, sf_dir):
    return _catalog(spark, sf_dir).information_schema("tables").filter(F.col("TABLE_NAME").isin(*LISTED)).select(F.col("TABLE_NAME").alias("t"), F.col("TABLE_ROWS").alias("n"))


@operator("sc19_pg_catalog", "SELECT table_name AS relname, column_name AS attname, CAST(ordinal_position AS INT) AS attnum, table_name IN ('nation', 'orders') AS indexed FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'orders', 'events')")
def pg_catalog(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    tables = catalog.pg_catalog("pg_tables").filter(F.col("tablename").isin(*LISTED))
    joined = catalog.pg_catalog("pg_attribute").join(tables, F.col("attrelid") == F.col("tablename"))
    return joined.select(F.col("tablename").alias("relname"), "attname", "attnum", (F.col("hasindexes") == "t").alias("indexed"))


@operator("sc20_backup_restore", "SELECT * FROM region")
def backup_restore(spark, sf_dir):
    return S.restore(spark, S.backup({"region": read_table(spark, sf_dir, "region")}, _folder(spark, "backup")), ["region"])["region"]


CODECS = ("zstd", "lz4_raw", "gzip", "none")


@operator("sc21_compression", " UNION ALL ".join(f"SELECT '{c}' AS codec, COUNT(*) AS n, ROUND(SUM(s_acctbal), 2) AS total FROM supplier" for c in CODECS))
def compression(spark, sf_dir):
    """Runs and dictionaries are Parquet's encodings of columns, whatever compresses its pages."""
    suppliers, parts = read_table(spark, sf_dir, "supplier"), []
    for codec in CODECS:
        path = _folder(spark, codec)
        suppliers.write.option("compression", codec).parquet(path)
        parts.append(spark.read.parquet(path).agg(F.lit(codec).alias("codec"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total")))
    return S.federated(*parts)


def _nations(spark: SparkSession, sf_dir: str, constraints: Constraints | None = None) -> SnapshotTable:
    table = SnapshotTable(spark, _folder(spark, "dml"), "nation", NATION, constraints)
    table.insert(read_table(spark, sf_dir, "nation"))
    return table


@operator("m1_insert_select", "SELECT * FROM nation UNION ALL SELECT 100 + n_nationkey, n_name, NULL FROM nation WHERE n_regionkey = 0")
def insert_select(spark, sf_dir):
    table = _nations(spark, sf_dir)
    table.insert(read_table(spark, sf_dir, "nation").filter("n_regionkey = 0").select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name"))
    return table.read()


@operator("m2_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN UPPER(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NEW', 1")
def upsert(spark, sf_dir):
    table = _nations(spark, sf_dir, Constraints(primary_key=["n_nationkey"]))
    changed = read_table(spark, sf_dir, "nation").filter("n_nationkey < 5").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    table.upsert(changed.unionByName(spark.createDataFrame([(99, "NEW", 1)], NATION)), ["n_nationkey"])
    table.upsert(spark.createDataFrame([(99, "IGNORED", 2)], NATION), ["n_nationkey"], ignore=True)
    return table.read()


@operator("m3_update_delete", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 20 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey % 3 <> 0")
def update_delete(spark, sf_dir):
    table = _nations(spark, sf_dir)
    table.update("n_regionkey = 2", {"n_regionkey": "n_regionkey * 10"})
    table.delete("n_nationkey % 3 = 0")
    return table.read()


@operator("m5_savepoint_rollback", "SELECT * FROM nation")
def rollback(spark, sf_dir):
    table = _nations(spark, sf_dir)
    table.savepoint("before")
    table.truncate()
    table.rollback("before")
    return table.read()


@operator("m7_trigger", "SELECT n_nationkey, LOWER(n_name) AS n_name, n_regionkey FROM nation")
def trigger(spark, sf_dir):
    table = SnapshotTable(spark, _folder(spark, "dml"), "nation", NATION)
    table.on("before insert", lambda new: new.withColumn("n_name", F.lower("n_name")))
    table.insert(read_table(spark, sf_dir, "nation"))
    return table.read()


@operator("m9_prepared_statement", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def prepared(spark, sf_dir):
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_totalprice > ?", args=[7, 1000])


@operator("m10_cursor_fetch", """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n, COUNT(*) OVER () AS total FROM customer)
    SELECT 'next' AS how, c_custkey FROM r WHERE n <= 3 UNION ALL SELECT 'relative', c_custkey FROM r WHERE n = 13 UNION ALL SELECT 'prior', c_custkey FROM r WHERE n = 12
    UNION ALL SELECT 'absolute', c_custkey FROM r WHERE n = total - 4 UNION ALL SELECT 'last', c_custkey FROM r WHERE n = total UNION ALL SELECT 'first', c_custkey FROM r WHERE n = 1""")
def cursor_fetch(spark, sf_dir):
    cursor = Cursor(read_table(spark, sf_dir, "customer"), [F.col("c_acctbal"), F.col("c_custkey")])
    steps = {"next": cursor.next(3), "relative": cursor.relative(10), "prior": cursor.prior(), "absolute": cursor.absolute(-5), "last": cursor.last(), "first": cursor.first()}
    return S.federated(*(page.select(F.lit(how).alias("how"), "c_custkey") for how, page in steps.items()))


@operator("m10_cursor_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
def cursor_page(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").orderBy("c_custkey").offset(20).limit(10).select("c_custkey", "c_name")


@operator("m8_sql_script", "SELECT CAST(55 AS INT) AS total")
def script(spark, sf_dir):
    return spark.sql("BEGIN DECLARE i INT = 0; DECLARE total INT = 0; WHILE i < 10 DO SET i = i + 1; SET total = total + i; END WHILE; SELECT total AS total; END")


@operator("m8_procedure", "SELECT n_nationkey, n_regionkey * 10 AS v FROM nation WHERE n_regionkey BETWEEN 1 AND 3 UNION ALL SELECT -1, -1")
def procedure(spark, sf_dir):
    """A loop over a query's rows with LEAVE and ITERATE, and a handler that goes on after an error."""
    register_views(spark, sf_dir, ("nation", "region"))
    return spark.sql("""BEGIN
        DECLARE wanted STRING = '';
        DECLARE failed INT = 0;
        keys: FOR r AS SELECT r_regionkey FROM region ORDER BY r_regionkey DO
            IF r.r_regionkey = 0 THEN ITERATE keys; END IF;
            IF r.r_regionkey > 3 THEN LEAVE keys; END IF;
            SET wanted = wanted || ',' || CAST(r.r_regionkey AS STRING);
        END FOR keys;
        BEGIN
            DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SET failed = -1; END;
            SET failed = 1 / 0;
        END;
        SELECT n_nationkey, n_regionkey * 10 AS v FROM nation WHERE array_contains(split(wanted, ','), CAST(n_regionkey AS STRING)) UNION ALL SELECT failed, failed;
    END""")


@operator("u1_sql_function", "SELECT p_partkey, ROUND(p_retailprice * 1.19, 7) AS gross FROM part")
def sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gross_price(x DOUBLE) RETURNS DOUBLE RETURN ROUND(x * 1.19, 7)")
    read_table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, gross_price(p_retailprice) AS gross FROM part")


@operator("st1_change_log", "SELECT 'U' AS op, n_nationkey AS k, UPPER(n_name) || '!' AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'D', n_nationkey, NULL FROM nation WHERE n_regionkey = 2")
def change_log(spark, sf_dir):
    """What was logged after the first sequence numbers, those of the rows inserted at first."""
    table = SnapshotTable(spark, _folder(spark, "dml"), "nation", NATION, Constraints(primary_key=["n_nationkey"]))
    table.enable_cdc()
    table.insert(read_table(spark, sf_dir, "nation"))
    seen = table.change_log().agg(F.max("seq")).first()[0]
    table.update("n_regionkey = 1", {"n_name": "UPPER(n_name) || '!'"})
    table.delete("n_regionkey = 2")
    found = table.change_log(after=seen)
    key = F.get_json_object(F.coalesce("new_data", "old_data"), "$.n_nationkey").cast("int")
    return found.select("op", key.alias("k"), F.get_json_object("new_data", "$.n_name").alias("name"))


@operator("m3_returning", "SELECT 'updated' AS what, n_nationkey, n_regionkey + 10 AS r FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'deleted', n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 3")
def update_returning(spark, sf_dir):
    table = _nations(spark, sf_dir)
    changed, gone = table.update("n_regionkey = 1", {"n_regionkey": "n_regionkey + 10"}), table.delete("n_regionkey = 3")
    show = lambda df, what: df.select(F.lit(what).alias("what"), "n_nationkey", F.col("n_regionkey").alias("r"))
    return S.federated(show(changed, "updated"), show(gone, "deleted"))


@operator("m5_transaction", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 4")
def transaction(spark, sf_dir):
    """A transaction that fails midway leaves nothing, one that ends counts, and a table opened anew is where it was."""
    folder = _folder(spark, "dml")
    table = SnapshotTable(spark, folder, "nation", NATION, Constraints(checks={"region": "n_regionkey >= 0"}))
    table.insert(read_table(spark, sf_dir, "nation"))
    try:
        with table.transaction():
            table.delete("n_regionkey = 1")
            table.update("true", {"n_regionkey": "-1"})
    except ValueError:
        pass
    with table.transaction():
        table.delete("n_regionkey = 4")
    return SnapshotTable(spark, folder, "nation", NATION).read()


@operator("st1_cdc_diff", "SELECT CASE WHEN n_nationkey < 3 THEN 'D' ELSE 'U' END AS op, n_nationkey FROM nation WHERE n_nationkey < 3 OR n_regionkey = 2 UNION ALL SELECT 'I', 500")
def cdc(spark, sf_dir):
    old = read_table(spark, sf_dir, "nation")
    kept = old.filter("n_nationkey >= 3").withColumn("n_name", F.when(F.col("n_regionkey") == 2, F.lower("n_name")).otherwise(F.col("n_name")))
    new = kept.unionByName(spark.createDataFrame([(500, "NEW", 1)], NATION))
    return diff(old, new, ["n_nationkey"]).select("op", "n_nationkey")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.stream_parquet(spark, sf_dir, read_table(spark, sf_dir, "events").schema, "events.parquet")


@operator("st4_continuous_aggregate", "SELECT DATE_TRUNC('day', ts)::TIMESTAMP AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def continuous(spark, sf_dir):
    out = St.continuous_aggregate(_events(spark, sf_dir), "ts", "1 day", "1 hour", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")], _folder(spark, "agg"), _folder(spark, "state"))
    return out.select("window_start", "event_type", "n", F.round("total", 2).alias("total"))


@operator("st8_sliding_window", "SELECT w AS window_start, COUNT(*) AS n FROM (SELECT UNNEST([TIME_BUCKET(INTERVAL '30 minutes', ts), TIME_BUCKET(INTERVAL '30 minutes', ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
def sliding(spark, sf_dir):
    counted = St.windowed(St.event_time(_events(spark, sf_dir), "ts", "1 hour"), F.window("ts", "1 hour", "30 minutes"), [], F.count("*").alias("n"))
    return St.run_to_parquet(counted, _folder(spark, "slide"), _folder(spark, "state"), "complete").select("window_start", "n")


@operator("st8_deduplicate", "SELECT event_id, user_id FROM events")
def deduplicate(spark, sf_dir):
    """Every event comes three times, in two files."""
    events, folder = read_table(spark, sf_dir, "events"), _folder(spark, "thrice")
    events.unionByName(events).write.parquet(f"{folder}/events.parquet")
    events.write.mode("append").parquet(f"{folder}/events.parquet")
    thrice = St.stream_parquet(spark, f"{folder}/events.parquet", events.schema)
    once = St.deduplicated(thrice, "ts", "1 hour", ["event_id"]).select("event_id", "user_id")
    return St.run_to_parquet(once, _folder(spark, "dedup"), _folder(spark, "state"))


@operator("st2_replication_batches", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def replicate(spark, sf_dir):
    out = _folder(spark, "replica")
    St.for_each_batch(_events(spark, sf_dir), lambda batch, n: batch.write.mode("append").parquet(out), _folder(spark, "state"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


sql_operator("st7_tumbling_window", "SELECT window(ts, '1 hour').start AS bucket, COUNT(*) AS n FROM events GROUP BY window(ts, '1 hour')", "SELECT TIME_BUCKET(INTERVAL '1 hour', ts) AS bucket, COUNT(*) AS n FROM events GROUP BY 1")


@operator("sc11_into_outfile", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 2")
def into_outfile(spark, sf_dir):
    path = S.export_csv(read_table(spark, sf_dir, "nation").filter("n_regionkey > 2").select("n_name", "n_regionkey"), _folder(spark, "outfile"), "|", header=False)
    return S.load_csv(spark, path, "n_name string, n_regionkey int", header=False)


@operator("sc4_sorted_index", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def sorted_index(spark, sf_dir):
    """An index in Parquet terms: rows clustered and sorted by the key, so that row groups are skipped by their bounds."""
    path = _folder(spark, "index")
    read_table(spark, sf_dir, "orders").repartitionByRange("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey").write.parquet(path)
    return spark.read.parquet(path).filter(F.col("o_custkey").between(10, 20)).select("o_orderkey", "o_custkey")


@operator("m1_returning", "SELECT n_nationkey + 200 AS n_nationkey, n_name, 9 AS n_regionkey FROM nation WHERE n_regionkey = 3")
def returning(spark, sf_dir):
    table = SnapshotTable(spark, _folder(spark, "dml"), "nation", NATION, Constraints(defaults={"n_regionkey": "9"}))
    new = read_table(spark, sf_dir, "nation").filter("n_regionkey = 3").select((F.col("n_nationkey") + 200).alias("n_nationkey"), "n_name")
    return table.insert(new)


@operator("m4_foreign_key_cascade", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
def cascade(spark, sf_dir):
    regions = SnapshotTable(spark, _folder(spark, "dml"), "region", "r_regionkey int, r_name string", Constraints(primary_key=["r_regionkey"]))
    regions.insert(read_table(spark, sf_dir, "region"))
    nations = _nations(spark, sf_dir, Constraints(foreign_keys=[("n_regionkey", regions, "r_regionkey")]))
    regions.delete("r_regionkey = 2")
    nations.cascade_from(regions, "n_regionkey", "r_regionkey")
    return nations.read()


@operator("m6_vacuum", "SELECT 2 AS gone, COUNT(*) AS n FROM nation")
def vacuum(spark, sf_dir):
    table = _nations(spark, sf_dir)
    table.update("true", {"n_name": "n_name"})
    gone = table.vacuum()
    return table.read().agg(F.lit(gone).alias("gone"), F.count("*").alias("n"))


@operator("m11_alter_table", "SELECT n_nationkey, n_name AS label, CAST(NULL AS DOUBLE) AS area FROM nation")
def alter(spark, sf_dir):
    table = _nations(spark, sf_dir)
    table.alter(add={"area": "double"}, drop=["n_regionkey"], rename={"n_name": "label"})
    return table.read()


@operator("m7_trigger_audit", "SELECT 'I' AS op, n_nationkey AS k FROM nation UNION ALL SELECT 'U', n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'D', n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey > 9")
def trigger_audit(spark, sf_dir):
    """Triggers after each kind of change write to another table; one before deletes spares some rows, one before inserts may stop them."""
    folder = _folder(spark, "dml")
    table, audit = SnapshotTable(spark, folder, "nation", NATION), SnapshotTable(spark, folder, "audit", "op string, k int")
    for event in ("insert", "update", "delete"):
        table.on(f"after {event}", lambda rows, op=event[0].upper(): audit.insert(rows.select(F.lit(op).alias("op"), F.col("n_nationkey").alias("k"))))
    table.on("before delete", lambda gone: gone.filter("n_nationkey > 9"))
    table.on("before insert", signal_if("n_name IS NULL", "a nation needs a name"))
    table.insert(read_table(spark, sf_dir, "nation"))
    table.update("n_regionkey = 1", {"n_name": "lower(n_name)"})
    table.delete("n_regionkey = 2")
    return audit.read()


@operator("fi11_row_policies", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'F' ELSE o_orderstatus END AS status FROM orders WHERE o_custkey = 7 OR o_orderstatus <> 'P'")
def row_policies(spark, sf_dir):
    """User 7 meets its own orders and those that are not pending, and changes only the latter."""
    folder = _folder(spark, "dml")
    table = SnapshotTable(spark, folder, "orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    table.insert(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    own = Policy("own", "o_custkey = CAST(CURRENT_USER_ID() AS BIGINT) OR o_orderstatus <> 'P'", command="select")
    change = Policy("change", "o_orderstatus = 'O'", "o_orderstatus = 'F'", command="update")
    seen = SecuredTable(table, "7", [own, change], {"select", "update"})
    seen.update("o_totalprice > 300000", {"o_orderstatus": "'F'"})
    return seen.read().select("o_orderkey", F.col("o_orderstatus").alias("status"))


# The next two stand for functions that only Python has; a column expression would do for these bodies.
@operator("u2_vectorised_function", "SELECT p_partkey, ROUND(p_retailprice * 2 + 1, 4) AS y FROM part")
def vectorised(spark, sf_dir):
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return read_table(spark, sf_dir, "part").select("p_partkey", F.round(twice("p_retailprice"), 4).alias("y"))


@operator("u3_aggregate_function", "SELECT p_brand, ROUND(MAX(p_retailprice) - MIN(p_retailprice), 4) AS spread, ROUND(EXP(AVG(LN(p_retailprice))), 4) AS middle FROM part GROUP BY p_brand")
def aggregate_function(spark, sf_dir):
    """Spread and geometric mean as an aggregate of the user's own."""
    import numpy as np

    partial = lambda g: {"high": g.p_retailprice.max(), "low": g.p_retailprice.min(), "logs": np.log(g.p_retailprice).sum(), "n": len(g)}
    merge = lambda s: {"high": s.high.max(), "low": s.low.min(), "logs": s.logs.sum(), "n": s.n.sum()}
    finish = lambda s: {"spread": s["high"] - s["low"], "middle": float(np.exp(s["logs"] / s["n"]))}
    parts = read_table(spark, sf_dir, "part").select("p_brand", "p_retailprice")
    found = user_aggregate(parts, ["p_brand"], "high double, low double, logs double, n long", partial, merge, "spread double, middle double", finish)
    return found.select("p_brand", F.round("spread", 4).alias("spread"), F.round("middle", 4).alias("middle"))


@operator("u4_table_function", "SELECT n_nationkey, UNNEST(string_split(n_name, 'A')) AS part FROM nation")
def table_function(spark, sf_dir):
    from pyspark.sql.functions import udtf

    @udtf(returnType="part: string")
    class Parts:
        def eval(self, text: str):
            for part in text.split("A"):
                yield (part,)

    spark.udtf.register("parts_of", Parts)
    read_table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, part FROM nation, LATERAL parts_of(n_name)")


@operator("in4_explain")
def explain(spark, sf_dir):
    """The plan of a query by each mode of EXPLAIN, and that its filter reaches the scan."""
    register_views(spark, sf_dir, ("orders",))
    query = "SELECT o_orderkey FROM orders WHERE o_custkey = 7"
    plans = [spark.sql(f"EXPLAIN {mode} {query}").select(F.lit(mode).alias("mode"), "plan") for mode in ("", "EXTENDED", "FORMATTED", "COST", "CODEGEN")]
    return S.federated(*plans).withColumn("pushed", F.rlike("plan", F.lit(r"PushedFilters: \[[^\]]*EqualTo\(o_custkey,7\)")))


@operator("st6_scheduled_run", "SELECT COUNT(*) AS n FROM events")
def scheduled(spark, sf_dir):
    """An event that runs SQL over what has come in: each run of the trigger takes the new files once."""
    out, state = _folder(spark, "event"), _folder(spark, "state")
    for _ in range(2):
        St.for_each_batch(_events(spark, sf_dir), lambda batch, n: batch.select("event_id").write.mode("append").parquet(out), state)
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@operator("st8_session_window", """WITH g AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts - LAG(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, s.n""")
def session_windows(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@operator("st8_session_stream", """WITH g AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts - LAG(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, s.n""")
def session_stream(spark, sf_dir):
    """Sessions of a stream in files: all events, one far later, and the events again, which by then are too late."""
    events, folder = read_table(spark, sf_dir, "events"), _folder(spark, "late")
    far = events.limit(1).withColumns({"user_id": F.lit(-1).cast(events.schema["user_id"].dataType), "ts": F.lit("2100-01-01").cast(events.schema["ts"].dataType)})
    for part in (events, far, far, events.unionByName(far)):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = St.stream_parquet(spark, folder, events.schema, files=1)
    found = St.run_to_parquet(St.sessions(stream, "ts", "6 hours", "1 hour", ["user_id"], F.count("*").alias("n")), _folder(spark, "sessions"), _folder(spark, "state"))
    return found.select("user_id", F.col("window_start").alias("session_start"), "n")


@operator("st8_keyed_state", "SELECT user_id, COUNT(value) AS n, ROUND(SUM(value), 4) AS total, MAX(value) AS greatest FROM events GROUP BY user_id")
def keyed_state(spark, sf_dir):
    """State that runs on over micro-batches of one file each: each user's last row is the whole."""
    events, folder, out = read_table(spark, sf_dir, "events"), _folder(spark, "files"), _folder(spark, "running")
    events.repartition(3, "event_id").write.parquet(folder)
    stream = St.running(St.stream_parquet(spark, folder, events.schema, files=1), ["user_id"], "value")
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    stream.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", _folder(spark, "state")).foreachBatch(write).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("user_id").agg(F.max_by(F.struct("n", "total", "greatest"), "batch").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 4).alias("total"), "s.greatest")


@operator("st8_stream_stream_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR AND a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_join(spark, sf_dir):
    clicks = St.event_time(_events(spark, sf_dir).filter("event_type = 'click'"), "ts", "1 hour").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("ts").alias("ta"))
    bought = St.event_time(_events(spark, sf_dir).filter("event_type = 'purchase'"), "ts", "1 hour").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").alias("tb"))
    joined = clicks.join(bought, F.expr("ua = ub AND tb >= ta AND tb <= ta + INTERVAL 1 HOUR")).select("a", "b")
    return St.run_to_parquet(joined, _folder(spark, "joined"), _folder(spark, "state"))


@operator("g1_create_graph", "SELECT 1000 + n_regionkey AS src, n_nationkey AS dst, 'HAS' AS type FROM nation")
def create_graph(spark, sf_dir):
    edges = SnapshotTable(spark, _folder(spark, "graph"), "edges", "src int, dst int, type string")
    edges.insert(read_table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1000).alias("src"), F.col("n_nationkey").alias("dst"), F.lit("HAS").alias("type")))
    return edges.read()
