"""Structured Streaming: event-time windows, continuous aggregates, deduplication, change logs.

Sources and sinks are folders of files, checkpoints lie in a folder that the caller names; every query
runs as ``availableNow`` here and as long-lived with another trigger.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType


def stream_parquet(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None, files: int | None = None) -> DataFrame:
    """A stream of the files in a folder, the oldest first, ``files`` of them a micro-batch."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """df with a time column that watermarks accept, and the watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def windowed(df: DataFrame, window: Column, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(window.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "*").drop("w")


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs what is there now into a Parquet folder and reads it; modes other than append rewrite the folder."""
    spark = df.sparkSession
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def continuous_aggregate(events: DataFrame, time: str, width: str, delay: str, keys: list[str], aggregates: list[Column], out: str, checkpoint: str) -> DataFrame:
    """Tumbling windows kept up to date: a micro-batch appends the windows that it changed, and the last row of each counts.

    So a run costs what is new, not what there is; ``compact`` rewrites the folder when old rows have piled up.
    """
    counted = windowed(event_time(events, time, delay), F.window(time, width), keys, *aggregates)
    append = lambda batch, n: batch.withColumn("batch_", F.lit(n).cast("long")).write.mode("append").parquet(out)
    counted.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(append).start().awaitTermination()
    return latest(events.sparkSession.read.schema(f"{ddl(counted)}, batch_ long").parquet(out), ["window_start", "window_end", *keys])


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the row of the last micro-batch that had it."""
    values = [c for c in rows.columns if c not in (*keys, "batch_")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_").alias("last_"))
    return last.select(*keys, *(F.col("last_")[v].alias(v) for v in values))


def compact(spark: SparkSession, out: str, keys: list[str], to: str) -> str:
    """The last rows of a folder of changes as a new folder, which later runs may append to."""
    latest(spark.read.parquet(out), keys).withColumn("batch_", F.lit(-1).cast("long")).write.parquet(to)
    return to


def sessions(events: DataFrame, time: str, gap: str, delay: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Session windows by key, given out once the watermark is past their end; rows behind the watermark are dropped."""
    return windowed(event_time(events, time, delay), F.session_window(time, gap), keys, *aggregates)


def running(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, total, greatest) of all values of a key so far, kept as state: a row a key and micro-batch with news."""
    own = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    def step(key: tuple, batches, state):
        n, total, greatest = state.get if state.exists else (0, 0.0, float("-inf"))
        for b in batches:
            values = b[value].dropna()
            n, total = n + len(values), total + float(values.sum())
            greatest = max(greatest, float(values.max())) if len(values) else greatest
        state.update((n, total, greatest))
        yield pd.DataFrame([(*key, n, total, greatest)], columns=[*keys, "n", "total", "greatest"])

    state = "n long, total double, greatest double"
    return events.groupBy(*keys).applyInPandasWithState(step, f"{own}, {state}", state, "update", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    return event_time(events, time, delay).dropDuplicatesWithinWatermark(keys)


def for_each_batch(df: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls act with each micro-batch: a replication sink or a notification."""
    df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(act).start().awaitTermination()
