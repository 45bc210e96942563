"""Small files in whatever store Spark writes to, through its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()), place


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; FileExistsError if there is one, so that two writers cannot both make it."""
    store, place = _place(spark, path)
    if store.exists(place):
        raise FileExistsError(path)
    out = store.create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    store, place = _place(spark, path)
    source = store.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    store, place = _place(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    store, place = _place(spark, path)
    store.delete(place, True)
