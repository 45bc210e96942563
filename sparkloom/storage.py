"""The folder for what queries write: the shared one that the session names, else a local one for tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only where driver and tasks are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="sparkloom-")
    return _local[app]


def materialised(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder, with no lineage behind them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)
