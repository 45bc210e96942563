"""Shuffle files of rows that are materialised go at once."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from sparkloom.llm.common import CLEANUP, cut


def test_shuffle_files_go(spark):
    local = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: set(local.rglob("shuffle_*.data"))
    before, setting = files(), spark.conf.get(CLEANUP, None)
    kept = spark.range(5000).repartition(4, "id").groupBy(F.col("id") % 7).count()
    once = cut(kept)
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert once.count() == kept.count() == 7 and cut(once.union(once)).count() == 14
