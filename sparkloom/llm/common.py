"""What the operators of this subpackage share: input tables, the shared folder, hashing."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; clusters ship it with the job."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, one process (tests) gets a local folder, set once and kept; a cluster, whose
    executors would each write to their own disk, gets an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, materialised in the shared folder, with no lineage behind them.

    The shuffle files behind them go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # read when a query is made, so it holds for this one alone
    try:
        whole = df.select("*")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return whole.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def slices(batches, rows: int = 256):
    """Arrow batches cut into short ones, so that Python objects exist for a few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(column) -> list[str]:
    """Strings of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


_held: dict = {}


def held(owner: str, key, make, most: int = 1):
    """What make() gives, kept in this Python worker: the last ``most`` keys of one operator.

    Workers outlive stages, so what another operator has left goes first.
    """
    if _held.get("owner") != owner:
        _held.clear()
        _held.update(owner=owner, kept={})
    kept = _held["kept"]
    if key not in kept:
        while len(kept) >= most:
            del kept[next(iter(kept))]
        kept[key] = make()
    return kept[key]


class BoundedCache(dict):
    """A dictionary that starts anew once its keys would exceed ``most`` entries or ``most_chars`` characters."""

    def __init__(self, most: int = 1_000_000, most_chars: int = 24_000_000):
        super().__init__()
        self.most, self.most_chars, self.chars = most, most_chars, 0

    def add(self, new: dict) -> None:
        """Takes new entries; what was known before goes if it would be too much."""
        size = sum(map(len, new))
        if len(self) + len(new) > self.most or self.chars + size > self.most_chars:
            self.clear()
            self.chars = 0
        self.update(new)
        self.chars += size

    def fill(self, needed: set, values) -> None:
        """After this every key of ``needed`` is there; ``values(keys)`` gives the values of the missing ones."""
        missing = [k for k in needed if k not in self]
        if not missing:
            return
        size = sum(map(len, missing))
        if len(self) + len(missing) > self.most or self.chars + size > self.most_chars:
            self.clear()
            missing = list(needed)
            self.chars, size = 0, sum(map(len, missing))
        self.update(zip(missing, values(missing), strict=True))
        self.chars += size


def fresh(name: str, taken) -> str:
    """A column name like ``name`` that is not among the taken ones, in whatever case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def with_text(docs: DataFrame, text_col: str, keep) -> tuple[DataFrame, int]:
    """The kept columns of docs and the text, and the text's place; a text that is kept is there once."""
    keep = list(keep)
    if text_col in keep:
        return docs.select(*keep), keep.index(text_col)
    return docs.select(*keep, F.col(text_col).alias(fresh("text_", keep))), len(keep)


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; the files stay outside this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunked(items, n: int):
    it = iter(items)
    while part := list(itertools.islice(it, n)):
        yield part
