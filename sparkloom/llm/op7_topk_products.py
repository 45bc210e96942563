"""Exact top-k inner products by norm-bucketed retrieval.

Each component x becomes floor(256 * x).  Queries are written to files of ``block`` rows in the shared folder; neither
the driver nor a broadcast holds them.  The longest vectors of the table (``seeds`` rows, a fixed bound, the only
rows that are broadcast) are searched first and give every query a lower bound of its k-th score.

The other vectors are range-partitioned by falling length over the whole table.  A task takes its range in buckets of
``bucket`` rows and loads one file of queries after the other.  From a bucket's greatest length follows,
for each query, the least cosine that a vector there needs to reach the query's bound; above 1 the query skips the
bucket.  Where that cosine is at least ``coordinate_from`` the query prunes by coordinates: in its
largest coordinates a candidate's unit vector has to lie in the interval that the cosine leaves.
Elsewhere it prunes by length: only the front of the bucket is long enough, queries of like fronts together.
What is left is verified by integer products, and bounds rise as buckets are done.  A task returns k rows
a query at most, and the k best over tasks remain.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part.
Only vectors of equal dimension are compared; empty vectors all score 0.  A query's own rows are all
rows with its id; query rows that repeat with the same vector count once, with another vector each
gives its own result.  Equal scores go to the smaller id.  Scores beyond 64 bits saturate.  Other
columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, new_folder, table
from .files import AttemptFile, open_input, remove_folder

SLACK = 1e-9
LONG = 2**63 - 1
TOGETHER = 128
FOUND = "number long, query_id long, vec_id long, score long"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, which hold these integers exactly."""
    return np.floor(vectors.astype(np.float64) * 256.0)


@dataclass
class Block:
    """Queries of one dimension with their best so far; a bound never exceeds the true k-th score."""

    number: np.ndarray
    ids: np.ndarray
    q: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.norm = np.sqrt((self.q * self.q).sum(axis=1))
        self.focus = np.argsort(-np.abs(self.q), axis=1, kind="stable")[:, :3]
        self.bound = np.full(len(self.ids), -np.inf)
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.ids]  # (-score, id), sorted
        self.verified = 0  # products computed

    def products(self, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Exact integer products of some queries with the rows of p."""
        q = self.q[rows]
        self.verified += len(rows) * len(p)
        if p.shape[1] == 0:
            return np.zeros((len(rows), len(p)))
        if len(p) and float(np.abs(q).max()) * float(np.abs(p).max()) * p.shape[1] < 2**53:
            return q @ p.T
        return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in q], dtype=object).reshape(len(q), len(p))

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes candidates of one query that reach its bound."""
        keep = np.flatnonzero((scores >= self.bound[row]) & (ids != self.ids[row]))
        if not len(keep):
            return
        scores, ids = scores[keep], ids[keep]
        if len(keep) > self.k and scores.dtype != object:  # the k best of these alone
            first = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[first], ids[first]
        best = self.best[row] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        best.sort()
        self.best[row] = best[: self.k]
        if len(best) >= self.k:
            self.bound[row] = max(self.bound[row], -best[self.k - 1][0])

    def search(self, ids: np.ndarray, p: np.ndarray, bucket: int, coordinate_from: float) -> None:
        """All vectors of one dimension: buckets by falling length."""
        length = np.sqrt((p * p).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        ids, p, length = ids[order], p[order], length[order]
        for i in range(0, len(ids), bucket):
            self._bucket(ids[i : i + bucket], p[i : i + bucket], length[i : i + bucket], coordinate_from)

    def _bucket(self, ids: np.ndarray, p: np.ndarray, length: np.ndarray, coordinate_from: float) -> None:
        reach = self.norm * length[0] * (1 + SLACK) + SLACK
        active = np.flatnonzero(reach >= self.bound)
        if not len(active):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.norm[active] * length[0] > 0, self.bound[active] / (self.norm[active] * length[0]), -np.inf) - SLACK
        by_coordinate = active[cosine >= coordinate_from]
        by_length = active[cosine < coordinate_from]
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where((self.norm[by_length] > 0) & (self.bound[by_length] > 0), self.bound[by_length] / self.norm[by_length], 0.0) * (1 - SLACK)
            fronts = np.maximum(1, np.searchsorted(-length, -least, side="right"))
            order = np.argsort(fronts, kind="stable")
            for i in range(0, len(order), TOGETHER):  # queries that need about as much of the bucket
                own = by_length[order[i : i + TOGETHER]]
                front = int(fronts[order[i : i + TOGETHER]].max())
                scores = self.products(own, p[:front])
                hit = (scores >= self.bound[own][:, None]).any(axis=1)
                for n in np.flatnonzero(hit):
                    self.offer(int(own[n]), scores[n], ids[:front])
        if len(by_coordinate):
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = np.where(length[:, None] > 0, p / length[:, None], 0.0)
            need = dict(zip(active.tolist(), cosine.tolist(), strict=True))
            for row in by_coordinate.tolist():
                delta = np.arccos(min(1.0, need[row]))
                front = max(1, int(np.searchsorted(-length, -self.bound[row] / self.norm[row] * (1 - SLACK), side="right")))
                left = np.arange(front)
                for f in self.focus[row]:
                    angle = np.arccos(np.clip(self.q[row, f] / self.norm[row], -1.0, 1.0))
                    high, low = np.cos(max(0.0, angle - delta)) + SLACK, np.cos(min(np.pi, angle + delta)) - SLACK
                    column = unit[left, f]
                    left = left[(column >= low) & (column <= high)]
                if len(left):
                    self.offer(row, self.products(np.array([row]), p[left])[0], ids[left])


def by_dimension(ids: pa.Array, vectors: pa.Array):
    """(places, ids, scaled vectors) of an Arrow batch for each dimension."""
    offsets = vectors.offsets.to_numpy()
    size, flat, ids = np.diff(offsets), vectors.values.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        at = offsets[:-1][own][:, None] + np.arange(d)[None, :]
        yield own, ids[own].astype(np.int64), scaled(flat[at]) if d else np.zeros((len(own), 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return read.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)


def write_queries(asked: DataFrame, folder: str, block: int) -> DataFrame:
    """(path) of files of at most block queries: number, id, v.  Numbers tell query rows apart."""

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                file = AttemptFile(folder, "queries", ".arrow")
                whole = pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + part.num_rows)), part.column(0), part.column(1)], ["number", "id", "v"])
                with pa.ipc.new_stream(file.out, whole.schema) as out:
                    out.write_batch(whole)
                file.close()
                n += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([file.path])], ["path"])

    return asked.mapInArrow(run, "path string")


def read_blocks(path: str, k: int) -> list[Block]:
    """The queries of a file, a block for each dimension."""
    with open_input(path) as f, pa.ipc.open_stream(f) as batches:
        parts = [(b.column(0).to_numpy(), at, ids, q) for b in batches for at, ids, q in by_dimension(b.column(1), b.column(2))]
    return [Block(number[at], ids, q, k) for number, at, ids, q in parts]


def results(blocks: list[Block]) -> pa.RecordBatch:
    out = [(int(b.number[i]), int(b.ids[i]), other, max(-LONG - 1, min(LONG, -minus))) for b in blocks for i, best in enumerate(b.best) for minus, other in best]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["number", "query_id", "vec_id", "score"])


def search_seeds(paths: DataFrame, longest: list[tuple[int, list[float]]], k: int, bucket: int, coordinate_from: float) -> DataFrame:
    """(path, bounds, found): for each file of queries its bounds after the longest vectors, and what they gave."""
    shared = paths.sparkSession.sparkContext.broadcast(longest)

    def run(batches):
        seeds = pa.RecordBatch.from_arrays([pa.array([i for i, _ in shared.value], pa.int64()), pa.array([v for _, v in shared.value], pa.list_(pa.float64()))], ["id", "v"])
        for b in batches:
            for path in b.column(0).to_pylist():
                blocks = read_blocks(path, k)
                for _, ids, p in by_dimension(seeds.column(0), seeds.column(1)):
                    for own in blocks:
                        if own.q.shape[1] == p.shape[1]:
                            own.search(ids, p, bucket, coordinate_from)
                found = results(blocks)
                bounds = np.concatenate([np.zeros(0), *(own.bound for own in blocks)])
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([bounds.tobytes()], pa.binary()), pa.array([found.serialize().to_pybytes()], pa.binary())], ["path", "bounds", "found"])

    return paths.mapInArrow(run, "path string, bounds binary, found binary")


def search_ranges(rows: DataFrame, files: list[tuple[str, bytes]], k: int, bucket: int, coordinate_from: float) -> DataFrame:
    """What each range of rows by length has for the queries of all files; files have paths and bounds, 8 bytes a query."""
    folder = new_folder(rows.sparkSession, "bounds")
    listed = f"{folder}/bounds.arrow"
    file = AttemptFile(folder, "bounds", ".arrow")
    listed, whole = file.path, pa.table({"path": [p for p, _ in files], "bounds": pa.array([b for _, b in files], pa.binary())})
    with pa.ipc.new_stream(file.out, whole.schema) as out:
        out.write_table(whole)
    file.close()

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for _, ids, p in by_dimension(b.column(0), b.column(1)):
                small = p.astype(np.float32)
                held.setdefault(p.shape[1], []).append((ids, small if (small == p).all() else p))
        ranges = {d: (np.concatenate([i for i, _ in parts]), np.concatenate([p for _, p in parts])) for d, parts in held.items()}
        if not ranges:
            return
        order = {}
        for d, (ids, p) in ranges.items():
            length = np.concatenate([np.sqrt((p[i : i + 8192].astype(np.float64) ** 2).sum(axis=1)) for i in range(0, len(p), 8192)])
            order[d] = np.argsort(-length, kind="stable")
        with open_input(listed) as f, pa.ipc.open_stream(f) as known:
            pairs = [x for b in known for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        for path, bounds in pairs:
            blocks, at = read_blocks(path, k), 0
            for own in blocks:
                own.bound = np.frombuffer(bounds, np.float64)[at : at + len(own.ids)].copy()
                at += len(own.ids)
                d = own.q.shape[1]
                if d in ranges:
                    ids, p = ranges[d]
                    for i in range(0, len(ids), bucket):
                        part = order[d][i : i + bucket]
                        own.search(ids[part], p[part].astype(np.float64), bucket, coordinate_from)
            found = results(blocks)
            if found.num_rows:
                yield found

    return rows.mapInArrow(run, FOUND)


def top_products(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seeds: int = 512,
    block: int = 4096,
    bucket: int = 512,
    range_rows: int = 200_000,
    coordinate_from: float = 0.6,
    folder: str | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the largest integer inner products.

    The files in ``folder`` (a new one unless given) are read when the result is; delete them afterwards.
    """
    spark = vectors.sparkSession
    folder = folder or new_folder(spark, "queries")
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.pow(F.floor(x * 256).cast("double"), 2))
    rows = rows.withColumn("norm", norm)
    first = rows.orderBy(F.desc("norm"), "id").limit(seeds + 1).collect()
    last = (first[-1]["norm"], first[-1]["id"]) if len(first) > seeds else None
    # Rows that are like the last one in length and id stay with the others, so none is in both.
    longest = [(r["id"], list(r["v"])) for r in first if last is None or (-r["norm"], r["id"]) < (-last[0], last[1])]
    searched = cut(search_seeds(cut(write_queries(asked, folder, block)).repartition(64), longest, k, bucket, coordinate_from))

    def unpack(batches):
        for b in batches:
            for x in b.column(0):
                yield pa.ipc.read_record_batch(x.as_buffer(), pa.schema([(n, pa.int64()) for n in ("number", "query_id", "vec_id", "score")]))

    found = searched.select("found").mapInArrow(unpack, FOUND)
    if last is not None:
        files = [(r["path"], bytes(r["bounds"])) for r in searched.select("path", "bounds").toLocalIterator()]
        rest = rows.filter((F.col("norm") < last[0]) | ((F.col("norm") == last[0]) & (F.col("id") >= last[1])))
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rest.count() // range_rows)
        by_length = rest.repartitionByRange(ranges, F.desc("norm"), F.xxhash64("id")).select("id", "v")
        found = found.unionByName(search_ranges(by_length, files, k, bucket, coordinate_from))
    rank = F.row_number().over(W.partitionBy("number", "query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, folder = table(spark, sf_dir, "embeddings"), new_folder(spark, "queries")
    out = cut(top_products(vectors, vectors.filter("vec_id % 50 = 0"), folder=folder))
    remove_folder(folder)
    return out


ORACLES = {
    "op7_topk_products": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
QUERIES = {"op7_topk_products": op7_topk_products}
