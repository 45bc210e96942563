"""Quality classifier by importance resampling with hashed n-gram models.

Two generative models are counted over hashed n-grams: the target model over labelled good documents,
the raw model over all documents.  N-grams are word unigrams, word bigrams and trigrams of word
shapes (letter case, digits, the marks themselves, and whether a word repeats the one before); each
family is a multinomial of its own.  The target model is smoothed towards the raw one by ``prior``
counts a bucket, so that what was hardly seen says nothing.  A document's log weight is the sum of
log p_target / p_raw over its n-grams.  Documents are drawn without replacement in proportion to
weight ** (1 / temperature) by Gumbel top-k: a key of log weight / temperature plus Gumbel noise that
hangs on id and seed alone, and the k largest keys are kept.  At temperature 1, the default, this is importance
resampling proper.  Unless k is given, it is the number of documents whose log weight reaches ``cut_at``.

Toxic documents are left out whatever their weight, as a few words drown in the sum over a long text: the
documents of toxic and of other labelled rows that have a word are counted, near copies once, and one word whose
share of toxic ones reaches ``toxic_pure``, and ``toxic_at`` when drawn towards the share of all rows by
``toxic_prior`` documents, decides.

The labelled sample is bounded by ``max_labelled`` rows (those of the smallest id hashes); the raw
counts, the weights and the k-th key cover every document.  The k-th key comes from histograms over
all keys, refined until a bin is short; no key table is gathered anywhere.  Only keys are written in the shared folder;
where more columns are kept than the id, rows are weighed again on their way out, which costs a third pass over the
texts but no copy of them.

Null texts count as empty; a text without words has log weight 0.  Rows with a null id share one
noise value.  Keys equal to the k-th are all kept.  Repeated rows repeat.  Without target rows all
weights are 0 and everything is kept.  Empty tables give empty results.  Other columns are kept, but those
called like a column of the result (_weight, _toxic, _key, _kept), which the result's own replace.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, cut, held, slices, table, texts_of, with_text

TOKEN = re.compile(r"\w+|[^\w\s]+")
FAMILIES = 3
OWN = ("_weight", "_toxic", "_key", "_kept")


def _shape(token: str) -> int:
    """A small number for the look of a token: marks by themselves, else case and digits."""
    if token.isdigit():
        return 1
    if token.islower():
        return 2
    if token.isupper():
        return 3 if len(token) > 1 else 4
    if token.istitle():
        return 4
    if token[0].isalpha():
        return 5
    return 16 + zlib.crc32(token.encode()) % 1000


def _facts(tokens: list[str]) -> list[int]:
    """Hash of the lower-case token and its shape, in one integer."""
    return [zlib.crc32(t.lower().encode()) << 16 | _shape(t) for t in tokens]


def facts_of(text: str) -> np.ndarray:
    """The hash and shape of each token of a text."""
    tokens = TOKEN.findall(text)
    known = held("quality", "tokens", lambda: BoundedCache(400_000, 8_000_000))
    known.fill(set(tokens), _facts)
    return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def ngrams(text: str, bits: int) -> np.ndarray:
    """Bucket numbers of a text's n-grams; family f has the buckets from f << bits on."""
    return buckets_of(facts_of(text), bits)


def buckets_of(facts: np.ndarray, bits: int) -> np.ndarray:
    if not len(facts):
        return np.zeros(0, dtype=np.int64)
    word, shape = facts >> np.uint64(16), facts & np.uint64(0xFFFF)
    again = np.zeros(len(word), dtype=np.uint64)
    again[1:] = word[1:] == word[:-1]
    look = shape * np.uint64(2) + again
    mix, mask = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << bits) - 1)
    high = np.uint64(64 - bits)
    families = [word * mix >> high, (word[:-1] * np.uint64(31) + word[1:]) * mix >> high]
    families.append(((look[:-2] * np.uint64(4099) + look[1:-1]) * np.uint64(4099) + look[2:]) * mix >> high)
    return np.concatenate([(f & mask).astype(np.int64) + (i << bits) for i, f in enumerate(families)])


def log_ratios(target: np.ndarray, raw: np.ndarray, bits: int, prior: float) -> np.ndarray:
    """log p_target / p_raw of each bucket, family by family; buckets that no document has get 0."""
    out = np.zeros(FAMILIES << bits)
    for i in range(FAMILIES):
        own = slice(i << bits, (i + 1) << bits)
        r, t = raw[own].astype(np.float64), target[own].astype(np.float64)
        if not r.sum() or not t.sum():
            continue
        expected = r / r.sum() * t.sum()
        out[own] = np.where(r > 0, np.log(np.maximum(t + prior, 1e-9) / np.maximum(expected + prior, 1e-9)), 0.0)
    return out


def weigh(text: str, ratios: np.ndarray, bits: int, toxic: np.ndarray) -> tuple[float, bool]:
    """Log weight of a text, and whether one of its words is toxic."""
    facts = facts_of(text)
    own = buckets_of(facts, bits)
    return (float(ratios[own].sum()) if len(own) else 0.0), bool(len(toxic)) and bool(np.isin(facts >> np.uint64(16), toxic).any())


def sketch_of(text: str) -> int:
    """The least hash of a text's five-word shingles, which near copies mostly share."""
    import xxhash

    words = text.encode().lower().split()
    shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return min(map(xxhash.xxh64_intdigest, shingles)) >> 1


def toxic_words(docs: DataFrame, labels: DataFrame, max_labelled: int, prior: float, at: float, pure: float, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Hashes of the words that toxic labelled documents have and others hardly do; max_labelled rows of each.

    Of documents that share a sketch one counts, as a group of copies is one piece of evidence.
    """
    classes = labels.filter(f"toxic is not null and `{id_col}` is not null").groupBy(F.col(id_col).alias("_label")).agg((F.max("toxic") == 1).alias("_toxic"))
    some = [classes.filter(c).orderBy(F.xxhash64("_label"), "_label").limit(max_labelled) for c in ("_toxic", "not _toxic")]
    sample = cut(some[0].unionByName(some[1]))
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_id") == F.col("_label")).select("_text", "_toxic")

    def run(batches):
        for b in slices(batches):
            texts = texts_of(b.column(0))
            words = [np.unique(facts_of(t) >> np.uint64(16)).astype(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([sketch_of(t) for t in texts], pa.int64()), b.column(1), pa.array(words, pa.list_(pa.int64()))], ["sketch", "toxic", "words"])

    rows = marked.mapInArrow(run, "sketch long, toxic boolean, words array<long>")
    single = cut(rows.groupBy("sketch", "toxic").agg(F.max("words").alias("words")))
    n, bad = single.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not bad:
        return np.zeros(0, dtype=np.uint64)
    found = single.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.count("*").alias("m"))
    chosen = found.filter(((F.col("t") + prior * bad / n) / (F.col("m") + prior) >= at) & (F.col("t") >= pure * F.col("m"))).select("word").collect()
    return np.sort(np.array([r["word"] for r in chosen], dtype=np.uint64))


class Weights:
    """The fitted models; ``ratios`` has a double a bucket and, with the toxic words, is all that is sent to the executors."""

    def __init__(self, ratios: np.ndarray, bits: int):
        self.ratios, self.bits, self.toxic = ratios, bits, np.zeros(0, dtype=np.uint64)

    @classmethod
    def fit(cls, docs: DataFrame, targets: DataFrame, bits: int = 14, prior: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> Weights:
        """Counts both models in one pass; targets holds the ids of the (bounded) target sample."""
        named = F.broadcast(targets.select(F.col(id_col).alias("_target")).filter("_target is not null").distinct())
        read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        marked = read.join(named, F.col("_id") == F.col("_target"), "left").select("_text", F.col("_target").isNotNull().alias("_good"))
        size = FAMILIES << bits

        def run(batches):
            counts = np.zeros((2, size), dtype=np.int64)
            for b in slices(batches):
                for good in (False, True):
                    own = [ngrams(t, bits) for t, g in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True) if g == good]
                    if own:
                        n = np.bincount(np.concatenate(own), minlength=size)
                        counts[0] += n
                        counts[1] += n if good else 0
            seen = np.flatnonzero(counts[0])
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), *(pa.array(c[seen], pa.int64()) for c in counts)], ["bucket", "raw", "target"])

        sums = marked.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        raw, target = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for r in sums.toLocalIterator():  # a row a bucket at most
            raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
        return cls(log_ratios(target, raw, bits, prior), bits)

    def score(self, docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
        """The kept columns of docs, the log weight of each row (_weight) and whether it has a toxic word (_toxic)."""
        shared, bits = docs.sparkSession.sparkContext.broadcast((self.ratios, self.toxic)), self.bits
        keep = tuple(c for c in keep if c.lower() not in OWN)
        sent, at = with_text(docs, text_col, keep)

        def run(batches):
            for b in slices(batches):
                ratios, toxic = shared.value
                found = [weigh(t, ratios, bits, toxic) for t in texts_of(b.column(at))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([w for w, _ in found], pa.float64()), pa.array([x for _, x in found], pa.bool_())], [*keep, "_weight", "_toxic"])

        fields = [docs.schema[c] for c in keep]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _weight double, _toxic boolean"
        return sent.mapInArrow(run, schema)


def gumbel_key(weight: Column, identity: Column, temperature: float, seed: int) -> Column:
    """log weight / temperature plus Gumbel noise from the id's hash."""
    uniform = (F.shiftrightunsigned(F.xxhash64(identity, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return weight / temperature - F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int, column: str, short: int = 20_000, bins: int = 2048) -> float:
    """The k-th largest value of a double column, from histograms whose bins are refined; -inf if there are no k."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k or k < 1:
        return float("-inf") if k >= 1 else float("inf")
    inside, above = n, 0
    while inside > short and high > low:
        step = (high - low) / bins
        if step == 0 or low + step == low:
            break
        own = keys.filter(F.col(column).between(low, high))
        bin_of = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).cast("int")
        found = {r["bin"]: (r["n"], r["low"], r["high"]) for r in own.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for b in sorted(found, reverse=True):
            count, first, last = found[b]
            if above + count >= k:
                inside, low, high = count, first, last
                break
            above += count
    if high == low:
        return low
    top = keys.filter(F.col(column).between(low, high)).orderBy(F.col(column).desc()).limit(min(k - above, inside)).agg(F.min(column)).first()
    return top[0]


def target_sample(labels: DataFrame, max_labelled: int, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents labelled good and not toxic: those of the smallest hashes, max_labelled at most."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(id_col).distinct()
    return good.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    cut_at: float = -3.0,
    temperature: float = 1.0,
    seed: int = 17,
    max_labelled: int = 20_000,
    bits: int = 14,
    prior: float = 20.0,
    toxic_prior: float = 8.0,
    toxic_at: float = 0.6,
    toxic_pure: float = 0.95,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """The kept columns of docs (all unless given) with _weight, _toxic, _key and _kept for every row; toxic rows are not drawn."""
    weights = Weights.fit(docs, target_sample(labels, max_labelled, id_col), bits, prior, id_col, text_col)
    weights.toxic = toxic_words(docs, labels, max_labelled, toxic_prior, toxic_at, toxic_pure, id_col, text_col)
    keyed = lambda kept: weights.score(docs, kept, text_col).withColumn("_key", gumbel_key(F.col("_weight"), F.col(id_col), temperature, seed))
    keys = cut(keyed((id_col,)))
    drawn = keys.filter("not _toxic")
    wanted = drawn.filter(F.col("_weight") >= cut_at).count() if k is None else k
    least = kth_largest(drawn, wanted, "_key")
    whole = keys if keep == (id_col,) else keyed(tuple(keep or docs.columns))
    return whole.withColumn("_kept", ~F.col("_toxic") & (F.col("_key") >= F.lit(least)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return found.select("doc_id", F.col("_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), F.col("_kept").alias("kept"))


QUERIES = {"op6_quality": op6_quality}
