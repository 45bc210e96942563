"""Full-text search: tokens, an inverted index, BM25 and boolean queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import materialised

# The stop words of the search dialect.
STOP_WORDS = ("der", "die", "das", "und", "oder", "in", "ist", "ein", "eine", "the", "a", "an", "of", "to", "and", "or", "is", "for", "with", "mit", "fuer", "fur", "von", "auf", "im", "zu")
K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and plus signs, without stop words."""
    words = F.split(F.lower(text), "[^a-z0-9+]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def query_tokens(query: str) -> list[str]:
    return sorted({w for w in re.split("[^a-z0-9+]+", query.lower()) if w and w not in STOP_WORDS})


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, doc_len)."""
    split = docs.select(id_col, tokens(F.col(text_col)).alias("_t")).withColumn("doc_len", F.size("_t"))
    return split.select(id_col, "doc_len", F.explode("_t").alias("term")).groupBy("term", id_col, "doc_len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of documents with a score above 0.

    A query names its terms, so one pass over the texts counts them per document inside the row, by lengths
    with and without a term, which is compiled code.  These few numbers a document are materialised, as
    both the totals of the corpus (a row) and the scores read them; nothing is shuffled.
    """
    terms = query_tokens(query)
    split = docs.select(id_col, tokens(F.col(text_col)).alias("_t"))
    times = [(F.size("_t") - F.size(F.array_remove("_t", t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    counted = materialised(split.select(id_col, F.greatest(F.size("_t"), F.lit(1)).alias("_len"), *times))
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))))
    both = counted.crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))).otherwise(0.0)
    return both.select(id_col, score.alias("score")).filter("score > 0")


def matches_any(text: Column, query: str) -> Column:
    """Natural mode: some term of the query is a token of the text."""
    return F.arrays_overlap(tokens(text), F.array(*(F.lit(t) for t in query_tokens(query))))


def matches_boolean(text: Column, query: str) -> Column:
    """Boolean mode by substrings: +required, -excluded, "a phrase", other words optional; one positive hit at least."""
    low = F.lower(text)
    must, never, some = [], [], []
    for sign, phrase, word in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query.lower()):
        {"+": must, "-": never, "": some}[sign].append(F.contains(low, F.lit(phrase or word)))
    ok = F.lit(True)
    for m in must:
        ok = ok & m
    for n in never:
        ok = ok & ~n
    hit = F.lit(bool(must))
    for s in some:
        hit = hit | s
    return ok & hit
