"""A corpus pipeline over the documents table: quality, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the docs of the next one.  All but the last return the columns of documents; the last returns each
document's tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import near_copies, op3_decontaminate, op5_byte_bpe, op6_quality, op8_pii
from sparkloom.llm.common import new_folder, reachable, table, vocabulary_path
from sparkloom.llm.files import remove_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return op6_quality.resample(docs, table(spark, sf_dir, "labels")).filter("_kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id.

    SimHash fingerprints propose pairs; documents are linked if the Jaccard similarity of their five-word
    shingles is 0.8 or more.
    """
    reachable(spark)
    return near_copies.keep_one(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = op3_decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return found.filter("n_hit = 0").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; n_chars follows the text."""
    return op8_pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives the text again."""
    import public_tokenizers

    reachable(spark)
    coded = op5_byte_bpe.encode(docs, vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokens", token_stage),
]

# Neither the classifier nor byte-pair encoding is expressible in SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again in the shared folder.

    A stage's rows go once the next one's are written; those that the last stage reads stay with the result.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline"), None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{folder}/{n}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove_folder(before)
            before = path
    return docs
