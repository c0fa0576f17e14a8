"""A cleaning pipeline over `documents`: language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages work on
all that the one before kept. Null or empty texts have no letter and go with the first stage. Rows without an id or with a repeated one are
documents like any other, and so are very long texts, which every stage works on whole. Of near-duplicates that tie, rows that are equal in every column
are alike and any one stays. An empty table gives no rows at any stage. Columns beside COLUMNS, whatever their names, are left behind by the first
stage. n_chars is the length of the text as it is after a stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import langid, packing, shingles, suffix_dedup
from gleaner.llm.common import free_shuffles, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects, as they have no letter to judge by, go; lang becomes the prediction."""
    docs = docs.select(COLUMNS)
    found = langid.identify(docs, langid.learn(docs), "doc_id", "text", "source", "n_chars")
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one row stays: that with the smallest id (null last), then by hash of the row; of equal rows any one.

    Candidates meet by SimHash fingerprints and Golay keys, and by minima of shingles where two bits do not reach; all are checked on their whole sets."""
    rows, labels = shingles.groups(docs.select(COLUMNS))
    keys = rows.select("rid", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "lang", "source", "n_chars"), "rid").alias("key"))
    chosen = keys.join(labels, "rid").groupBy("label").agg(F.min("key").alias("least")).select("least.rid")
    return rows.join(chosen, "rid", "left_semi").select(COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 51 words and strings of 400 bytes that also start elsewhere are removed; every document stays."""
    free_shuffles(spark)
    kept = suffix_dedup.remove_repeats(docs, "lang", "source", words=51)
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its place in a sequence of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_known_languages),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("best-fit packing", pack),
]

#: Fingerprints, induced sorting and public tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
