"""Summaries, histograms, facets and quality rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(df: DataFrame, ok: Column, failed: Column) -> DataFrame:
    """total, success, failed, status: all, none or partial; failed without rows."""
    c = df.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(failed).alias("failed"))
    return c.withColumn("status", F.when((F.col("total") == 0) | (F.col("success") == 0), "failed").when(F.col("success") == F.col("total"), "success").otherwise("partial"))


def code_histogram(df: DataFrame, codes: Column) -> DataFrame:
    """How many rows have each code; a code counts once a row."""
    return df.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").count().withColumnRenamed("count", "n")


def facet_counts(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """facet, n in one pass over the rows."""
    one = df.agg(*(F.count_if(c).alias(k) for k, c in facets.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), F.col(k).alias("n")) for k in facets))).alias("x")).select("x.*")


def rank_sentences(df: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """(key, rank, sentence, score): a document's sentences by the summed frequency of their words within it, repeats counted, each sentence once, the earlier of equals first."""
    import re
    from collections import Counter

    end = re.compile(r"[.!?\n]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sentences = [s for s in (" ".join(x.split()) for x in end.split(t.as_py() or "")) if s]
                n = Counter(w for s in sentences for w in s.split())
                scored = dict.fromkeys(sentences)
                best = sorted(((-sum(n[w] for w in s.split()), i, s) for i, s in enumerate(scored)))[:most]
                rows += [(k, r, s, -x) for r, (x, _, s) in enumerate(best, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int64()))], names=[key, "rank", "sentence", "score"])

    return df.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(run, f"{key} long, rank int, sentence string, score long")


def quality(df: DataFrame, group: str, item: Column, measure: Column, least: float) -> DataFrame:
    """Counts, distinct items, items that occur again, average, least and greatest measure, and the warnings they give."""
    items = df.groupBy(F.col(group), F.md5(item.cast("string")).alias("_item")).agg(F.count("*").alias("n"), F.sum(measure).alias("s"), F.min(measure).alias("a"), F.max(measure).alias("z"))
    out = items.groupBy(group).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.bround(F.sum("s") / F.sum("n"), 2).alias("average"), F.min("a").alias("least"), F.max("z").alias("greatest"))
    warnings = F.array_compact(F.array(F.when(F.col("n_repeated") > 0, "duplicate-items"), F.when(F.col("average") < least, "items-too-short")))
    return out.withColumn("warnings", F.array_join(warnings, ","))


def archives(comments: DataFrame, note: str, comment: str) -> DataFrame:
    """(note, total, archive): a note's comments (a struct column that begins with their order) as the JSON of one file. A file holds all comments of its note, as its readers want."""
    rows = comments.groupBy(note).agg(F.array_sort(F.collect_list(comment)).alias("comments"), F.count("*").alias("total"))
    return rows.select(note, "total", F.to_json(F.struct(F.col(note).alias("noteId"), F.col("total").alias("totalComments"), "comments")).alias("archive"))


def batch_manifest(results: DataFrame, name: Column, failed: Column) -> DataFrame:
    """One row: the batch's name, and how many of its results are there, done and failed."""
    return results.agg(F.count("*").alias("total"), F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed")).select(name.alias("name"), "total", "done", "failed")


def failure_lines(results: DataFrame, failed: Column, order: list[str], line: Column) -> DataFrame:
    """The lines of a list of failures, with their order, to be written as text."""
    return results.where(failed).select(*order, line.alias("line"))


def favorites_report(results: DataFrame, ok: str, message: str) -> DataFrame:
    """(code, message, n, total, successes): each different warning with its count, beside the counts of the whole."""
    counts = results.agg(F.count("*").alias("total"), F.count_if(F.col(ok)).alias("successes"))
    warned = results.select(F.trim(F.coalesce(F.col(message), F.lit(""))).alias("message")).where("message <> ''").groupBy("message").agg(F.count("*").alias("n"))
    return warned.select(F.lit("favorites_warning").alias("code"), "message", "n").crossJoin(counts)  # one row of counts
