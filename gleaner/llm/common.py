"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.tables import delete, hadoop_fs, new_path, shared_dir, written  # noqa: F401


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (with a column n) that have the highest n, `most` or so: of those that tie for the last places, a share by hash. Only how many rows have each n comes to the driver."""
    held, _ = written(counts, "counts")
    left, least, share = most, 0, 1.0
    for r in held.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).toLocalIterator():
        least, share = r["n"], min(1.0, left / r["rows"])
        left -= r["rows"]
        if left <= 0:
            break
    tied = F.pmod(F.xxhash64(*(c for c in held.columns if c != "n")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    return held.where((F.col("n") > least) | (F.col("n") == least) & tied)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the named columns; whatever else the table has is left behind here."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c) for c in more))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema; needs the driver's session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def per_batch(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Maps each Arrow batch, given as a dict of lists, to a dict of lists or arrays in the order of schema."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def remainder(column: str, m: int):
    """crc32 of the id as decimal text, modulo m: the fold of a document. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(m))
