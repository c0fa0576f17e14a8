"""File names by content: a body keeps the name it once got, another body of the same name takes the next free number, over any number of batches.

The registry is a folder of batches with a row (base, digest, name) for each body. A batch that is stored again under its number
gives the same rows, and a batch whose bodies are known adds none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.notes import body_of
from gleaner.operators.naming import allocate, numbered_name
from gleaner.streaming.inbox import committed
from gleaner.tables import hadoop_fs

REGISTRY = "base string, digest string, name string"


def name_batch(batch: DataFrame, number: int, path: str, base: str, text: str, order: list[str]) -> DataFrame:
    """batch with `name`; the registry at path gets its new bodies. order must order the batch's rows, different for each."""
    spark = batch.sparkSession
    here = f"{path}/batch-{number:09d}"
    fs, p = hadoop_fs(spark, here)
    fs.delete(p, True)
    registry = committed(spark, path, REGISTRY)
    rows = batch.withColumn("_digest", F.sha2(body_of(text), 256))
    first = rows.groupBy(F.col(base).alias("base"), F.col("_digest").alias("digest")).agg(F.min(F.struct(*order)).alias("_first"))
    new = first.join(registry, ["base", "digest"], "left_anti")
    owned = registry.groupBy("base").agg(F.count("*").alias("_owned"))
    asked = new.join(owned, "base", "left").withColumn("_owned", F.coalesce("_owned", F.lit(0))).select("base", "digest", "_owned", *(F.col(f"_first.{c}").alias(f"_o{k}") for k, c in enumerate(order)))
    got, _ = allocate(asked, ["base"], [f"_o{k}" for k in range(len(order))], numbered_name("base"), F.col("_owned"), registry)
    got.select("base", "digest", "name").write.parquet(here)
    names = committed(spark, path, REGISTRY).select(F.col("base").alias(base), F.col("digest").alias("_digest"), "name")
    return rows.join(names, [base, "_digest"]).drop("_digest")
