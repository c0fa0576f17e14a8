"""Incremental collection into a table of items, each link once over the whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.order import new_rows


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of committed batches. A batch is a folder; one that was cut off is written again under the same name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [d for d in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS"))]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


stored = committed


def append_batch(batch: DataFrame, name: str, path: str, keys: list[str], order: list[str]) -> None:
    """Stores a batch's first row of each key that no other batch has. Storing a batch again gives the same rows, so a retried batch is exact."""
    spark = batch.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    new_rows(batch, committed(spark, path, batch.schema), keys, order).write.parquet(f"{path}/{name}")


def collect_available(source: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Takes in all that a streaming source has now. No watermark: late rows are as good as others."""

    def store(batch: DataFrame, number: int) -> None:
        append_batch(batch, f"batch-{number:09d}", path, keys, order)

    query = source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def high_water_mark(pulled: DataFrame, modified: str, mode: str, truncated: bool, mark: float) -> float:
    """The next mark: the greatest time of all that was pulled, but the old one after a truncated pull and in modes that look back."""
    top = pulled.agg(F.max(modified)).first()[0]
    return mark if truncated or mode in ("recent", "window") or top is None else max(mark, float(top))
