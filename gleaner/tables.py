"""Tables that a job writes on its way, in the folder that the driver and all executors share, and numbering of rows in order."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that are still there; they go with the driver's process.
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder of its own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the path, for checks and deletes that work in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)
    _left.pop(path, None)


def delete_left() -> None:
    """Deletes all tables that were written and not deleted yet. Results that still read them must be used up before."""
    for path, spark in list(_left.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            _left.pop(path, None)


atexit.register(delete_left)


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder (with options of the writer) and reads it back, so that a lost executor costs no earlier work. Also returns the path, for delete()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def numbered(df: DataFrame, order: list[str], column: str = "at") -> tuple[DataFrame, str]:
    """Numbers all rows from 0 in an order, without a task that holds them all: ranges are sorted and written with a row's place in its range, and the ranges' sizes, one number each, are summed. Also returns the path of the table that was written."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    table, path = written(placed, "numbered")
    sizes = table.groupBy(F.shiftright("_place", 33).alias("_range")).agg(F.count("*").alias("_n")).orderBy("_range").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r["_range"], before))
        before += r["_n"]
    starts = F.broadcast(spark.createDataFrame(rows, "_range long, _before long"))  # a row for each range, as many as there are partitions
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return table.join(starts, F.shiftright("_place", 33) == F.col("_range")).withColumn(column, F.col("_before") + place).drop("_place", "_range", "_before"), path
