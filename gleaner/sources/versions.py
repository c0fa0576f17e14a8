"""A store of immutable versions: each writer gets an id of its own, and the manifest is what the committed versions say.

An id is a base (a time stamp) or, where that is taken, the base with -02, -03 and so on. A writer claims an id by creating a
file that no other can create as well (the store must refuse to create a file twice, as Hadoop's file systems do), writes its
rows below it, and commits by writing what it wrote. A version without that is one that was cut off; readers don't see it. The
manifest needs no file of its own: it is read again from the versions whenever it is lost.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.tables import hadoop_fs

MANIFEST = "version_id string, base string, suffix int, generated_at string, n_rows long, options string"


def claim(spark: SparkSession, root: str, base: str) -> str:
    """The first free id of a base, from now on this writer's."""
    fs, _ = hadoop_fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    k = 1
    while True:
        own = base if k == 1 else f"{base}-{k:02d}"
        at = path(f"{root}/{own}")
        if not fs.exists(at):
            fs.mkdirs(at)
        try:
            fs.create(path(f"{root}/{own}/_claimed"), False).close()
        except Exception as e:  # noqa: BLE001  Java's exception of a file that is there
            if not fs.exists(path(f"{root}/{own}/_claimed")):
                raise e
        else:
            return own
        k += 1


def publish(rows: DataFrame, root: str, base: str, options: dict | None = None) -> str:
    """Writes rows as a version; returns its id. A version that is published is never changed."""
    spark = rows.sparkSession
    own = claim(spark, root, base)
    rows.write.parquet(f"{root}/{own}/rows")
    fs, at = hadoop_fs(spark, f"{root}/{own}/version.json")
    entry = {"version_id": own, "base": base, "suffix": int(own[len(base) + 1 :] or 1), "generated_at": base, "n_rows": spark.read.parquet(f"{root}/{own}/rows").count(), "options": json.dumps(options or {})}
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    return own


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row (MANIFEST) for each committed version; the newest first by (base, suffix)."""
    fs, at = hadoop_fs(spark, root)
    some = fs.exists(at) and fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/version.json"))
    rows = spark.read.schema(MANIFEST).json(f"{root}/*/version.json") if some else spark.createDataFrame([], MANIFEST)
    return rows.orderBy(F.desc("base"), F.desc("suffix"))


def rows_of(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{version_id}/rows")
