"""Readers of collected files: JSON lines, snapshots, Markdown libraries, pages of pushes, subtitles. All take paths that Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import text_of, urls_in
from gleaner.tables import written

#: Characters of files that a task gives on at once.
LIBRARY_CHARS = 4_000_000

PUSH = "type string, url string, title string, body string, modified double"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the blank and malformed ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def push_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of pushes ({pushes: [...], cursor}) as one row a push, in order of page and place (seq)."""
    pages = spark.read.schema(f"pushes array<struct<{PUSH.replace(' ', ':').replace(',:', ',')}>>, cursor string, page long").json(path)
    return pages.select("page", F.posexplode("pushes").alias("place", "push")).select(F.col("page"), "place", "push.*")


def items_of(pushes: DataFrame) -> DataFrame:
    """A push becomes an item: a link by its own url, any other by the first url in its body; others go."""
    url = F.when((F.col("type") == "link") & (text_of("url") != ""), F.col("url")).otherwise(F.get(urls_in("body"), F.lit(0)))
    rest = [c for c in pushes.columns if c not in ("type", "url", "title", "body", "modified")]
    return pushes.select(*rest, F.lit("pushbullet").alias("source"), url.alias("url"), text_of("title").alias("title"), F.coalesce("modified", F.lit(0.0)).alias("timestamp")).where("url is not null")


def snapshot(spark: SparkSession, path: str, note: str) -> DataFrame:
    """{boards: {name: [note, ...]}} as one row a note, with its board and place."""
    raw = spark.read.schema(f"boards map<string, array<struct<{note}>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("boards").alias("board", "notes")).select("board", F.posexplode("notes").alias("place", "note")).select("board", "place", "note.*")


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """at: all files below a folder of any store that Arrow reaches, as the store's own paths. Tasks list folders, a level at a time, so one task needs the names in one folder alone; as for Spark, names that begin with _ or . don't count."""
    from pyarrow import fs

    def names(batches):
        import pyarrow as pa

        store = fs.FileSystem.from_uri(path)[0]
        for b in batches:
            for folder in b.column("at").to_pylist():
                found = [f for f in store.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(("_", "."))]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in found], pa.string()), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())], names=["at", "folder"])

    tasks, below = spark.sparkContext.defaultParallelism, None
    level = spark.createDataFrame([(fs.FileSystem.from_uri(path)[1],)], "at string").coalesce(1)
    while True:
        found = written(level.mapInArrow(names, "at string, folder boolean"), "names")[0]
        below = found if below is None else below.union(found)
        folders = found.where("folder")
        if folders.isEmpty():
            return below.where("not folder").select("at")
        level = folders.select("at").repartition(4 * tasks, "at")


def markdown_library(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all Markdown files below a folder of any store that Arrow reaches; a task reads thousands."""
    from pyarrow import fs

    root = fs.FileSystem.from_uri(path)[1]
    scheme = path[: path.rfind(root)] if root in path else ""

    def read(batches):
        import pyarrow as pa

        store = fs.FileSystem.from_uri(path)[0]
        for b in batches:
            held, size = [], 0
            for at in b.column("at").to_pylist():
                with store.open_input_stream(at) as f:
                    held.append((scheme + at, f.read().decode(errors="replace")))
                size += len(held[-1][1])
                if size > LIBRARY_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=["path", "text"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=["path", "text"])

    files = files_below(spark, path).where(F.lower("at").endswith(".md"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, files.count() // 4000)
    return files.repartition(tasks, "at").mapInArrow(read, "path string, text string")


def seconds(time: Column) -> Column:
    """[hh:]mm:ss.mmm (or with a comma) in seconds."""
    parts = F.transform(F.split(F.replace(time, F.lit(","), F.lit(".")), ":"), lambda p: p.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)


def vtt_segments(files: DataFrame) -> DataFrame:
    """(path, seq, start, end, text) from WebVTT or SRT files (path, text): a block's lines after its time line, joined."""
    times = r"(?m)^\s*([\d:.,]+)\s*-->\s*([\d:.,]+)"
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), r"\n[ \t]*\n")).alias("seq", "block")).where(F.col("block").rlike(times))
    body = F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)", 1)
    said = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", ""), r"\s*\n\s*", " "))
    return blocks.select("path", "seq", seconds(F.regexp_extract("block", times, 1)).alias("start"), seconds(F.regexp_extract("block", times, 2)).alias("end"), said.alias("text")).where("text <> ''")


def json3_segments(files: DataFrame) -> DataFrame:
    """The same from event lists with millisecond times and text pieces."""
    doc = F.from_json("text", "events array<struct<tStartMs:double,dDurationMs:double,segs array<struct<utf8:string>>>>".replace("segs array", "segs:array"))
    e = files.select("path", F.posexplode(doc["events"]).alias("seq", "e"))
    said = F.trim(F.array_join(F.transform(F.coalesce("e.segs", F.array()), lambda s: s["utf8"]), ""))
    return e.select("path", "seq", (F.col("e.tStartMs") / 1000).alias("start"), ((F.col("e.tStartMs") + F.coalesce("e.dDurationMs", F.lit(0.0))) / 1000).alias("end"), said.alias("text")).where("text <> ''")


def body_segments(files: DataFrame) -> DataFrame:
    """The same from {body: [{from, to, content}]}."""
    b = files.select("path", F.posexplode(F.from_json("text", "body array<struct<`from`:double,`to`:double,content:string>>")["body"]).alias("seq", "b"))
    return b.select("path", "seq", F.col("b.from").alias("start"), F.col("b.to").alias("end"), F.trim(text_of("b.content")).alias("text")).where("text <> ''")
