"""A streaming source of pushes that come in pages, each with a cursor to the next.

The offset is (modified, cursor, top): pushes changed after `modified` are pulled, `cursor` is the next page to fetch, and `top`
the latest change seen in this pull. While a pull has pages left only the cursor moves on; when it ends, `top` becomes the new
`modified`. So a query that stops between two pages goes on with the next one, and one that is cut off reads the pages of its
last batch again between the same two offsets; the table that stores batches by number then writes the same rows.

The driver reads the source's list of pages, a line with a cursor and the page's latest change each, once a step; executors fetch pages, PER_TASK to a task, and make rows.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gleaner.sources.readers import PUSH
from gleaner.sources.writers import text_files

SCHEMA = f"page long, place int, {PUSH}"
FIELDS = [f.split()[0] for f in PUSH.split(", ")]
LISTS = "lists"


#: Pages that a task fetches, one after the other.
PER_TASK = 32


class Pages:
    """Pages as JSON files in a folder of any store that Arrow reaches: page-000000000.json and so on, a push a line, and in the folder LISTS the list of them. A client of a service has the same two methods."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(path)

    def changed(self, cursor: str, since: float) -> list[tuple[str, float]]:
        """Pages from a cursor on (empty: from the first on) that have pushes changed after a time, in order, each with its latest change."""
        from pyarrow import fs

        tops: dict[str, float] = {}
        for f in self.store.get_file_info(fs.FileSelector(f"{self.folder}/{LISTS}", allow_not_found=True)):
            if posixpath.basename(f.path).startswith("part-"):
                with self.store.open_input_stream(f.path) as lines:
                    for name, top in map(str.split, lines.read().decode().splitlines()):
                        tops[name] = max(float(top), tops.get(name, 0.0))  # of a page that was stored again the latest of both
        return sorted((n, t) for n, t in tops.items() if n >= cursor and t > since)

    def fetch(self, cursor: str, since: float) -> list[dict]:
        """The pushes of a page that changed after a time, each with its place in the page."""
        with self.store.open_input_stream(f"{self.folder}/{cursor}") as f:
            rows = [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
        return [r for r in rows if float(r.get("modified") or 0) > since]


def number_of(cursor: str) -> int:
    return int(cursor[5:14])


class Fetch(InputPartition):
    def __init__(self, cursors: list[str], since: float):
        self.cursors, self.since = cursors, since


class PushReader(DataSourceStreamReader):
    def __init__(self, path: str, since: float, max_pages: int):
        self.client, self.path, self.since, self.max_pages, self.now = Pages(path), path, since, max_pages, None

    def initialOffset(self) -> dict:
        return {"modified": self.since, "cursor": "", "top": self.since}

    def latestOffset(self) -> dict:
        """The offset after up to max_pages pages with new pushes; pages without don't count."""
        start = self.now or self.initialOffset()
        since, changed = start["modified"], self.client.changed(start["cursor"], start["modified"])
        top = max([start["top"], *(t for _, t in changed[: self.max_pages])])
        left = [c for c, _ in changed[self.max_pages : self.max_pages + 1]]
        self.now = {"modified": since, "cursor": left[0], "top": top} if left else {"modified": top, "cursor": "", "top": top}
        return self.now

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.now is None:  # after a restart Spark plans the last batch first
            self.now = end
        cursors = [c for c, _ in self.client.changed(start["cursor"], start["modified"]) if not end["cursor"] or c < end["cursor"]]
        return [Fetch(cursors[k : k + PER_TASK], start["modified"]) for k in range(0, len(cursors), PER_TASK)]

    def read(self, partition: Fetch) -> Iterator[tuple]:
        client = Pages(self.path)
        for cursor in partition.cursors:
            page = number_of(cursor)
            for r in client.fetch(cursor, partition.since):
                yield (page, int(r["place"]), *(float(r[c]) if c == "modified" else r.get(c) for c in FIELDS))


class PagedPushes(DataSource):
    """format("paged_pushes") with options path, since (seconds, 0) and max_pages (a trigger's most, 100)."""

    @classmethod
    def name(cls) -> str:
        return "paged_pushes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PushReader(self.options["path"], float(self.options.get("since", 0)), int(self.options.get("max_pages", 100)))


def pushes(spark: SparkSession, path: str, since: float = 0.0, max_pages: int = 100) -> DataFrame:
    """The stream of pushes at a path."""
    spark.dataSource.register(PagedPushes)
    return spark.readStream.format("paged_pushes").option("path", path).option("since", since).option("max_pages", max_pages).load()


def store_pages(pushes: DataFrame, path: str) -> None:
    """Writes pushes (page, place and the fields of a push) as pages that the source reads, a file a page, then adds them to its list of pages; a page has as many pushes as its source gives at once."""
    body, name = F.to_json(F.struct("place", *FIELDS)), F.format_string("page-%09d.json", "page")
    pages = pushes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", body.alias("body")))).alias("rows"))
    text_files(pages.select(name.alias("name"), F.array_join(F.transform("rows", lambda r: r["body"]), "\n").alias("body")), path, "name", "body")
    tops = pushes.groupBy("page").agg(F.max(F.coalesce("modified", F.lit(0.0))).alias("top"))
    tops.select(F.concat_ws(" ", name, "top").alias("value")).write.mode("append").text(f"{path}/{LISTS}")


def pull_state(progress) -> dict:
    """Of a query's last progress: the next mark, whether pages are left (the mark then stays), and the cursor."""
    end = json.loads(progress.json)["sources"][0]["endOffset"]
    return {"modified": end["modified"], "cursor": end["cursor"], "truncated": bool(end["cursor"])}
