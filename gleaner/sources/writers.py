"""Writers: month archives, link lists, notes as Markdown."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.dates import from_epoch
from gleaner.functions.text import text_of


def month_archive(items: DataFrame, path: str, now: Column) -> None:
    """Appends items (timestamp in epoch seconds or milliseconds; invalid: now) as JSON lines by year and month."""
    ts = F.coalesce(F.when(F.col("timestamp") > 0, from_epoch(F.col("timestamp"))), now)
    items.withColumns({"year": F.date_format(ts, "yyyy"), "year_month": F.date_format(ts, "yyyy-MM")}).write.partitionBy("year", "year_month").mode("append").json(path)


def link_list(links: DataFrame, path: str) -> None:
    links.select("url").write.mode("overwrite").text(path)


def markdown(note: dict[str, Column]) -> Column:
    """A note as Markdown: front matter of the plain fields, its title, content, then tags."""
    front = [F.concat(F.lit(f"{k}: "), text_of(note[k])) for k in ("title", "author", "date", "source") if k in note]
    tags = F.when(F.size(note["tags"]) > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform(note["tags"], lambda t: F.concat(F.lit("#"), t)), " "))).otherwise("") if "tags" in note else F.lit("")
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *front), F.lit("\n---\n\n# "), text_of(note["title"]), F.lit("\n\n"), text_of(note["content"]), tags, F.lit("\n"))


def put(store, at: str, data: bytes) -> None:
    """Writes a file of an Arrow store under a hidden name first, so that an attempt that is ended midway leaves no part of it and spoils no whole one."""
    from pyarrow import fs

    part = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    try:
        store.move(part, at)
    except OSError:  # a store that doesn't replace files has the same one already
        if store.get_file_info(at).type != fs.FileType.File:
            raise
        store.delete_file(part)


def text_files(rows: DataFrame, path: str, name: str, text: str) -> None:
    """Writes a file for each row, under its name, in a folder of any store that Arrow reaches; a name may have folders before it. Tasks write their own rows; a row that is written again gives the same file."""

    def write(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        there = set()
        for b in batches:
            for own, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (at := posixpath.dirname(f"{folder}/{own}")) not in there:
                    store.create_dir(at, recursive=True)
                    there.add(at)
                put(store, f"{folder}/{own}", (content or "").encode())
            yield b.select([name])

    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)  # it is there without rows, too
    rows.select(name, text).mapInArrow(write, f"`{name}` string").count()
