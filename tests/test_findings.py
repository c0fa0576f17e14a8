"""What a round's review found: queries on small tables of odd rows, against their SQL."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet  # noqa: F401
import pytest
from oracle import differences

from gleaner.functions import content
from gleaner.llm import attention, lm
from gleaner.llm.packing import token_ids
from gleaner.plans import oracle, queries
from gleaner.sources import readers, writers
from gleaner.streaming import pushes


def same_as_sql(spark, name: str, at) -> str:
    return differences(spark, queries.QUERIES[name], oracle.SQL[name], str(at))


@pytest.mark.parametrize("title", ["a &amp;&amp", "&lt; &quot;b &am", "&copy; &amp;lt; &#39 &lt", "&"])
def test_cut_references(spark, tmp_path, title):
    rows = [(k, f"https://ex.example/{k}", f"<html><body><h1>{title}</h1><p>x</p></body></html>") for k in range(6)]
    pa.parquet.write_table(pa.Table.from_pylist([dict(zip(("page_id", "url", "html"), r, strict=True)) for r in rows]), f"{tmp_path}/pages.parquet")
    assert same_as_sql(spark, "article_pages", tmp_path) == ""


def test_the_driver_lists_pages_and_fetches_none(spark, tmp_path, monkeypatch):
    """A stream's next step is planned from the list of pages alone, once a step, and many pages share a task."""
    rows = spark.range(300).selectExpr("id as page", "0 as place", "'link' as type", "'u' as url", "'' as title", "'' as body", "cast(id % 7 as double) as modified")
    pushes.store_pages(rows, f"file://{tmp_path}/pages")
    calls = []
    real = pushes.Pages.changed
    monkeypatch.setattr(pushes.Pages, "changed", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(pushes.Pages, "fetch", lambda *a: pytest.fail("the driver fetched a page"))
    reader = pushes.PushReader(f"file://{tmp_path}/pages", 3.0, 100)
    changed, start, seen = [k for k in range(300) if k % 7 > 3], reader.initialOffset(), []
    for most, cursor in ((100, f"page-{changed[100]:09d}.json"), (10_000, "")):
        reader.max_pages = most
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        seen += [pushes.number_of(c) for p in parts for c in p.cursors]
        assert end["cursor"] == cursor and len(parts) <= 4
        start = end
    assert seen == changed and start["modified"] == 6.0 and len(calls) == 4


@pytest.mark.parametrize("of,most", [(lambda: content.words_around("t", ["a", "b"], 20), 2), (lambda: content.answer_only("t"), 9), (lambda: content.is_low_quality("t"), 1)])
def test_shared_values_are_worked_out_once(spark, of, most):
    """An expression doesn't repeat the text that its parts share."""
    df = spark.createDataFrame([("xx aa bb cc dd",)], "t string").select(of().alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") <= 4 * most and plan.count("t#") < 12


def test_answers_and_windows_of_odd_texts(spark):
    texts = {None: ("", ""), "": ("", ""), "好的\n---\n": ("", ""), "好的\r\n a  \n\n---\n b \n以上就是": ("a\n\n---\n b", ""), "key": ("key", "key"), "one two three key four, five": ("one two three key four, five", "two three key")}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", content.answer_only("t").alias("a"), content.words_around("t", ["no", "key"], 12).alias("w")).collect()
    assert {r.t: (r.a, r.w) for r in got} == texts


def test_a_task_reads_many_files_of_a_library(spark, tmp_path):
    texts = {f"{k % 3}/deep {k % 2}/{k}.md" if k % 4 else f"{k}.MD": f"é {k}\n" * (k % 3) for k in range(640)}
    for name, text in {**texts, "no.txt": "x", "_hidden/a.md": "x", "1/.b.md": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = readers.markdown_library(spark, f"file://{tmp_path}")
    assert {r.path.removeprefix(f"file://{tmp_path}/"): r.text for r in got.collect()} == texts
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


FIRST_LINES = ["", " \t", "\n", "\u00a0x\u00a0", "\ufeffx ", "\u3000", "\x0bx\x0b", "\x85x", "\u2028", "a\r", "a\rb", "#a", "编辑于 1", "2024-05-06", "|", "Doc 3", "é $1 \\1 \f"]


@pytest.mark.parametrize("rows", [
    [(k, f"{t}\n#x\nrest", "en", "s") for k, t in enumerate(FIRST_LINES)],
    [(1, None, "en", "s"), (2, "a", None, "s"), (3, "a", "en", None), (None, "a", "en", "s"), (None, None, None, None), (4, "a", "", "")],
    [(7, "a", "en", "s"), (7, "b", "en", "s"), (7, "a", "en", "s"), (-7, "a", "en", "s"), (-(2**63), "a", "en", "s"), (2**63 - 1, "a", "en", "s")],
    [],
])
def test_notes_of_odd_documents(spark, tmp_path, rows):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])
    pa.parquet.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), f"{tmp_path}/documents.parquet")
    assert same_as_sql(spark, "markdown_notes", tmp_path) == ""


def test_a_write_that_is_ended_spoils_no_file(spark, tmp_path):
    """Of two attempts at a task, the one that is ended midway leaves the other's file whole, and nothing that readers see."""
    from pyarrow import fs

    class Ends:
        def __getattr__(self, name):
            return getattr(fs.LocalFileSystem(), name)

        def open_output_stream(self, at, **options):
            with fs.LocalFileSystem().open_output_stream(at, **options) as f:
                f.write(b"wh")
            raise OSError("ended")

    writers.put(fs.LocalFileSystem(), f"{tmp_path}/a.md", b"whole")
    for name in ("a", "b"):
        with pytest.raises(OSError, match="ended"):
            writers.put(Ends(), f"{tmp_path}/{name}.md", b"whole")
    writers.put(fs.LocalFileSystem(), f"{tmp_path}/a.md", b"whole")
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in readers.markdown_library(spark, f"file://{tmp_path}").collect()] == [("a.md", "whole")]


def test_the_model_learns_from_every_document(spark):
    """Slots and counts follow all 900 texts, not the first few hundred by hash."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [f"the word{k % 37} stands by word{k % 11} and {k}" for k in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t, encode = lm.fit(df, ranks)[1], token_ids(ranks)
    flows = [[lm.END, *lm.ids_of(lm.words_of(x), encode).tolist(), lm.END] for x in texts]
    count = np.bincount([i for f in flows for i in f[1:]], minlength=lm.TOKENS)
    top = np.argsort(-count, kind="stable")[: attention.OWN]
    assert (t.slot_of[top] == np.arange(attention.OWN)).all()
    pairs = Counter(int(t.slot_of[a]) << 16 | b for f in flows for a, b in zip(f, f[1:], strict=False) if t.slot_of[a] < attention.OWN)
    assert dict(zip(t.near[:-1].tolist(), t.near_n[:-1].tolist(), strict=True)) == pairs


def test_python_gets_few_rows_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with lm.small_batches(spark, 7):
        sizes = spark.range(0, 50, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "id", pa.array([b.num_rows])) for b in batches), "id long").collect()
        assert sum(r.id for r in sizes) == 50 and max(r.id for r in sizes) == 7
    assert spark.conf.get(key) == before
