"""Names, titles, what is kept, and the stream of pages: against plain loops, over cuts and restarts."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import blocks, keeping, naming
from gleaner.plans import cases, runs
from gleaner.streaming import inbox, names, pushes
from gleaner.tables import new_path

SF = "/root/testdata/sf0.001"


def loop_of_titles(rows):
    used, out = set(), {}
    for title, key, order in sorted(rows, key=lambda r: r[2]):
        name, k = title or "", 1
        while name in used:
            name, k = f"{title or ''}（{'' if key is None else key}{'' if k == 1 else f'-{k}'}）", k + 1
        used.add(name)
        out[order] = name
    return out


@pytest.mark.parametrize("seed", range(3))
def test_titles_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a（1）", "a（1-2）", "b（2）", "b", None, ""]), rng.choice([1, 1, 2, None]), k) for k in range(60)]
    got, rounds = naming.unique_titles(spark.createDataFrame(rows, "title string, key int, k int").repartition(3), "title", "key", ["k"])
    assert {r.k: r["name"] for r in got.collect()} == loop_of_titles(rows) and rounds < 20


def test_many_rows_of_one_name_take_one_round(spark):
    got, rounds = naming.allocate(spark.range(5000).withColumn("base", F.lit("x")), ["base"], ["id"], naming.numbered_name("base"))
    assert rounds == 1 and {r.id: r["name"] for r in got.collect()} == {k: f"x-{k}" if k else "x" for k in range(5000)}


def loop_of_files(batches):
    held, out = {}, []  # name: body
    for batch in batches:
        for base, body, k in sorted(batch, key=lambda r: r[2]):
            own = next((n for (b, t), n in held.items() if (b, t) == (base, body)), None)
            if own is None:
                taken, i = set(held.values()), 0
                while (own := base + (f"-{i}" if i else "")) in taken:
                    i += 1
                held[base, body] = own
            out.append((k, own))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_names_by_content_over_batches(spark, seed):
    rng = random.Random(seed)
    batches = [[(rng.choice(["a", "a-1", "b", "a-1-1"]), rng.choice("uvwxyz"), 100 * n + k) for k in range(25)] for n in range(2)]
    path, got = new_path(spark, "names"), []
    frames = [spark.createDataFrame([(b, f"﻿---\nid: {k}\n---\n {t} " if k % 2 else t, k) for b, t, k in rows], "base string, text string, k int") for rows in batches]
    for n, df in enumerate(frames):
        got += [(r.k, r["name"]) for r in names.name_batch(df, n, path, "base", "text", ["k"]).collect()]
    assert sorted(got) == loop_of_files(batches)
    before = sorted(map(tuple, inbox.stored(spark, path, names.REGISTRY).collect()))
    again = names.name_batch(frames[0], 2, path, "base", "text", ["k"]).collect()  # a batch that was there before
    assert sorted((r.k, r["name"]) for r in again) == [x for x in sorted(got) if x[0] < 100]
    names.name_batch(frames[1], 1, path, "base", "text", ["k"]).collect()  # and one that is stored again under its number
    assert sorted(map(tuple, inbox.stored(spark, path, names.REGISTRY).collect())) == before


def loop_of_kept(rows):
    out = []
    for u in sorted({r[0] for r in rows if r[0] is not None}):
        own = []
        for r in (r for r in rows if r[0] == u):
            row = (r[2], " ".join((r[3] or "").split()).lower(), r[4] or 0.0)
            if own and own[-1][1][0] == row[0]:
                a, b = own[-1][1][1], row[1]
                if (not a and not b) or (a and b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.95):
                    if row[2] > own[-1][1][2]:
                        own[-1] = (r[1], row)
                    continue
            own.append((r[1], row))
        out += [k for k, _ in own]
    return sorted(out)


@pytest.mark.parametrize("size", [5, 64, 20_000])
def test_kept_equals_a_loop_over_any_cut(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, 1.0 if k % 40 else 2.0, rng.choice(["a b", "A  B", "", None, "abcdefghijklmnopqrstu", "abcdefghijklmnopqrstv"]), rng.choice([None, 1.0, 2.0, 3.0])) for k in range(400)]
    df = spark.createDataFrame(rows, "u long, k long, p double, t string, q double").repartition(3)
    same = lambda a, b: 1.0 if a == b else 0.0
    assert sorted(r.k for r in keeping.kept(df, "u", ["k"], "p", "t", "q", same, size).collect()) == loop_of_kept(rows)
    assert keeping.kept(df.limit(0), "u", ["k"], "p", "t", "q", same, size).count() == 0


def test_a_state_that_runs_through_every_block(spark):
    """A fold that never forgets: each block depends on all before it, and still comes out right."""
    fold = lambda last, row: ((row[0] + (last[0] if last else 0),), str(row[0] + (last[0] if last else 0)))
    df = spark.createDataFrame([("x", k, k) for k in range(40)] + [("y", k, 1) for k in range(9)], "u string, k int, v int")
    got, rounds = blocks.folded(df, "u", ["k"], ["v"], fold, 8)
    rows = {(r.u, r.k): int(r.verdict) for r in got.collect()}
    assert rows == {("x", k): k * (k + 1) // 2 for k in range(40)} | {("y", k): k + 1 for k in range(9)} and 2 < rounds <= 7


MODES = {m[0]: m[1:] for m in cases.MODES}


@pytest.mark.parametrize("mode", ["latest", "all", "bootstrap", "window"])
def test_stream_of_pages_equals_sync(spark, mode, tmp_path):
    """What a stream adds with a mode's mark and page cap is what the sync over tables says, and the mark moves when it does."""
    since, max_pages, _ = MODES[mode]
    max_pages = min(max_pages, 1) if mode == "all" else max_pages
    at = f"file://{tmp_path}"
    rows = runs.push_rows(spark, SF)
    pushes.store_pages(rows, f"{at}/pages")
    state = runs.pull(spark, f"{at}/pages", at, since, max_pages)
    changed = rows.where(F.col("modified") > since)
    pages = [r.page for r in changed.select("page").distinct().orderBy("page").collect()]
    seen = changed.where(F.col("page").isin(pages[:max_pages]))
    got = inbox.stored(spark, f"{at}/items", "page long, place int, url string").collect()
    assert {r.url for r in got} == {r.url for r in seen.where("url is not null").select("url").distinct().collect()} and len(got) == len({r.url for r in got})
    if pages:
        assert state["truncated"] == (len(pages) > max_pages)
        assert state["modified"] == (since if state["truncated"] else seen.agg(F.max("modified")).first()[0])


def test_stream_stopped_between_pages_loses_and_repeats_none(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = runs.push_rows(spark, SF).withColumns({"page": F.floor(F.col("place") / 90), "place": F.col("place") % 90})
    pushes.store_pages(rows, f"{at}/pages")
    cursors = [runs.pull(spark, f"{at}/pages", at, 0.0, 2).get("cursor") for _ in range(4)]
    assert cursors[0] == "page-000000002.json" and cursors[1] == "page-000000004.json" and cursors[2] == ""
    got = [tuple(r) for r in inbox.stored(spark, f"{at}/items", "page long, place int, url string").collect()]
    first = rows.where("url is not null").groupBy("url").agg(F.min(F.struct("page", "place")).alias("x")).select("x.page", "x.place", "url").collect()
    assert sorted(got) == sorted(map(tuple, first))
    more = rows.limit(1).select(F.lit(9).cast("long").alias("page"), F.lit(0).alias("place"), "type", F.lit("https://new.example/").alias("url"), "title", "body", (F.lit(4e9)).alias("modified"))
    pushes.store_pages(more.withColumn("type", F.lit("link")), f"{at}/pages")
    runs.pull(spark, f"{at}/pages", at, 0.0, 50)  # after the mark only what is new comes
    assert inbox.stored(spark, f"{at}/items", "page long, place int, url string").count() == len(got) + 1


@pytest.mark.parametrize("seed", range(2))
def test_merges_equal_a_loop_over_any_cut(spark, seed, monkeypatch):
    from gleaner.operators import folds

    real = blocks.folded
    monkeypatch.setattr(folds, "folded", lambda *a: real(*a, rows=9))
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2]), k, rng.choice(["ab", "abcdef", "end.", ""]), k * 10, k * 10 + 5) for k in range(70)]
    want = []
    for u in (1, 2):
        group = []
        for r in [r for r in rows if r[0] == u and r[2]] + [None]:
            if group and (r is None or sum(len(x[2]) for x in group) >= 12 or len(group) >= 4 or group[-1][2].endswith(".")):
                want.append((u, group[0][3], group[-1][4], " ".join(x[2] for x in group), len(group)))
                group = []
            group.append(r)
    got = folds.merge_segments(spark.createDataFrame(rows, "u long, k long, t string, a long, z long"), "u", "k", F.col("t"), "a", "z", 12, 4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
