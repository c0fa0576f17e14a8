"""Rules to a fixpoint, shapes, state in scripts, image picks, quotas, versions, themes and context at their edges."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gleaner.functions import rules
from gleaner.operators import captions, context, joins, themes, windows
from gleaner.sources import payloads, versions


def test_rules_end(spark):
    shrink = rules.Table([rules.Rule("^(?:a|b) ", ""), rules.Rule("xx", "x")])
    assert shrink.until_stable("a b a xxxxx b") == ("x b", 3) and shrink.until_stable("") == ("", 0)
    assert rules.Table([rules.Rule("a", "aa")]).until_stable("a") == ("aa", 1)  # a rule that grows texts ends at once
    assert rules.Table([rules.Rule("a", "b"), rules.Rule("c", "a")]).until_stable("c") == ("a", 1)
    assert rules.Table([rules.Rule("(?i)A", "b"), rules.Rule(r"(b)\1", r"\1")]).once("aab") == "bb"
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "k int, t string")
    got = rules.rewritten(df, "t", [rules.Rule("^[ab] ", "")], "new", stable=True).orderBy("k").collect()
    assert [(r.k, r.t, r.new, r.passes) for r in got] == [(1, "a b c", "c", 2), (2, None, "", 0)]


def test_payloads(spark):
    rows = [(1, '{"data": {"comments": {"no": "list"}, "items": [1]}, "cursor": 7, "hasMore": 1}'), (2, "broken"), (3, None), (4, '{"list": [], "has_more": "false"}')]
    got = spark.createDataFrame(rows, "k int, p string").select("k", payloads.comment_list("p").alias("x"), payloads.camel_keys("p").alias("c")).orderBy("k").collect()
    assert [(r.x.comments, r.x.cursor, r.x.has_more) for r in got] == [("[1]", "7", True), (None, "", False), (None, "", False), ("[]", "", False)]
    assert [r.c for r in got][1:] == [None, None, '{"list":[],"hasMore":"false"}']


def test_state_in_scripts():
    take = lambda t: payloads.literal_after(t, "STATE")
    assert take('x STATE = {"a": "}\\"{", \'b\': {c: `}`}}; more }') == '{"a": "}\\"{", \'b\': {c: `}`}}'
    assert take("STATE = {open") is None and take("no") is None and take('STATE={"a":"\\\\"}') == '{"a":"\\\\"}'
    assert json.loads(payloads.as_json('{"a": undefined, "b": "undefined,}", "c": [1, NaN,], }')) == {"a": None, "b": "undefined,}", "c": [1, None]}


def test_images(spark):
    items = [[("x", "1"), ("first", "2")], [("first", "2"), ("second", "1"), (None, "3")], [("first", "2")], [], [("x", None), ("x", "4")]]
    df = spark.createDataFrame([(items,)], "i array<array<struct<scene:string,url:string>>>")
    assert df.select(payloads.unseen_images(F.col("i"), ["first", "second"]).alias("u")).first().u == ["2", "1", "4"]


@pytest.mark.parametrize("buckets,most", [(3, 5), (4, 4), (1, 2)])
def test_quota(spark, buckets, most):
    rng = random.Random(buckets)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, float(rng.randint(0, 5))) for k in range(60)] + [("c", 100, 1.0)]
    want = set()
    for u in ("a", "b", "c"):
        own = [r for r in rows if r[0] == u]
        each, more, at, cut = len(own) // buckets, len(own) % buckets, 0, []
        for b in range(buckets):
            n = each + (b < more)
            cut.append(own[at : at + n])
            at += n
        best = [max(c, key=lambda r: (r[2], -r[1])) for c in cut if c]
        rest = sorted((r for r in own if r not in best), key=lambda r: (-r[2], r[1]))
        want |= {r[1] for r in best + (rest if len(own) <= most else rest[: max(0, most - len(best))])}
    got = windows.best_then_rest(spark.createDataFrame(rows, "u string, k int, v double").repartition(3), "u", ["k"], buckets, most, F.col("v"))
    assert {r.k for r in got.collect()} == want and got.count() == len(want)


def test_writers_at_once_get_ids_of_their_own(spark, tmp_path):
    root, df = f"file://{tmp_path}/v", spark.range(3)
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda k: versions.publish(df.where(F.col("id") < k % 4), root, "20240101-000000"), range(6)))
    assert sorted(ids) == ["20240101-000000"] + [f"20240101-000000-0{k}" for k in range(2, 7)]
    (tmp_path / "v/20250101-000000").mkdir()  # one that was cut off
    assert [r.version_id for r in versions.manifest(spark, root).collect()] == sorted(ids, key=lambda i: int(i[16:] or 1), reverse=True)
    assert versions.manifest(spark, f"{root}/none").count() == 0
    assert {r.version_id: r.n_rows for r in versions.manifest(spark, root).collect()} == {i: versions.rows_of(spark, root, i).count() for i in ids}


def test_themes_and_points(spark):
    df = spark.createDataFrame([(1, "One two. Two one! Three"), (2, None), (3, " . ! "), (4, "ab")], "k int, t string")
    rule = [themes.Theme("T", ("one", "One"), 2, "g"), themes.Theme("One two", ("none",), 9)]
    got = [tuple(r) for r in themes.title_candidates(df, "k", "t", rule, r"[.!]", r"[,.!]", "else").orderBy("k", "place").collect()]
    assert got[:5] == [(1, 1, "One two", 60.0, ""), (1, 2, "Two one", 59.0, ""), (1, 3, "Three", 58.0, ""), (1, 4, "T", 3 + 15 + 2 + 3 + 12 + 2.0, "g"), (1, 5, "else", 1.0, "")] and got[5:] == [(2, 1, "else", 1.0, ""), (3, 1, "else", 1.0, ""), (4, 1, "ab", 60.0, ""), (4, 2, "else", 1.0, "")]
    points = themes.key_points(df, "k", "t", [themes.Marker(("Three",), 6.0)], clause=r"[.!]").orderBy("k", "place").collect()
    assert [tuple(r) for r in points] == [(1, 1, "Three"), (1, 2, "One two"), (1, 3, "Two one"), (4, 1, "ab")]


def test_context_grows_to_both_sides(spark):
    lines = spark.createDataFrame([("v", k, float(k), k + 1.0, f"line {k}", k == 4) for k in range(9)] + [("w", 90, 50.0, 51.0, "far", False)], "v string, line long, line_start double, line_end double, text string, weak boolean")
    window = "v string, window long, window_start double, window_end double, at double"
    ws = spark.createDataFrame([("v", 1, 4.2, 4.8, 4.5), ("v", 2, 100.0, 101.0, 100.5), ("w", 3, 0.0, 1.0, 0.5), ("x", 4, 0.0, 1.0, 0.5)], window)
    got = {r.window: (r.lines, r.met) for r in context.expanded(ws, lines, "v", 10.0, reach=3.0, chars=18).collect()}
    assert got == {1: ([2, 3, 4, 5], True), 2: ([8], False), 3: ([90], False)}  # the weak line doesn't count where others are; nothing within reach of the far ones


@pytest.mark.parametrize("rows", [3, 7, 50_000])
def test_nearest_over_any_blocks(spark, rows):
    rng = random.Random(rows)
    points = [(rng.choice("aab"), k, float(rng.randint(0, 30))) for k in range(40)] + [("z", 99, 1.0)]
    targets = [(rng.choice("aab"), k, float(rng.randint(0, 30))) for k in range(15)]
    p, t = spark.createDataFrame(points, "u string, p long, at double"), spark.createDataFrame(targets, "u string, t long, t_at double")
    got = {r.p: r.t for r in joins.nearest(p, t, "u", "p", "at", "t", "t_at", rows).collect()}
    assert got == {k: min(((abs(x[2] - at), x[1]) for x in targets if x[0] == u), default=(0, None))[1] for u, k, at in points}


@pytest.mark.parametrize("seed", range(3))
def test_binding_equals_taking_turns(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2]), c, float(c), s, float(s), float(rng.randint(0, 3))) for c in range(12) for s in rng.sample(range(9), 4)]
    want = set()
    for v in (1, 2):
        taken = set()
        for c in range(12):
            free = sorted((-r[5], r[4], r[3]) for r in rows if r[0] == v and r[1] == c and r[3] not in taken)
            if free:
                taken.add(free[0][2])
                want.add((v, c, free[0][2]))
    got = captions.bind_one_to_one(spark.createDataFrame(rows, "video long, chapter long, chapter_start double, shot long, at double, score double"))
    assert {(r.video, r.chapter, r.shot) for r in got.collect()} == want
