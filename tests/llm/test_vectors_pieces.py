"""Centroid clustering, vector codes and SentencePiece coding: SQL, brute force, the library, and odd rows."""

import hashlib
import math
import random
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import differences

from gleaner.llm import automaton, centroids, codebooks, pieces, registry, vectors

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, code string, key int, vector array<float>, part int"
NAN, INF = float("nan"), float("inf")
ODD = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [0.1, 0.1]), (2, None), (3, []), (4, [1.0]), (5, [NAN, 0.0]), (6, [INF, 0.0]), (7, [None, 0.0]), (8, [0.5, -0.25]), (9, [-0.1, -0.7])]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, None if k % 3 == 0 else k % 2, 0, "x", 1, None, 2) for k, (i, v) in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_vector_codes"])
def test_matches_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) == ""


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def rounds_of(xs, centres, rounds):
    """Plain rounds: nearest with ties to the lower index, floor means."""
    for _ in range(rounds + 1):
        at = [min(range(len(centres)), key=lambda k: (distance(x, centres[k]), k)) for x in xs]
        yield at, centres
        own = [[x for x, a in zip(xs, at, strict=True) if a == k] for k in range(len(centres))]
        centres = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else c for o, c in zip(own, centres, strict=True)]


def some_vectors(seed, n, width):
    rng = random.Random(seed)
    return [(rng.choice([None, k, 5]), [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, rng.random()]) for _ in range(width)]) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    rows = some_vectors(seed, 60, 4)
    rows += rows[:20]
    got = centroids.cluster(table(spark, rows), 5, 4, 4)[0].collect()
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in [(i, np.float32(v).astype(float).tolist()) for i, v in rows])
    xs = [whole(np.float32(v).astype(float), 1024) for _, v in rows]
    *_, (at, centres) = rounds_of(xs, [whole(v, 1024) for _, v in hashed[:5]], 4)
    near = [distance(x, centres[a]) for x, a in zip(xs, at, strict=True)]
    spread = [sum(d for d, a in zip(near, at, strict=True) if a == k) for k in range(5)]
    want = [(i, a, d, spread[a], sum(near), hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest()) for (i, _), a, d in zip(rows, at, near, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_brute_force(spark, seed):
    rows = some_vectors(seed, 70, 6)
    rows += rows[:20]
    df = table(spark, rows)
    got = codebooks.compress(df, 3, 4, 5)[0].collect()
    xs = [whole(np.float32(v).astype(float), 4096) for _, v in rows]
    first = [x for *_, x in sorted((i is None, i or 0, x) for (i, _), x in zip(rows, xs, strict=True))[:4]]
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in (0, 2, 4):
        own = [x[p : p + 2] for x in xs]
        *_, (at, book) = rounds_of(own, [x[p : p + 2] for x in first], 5)
        codes = [c + f"{a:02x}" for c, a in zip(codes, at, strict=True)]
        errors = [e + distance(x, book[a]) for e, x, a in zip(errors, own, at, strict=True)]
        books += [c for entry in book for c in entry]
    labels = [None if k % 3 == 0 else k % 2 for k in range(len(rows))]
    total = {n: sum(e for e, m in zip(errors, labels, strict=True) if m == n) for n in set(labels)}
    want = [(i, c, e, total[n], hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()) for (i, _), c, e, n in zip(rows, codes, errors, labels, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_odd_vectors(spark):
    got = centroids.cluster(table(spark, ODD), 8, 3, 2)[0].collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "8", "9", "None"] and {r.cluster for r in got if r.vec_id in (1, 8)} == {min(r.cluster for r in got if r.vec_id in (1, 8))}
    got = codebooks.compress(table(spark, ODD), 2, 16, 3)[0].collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "8", "9", "None"] and all(r.error == 0 and r.label_error == 0 for r in got)
    for bad in ([], ODD[3:9]):
        assert centroids.cluster(table(spark, bad), 8, 3, 2)[0].count() == 0 and codebooks.compress(table(spark, bad), 2, 16, 3)[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(table(spark, [(1, [1e9, 0.0])]), 8, 3, 2)


def test_orchard_measures_few_and_keeps_ties():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (60, 3))
    centres[40] = centres[7]
    x = np.concatenate([centres[rng.integers(0, 60, 3000)] + rng.integers(-20, 20, (3000, 3)), (centres[:30] + centres[30:]) // 2])
    search = centroids.Orchard(centres)
    at, best = search.nearest(x)
    want = vectors.nearest_two(x, centres)
    assert (at == want[0]).all() and (best == want[1]).all() and search.measured < len(x) * 30


def test_bounds_save_scans_and_net_is_tighter():
    """Entries that wander and come back: net displacement is nothing, so no part is measured; summed drifts would have been."""
    book = np.array([[0, 0], [1000, 0], [0, 1000]])
    x = np.array([[10, 10], [990, 5], [3, 980]])
    own, away = codebooks.Bounds.unseen(3), book + 400
    own.advance(x, np.stack([book]))
    assert own.advance(x, np.stack([book, away, book])) == (0, 0) and own.entry.tolist() == [0, 1, 2]
    rng = np.random.default_rng(2)
    x, history, scans = rng.integers(-2000, 2000, (4000, 8)), [rng.integers(-2000, 2000, (16, 8))], 0
    own = codebooks.Bounds.unseen(4000)
    for _ in range(12):
        scans += own.advance(x, np.stack(history))[1]
        assert (own.entry == vectors.nearest_two(x, history[-1])[0]).all()
        sums, counts = np.zeros((16, 8), np.int64), np.bincount(own.entry, minlength=16)
        np.add.at(sums, own.entry, x)
        history.append(vectors.floor_means(history[-1], sums, counts))
    assert scans < 12 * 4000 * 0.8


def texts():
    rng, names = random.Random(4), list(pieces.pieces(MODEL).ids)
    out = ["", None, " ", "  ", " " * 70, "▁", "▁▁ x", "é中 国", "\x1c\x85 ok\n\n\t x 😀", "<0x41></s><s><unk>", "/" * 50 + "#" * 77, "\0a\0", "=-" * 40, "a" * 20_000, "word " * 5000, "pgfpathlineto" * 9]
    for _ in range(150):
        out.append("".join(rng.choices(names, k=rng.randint(1, 14))).replace("▁", " "))
        out.append("".join(rng.choices("ab c de\n.=#/ 中é😀", k=rng.randint(1, 90))))
        out.append("".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x250, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(20)))
        out.append("".join(rng.choices("etaoinshr", k=rng.randint(1, 120))))
    return out + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:200]


def test_sentencepiece_equals_library(spark):
    library, some = sentencepiece.SentencePieceProcessor(model_file=MODEL), texts()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(some)] + [(None, "again", "x", 1)] * 2, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    rows = pieces.encode_documents(df, MODEL, with_ids=True).collect()
    assert len(rows) == len(some) + 2
    for r in rows:
        want = library.encode((some[r.doc_id] or "") if r.doc_id is not None else "again", add_eos=True)
        text = library.decode(want)
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert pieces.encode_documents(df.limit(0), MODEL).count() == 0


def test_decoding_equals_library():
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.pieces(MODEL), random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 12))]
        assert library.decode(ids) == model.decode(ids)


def test_longest_matches():
    own = {w: k for k, w in enumerate(["a", "ab", "abc", "bcd", "cab", "dddd"])}
    found = automaton.LongestMatches(own)
    text = "".join(random.Random(6).choices("abcde", k=700))
    want = [max((k for w, k in own.items() if text.startswith(w, i)), key=lambda k: len(list(own)[k]), default=-1) for i in range(len(text))]
    assert found.starting_at(np.array([ord(c) for c in text])).tolist() == want and found.starting_at(np.zeros(0, np.int64)).tolist() == []
