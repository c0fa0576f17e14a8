"""Near copies by fingerprints over documents, and the whole pipeline, against plain loops; stages on empty tables and clashing columns."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from test_operators import ODD, ids_of

from gleaner.llm import chat, simhash

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(s, seed=42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes)) if len(hashes) else 0


def test_fingerprint_links_of_documents_equal_all_pairs(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(500)
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)] + [(10_000 + k, r[1]) for k, r in enumerate(ODD)]
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    label = np.array([i for i, _ in rows])
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 2) for f in fps]
    for _ in range(12):
        label = np.array([label[n].min() for n in near])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: (f"{int(f):016x}", int(c)) for (i, _), f, c in zip(rows, fps, label, strict=True)}


def small_corpus(seed):
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choices("abcdefghijklm", k=rng.randint(1, 5))) for _ in range(n)]
    texts = [" ".join(words(rng.randint(60, 150))) for _ in range(30)] + ["12 345", "", "...", None]
    for k in range(0, 12, 3):  # near copies
        own = texts[k].split(" ")
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts.append(texts[5])
    passage = " ".join(words(60))
    for k in (20, 21, 22):
        texts[k] += f" l{k} {passage} r{k} " + " ".join(words(40))
    return list(enumerate(texts))


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def without_passages(texts, width=51):
    """Runs of words that start elsewhere as well; blanks around them stay."""
    seen: dict[tuple, int] = {}
    split = {i: t.split(" ") for i, t in texts.items()}
    for w in split.values():
        for k in range(len(w) - width + 1):
            seen[tuple(w[k : k + width])] = seen.get(tuple(w[k : k + width]), 0) + 1
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        text = "".join(("" if g else x) + ("" if g and k + 1 < len(w) and gone[k + 1] else " ") for k, (x, g) in enumerate(zip(w, gone, strict=True)))
        out[i] = text[:-1]
    return out


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    rows = small_corpus(3)
    spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    known = {i: t for i, t in rows if re.search("[a-z]", t or "")}
    label = {i: i for i in known}
    for _ in range(4):
        for a in known:
            for b in known:
                if a < b and jaccard(known[a], known[b]) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
    one = {i: t for i, t in known.items() if label[i] == i}
    left = without_passages(one)
    assert len(one) == len(known) - 5 and sum(left[i] != one[i] for i in one) == 3
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").toPandas()
    assert set(got.doc_id) == set(left)
    for i, own in got.groupby("doc_id"):
        ids = np.array([*ids_of(left[i]), 2], "<u4")
        own = own.sort_values("piece")
        assert own.length.sum() == len(ids) and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    assert got.groupby("sequence_id").length.sum().max() <= 1024


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_empty_tables_and_clashing_columns(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid long, label string, piece int, fp long, key string"
    _, run = corpus_pipeline.STAGES[stage]
    assert run(spark, spark.createDataFrame([], schema), SF).count() == 0
    docs = spark.createDataFrame([(k, f"some words of text number {k} " * 5, "en", "x", 9, 7, "q", 1, 2, "z") for k in range(5)] + [(9, "w" * 40_000, None, None, None, None, None, None, None, None)], schema)
    assert {r.doc_id for r in run(spark, docs, SF).select("doc_id").distinct().collect()} <= {0, 1, 2, 3, 4, 9}


def test_chat_of_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a", 5, 0.0, "z", 9)] * 2 + [(1, 1, "assistant", "x" * 200_000, 5, 0.0, "z", 9), (2, 0, "user", None, 5, 0.0, "z", 9), (2, 0, "user", None, 5, 0.0, "z", 9)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg long, cost double, rendered string, enter int").repartition(3)).toPandas().sort_values("seq")
    one, two = ("".join(got[got.conv_id == c].rendered) for c in (1, 2))
    assert len(got) == 5 and one.count("a") - one.count("assistant") * 2 >= 2 and "x" * 200_000 in one
    assert got[got.conv_id == 1].cost.sum() == chat.MERGE and got[got.conv_id == 2].cost.sum() == chat.RELABEL and "assistant" in two
