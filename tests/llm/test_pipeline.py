import random

import corpus_pipeline
import pytest
from test_operators import ODD
from pyspark.sql import functions as F

from gleaner.llm import shingles

SF = "/root/testdata/sf0.01"


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    kept = {r.doc_id for r in docs.collect()}
    known = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert known.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in docs.where("text rlike '[a-zA-Z]'").collect()}
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert one.columns == corpus_pipeline.COLUMNS and one.count() == 197  # of 198 texts two have a similarity of 0.967
    whole = corpus_pipeline.remove_repeated_passages(spark, docs, SF)
    assert whole.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in whole.collect()} == kept
    assert whole.where(F.length("text") != F.col("n_chars")).count() == 0


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 1024 and rows.doc_id.nunique() > 900


def jaccard(a, b, width=5):
    a, b = ({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in (a.encode().lower().split(), b.encode().lower().split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("rounds", "block"), [(3, 128), (0, 3)])
def test_near_copies_against_brute_force(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(shingles, "ROUNDS", rounds)
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng, texts = random.Random(5), []
    for k in range(60):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 5, 6, 8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"x{rng.randint(0, 10**9)}"
            texts.append(" ".join(copy))
    pairs = {(a, b): jaccard(texts[a], texts[b]) for k in range(0, len(texts), 8) for a in range(k, k + 8) for b in range(k, a)}
    assert all(sum(low <= s < low + 0.05 for s in pairs.values()) > 20 for low in (0.75, 0.8, 0.85, 0.9))
    label = list(range(len(texts)))
    for _ in range(8):
        for (a, b), s in pairs.items():
            if s >= 0.8:
                label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == set(label)


ROWS = [(None, "a text of six words here"), (None, "another text without an id is kept"), (None, "another text without an id is kept"), (1, "one text under one id"), (1, "one text under one id"), (1, "quite a different text under that id"), (0, "quite a different text under that id"), (2, "a text of six words here"), (3, None), (4, ""), (5, " \n\t"), (6, "un"), (7, "the cat sat on the mat " * 60)]


def test_near_copies_of_rows_without_and_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, ROWS[1][1]), (0, ROWS[6][1]), (1, ROWS[3][1]), (2, ROWS[7][1]), (3, None), (6, "un"), (7, ROWS[12][1])], key=str)


def test_all_stages_on_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 0) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {3, 4, 5, 8}


def test_passages_of_over_fifty_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 5)))
    rows, want = [], {}
    for k, n in enumerate((45, 50, 51, 53, 55, 60, 65, 120)):
        passage = " ".join(word() for _ in range(n))
        for j, blank in enumerate(" \n"):
            head, tail = (" ".join([f"{side}{k}{j}", *(word() for _ in range(80)), f"{side}{j}{k}"]) for side in "ht")
            rows.append((2 * k + j, head + blank + passage + blank + tail))
            want[2 * k + j] = head + blank + ("" if n > 50 else passage) + blank + tail
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_passages(spark, docs, SF).collect()} == want
