"""Each operator against brute force, a round trip or held-out accuracy, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import differences

from gleaner.llm import attention, bpe, chat, induced, langid, ledger, lm, packing, phrases, search, simhash, suffix_dedup
from gleaner.llm.common import most_frequent

SF = "/root/testdata/sf0.01"
VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [(None, None, None, "x"), (1, "", "en", "x"), (1, "", "en", "x"), (2, None, None, "y"), (3, "Wörter<|endoftext|> 中文 😀\x1c\x85 ok", "de", None), (4, "a" * 30_000, "en", "x"), (5, "the cat sat on the mat " * 60, "en", "x"), (6, "the cat sat on the mat " * 60, "en", "x"), (7, " \n\t", "fr", "z"), (8, "un", None, "z")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key int, label string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 7, 1, "q") for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text", "lang"]]


def ids_of(text, tokenizer=Tokenizer.from_file(VOCABULARY)):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


OPERATORS = {
    "bpe": lambda d: bpe.encode_documents(d, VOCABULARY, words=100),
    "lm": lambda d: lm.score(d, RANKS),
    "packing": lambda d: packing.pack_documents(d, RANKS),
    "search": lambda d: search.search_documents(d, d.where("doc_id % 2 = 1")),
    "phrases": phrases.fingerprint_documents,
    "suffixes": suffix_dedup.removal_digests,
    "cleaned": lambda d: suffix_dedup.remove_repeats(d, "lang", "label"),
    "simhash": simhash.near_duplicates,
    "langid": lambda d: langid.identify(d, langid.learn(d), "doc_id", "label"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, empty, name):
    assert OPERATORS[name](empty).count() == 0
    rows = OPERATORS[name](odd).collect()
    if name not in ("search", "packing"):
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)


def test_bpe_equals_library(spark, docs):
    some = docs.text.tolist()[:150] + [r[1] for r in ODD] + ["".join(random.Random(k).choices([chr(c) for c in range(32, 600)] + [" "] * 90 + ["<|endoftext|>", "　"], k=60)) for k in range(150)]
    rows = bpe.encode_documents(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), VOCABULARY, words=500, with_ids=True).collect()
    for r in rows:
        want = ids_of(some[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == (some[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((some[r.doc_id] or "").encode()).hexdigest()


def test_lexicon_shares_suffixes():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["walking", "talking", "walked", "talked", "w", "é"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.get(w) == ids for w, ids in words.items()) and lexicon.get(b"walk") is None and lexicon.n_states < sum(map(len, words))


def test_packing(spark, odd, docs):
    some = [(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)][:300]
    rows = packing.pack_documents(spark.createDataFrame(some, "doc_id long, text string"), RANKS).toPandas()
    for doc, own in rows.groupby("doc_id"):
        ids = np.array([*ids_of(dict(some)[doc]), 2], "<u4")
        own = own.sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all() and (own.start == own.length.cumsum() - own.length).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 1024 and (own.offset == own.length.cumsum() - own.length).all()


@pytest.mark.parametrize("seed", range(20))
def test_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 60), 20, 7]) for _ in range(rng.randint(0, 200))]
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(60 - n)
    bins: dict[int, int] = Counter()
    runs = packing.fit_runs(Counter(lengths), 60)
    for n, count in Counter(lengths).items():
        own = [r for r in runs if r[0] == n]
        for j in range(count):
            _, rank, first, each, _ = max(r for r in own if r[1] <= j)
            bins[first + (j - rank) // each] += n
    assert len(bins) == len(gaps) and sorted(60 - v for v in bins.values()) == sorted(gaps)


def components(values, near):
    label = list(range(len(values)))
    while True:
        new = [min(label[j] for j in range(len(values)) if near(values[i], values[j])) for i in range(len(values))]
        if new == label:
            return label
        label = new


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x = rng.integers(0, 1 << 63, dtype=np.int64)
        y = x
        for b in rng.integers(0, 64, 2):
            y ^= np.int64(np.uint64(1) << np.uint64(b))
        a, b = (set(simhash.fuzzy_keys(np.array([v], np.int64))[1].tolist()) for v in (x, y))
        assert a & b


@pytest.mark.parametrize("small", [128, 2])
def test_links_have_all_components(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 6)
    fps = sorted({int(v ^ np.int64(sum(1 << int(b) for b in set(rng.integers(0, 62, rng.integers(0, 5)))))) for v in base for _ in range(30)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    label = components(fps, near)
    assert [fps[k] for k in label] == [got.get(f, f) for f in fps]


def test_simhash_documents(spark, docs):
    rows = simhash.op10_simhash_near_dedup(spark, SF).toPandas().merge(docs, on="doc_id")
    assert rows.groupby("text").component_id.nunique().max() == 1 and (rows.component_id <= rows.doc_id).all()
    import xxhash

    for r in rows.head(40).itertuples():
        w = r.text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        assert int(r.fingerprint, 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def covered(text: np.ndarray, depth: int) -> np.ndarray:
    data = text.astype(np.uint16).tobytes()
    parts = [data[2 * i : 2 * (i + depth)] for i in range(len(text) - depth + 1)]
    n = Counter(parts)
    return np.array([i < len(parts) and n[parts[i]] > 1 for i in range(len(text))], bool)


@pytest.mark.parametrize("seed", range(150))
def test_induced_sorting(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, rng.integers(1, 150)).astype(np.uint16)
    if seed % 3 == 0:
        text = np.repeat(np.concatenate([text, text[: len(text) // 2]]), rng.integers(1, 4))
    depth = int(rng.integers(1, 12))
    assert (induced.repeated_starts(text, depth, limit=64 if seed % 2 else 1 << 20) == covered(text, depth)).all()


@pytest.mark.parametrize("hot", [6000, 3])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(4)
    rows = [(int(i), t[:3000]) for i, t in zip(docs.doc_id, docs.text, strict=True)][:150]
    for k in range(40):
        a, b = rng.choice(rows)[1], rng.choice(rows)[1]
        at = rng.randint(0, len(a))
        rows.append((5000 + k, b[: rng.randint(0, len(b))] + a[at : at + rng.randint(380, 900)] + b[-50:]))
    rows += [(6000, "a" * 1500), (6001, "xyzé" * 300), (6002, None), (6000, "a" * 1500), (6003, "我能吞下玻璃而不伤身体" * 9), (6004, "x " * 51), (6005, "x " * 52)]
    passages = Counter(tuple(words[k : k + 51]) for _, t in rows for words in [[u for w in (t or "").encode().split() for u in suffix_dedup.units_of_word(w)]] for k in range(len(words) - 50))
    seen = Counter(p for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 399) for p in [b[i : i + 400]])
    want = []
    for i, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                hit[p] += 1
                hit[p + 400] -= 1
        out = np.cumsum(hit)[:-1] > 0
        places = suffix_dedup.Words.places(b)
        words, inside = [b[x:y] for x, y in places], set()
        for k in range(len(words) - 50):
            if passages[tuple(words[k : k + 51])] > 1:
                inside.update(range(places[k][0], places[k + 50][1]))
        want.append((i, len(b), int(out.sum()), int((np.diff(np.append(0, out.astype(int))) == 1).sum()), hashlib.sha256(bytes(x for x, o in zip(b, out, strict=True) if not o)).hexdigest(), len(inside)))
    got = suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shard_bytes=20_000).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("form, length", [(suffix_dedup.Bytes, 80), (suffix_dedup.Bytes, 400), (suffix_dedup.Words, 51)])
def test_segments_without_a_common_window_are_left_out_before_sorting(form, length, monkeypatch):
    """Whatever has a window in common with another segment stays, however the segments are taken together; most of what shares one side of an anchor alone goes."""
    rng = np.random.default_rng(length)
    unit = (lambda n: rng.integers(97, 123, n).astype(np.uint8)) if form is suffix_dedup.Bytes else (lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64))
    texts = []
    for _ in range(40):
        core = unit(length)
        for _ in range(3):  # copies that are changed in one place
            t = np.concatenate([unit(length), core, unit(length)])
            t[length + int(rng.integers(length))] = unit(1)[0]
            texts.append(t)
        texts += [np.concatenate([unit(9), core, unit(k)]) for k in range(2)]
    parts, anchors = [], []
    for c in suffix_dedup.text_runs(texts, length, form):
        for which, at, n, anchor in zip(*(x.tolist() for x in c[:4]), strict=True):
            parts.append(texts[which][at : at + n + length - 1])
            anchors.append(anchor)
    order = np.argsort(anchors, kind="stable")
    kinds = Counter(anchors)
    order = [k for k in order.tolist() if kinds[anchors[k]] > 1]
    parts, anchors = [parts[k] for k in order], np.array([anchors[k] for k in order])
    windows = [{p[i : i + length].tobytes() for i in range(len(p) - length + 1)} for p in parts]
    whole = rng.random(len(parts)) < 0.2
    held = Counter(w for ws in windows for w in ws)
    open_ = Counter(w for ws, done in zip(windows, whole, strict=True) if not done for w in ws)
    need = np.array([any(held[w] > 1 and open_[w] for w in ws) for ws in windows])
    results = []
    for block in (1 << 20, 4 * length):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        results.append(suffix_dedup.alike(parts, anchors, whole, length, form.gram))
    assert (results[0] == results[1]).all() and results[0][need].all()
    assert need.any() and results[0][~need].mean() < 0.6


def test_codes_of_words_taken_together(monkeypatch):
    """A word has one code wherever it stands and whatever is taken with it, and different words of one to sixty bytes have different codes."""
    rng = random.Random(5)
    words = ["".join(rng.choices("aéb中\x00d", k=rng.choice([1, 2, 5, 8, 9, 16, 17, 60, 61, 70]))).encode() for _ in range(400)]
    texts = [b" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(300)] + [b"", b" "]
    every = []
    for group in (1 << 18, 100):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        every.append([c.tolist() for c in suffix_dedup.Words.codes_of(texts)])
    assert every[0] == every[1] == [suffix_dedup.Words.codes(t).tolist() for t in texts]
    units = [[u for w in t.split() for u in suffix_dedup.units_of_word(w)] for t in texts]
    assert [len(u) for u in units] == [len(c) for c in every[0]]
    pairs = {p for u, c in zip(units, every[0], strict=True) for p in zip(u, c, strict=True)}
    assert len(pairs) == len({u for u, _ in pairs}) == len({c for _, c in pairs})


def test_spans_of_many_rows_are_merged_at_once():
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    rows = [[(5, 9), (1, 5)], None, [], [(4, 9), (0, 3), (6, 7)], [(2, 4), (3, 8)]]
    column = pa.array([None if r is None else [{"from": a, "to": z} for a, z in r] for r in rows], kind)
    assert suffix_dedup.merged(column, 1) == [[(1, 9)], [], [], [(0, 3), (4, 9)], [(2, 8)]]
    assert suffix_dedup.merged(column, 0) == [[(1, 5), (5, 9)], [], [], [(0, 3), (4, 9)], [(2, 8)]]
    assert suffix_dedup.merged(column.slice(3), 1) == [[(0, 3), (4, 9)], [(2, 8)]]


def test_places_and_groups_of_windows(monkeypatch):
    """Units' places come as one array, equal to a walk over words and characters; windows are the same however many texts are taken together."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("aé中 \t\n\x0b\x85\xa0😀", k=rng.randrange(300))) + "é中x" * rng.randrange(60) for _ in range(200)] + ["", " ", "a", "x" * 61, " y" * 70]
    for data in (t.encode() for t in texts):
        want = []
        for m in re.finditer(rb"[^\x09-\x0d\x20]+", data):
            at = m.start()
            for u in suffix_dedup.units_of_word(m.group()):
                want.append((at, at + len(u)))
                at += len(u)
        places = suffix_dedup.Words.places(data)
        assert isinstance(places, np.ndarray) and list(map(tuple, places.tolist())) == want
    for form, length in ((suffix_dedup.Bytes, 80), (suffix_dedup.Words, 12)):
        codes, runs = [form.codes(t.encode()) for t in texts], []
        for group in (1 << 18, 700):
            monkeypatch.setattr(suffix_dedup, "GROUP", group)
            runs.append(sorted(r[:4] + r[6:] for c in suffix_dedup.text_runs(codes, length, form) for r in zip(*(x.tolist() for x in c), strict=True)))  # what stands beside an anchor counts only within the segment
        assert runs[0] and runs[0] == runs[1]


def test_chat_repair(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 2)
    rng, rows, want = random.Random(1), [], {}
    for conv in range(60):
        roles = [rng.randint(0, 4) for _ in range(rng.randint(1, 4))]
        rows += [(conv, k, (*chat.ROLES, None)[r], f"t{k}", 1) for k, r in enumerate(roles)]
        costs = []
        for way in itertools.product(range(4), repeat=len(roles)):
            state, cost = chat.START, 0.0
            for r, t in zip(roles, way, strict=True):
                ways = [chat.INSERT * len(w) for w in [chat.inserted().get((state, t))] if w is not None] + [chat.MERGE] * (state == t)
                cost += min(ways, default=math.inf) + (0 if r == t else chat.RELABEL if r < 4 else chat.RELABEL_UNKNOWN)
                state = t
            costs.append(cost + chat.INSERT * len(chat.inserted()[state, chat.START]))
        want[conv] = min(costs)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg int")
    got = chat.repair(df).toPandas()
    assert got.groupby("conv_id").cost.sum().to_dict() == want
    import re

    for _, own in got.sort_values(["conv_id", "seq"]).groupby("conv_id"):
        said, state = "".join(own.rendered), chat.START
        for role in re.findall(r"<\|im_start\|>(\w+)\n", said):
            assert chat.ROLES.index(role) in chat.LEGAL[state]
            state = chat.ROLES.index(role)
        assert state == 2
    assert chat.repair(df.where("false")).count() == 0
    assert chat.repair(spark.createDataFrame([(None, None, None, None), (None, 1, "USER ", "x")], "conv_id long, turn long, role string, text string")).count() == 2


def test_search_is_exact(spark, docs):
    got = search.op5_bm25_top_k(spark, SF).toPandas()
    counts = [Counter(search.terms_of(t)) for t in docs.text]
    df, n, size = Counter(t for c in counts for t in c), len(counts), np.array([c.total() for c in counts])
    for q, c in zip(docs.doc_id, counts, strict=True):
        if q % 50 == 0:
            scores = [sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * o[t] * 2.2 / (o[t] + 1.2 * (0.25 + 0.75 * size[j] / size.mean())) for t, m in c.items() if t in o) for j, o in enumerate(counts)]
            best = sorted((-round(s, 9), i) for s, i in zip(scores, docs.doc_id, strict=True) if s > 0)[:10]
            assert got[got.query_id == q].sort_values("rank").doc_id.tolist() == [i for _, i in best]


def test_language_accuracy(spark, docs):
    rows = langid.op8_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()


def test_phrase_fingerprints(spark, docs):
    rows = phrases.op6_phrase_fingerprints(spark, SF).toPandas().sort_values("doc_id")
    texts = docs.sort_values("doc_id").text.tolist()
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert rows.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    assert rows.assign(t=texts).groupby("t").fingerprint.nunique().max() == 1
    assert rows.near_edited.mean() > 0.25 and rows.near_next.mean() < 0.02
    moved = phrases.sketches([texts[0], "some words before it, " + texts[0]])
    assert phrases.likeness(moved[:1], moved[1:])[0] > 0.6


def test_token_ledger(spark):
    query = lambda s, sf: ledger.kept_totals(s.read.parquet(f"{sf}/documents.parquet"), s.read.parquet(f"{sf}/labels.parquet"), lambda d, c: ledger.counted_by_patterns(d, c, ledger.PATTERNS), tuple(ledger.PATTERNS))
    assert differences(spark, query, ledger.PATTERNS_SQL, SF) == ""


def test_token_counts_of_public_vocabularies(spark):
    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic, low = set(labels[labels.toxic == 1].doc_id), set(labels[labels.quality == 0].doc_id)
    count = {v: packing.token_ids(public_tokenizers.path(f)) for v, f in ledger.RANKS.items()}
    want: dict[tuple, list] = {}
    for d in docs.itertuples():
        for v, encode in count.items():
            first = v == "byte-bpe-50k"
            if first or d.doc_id not in toxic:
                text = d.text.split("\n")[0] if first and d.doc_id in low else d.text
                own = want.setdefault((d.source, d.lang, v), [0, 0, 0])
                if d.doc_id not in toxic:
                    own[:] = [own[0] + 1, own[1] + len(encode(text)), own[2] + len(text)]
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in ledger.op9_token_counts(spark, SF).where("level = 0").collect()}
    assert got == want and len(ids_of(docs.text[0])) == len(count["byte-bpe-50k"](docs.text[0]))


def test_ledger_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    run = lambda d: ledger.kept_totals(d, labels, lambda x, c: ledger.counted_by_patterns(x, c, ledger.PATTERNS), tuple(ledger.PATTERNS))
    assert run(empty).where("level = 0").count() == 0
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in run(odd).where("level = 0").collect()}
    assert got["x", None, "words-v1"][0] == 1 and got["y", None, "marks-v2"] == (1, 0) and got[None, "de", "words-v1"] == (1, 4)


def test_ledger_survives_cuts_and_repeats(spark, tmp_path):
    book, rows = ledger.Ledger(spark, f"file://{tmp_path}/l"), spark.createDataFrame([(None, "en", 5, 9), ("s", None, 2, 3)], "source string, lang string, n_tokens long, n_chars long")
    assert book.totals().count() == 0 and book.commit("a", ledger.signed(rows, "t", 1)) and not book.commit("a", ledger.signed(rows, "t", 1))
    (tmp_path / "l/batches/b").mkdir()  # cut off before its marker
    (tmp_path / "l/batches/b/part-0.parquet").write_bytes(b"broken")
    assert {r.source: (r.n_docs, r.n_tokens) for r in book.totals().collect()} == {None: (1, 5), "s": (1, 2)}
    assert book.commit("b", ledger.signed(rows.where("source = 's'"), "t", -1))
    book.compact()
    (tmp_path / "l/snapshots/000000001/totals").mkdir(parents=True)  # a snapshot that was cut off doesn't count
    assert not book.commit("a", ledger.signed(rows, "t", 1)) and book.commit("c", ledger.signed(rows, "t", 1))
    assert {r.source: (r.n_docs, r.n_tokens, r.n_chars) for r in book.totals().collect()} == {None: (2, 10, 18), "s": (1, 2, 3)}


def test_scores_do_not_depend_on_partitions(spark, docs):
    some = spark.createDataFrame(docs[["doc_id", "text"]][:150].values.tolist() + [[7, "again and again"]] * 5, "doc_id long, text string")
    each = [sorted(map(tuple, lm.score(d, RANKS).select("doc_id", "score", "base_score").collect())) for d in (some.repartition(2), some.repartition(7, "text"), some.orderBy("text").coalesce(1))]
    assert all(np.allclose([r[1:] for r in each[0]], [r[1:] for r in other], rtol=1e-6) and [r[0] for r in other] == [r[0] for r in each[0]] for other in each[1:])


def test_shards_hold_every_flow_in_one_order(spark):
    flows = [bytes([k % 256, k // 256]) * (1 + k % 5) for k in range(300)] + [b"aa"] * 200
    cut = [lm.in_shards(spark.createDataFrame([(f,) for f in flows], "ids binary").repartition(n), 100)[0] for n in (2, 5)]
    a, b = ([(r.shard, bytes(r.ids)) for r in c.orderBy("at").collect()] for c in cut)
    assert a == b and sorted(x for _, x in a) == sorted(flows) and len({s for s, _ in a}) > 5


def test_lm_base_and_model(spark, docs):
    rows = lm.op3_lm_scores(spark, SF).toPandas().set_index("doc_id")
    words = {i: [*t.encode().lower().split(), b""] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = c.total(), len(c)
    for i, ws in words.items():
        r = rows.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    assert rows[rows.held_out].score.sum() > rows[rows.held_out].base_score.sum()


def test_words_of_a_first_subword_add_up_to_one():
    stop = attention.STOP
    can = np.isin(np.arange(stop), [0, 1, stop - 1])
    after = np.bincount([5, 6, stop], [9, 2, 20], stop + 1)
    spelling = attention.Spelling(np.array([0 << 16 | 5, 0 << 16 | stop, 5 << 16 | stop]), np.array([3, 4, 3]), after, can, np.zeros(stop, np.int64))
    every = np.arange(stop + 1)
    for token in (0, 5, 7):  # with pairs and without: all that can stand after a subword
        step = spelling.rest(every, np.full(stop + 1, token), every, np.zeros(stop + 1, np.int64), np.zeros(stop + 1))
        assert np.exp(step).sum() == pytest.approx(1)
    words = [(), (5,), (6,), (5, 5), (7, 6)]
    spell = np.repeat(np.arange(5), [1, 2, 2, 3, 3]), np.concatenate([[0, *w] for w in words]), np.concatenate([[*w, stop] for w in words]), np.zeros(5, np.int64)
    spelt = np.exp(spelling.rest(*spell, np.zeros(5)))
    spelling.begun[0], spelling.kinds[0] = 7, 2
    got = np.exp(spelling.rest(*spell, np.array([4, 3, 0, 0, 0])))
    unseen = got[2] / spelt[2]  # what all words without a count have in common
    assert got.sum() + unseen * (1 - spelt.sum()) == pytest.approx(1) and got[3:] == pytest.approx(spelt[3:] * unseen) and got[0] > got[1] > 0.2
    long = spelling.rest(np.zeros(2000, np.int64), np.full(2000, 7), np.append(np.full(1999, 7), stop), np.zeros(1, np.int64), np.zeros(1))
    assert long[0] < -1500  # no floor


def test_a_text_is_cut_once_and_chunks_keep_it(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_CHARS", 3000)
    some = docs[["doc_id", "text"]][:40].values.tolist() + [[900, ""], [901, "\u00a0 \u00a0\u00a0 x\u00a0 \u3000"], [None, "w" * 5000]]
    table = spark.createDataFrame(some, "doc_id long, text string").selectExpr("doc_id", "text", "coalesce(doc_id % 3 = 0, false) held")
    rows = lm.chunks(table, RANKS).toArrow()
    encode, got, n = lm.token_ids(RANKS), Counter(), Counter()
    for row, c in lm.each_chunk(rows.to_batches()):
        words, ends = row["words"].as_py().split(b" "), np.cumsum(c.cuts)
        assert len(set(words)) == len(words)
        for k, w in enumerate(words):
            assert c.ids[ends[k] - c.cuts[k] : ends[k]].tolist() == (lm.ids_of([w], encode).tolist() if w else [])
        n.update({w: int(x) for w, x in zip(words, c.n, strict=True) if x})
        got.update((i, h, tuple(words[x] for x in part)) for i, h, part in zip(row["doc_id"].as_py(), row["held"].as_py(), np.split(c.numbers, np.cumsum(c.sizes)[:-1]), strict=True))
    want = [(i, i is not None and i % 3 == 0, (*lm.words_of(t), b"")) for i, t in some]
    assert got == Counter(want) and len(rows) > 3 and n == Counter(w for _, h, ws in want if not h for w in ws)
    # counts come back to every chunk
    counts, _ = lm.count_words(spark.createDataFrame(rows))
    back = {r.chunk: {} for r in counts.collect()}
    for r in counts.collect():
        back[r.chunk].update(zip(np.frombuffer(r.numbers, np.int32).tolist(), np.frombuffer(r.c, np.int64).tolist(), strict=True))
    for row, c in lm.each_chunk(rows.to_batches()):
        assert back[row["chunk"].as_py()] == {k: n[w] for k, w in enumerate(row["words"].as_py().split(b" "))}


def test_most_frequent_is_bounded(spark):
    counts = spark.createDataFrame([("a", 5), ("d", 1), *((f"b{k}", 3) for k in range(400))], "word string, n long")
    got = {most: {r.word for r in most_frequent(counts, most).collect()} for most in (0, 1, 101, 401, 900)}
    assert not got[0] and got[1] == {"a"} and len(got[401]) == 401 and len(got[900]) == 402
    assert "a" in got[101] and "d" not in got[101] and 60 < len(got[101]) < 140
    assert most_frequent(counts.where("false"), 3).count() == 0


def test_tokens_of_a_class_add_up_to_one():
    rng, tokens = np.random.default_rng(0), 300
    class_of = np.arange(tokens) % attention.CLASSES
    near = np.unique(rng.integers(0, 20, 500) << 16 | rng.integers(0, tokens, 500))
    after, pairs = rng.integers(0, 9, (attention.OWN + attention.CLASSES, attention.CLASSES)), rng.integers(0, 9, (attention.CLASSES, tokens))
    t = attention.Tables.counted(class_of, np.arange(tokens), after, pairs, near, rng.integers(1, 50, len(near)))
    for before in (0, 7, 250):
        all_ = np.arange(tokens)
        same = np.full(tokens, before)
        sums = np.bincount(class_of, np.exp(t.within(same, same, all_, class_of)), attention.CLASSES)
        assert sums == pytest.approx(np.ones(attention.CLASSES), rel=1e-4)


def test_shared_ranks_sort_like_all(monkeypatch):
    rng = np.random.default_rng(6)
    text = np.concatenate([rng.integers(1, 4, 3000), np.tile(rng.integers(1, 4, 50), 30), np.ones(90, int)]).astype(np.uint16)
    sorted_keys, plain = [], np.argsort
    monkeypatch.setattr(induced.np, "argsort", lambda x, **kw: (sorted_keys.append(len(x)), plain(x, **kw))[1])
    for depth in (5, 40, 400):
        seeds, lcp = induced.sorted_seeds(induced.Shard(text, 5), depth, 1 << 20)
        tails = [text[i : i + depth].tolist() for i in seeds]
        assert tails == sorted(tails)
        for k in range(1, len(seeds)):
            same = next((j for j, (x, y) in enumerate(zip(tails[k - 1], tails[k], strict=False)) if x != y), min(map(len, tails[k - 1 : k + 1])))
            assert min(int(lcp[k]), depth) == min(same, depth)
    monkeypatch.setattr(induced.np, "argsort", plain)
    assert sorted_keys[-1] < len(seeds) / 2  # the last round takes those alone that are not told apart yet


def test_empty_lexicon_holds_nothing():
    lexicon = bpe.Lexicon(bpe.compile_lexicon({}))
    assert lexicon.get(b"word") is None and lexicon.get(b"") is None


@pytest.mark.parametrize("lengths", [[3], [23], [24], [25], [49, 1, 0, 30]])
def test_training_reaches_every_token(monkeypatch, lengths):
    tokens, end = 300, 299
    t = attention.Tables.counted(np.arange(tokens) % attention.CLASSES, np.arange(tokens), np.ones((attention.OWN + attention.CLASSES, attention.CLASSES)), np.ones((attention.CLASSES, tokens)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    texts, seen, plain = [np.arange(n) for n in lengths], Counter(), attention.gradients

    def watched(p, bigram, slots, classes, real=None):
        seen.update(zip(slots[real].tolist() if real is not None else slots.ravel().tolist(), classes[real].tolist() if real is not None else classes.ravel().tolist(), strict=True))
        return plain(p, bigram, slots, classes, real)

    monkeypatch.setattr(attention, "gradients", watched)
    p = attention.fresh()
    assert attention.train_on(p, t, iter(texts), end) == 1 and p["top"].any()
    want = Counter()
    for x in texts:
        flow = [end, *x.tolist(), end]
        want.update((a, b % attention.CLASSES) for a, b in itertools.pairwise(flow))
    assert seen == want


def test_masked_gradients_leave_padding_out():
    rng = np.random.default_rng(8)
    p, bigram = attention.fresh(), rng.normal(size=(attention.OWN + attention.CLASSES, attention.CLASSES)).astype(np.float32)
    p["top"] = rng.normal(size=p["top"].shape).astype(np.float32)
    slots, classes = rng.integers(0, 100, (3, attention.WINDOW)), rng.integers(0, attention.CLASSES, (3, attention.WINDOW))
    short = attention.gradients(p, bigram, slots[:, :7], classes[:, :7])
    padded = attention.gradients(p, bigram, slots, classes, np.arange(attention.WINDOW) < np.full((3, 1), 7))
    assert all(np.allclose(short[k], padded[k], atol=1e-5) for k in short)


def test_search_of_repeated_query_ids(spark):
    texts = ["red fox runs", "blue whale swims deep", "red whale", "green fox", "blue blue sky", "deep red sky", "fox whale sky", "green sea"] * 3
    docs = spark.createDataFrame([(100 + i, f"{t} n{i}") for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    asked = [(1, "red fox"), (1, "blue whale"), (1, "red fox"), (2, "deep sky n3")]
    got = search.search_documents(docs, spark.createDataFrame(asked, "doc_id long, text string").repartition(2), k=5).toPandas()
    want = Counter()
    for k, (_, t) in enumerate(asked):  # each by itself
        for r in search.search_documents(docs, spark.createDataFrame([(k, t)], "doc_id long, text string"), k=5).collect():
            want[(asked[k][0], r.doc_id, r.score, r["rank"])] += 1
    assert Counter((r.query_id, r.doc_id, r.score, r.rank) for r in got[["query_id", "doc_id", "score"]].assign(rank=got["rank"]).itertuples()) == want
    counts = [Counter(search.terms_of(f"{t} n{i}")) for i, t in enumerate(texts)]
    mean = sum(c.total() for c in counts) / len(counts)
    idf = {w: math.log(1 + (len(counts) - n + 0.5) / (n + 0.5)) for w, n in Counter(w for c in counts for w in c).items()}
    for r in got.itertuples():
        c = counts[r.doc_id - 100]
        scores = [sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in search.terms_of(t) if c[w]) for i, t in asked if i == r.query_id]
        assert any(abs(s - r.score) < 1e-6 for s in scores)


def test_search_skips_blocks_and_scores_queries_together():
    """documents of one kind share blocks, those of a kind that can't reach the threshold are left unread, and queries are as right together as each by itself."""
    rng, held = random.Random(5), search.Postings()
    kinds = [[f"{k}{j}" for j in range(300)] for k in "ab"]
    texts = [rng.choices(kinds[i % 2], k=40) + rng.choices([f"s{j}" for j in range(20)], k=20) for i in range(2 * 2048)]
    for i, t in enumerate(texts):
        held.add(i, " ".join(t))
    mean, n = sum(held.lengths) / len(held.ids), len(held.ids)
    shard, parts = search.Shard(held.row(), mean), [Counter(t) for t in texts]
    queries, want = [], []
    for i in range(0, n, 97):
        terms = np.array([shard.number[x] for x in parts[i]], np.int64)
        df = shard.start[terms + 1] - shard.start[terms]
        weights = np.log(1 + (n - df + 0.5) / (df + 0.5)) * np.array(list(parts[i].values()))
        w = dict(zip(parts[i], weights.tolist(), strict=True))
        scores = [sum(w[x] * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * 60 / mean)) for x in w if c[x]) for c in parts]
        want.append(sorted((-round(s, 9), j) for j, s in enumerate(scores))[:10])
        queries.append((terms, weights, -want[-1][-1][0] - 1e-8))
    got = [[(-s, shard.ids[d]) for s, d in best] for best in shard.best_of(queries, 10)]
    assert [[j for _, j in x] for x in got] == [[j for _, j in x] for x in want]
    assert np.allclose([[s for s, _ in x] for x in got], [[s for s, _ in x] for x in want])
    assert shard.read < 0.8 * shard.held  # a third of what a query's terms have lies in the other kind's block
    assert got == [[(-s, shard.ids[d]) for s, d in shard.best(*q, 10)] for q in queries]
    assert shard.best_of([(q[0], q[1], 0.0) for q in queries[:3]], 10) == shard.best_of(queries[:3], 10)


def test_search_takes_queries_through_a_block_together(monkeypatch):
    """F1: steps in Python grow with a shard's blocks, not with its queries, and a query that finds nothing above its threshold scores nothing; the results are those of brute force."""
    rng, held, calls = random.Random(7), search.Postings(), Counter()
    texts = [rng.choices([f"c{j}" for j in range(60)], k=rng.randint(5, 60)) + rng.choices([f"r{j}" for j in range(900)], k=8) for _ in range(2 * 2048 + 9)]
    for i, t in enumerate(texts):
        held.add(i, " ".join(t))
    shard, mean, n = search.Shard(held.row(), sum(held.lengths) / len(held.ids)), sum(held.lengths) / len(held.ids), len(held.ids)
    for name in ("scores", "exact"):
        monkeypatch.setattr(search.Shard, name, lambda *a, name=name, real=getattr(search.Shard, name): calls.update([name]) or real(*a))
    parts, queries, want = [Counter(t) for t in texts], [], []
    for i in range(0, 600, 3):
        terms = np.array([shard.number[x] for x in parts[i]], np.int64)
        df = shard.start[terms + 1] - shard.start[terms]
        weights = np.log(1 + (n - df + 0.5) / (df + 0.5)) * np.array(list(parts[i].values()))
        w = dict(zip(parts[i], weights.tolist(), strict=True))
        scores = [sum(x * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for t, x in w.items() if t in c) for c in parts]
        want.append(sorted((-round(s, 9), j) for j, s in enumerate(scores) if s > 0)[:10])
        queries.append((terms, weights, 0.0))
    none = (np.zeros(0, np.int64), np.zeros(0), 0.0)
    got = shard.best_of([*queries, none], 10)
    assert got.pop() == [] and [[shard.ids[d] for _, d in x] for x in got] == [[j for _, j in x] for x in want]
    assert np.allclose([[s for s, _ in x] for x in got], [[-s for s, _ in x] for x in want])
    assert calls["scores"] <= shard.blocks and calls["exact"] == len(queries)
    assert shard.best_of([(t, w, 1e6) for t, w, _ in queries], 10) == [[]] * len(queries) and calls["exact"] == len(queries)
    again = shard.best_of([(t, w, x[-1][0] - 1e-8) for (t, w, _), x in zip(queries, got, strict=True)], 10)
    assert again == got


def test_search_reads_few_postings():
    """Where a few rare words decide, most postings are left unread."""
    rng, held = random.Random(3), search.Postings()
    for i in range(3000):
        held.add(i, " ".join([*rng.choices([f"c{k}" for k in range(40)], k=60), *([f"r{i % 100}a", f"r{i % 100}b", f"r{i % 100}c"] * 4)]))
    mean, n = sum(held.lengths) / len(held.ids), len(held.ids)
    whole, pruned = (search.Shard(held.row(), mean) for _ in range(2))
    for i in range(0, 3000, 50):
        c = Counter([*rng.choices([f"c{k}" for k in range(40)], k=20), f"r{i % 100}a", f"r{i % 100}b", f"r{i % 100}c"])
        terms = np.array([whole.number[x] for x in c], np.int64)
        df = whole.start[terms + 1] - whole.start[terms]
        weights = np.log(1 + (n - df + 0.5) / (df + 0.5)) * np.array(list(c.values()))
        best = whole.best(terms, weights, 0.0, 10)
        assert len(best) == 10 and pruned.best(terms, weights, best[-1][0] - 1e-8, 10) == best
    assert 0 < pruned.read < 0.3 * whole.read
