"""Removal of repeated passages against a plain search over all strings of the length."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from docgrowth.llm import queries, suffixes

DATA = "/root/testdata/sf0.001"


def plain(docs, length):
    """(bytes, removed, spans, digest of the rest) of each id, by a set of all strings met so far."""
    met, out = set(), {}
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in met:
                gone[s : s + length] = b"\1" * length
            met.add(raw[s : s + length])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = len(raw), sum(gone), sum(gone[j] and not (j and gone[j - 1]) for j in range(len(gone))), hashlib.sha256(kept).hexdigest()
    return out


def results(df):
    return {r[0]: tuple(r)[1:5] for r in df.collect()}


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(20, 90))) for _ in range(30)]
    docs = [(None, "x" * 150)]
    for i in range(120):
        kind = r.random()
        t = "".join(r.choice(base) if r.random() < 0.6 else "".join(r.choice("abcd") for _ in range(r.randint(5, 60))) for _ in range(r.randint(0, 12)))
        if kind < 0.1:
            t = "ab" * 300 if kind < 0.05 else None
        elif kind > 0.9:
            t = "x" * 700 if kind > 0.95 else ""
        elif kind > 0.7:
            t = docs[r.randrange(len(docs))][1]
        docs.append((3 * i - 7, t))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "length", "gram"), [(0, 100, 24), (1, 20, 8), (2, 20, 20), (3, 5, 1)])
def test_equals_a_plain_search(spark, monkeypatch, seed, length, gram):
    monkeypatch.setattr(suffixes, "SPLIT", seed)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert results(suffixes.without_repeats(df, length, gram=gram)) == plain(docs, length)


def test_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert results(queries.op13_suffix_dedup(spark, DATA)) == plain(docs, 100)


@pytest.mark.parametrize("split", [20, 2000])
def test_one_gram_in_most_rows_is_split_over_ranges(spark, monkeypatch, split):
    """A passage that stands in every document between different neighbours: its grams span all ranges."""
    monkeypatch.setattr(suffixes, "SPLIT", split)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = word(130)
    docs = [(n, word(150) + passage + word(150)) for n in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = results(suffixes.without_repeats(df))
    assert got == plain(docs, 100)
    assert all(v[1] >= 130 for k, v in got.items() if k)


def test_rows_that_repeat_an_id(spark):
    a, b = "abcdefghij" * 20, "klmnopqrst" * 20
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a), (2, b)], "doc_id long, text string")
    got = [tuple(r) for r in suffixes.without_repeats(df, keep=True).collect()]
    rest = {(r[0], bytes(r[5])[:3], r[2]) for r in got}
    assert len(got) == 5 and len({r[:3] for r in got if r[0] == 1}) == 1  # both texts keep their first string, and their copies alike
    assert {(2, b"", 200)} == {x for x in rest if x[0] == 2}


def test_long_texts_are_cut_without_a_seam(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    texts = [b"x" * n for n in (0, 9, 10, 11, 41, 42, 50, 500)]
    starts = {n: [] for n in range(len(texts))}
    for rows, at, raw in suffixes._parts(texts, 10):
        assert sum(map(len, raw)) <= 64
        for n, a, part in zip(rows, at, raw, strict=True):
            assert part == texts[n][a : a + len(part)]
            starts[n] += range(a, a + len(part) - 9)
    assert starts == {n: [*range(len(t) - 9)] for n, t in enumerate(texts)}


@pytest.mark.parametrize("step", [1, 100, 1 << 20])
def test_windows_of_a_range_by_steps(monkeypatch, step):
    monkeypatch.setattr(suffixes, "STEP", step)
    r = random.Random(step)
    raws = ["".join(r.choice("ab") for _ in range(r.randint(6, 12))).encode() for _ in range(200)]
    k = [n % 7 for n in range(200)]
    rows = pd.DataFrame({"k": k, "d": range(200), "tie": 0, "lo": 0, "raw": raws})
    got = pd.concat([*suffixes._windows(iter([rows[:90], rows[90:]]), 6, True)])
    met, want = set(), {}
    for n, raw in enumerate(raws):
        for s in range(len(raw) - 5):
            if (x := (k[n], raw[s : s + 6])) in met:
                want.setdefault(n, set()).update(range(s, s + 6))
            met.add(x)
    covered = {}
    for d, lo, hi in zip(got["d"], got["lo"], got["hi"], strict=True):
        covered.setdefault(d, set()).update(range(lo, hi))
    assert covered == want


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(empty).collect() == []
    assert suffixes.without_repeats(empty).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    nothing = hashlib.sha256(b"").hexdigest()
    odd = spark.createDataFrame([(1, None, 5, "a"), (2, "", 6, "b"), (3, "kurz", 7, "c")], "doc_id int, text string, d int, k string")
    assert {(r[0], *r[1:4]) for r in suffixes.without_repeats(odd).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0), (3, 4, 0, 0)}
    assert [r["kept_sha256"] for r in suffixes.without_repeats(odd).orderBy("doc_id").collect()][:2] == [nothing] * 2
    with pytest.raises(ValueError):
        suffixes.without_repeats(odd, length=10, gram=11)


def test_multikey_order():
    r = np.random.default_rng(0)
    columns = [r.integers(0, 4, 500) for _ in range(4)]
    assert [tuple(c[k] for c in columns) for k in suffixes.multikey_order(columns)] == sorted(zip(*columns, strict=True))
    assert len(suffixes.multikey_order([np.zeros(0, np.int64)] * 3)) == 0
