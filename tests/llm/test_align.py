"""Aligned tokens against a plain walk over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from docgrowth.llm import align, queries

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NOISE = ["a", "foo", " ", "  ", "\n", "\t", "é", "e\u0301", "ﬁ", "<s>", "<|endoftext|>", "'s", "123", "漢字", "😀", "\x00", "<0x41>", "...", "\u061f", "b", "Haus"]
ODD = ["\u2581", "\r", "\u3000", "\xa0", "\u200b", "\x1c", "\u2028", "\u180e", "\ufeff"]


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(texts):
    both, found, counts = align.Sides(A, B), {}, Counter()
    for i, t in texts:
        raw = f" {t}".encode()
        a, b = (both.a.encode(f" {t}", add_special_tokens=False).ids, both.b.encode(t)) if t else ([], [])
        a_parts, b_parts = [both.a_bytes[x] for x in a], [both.b_bytes[x] for x in b]
        if not t or b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            found[i] = None
            continue
        a_at, b_at, groups, links, low, first = spans(a_parts), spans(b_parts), [], [], 0, 0
        for cut in sorted({e for _, e in a_at} & {e for _, e in b_at}):
            groups.append("|".join(",".join(str(x) for x, (s, _) in zip(ids, at, strict=True) if low <= s < cut) for ids, at in ((a, a_at), (b, b_at))))
            low = cut
        for x, (s, e) in zip(a, a_at, strict=True):
            while b_at[first][1] <= s:
                first += 1
            at = first
            while at < len(b) and b_at[at][0] < e:
                links.append((x, b[at]))
                at += 1
        found[i] = len(a), len(b), groups, links
        counts.update(links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    zero = (0, 0, 0, 0, 0, 0, "")
    return {
        i: zero if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for i, f in found.items()
    }


def results(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def noise(seed, n):
    r = random.Random(seed)
    return [(k, "".join(r.choice(NOISE + ODD * (k % 3 == 0)) for _ in range(r.randint(0, 40)))) for k in range(n)]


@pytest.mark.parametrize(("bound", "kept"), [(1_000_000, 200_000), (0, 200_000), (1_000_000, 5), (0, 5)])
def test_equals_a_plain_walk(spark, bound, kept):
    docs = [*noise(1, 300), (None, "null id"), (-1, None), (-2, ""), (-3, " "), (-4, "  "), (-5, "\n"), (-6, "\nfoo"), (-7, "a "), (2**60 + 1, "big id")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    got = results(align.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), A, B, pairs=bound, kept_units=kept))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == plain(docs)


def test_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert results(queries.op12_alignment(spark, DATA)) == plain(docs)


def test_rows_that_repeat_have_a_result_each(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, "one two"), (None, None)], "doc_id int, text string")
    broadcast, joined = (sorted(map(str, align.align(docs, A, B, pairs=n).collect())) for n in (1000, 0))
    assert broadcast == joined and len(joined) == 5


def test_edges(spark):
    odd = spark.createDataFrame([(1, "ab", "x", 5)], "doc_id int, text string, k string, pair int")
    assert [r["n_groups"] > 0 for r in align.align(odd, A, B).collect()] == [True]
    for bound in (1000, 0):
        none = align.align(odd.filter("false"), A, B, pairs=bound)
        assert none.collect() == [] and none.columns[0] == "doc_id"
