"""Ranked search against its SQL and against a plain loop."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from docgrowth.llm import queries, search

DATA = "/root/testdata/sf0.001"
_TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, top):
    split = [(i, _TERM.findall((t or "").translate(_LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    out = []
    for item, text in items:
        wanted = _TERM.findall((text or "").translate(_LOWER))
        found = []
        for i, t in split:
            tf, total = Counter(t), 0
            for w in wanted:
                if tf[w]:
                    m = 100 - 75 + 75 * len(t) * n_docs // n_terms
                    total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m))
            if total > 0:
                found.append((-total, i is None, i or 0, i))
        out += [(item, n, x[3], -x[0]) for n, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=lambda r: r[:2])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def texts(seed, n, words):
    r = random.Random(seed)
    pool = ["Haus", "haus", "été", "ÉTÉ", "a1", "x-y", "\u0085", "ﬁ", "don't", *(f"w{k}" for k in range(40))]
    phrases = [" ".join(r.choice(pool) for _ in range(4)) for _ in range(6)]
    return [" ".join(r.choice(phrases) if r.random() < 0.3 else r.choice(pool) for _ in range(r.randint(0, words))) for _ in range(n)]


@pytest.mark.parametrize(("top", "block", "at_once"), [(10, 256, 4096), (3, 4, 7), (1, 2, 2)])
def test_equals_a_plain_loop(spark, monkeypatch, top, block, at_once):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "PASS", at_once)
    docs = [*enumerate(texts(1, 200, 30)), (None, "w1 w2 haus"), (500, None), (501, ""), (502, "Haus"), (503, "Haus")]
    items = [*enumerate(texts(2, 15, 12)), (90, ""), (91, None), (92, "nothere"), (93, "haus haus HAUS")]
    got = rows(search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), top))
    assert got == plain(docs, items, top)


def test_given_tables_equal_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(queries.op11_ranked_search(spark, DATA)) == sorted(con.execute(search.SQL).fetchall())


def test_shared_sets_are_summed_once():
    items = [{0, 1, 2, 3}, {0, 1, 2, 4}, {0, 1, 2}, {3, 4}]
    dag = search.Sharing(items, 5)
    leaf = search.np.arange(1, 11).reshape(5, 2)
    assert dag.scores(leaf).tolist() == [leaf[sorted(x)].sum(axis=0).tolist() for x in items]
    assert len(dag.pairs) + len(dag.nodes) < sum(map(len, items))


def test_edges(spark):
    docs, items = spark.createDataFrame([(1, "a b", 3, "z")], "doc_id int, text string, d int, item_id string"), spark.createDataFrame([(5, "b", 1), (5, "a", 2), (None, "a", 3)], "item_id int, text string, doc_id int")
    assert [tuple(r)[:3] for r in search.search(docs, items).collect()] == [(5, 1, 1)]  # one row an id, by its smallest text
    none = docs.filter("false")
    for d, i in ((none, items), (docs, items.filter("false")), (none, items.filter("false"))):
        got = search.search(d, i)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]
