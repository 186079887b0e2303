"""Tables made to hurt: periodic texts, keys with many classes, orders that mislead samples, empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_brute import plain_overlaps, story
from test_small import brute_components

from docgrowth.llm import ann, decontam, jaccard, langid, pii, toxicity, urls
from docgrowth.llm.hashing import LETTERS, word_hashes


@pytest.mark.parametrize("period", range(1, 12))
def test_periodic_texts_have_few_windows(period):
    words = " ".join(story(period, period))
    for hashed, begins in word_hashes([" ".join([words] * 4000)], LETTERS):
        kept = sum(len(p) for _, p, *_ in decontam.windows_in(hashed, begins, list(decontam.MASKS)))
        assert kept <= len(decontam.MASKS) * 2 * period


def test_periodic_passages_equal_a_plain_search(spark):
    r, docs = random.Random(3), {}
    ab, abc = ["a", "b"], ["a", "b", "c"]
    items = {1: " ".join(ab * 30), 2: " ".join(["x", *abc * 12, "y", "z"]), 3: " ".join(story(1, 8) + ab * 9 + story(2, 8)), 4: "q " * 25}
    for i in range(40):
        w = story(50 + i, r.randint(0, 5)) + r.choice([ab, abc, ["q"], ["a", "a", "b"]]) * r.randint(1, 60)
        w += r.choice([[], ["y", "z"], story(2, 8), ["c"] * 15])
        docs[i] = " ".join((["x"] if i % 3 == 0 else story(1, 8) if i % 3 == 1 else []) + w)
    got = {(x["doc_id"], x["item_id"]): x["matched"] for x in decontam.overlaps(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")).collect()}
    assert got == plain_overlaps(docs, items)


@pytest.mark.parametrize("meeting", [2, 5, 2000])
def test_a_key_of_many_unlinked_classes_is_split(spark, monkeypatch, meeting):
    """Texts that share a third of their words, which makes keys of all of them, and some of which are near copies."""
    monkeypatch.setattr(jaccard, "MEETING", meeting)
    r, shared, docs = random.Random(9), story(7, 60), []
    for n in range(60):
        own = story(1000 + n, 120)
        docs.append((n, " ".join(shared + own)))
        for k in range(r.randint(0, 2)):
            near = [*own]
            near[r.randrange(len(near))] = f"changed{k}"
            docs.append((100 + 3 * n + k, " ".join(shared + near)))
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(dict(docs))


def test_recall_on_a_table_sorted_by_cluster(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * np.array([0.01, *[3.0] * 11])[:, None]  # the first cluster is tight and comes first
    rows = np.concatenate([c + rng.normal(size=(250, 16)) * (0.01 if k == 0 else 1.0) for k, c in enumerate(centres)])
    df = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(rows)], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for x in ann.nearest(df, every=100, top=10).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    hit = 0
    for q in range(0, len(rows), 100):
        far = np.linalg.norm(rows - rows[q], axis=1)
        far[q] = np.inf
        hit += len(got[q] & {*np.argsort(far, kind="stable")[:10].tolist()})
    assert hit >= 0.9 * 10 * len(range(0, len(rows), 100))
    back = ann.nearest(df.orderBy("vec_id", ascending=False), every=100, top=10)
    assert {(x["query_id"], x["vec_id"]) for x in back.collect()} == {(q, v) for q, s in got.items() for v in s}  # the order of rows plays no part


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert pii.find_pii(docs).count() == 0 and jaccard.near_copies(docs).count() == 0
    assert decontam.overlaps(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    assert decontam.overlaps(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert langid.predict(docs, langid.fit(docs)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
