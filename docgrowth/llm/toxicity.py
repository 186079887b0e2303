"""Toxicity scores from a counterfactually regularised linear classifier.

Logistic regression on the words of a text and their beginnings (inflected and compound
insults share these), kept if they point to toxic texts well beyond chance. For every training text that names a group
of people, the group's name is swapped for another in the text and the change of the
score is penalised: all features that the swap takes out and brings in count, the name's
beginnings too, so that naming a group moves no score by itself.

Fitted on at most `sample` labelled rows (default 12,000, chosen by a hash of the id), of
each at most `WORDS_A_TEXT` distinct words (chosen by checksum), so the fit is bounded in
bytes too; scores cover all rows and whole texts. Copies of a text teach once.
Defined results: null or empty text has the score of a text without known words; without
labels of both kinds every score is the smoothed share of label 1; labels null or other
than 0 and 1 teach nothing; rows that repeat an id are each joined to its labels; a
column `toxicity` of the documents is refused; empty tables teach nothing and have no rows. Any text length is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\W\d_]+")
# Terms that name groups of people; within a row they are swapped.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "african", "latino", "arab", "european", "indigenous"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)


#: Beginnings of words that are features beside the words, marked by a leading ^.
BEGINNINGS = (4, 5, 6, 7, 8)


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


#: Distinct words of one text that teach, at most; more only in texts of some 100 KB.
WORDS_A_TEXT = 20_000


def bounded(found: set[str]) -> list[str]:
    """The words in order; of very many, those of smallest checksum and the names of groups."""
    if len(found) > WORDS_A_TEXT:
        named = found & {w for row in IDENTITY for w in row}
        found = named | set(sorted(found, key=lambda w: (zlib.crc32(w.encode("utf-8", "replace")), w))[:WORDS_A_TEXT])
    return sorted(found)


def parts(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def features(found: set[str]) -> set[str]:
    return {x for w in found for x in parts(w)}


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str | None) -> float:
        known = {x for w in words(text) if w[:4] in self.openings for x in parts(w) if x in self.weights}
        z = self.bias + sum(self.weights[x] for x in sorted(known))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    @cached_property
    def openings(self) -> frozenset[str]:
        """The first four letters of whatever has a weight: most words need no further look."""
        return frozenset(x.lstrip("^")[:4] for x in self.weights)


def _swaps(texts: list[set[str]]) -> Counter[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(features that go, features that come) for each swap of a group's name in a text for another of its row, and how often."""
    out: Counter[tuple[tuple[str, ...], tuple[str, ...]]] = Counter()

    def add(before: set[str], old: str, new: str) -> None:
        one, two = features(before), features((before - {old}) | {new})
        out[tuple(sorted(one - two)), tuple(sorted(two - one))] += 1

    for t in texts:
        for row in IDENTITY:
            for k, w in enumerate(row):
                if w in t:
                    add(t, w, row[(k + 1 + len(t) % (len(row) - 1)) % len(row)])
    for row in IDENTITY:  # also for names that the sample lacks
        for k in range(len(row) - 1):
            add({row[k]}, row[k], row[k + 1])
    return out


def train(texts: list[set[str]], y: np.ndarray, fairness: float = 20.0, chance: float = 12.0, least: int = 5, ridge: float = 1e-4, steps: int = 300) -> Model:
    """Features that point to label 1, then gradient steps on balanced loss + ridge + squared score change under swaps.

    A feature needs `least` texts and a log odds ratio times root of its texts of `chance`.
    """
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        share = (n1 + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), {})
    swaps = _swaps(texts) if fairness else Counter()
    # Features are made anew in each pass, not kept: those of all texts at once would be several times the words.
    df1: Counter[str] = Counter(w for t, v in zip(texts, y, strict=True) if v for w in features(t))
    df1 = Counter({w: n for w, n in df1.items() if n >= least})
    df0: Counter[str] = Counter(w for t, v in zip(texts, y, strict=True) if not v for w in features(t) if w in df1)
    odds = lambda w: np.log((df1[w] + 0.5) / (n1 + 1)) - np.log((df0[w] + 0.5) / (n0 + 1))
    vocabulary = sorted(w for w in df1 if odds(w) * np.sqrt(df1[w] + df0[w]) >= chance)
    place = {w: k for k, w in enumerate(vocabulary)}
    pairs = [(k, place[w]) for k, t in enumerate(texts) for w in features(t) if w in place]
    row, col = (np.array(x, dtype=np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    # The change of score under swap k is the sum of sign * w[at] over its entries; swaps of features without weights change nothing.
    entries = [(k, place[x], sign) for k, (gone, come) in enumerate(swaps) for sign, side in ((1.0, gone), (-1.0, come)) for x in side if x in place]
    swap, at, sign = (np.array(x) for x in zip(*entries, strict=True)) if entries else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    often = np.array(list(swaps.values()), float) / max(1, sum(swaps.values()))
    cost = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(place)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam
        z = b + np.bincount(row, w[col], minlength=len(y))
        r = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col, r[row], minlength=len(w)) + ridge * w
        if len(entries):
            change = fairness * often * np.bincount(swap, sign * w[at], minlength=len(often))
            g += np.bincount(at, sign * change[swap], minlength=len(w))
        gb = r.sum()
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        v, vb = 0.99 * v + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.1 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return Model(float(b), {x: float(w[k]) for x, k in place.items() if w[k]})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 12_000, fairness: float = 20.0) -> Model:
    """At most `sample` labels are joined to their texts by broadcast; their distinct word sets are fitted in one task."""
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull()).orderBy(F.xxhash64("k"), "k").limit(sample)
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").filter(F.col("t").isNotNull())

    @F.pandas_udf("array<string>")
    def vocabulary(t: pd.Series) -> pd.Series:
        return pd.Series([bounded(words(x)) for x in t], dtype=object)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "y"]).drop_duplicates(["h", "y"])
        model = train([set(x) for x in rows["w"]], rows["y"].to_numpy(), fairness)
        return pd.DataFrame({"bias": model.bias, "word": [[*model.weights]], "weight": [[*model.weights.values()]]})

    sets = known.select("y", F.xxhash64("t").alias("h"), vocabulary("t").alias("w"))
    got = sets.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "bias double, word array<string>, weight array<double>").first()
    return Model(got["bias"], dict(zip(got["word"], got["weight"], strict=True))) if got else train([], np.zeros(0))


def score(docs: DataFrame, model: Model, text: str | Column = "text") -> DataFrame:
    """docs with a column `toxicity` in 0 to 1."""
    if "toxicity" in docs.columns:
        raise ValueError("documents already have a column toxicity")

    @F.pandas_udf("double")
    def of(t: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in t], dtype=float)

    return docs.withColumn("toxicity", of(text))
