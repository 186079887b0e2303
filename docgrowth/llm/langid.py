"""Language identification by error-correcting output codes.

Each language has a codeword: a row of a Hadamard matrix, so any two differ in half
their bits. For each bit a binary n-gram classifier separates the languages whose bit
is 1 from the others; its weights are the log ratios of n-gram frequencies, counted
over all labelled rows. A text's margins are decoded to the codeword of least weighted
hinge loss; bits that separate well weigh more. A text is ambiguous if the runner-up's
loss is near the best.

Defined results: null text or text without a letter (Unicode category L; digits, number
signs and marks are none) is `und` with score 0; with no labelled row all texts are `und`;
with one language every text with a letter gets it, score 1; ties of losses go to the
language first in order. Null labels teach nothing. Any text length is read whole.
Repeated rows teach and are judged each; an empty table teaches nothing and has no rows. More than `LANGUAGES` different labels are
refused, since the counts of each reach the driver; so is a column of the result's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrowth.functions.shared import written

DIMS = 1 << 13
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Labels, at most: the driver gets 64 KB of counts of each.
LANGUAGES = 1000
_CHUNK = 1 << 20


def ngrams(text: str) -> np.ndarray:
    """Counts of hashed character 1-, 2- and 3-grams; all but letters count as blanks."""
    total = np.zeros(DIMS)
    low = text.lower()
    for at in range(0, len(low), _CHUNK):  # bounded memory for very long texts
        a = np.frombuffer(low[max(0, at - 2) : at + _CHUNK].encode("utf-32-le", "replace"), np.uint32).copy()
        a[(a < 97) | ((a > 122) & (a < 170))] = 32
        two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F)
        for h in (a * np.uint32(0x165667B1), two ^ np.uint32(0x5BD1E995), three):
            total += np.bincount((h * np.uint32(0x2545F491)) >> np.uint32(19), minlength=DIMS)
    return total


def _codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1, without columns that are the same for all."""
    size = 16
    while size < 2 * n:
        size *= 2
    h = np.array([[1 - 2 * (bin(i & j).count("1") & 1) for j in range(size)] for i in range(size)])
    rows = h[[1 + (7 * k) % (size - 1) for k in range(n)]] if n > 1 else h[:1]
    return rows[:, np.abs(rows.sum(axis=0)) < n].astype(float)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # n-gram x bit
    spread: np.ndarray  # per bit: usual margin of a text of either side
    trust: np.ndarray  # per bit: weight of its loss, sums to 1

    def losses(self, counts: np.ndarray) -> np.ndarray:
        margin = counts @ self.weights / np.maximum(counts.sum(axis=1, keepdims=True), 1) / self.spread
        return np.maximum(0, 1 - margin[:, None, :] * self.codes[None]) @ self.trust


def fit(docs: DataFrame, text: str | Column = "text", lang: str | Column = "lang") -> Model | None:
    """Counts n-grams by language in each partition and adds them up: languages x DIMS sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, y in zip(b["t"], b["y"], strict=True):
                c = ngrams(t)
                sums[y] = sums[y] + c if y in sums else c
        for y, c in sums.items():
            k = np.flatnonzero(c)
            yield pd.DataFrame({"y": y, "k": k, "c": c[k]})

    known = docs.select(F.col(text).alias("t") if isinstance(text, str) else text.alias("t"), (F.col(lang) if isinstance(lang, str) else lang).alias("y")).dropna()
    sums = known.mapInPandas(count, "y string, k long, c double").groupBy("y", "k").agg(F.sum("c").alias("c"))
    sums = written(sums, "ngrams")
    if sums.select("y").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    got = sums.toPandas()
    languages = tuple(sorted(got["y"].unique()))
    if not languages:
        return None
    counts = np.full((len(languages), DIMS), 0.5)
    counts[got["y"].map(languages.index).to_numpy(), got["k"].to_numpy()] += got["c"].to_numpy()
    share = counts / counts.sum(axis=1, keepdims=True)
    codes = _codewords(len(languages))
    if not codes.shape[1]:
        return Model(languages, codes, np.zeros((DIMS, 0)), np.ones(0), np.ones(0))
    one, other = (np.stack([share[codes[:, b] == side].mean(axis=0) for b in range(codes.shape[1])], axis=1) for side in (1, -1))
    weights = np.log(one) - np.log(other)
    weights -= ((one * weights).sum(axis=0) + (other * weights).sum(axis=0)) / 2  # both sides as far from 0
    spread = ((one - other) * weights).sum(axis=0) / 2
    return Model(languages, codes, weights, spread, spread / spread.sum())


RESULT = "lang_pred string, score double, ambiguous boolean"


def _decide(model: Model | None, text: pd.Series, near: float) -> pd.DataFrame:
    out = []
    usable = [isinstance(t, str) and model is not None and bool(_LETTER.search(t)) for t in text]
    for at in range(0, len(text), 128):
        part = [t for t, ok in zip(text.iloc[at : at + 128], usable[at : at + 128], strict=True) if ok]
        if part and len(model.languages) > 1:
            loss = model.losses(np.stack([ngrams(t) for t in part]))
            p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
            best, two = loss.argmin(axis=1), np.sort(loss, axis=1)[:, :2]
            got = iter([(model.languages[k], float(q[k] / q.sum()), bool(b - a < near)) for k, q, (a, b) in zip(best, p, two, strict=True)])
        else:
            got = iter([(model.languages[0], 1.0, False)] * len(part) if part else [])
        out += [next(got) if ok else (UNKNOWN, 0.0, False) for ok in usable[at : at + 128]]
    return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])


def predict(docs: DataFrame, model: Model | None, text: str | Column = "text", near: float = 0.05, into: str = "language") -> DataFrame:
    """docs with a column `into`: the decoded language, its score, and whether the runner-up's loss is within `near`."""
    if into in docs.columns:
        raise ValueError(f"documents already have a column {into}")

    @F.pandas_udf(RESULT)
    def decide(t: pd.Series) -> pd.DataFrame:
        return _decide(model, t, near)

    return docs.withColumn(into, decide(text))
