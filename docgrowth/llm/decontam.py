"""Benchmark passages in training documents, found by spaced seeds.

A seed is a fixed mask over consecutive words; words at its blanks are ignored, so a
passage with changed words still meets the benchmark where the changes fall on blanks.
The hashes of the masked windows of documents and benchmark are joined; each hit is a
diagonal, a fixed shift between the two texts, along which they are compared: the best
stretch (a match counts 1, a mismatch -2) must match `least` words, or all words of an
item with fewer.

Windows of documents are sent on only if a bitmap of the benchmark's hashes (at most
`BITMAP_BITS` bits) has theirs, so the join meets few others. Where windows recur at a
distance of up to the span, as repeated words and phrases make them, only the first and
last period count: two such stretches overlap most where their ends meet. Items of equal
text are compared once.

Words are runs without ASCII white space and punctuation, A-Z as a-z. Defined results:
null and empty texts have no overlap, nor do items without words, nor null items; rows
that repeat an id are reported once per item, by their best overlap (most words, then
first, then shortest); an empty table on either side gives no rows; other columns, of any
name, play no part. Whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.shared import written
from docgrowth.llm.hashing import LETTERS, mix, word_hashes

# The masks; 1 is a word that counts, 0 one that is ignored.
MASKS = ("11011001101", "10110100111", "11100111001")
SPAN = 11
#: The bitmap has some 256 bits a window of the benchmark, and at most 2 ** this (32 MB).
BITMAP_BITS = 28
#: Flagged ids up to this many are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _masked(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked window that begins at each place."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(int(mask, 2)))
    for k, c in enumerate(mask):
        if c == "1":
            h = (h ^ words[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


class Bitmap:
    """Which of 2 ** bits buckets, by the hash's first bits, have a window; packed, eight to a byte."""

    def __init__(self, bits: int, packed: np.ndarray) -> None:
        self.shift, self.packed = np.uint64(64 - bits), packed

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def windows_in(words: np.ndarray, begins: np.ndarray, masks: list[str], whole: bool = False, known: Bitmap | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(text, place, hash, length of the mask) of the masked windows of several texts; with `whole` masks of less than the span take whole texts only."""
    for mask in masks:
        h = _masked(words, mask)
        at = np.arange(len(h)) if known is None else np.flatnonzero(known.has(h))
        text = np.searchsorted(begins, at, "right") - 1
        ok = at + len(mask) <= begins[text + 1]
        if whole and len(mask) < SPAN:
            ok &= begins[text + 1] - begins[text] == len(mask)
        for period in range(1, SPAN + 1) if len(at) else ():
            inside = (at - period >= begins[text]) & (at + period + len(mask) <= begins[text + 1])
            before, after = h[np.maximum(at - period, 0)], h[np.minimum(at + period, len(h) - 1)]
            ok &= ~(inside & (before == h[at]) & (after == h[at]))
        if ok.any():
            yield text[ok], at[ok] - begins[text[ok]], h[at[ok]], len(mask)


def _windows(rows: DataFrame, masks: list[str], whole: bool = False, known: Bitmap | None = None) -> DataFrame:
    """(h, k, p, m) of rows (k, t): the windows' hashes, places and lengths."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, at = b["k"].to_numpy(), 0
            for words, begins in word_hashes([*b["t"]], LETTERS):
                for text, place, h, m in windows_in(words, begins, masks, whole, known):
                    yield pd.DataFrame({"h": h.view(np.int64), "k": keys[at + text], "p": place, "m": m})
                at += len(begins) - 1

    return rows.mapInPandas(emit, f"h long, k {rows.schema['k'].dataType.simpleString()}, p long, m int")


def _bitmap(windows: DataFrame) -> Bitmap:
    n = windows.count()
    bits = min(BITMAP_BITS, max(16, math.ceil(math.log2(256 * n + 1))))
    at = F.shiftrightunsigned("h", 64 - bits)
    made = windows.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("map"))
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for r in made.toLocalIterator():  # at most 2 ** BITMAP_BITS bits in all
        packed[4096 * r["block"] : 4096 * (r["block"] + 1)] = np.frombuffer(bytes(r["map"]), np.uint8)[: len(packed)]
    return Bitmap(bits, packed)


def stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, end) of the stretch of greatest score."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return int(same[start:end].sum()), start, end


def best_overlap(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(start, length, matched) of the best stretch along any of the diagonals, in words of the text; none below the least."""
    best = None
    for d in np.sort(diagonals).tolist():
        first, last = max(0, -d), min(len(item), len(words) - d)
        if last <= first:
            continue
        matched, s, e = stretch(words[d + first : d + last] == item[first:last])
        if matched >= min(least, len(item)) and (best is None or matched > best[2]):
            best = d + first + s, e - s, matched
    return best


def _verified(met: DataFrame, key_type: str, item_type: str, least: int) -> DataFrame:
    """(k, item, start, length, matched, coverage) of rows (k, t, item, item_text, diagonals)."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = lambda texts: [w[b[i] : b[i + 1]] for w, b in word_hashes(texts, LETTERS) for i in range(len(b) - 1)]
        for b in batches:
            out = []
            for at in range(0, len(b), 50):
                part = b.iloc[at : at + 50]
                for k, j, words, item, diagonals in zip(part["k"], part["item"], split([*part["t"]]), split([*part["item_text"]]), part["diagonals"], strict=True):
                    got = best_overlap(words, item, np.asarray(diagonals), least)
                    if got:
                        out.append((k, j, *got, got[2] / len(item)))
            if out:
                yield pd.DataFrame(out)

    return met.mapInPandas(verify, f"k {key_type}, item {item_type}, start long, length long, matched long, coverage double")


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str | Column = "text", item: str = "item_id", item_text: str = "text", least: int = 12) -> DataFrame:
    """(key, item_id, start, length, matched, coverage): one row per document and benchmark item that it overlaps."""
    key_type, item_type = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    all_items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("t")).dropna()
    items = written(all_items.groupBy("t").agg(F.min("item_id").alias("k")), "items")
    theirs = written(_windows(items.select("k", "t"), [*MASKS, *("1" * n for n in range(1, SPAN))], whole=True), "item_windows")
    short = sorted(r["m"] for r in theirs.select("m").distinct().filter(F.col("m") < SPAN).collect())  # at most SPAN - 1 rows
    masks = [*MASKS, *("1" * n for n in short)]
    rows = docs.select(F.col(key).alias("k"), (F.col(text) if isinstance(text, str) else text).alias("t"))
    hits = _windows(rows, masks, known=_bitmap(theirs)).join(theirs.select("h", F.col("k").alias("item"), F.col("p").alias("q")), "h")
    found = hits.select("k", "item", (F.col("p") - F.col("q")).alias("d")).groupBy("k", "item").agg(F.collect_set("d").alias("diagonals"))
    found = written(found, "hits")
    few = found.count() <= BROADCAST_IDS // 10
    met = rows.join(F.broadcast(found) if few else found, "k").join(items.select(F.col("k").alias("item"), F.col("t").alias("item_text")), "item")
    best = W.partitionBy("k", "item").orderBy(F.desc("matched"), "start", "length")
    one = _verified(met, key_type, item_type, least).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    names = all_items.join(items.select("t", F.col("k").alias("item")), "t").select("item", "item_id")
    return one.join(names, "item").select(F.col("k").alias(key), "item_id", "start", "length", "matched", "coverage")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs without those that overlap any benchmark item; documents without an id stay."""
    flagged = written(overlaps(docs, benchmark, key, **options).select(key).distinct(), "flagged")
    return docs.join(F.broadcast(flagged) if flagged.count() <= BROADCAST_IDS else flagged, key, "left_anti").select(docs.columns)
