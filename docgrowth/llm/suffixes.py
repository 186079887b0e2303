"""Repeated passages of exact bytes, removed wherever they stand again.

A byte goes if it lies in a string of `length` bytes that also starts earlier in the
corpus. Equal strings are neighbours once suffixes are sorted, so suffixes are dealt out
by sampled splitters to range partitions, sorted there by a multikey quicksort and
compared with the one before, across the ends of partitions too.

Sorting the suffix of every byte would send each text a hundred times. So suffixes are
thinned without loss first: of the strings of `GRAM` bytes in a window of `length`, the
window's anchor is the one of smallest hash (the leftmost, if equal). Equal windows have
their anchors at equal places, so only suffixes that begin at anchors, about 3 % of all,
are sorted. A suffix's leading tokens are two 64-bit fingerprints: of the anchor's gram,
and of all bytes of the windows that share the anchor (its context).

* Equal contexts: all but the first in the corpus are repeats, whole.
* Different contexts of one gram: the first of each is opened into its windows, which are
  compared within the gram. Contexts travel as bytes and are opened where they are compared.
  A gram with more than `SPLIT` contexts doesn't have to fit one task: its contexts are dealt
  out over ranges, what repeats within a range is settled there, and the windows that are
  left are dealt out and sorted once more, each by itself.
* Contexts that repeat within a batch of texts are settled before anything is sent.

Order of the corpus: by id, then by place. Defined results: null text is empty; texts of
fewer bytes than `length` keep all; a null id is the smallest id; rows of one id and
different texts are documents of their own, ordered by a digest of the text, and rows
alike in id and text count as one document, each with its result; an empty table gives
none; other columns, of any name, play no part. Fingerprints of 2 x 64 bits stand for
strings: with 10^14 bytes, one false match is expected in some 10^12 corpora.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrowth.functions.shared import written
from docgrowth.llm.hashing import CHUNK, _Powers, _R, mix

GRAM = 24
#: Bytes of contexts that one step of a task opens and sorts at once.
STEP = 1 << 20
#: Contexts of a gram that one task compares; more are split.
SPLIT = 2000
#: Grams that are split are broadcast up to so many (8 MB), else joined by a shuffle.
BROADCAST = 1_000_000
_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _R)
_KEYS = ["k", "c", "d", "tie", "p"]
_ROW = "k long, c long, d long, tie long, p long, lo long, hi long"
_SPAN, _OPEN, _EDGE, _WINDOW = range(4)


class Fingerprints:
    """64-bit fingerprints of any substrings of some bytes."""

    def __init__(self, raw: bytes | np.ndarray) -> None:
        data = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
        self.n = len(data)
        up, self.down = _Powers.first(self.n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: self.n], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ np.asarray(salt, np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(raw: bytes, begins: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(k, c, text, p, lo, hi): gram and context of each anchor, where it stands, and its first and last window; of several texts in a row."""
    at, none = Fingerprints(raw), np.zeros(0, np.int64)
    if at.n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    grams = at.of(places := np.arange(at.n - gram + 1), places + gram)
    low = np.uint64((1 << 24) - 1)  # the place, so that the leftmost of equal grams wins
    found = (_least(grams & ~low | places.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[: len(found)]
    start = np.flatnonzero(np.arange(len(found)) + length <= begins[text + 1])
    first = np.flatnonzero(np.diff(found[start], prepend=-1))
    if not len(first):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    lo, hi, p = start[first], start[np.append(first[1:], len(start)) - 1], found[start[first]]
    shape = (p - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)
    return grams[p], at.of(lo, hi + length, mix(shape)), text[lo], p, lo, hi


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their columns: a quicksort by the first, and by each next one only of rows that were equal so far."""
    order = np.argsort(columns[0])
    open_rows, group = np.arange(len(order)), columns[0][order]
    for column in columns[1:]:
        group = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
        many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        open_rows, group = open_rows[many], group[many]
        if not len(open_rows):
            break
        within = order[open_rows]
        sub = np.lexsort((column[within], group))
        order[open_rows] = within[sub]
        # equal only if both the group and this column are
        value = column[within[sub]]
        group = np.cumsum((np.diff(group[sub], prepend=group[sub][:1]) != 0) | (value != np.roll(value, 1)))
    return order


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    differs = np.ones(len(columns[0]), bool)
    differs[1:] = False
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    return differs


def merged(d: np.ndarray, tie: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans by document, those that overlap or touch made one."""
    order = np.lexsort((hi, lo, tie, d))
    d, tie, lo, hi = (x[order] for x in (d, tie, lo, hi))
    doc = np.cumsum(_new(d, tie)) if len(d) else d
    top = np.maximum.accumulate(hi + doc * (1 << 40)) - doc * (1 << 40) if len(d) else hi
    first = _new(doc)
    first[1:] |= lo[1:] > top[:-1]
    at = np.flatnonzero(first)
    return d[at], tie[at], lo[at], top[np.append(at[1:], len(d)) - 1] if len(at) else hi[at]


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts by number, with the place of the part in them: many short ones or a part of a long one, about CHUNK bytes at a time."""
    rows, begins, raw, size = [], [], [], 0
    for n, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), CHUNK // 2):
            part = t[at : at + CHUNK // 2 + length - 1]
            if size + len(part) > CHUNK:
                yield rows, begins, raw
                rows, begins, raw, size = [], [], [], 0
            rows.append(n)
            begins.append(at)
            raw.append(part)
            size += len(part)
    if rows:
        yield rows, begins, raw


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of all texts (d, tie, t), and spans already known to repeat (p is -1, hi their end)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, ties = b["d"].to_numpy(np.int64), b["tie"].to_numpy(np.int64)
            for rows, at, raw in _parts([(t or "").encode() for t in b["t"]], length):
                begins = np.cumsum([0, *map(len, raw)])
                k, c, text, p, lo, hi = anchors(b"".join(raw), begins, length, gram)
                shift = np.asarray(at)[text] - begins[text]
                d, tie = ids[np.asarray(rows)[text]], ties[np.asarray(rows)[text]]
                cols = [k.view(np.int64), c.view(np.int64), d, tie, p + shift, lo + shift, hi + shift]
                order = multikey_order(cols[:5])
                k, c, d, tie, p, lo, hi = (x[order] for x in cols)
                first, other = _new(k, c), _new(k, c, d, tie, p)
                yield pd.DataFrame({n: x[first] for n, x in zip(_KEYS + ["lo", "hi"], (k, c, d, tie, p, lo, hi), strict=True)})
                again = ~first & other
                d, tie, lo, hi = merged(d[again], tie[again], lo[again], hi[again] + length)
                spread = mix((d ^ lo).astype(np.uint64)).view(np.int64)
                yield pd.DataFrame({"k": spread, "c": 0, "d": d, "tie": tie, "p": -1, "lo": lo, "hi": hi})

    return docs.mapInPandas(emit, _ROW)


def _gathered(batches: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    parts = [[b[n].to_numpy() for n in names] for b in batches]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in names]


def _bucket(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """A range of suffixes, sorted: repeats, first contexts of grams that have several, and what stands at the range's ends."""
    k, c, d, tie, p, lo, hi = _gathered(batches, _KEYS + ["lo", "hi"])
    known = p < 0
    span = [x[known] for x in (d, tie, lo, hi)]
    rows = [x[~known] for x in (k, c, d, tie, p, lo, hi)]
    order = multikey_order(rows[:5])
    rows = [x[order] for x in rows]
    rows = [x[_new(*rows[:5])] for x in rows]
    k, c, d, tie, p, lo, hi = rows
    frame = lambda kind, at, **more: pd.DataFrame({"kind": kind, "b": 0, "k": k[at], "c": c[at], "d": d[at], "tie": tie[at], "p": p[at], "lo": lo[at], "hi": hi[at], "last_c": 0, "n": 0, "own": 0, "last": 0} | more)
    yield pd.DataFrame({"kind": _SPAN, "b": 0, "k": 0, "c": 0, "d": span[0], "tie": span[1], "p": 0, "lo": span[2], "hi": span[3], "last_c": 0, "n": 0, "own": 0, "last": 0})
    if not len(k):
        return
    first = _new(k, c)
    run = np.cumsum(_new(k)) - 1
    classes = np.bincount(run, weights=first).astype(np.int64)
    starts = np.flatnonzero(_new(k))
    edges = np.unique([0, starts[-1]])  # first rows of the two grams that may go on beyond the ends
    inner = np.ones(len(k), bool)
    inner[edges] = False
    again = np.flatnonzero(~first)
    yield frame(_SPAN, again, k=0, c=0, p=0, hi=hi[again] + length)
    yield frame(_OPEN, np.flatnonzero(first & inner & (classes[run] > 1)), c=0)
    ends = np.append(starts[1:], len(k)) - 1
    own, last = edges, ends[run[edges]]
    where = mix(mix(d.astype(np.uint64)) ^ mix(tie.astype(np.uint64) + _R) + mix(p.astype(np.uint64))).view(np.int64)
    yield frame(_EDGE, edges, b=TaskContext.get().partitionId(), last_c=c[last], n=classes[run[edges]], own=where[own], last=where[last])


_FOUND = f"kind int, b int, {_ROW}, last_c long, n long, own long, last long"


def _sorted(rows: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(spans, open): repeats (d, tie, lo, hi), and contexts (k, d, tie, lo, hi) to open, of rows sorted over all ranges."""
    spark = rows.sparkSession
    found = written(rows.repartitionByRange(*_KEYS).mapInPandas(lambda batches: _bucket(batches, length), _FOUND), name)
    spans, opened = [], []
    chain: list = []

    def settle() -> None:
        """Of a gram that stands in one range or in several that follow each other: what its first rows are."""
        total = sum(r["n"] for r in chain) - sum(x["last_c"] == y["c"] for x, y in zip(chain, chain[1:], strict=False))
        before = None
        for r in chain:
            if before is not None and before["last_c"] == r["c"]:
                if before["last"] != r["own"]:  # else a row that stands twice in the table
                    spans.append((r["d"], r["tie"], r["lo"], r["hi"] + length))
            elif total > 1:
                opened.append((r["k"], r["d"], r["tie"], r["lo"], r["hi"]))
            before = r
        chain.clear()

    edges = found.filter(F.col("kind") == _EDGE).collect()  # at most two a range
    for r in sorted(edges, key=lambda r: (r["b"], r["k"])):
        if chain and chain[-1]["k"] != r["k"]:
            settle()
        chain.append(r)
    settle()
    more = spark.createDataFrame(spans, "d long, tie long, lo long, hi long")
    more_open = spark.createDataFrame(opened, "k long, d long, tie long, lo long, hi long")
    return (
        found.filter(F.col("kind") == _SPAN).select("d", "tie", "lo", "hi").union(more),
        found.filter(F.col("kind") == _OPEN).select("k", "d", "tie", "lo", "hi").union(more_open),
    )


def _contexts(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """(k, d, tie, lo, raw): the bytes of contexts to open."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, tie, t, places in zip(b["d"], b["tie"], b["t"], b["places"], strict=True):
                raw = t.encode()
                out += [(x["k"], d, tie, x["lo"], raw[x["lo"] : x["hi"] + length]) for x in places]
            if out:
                yield pd.DataFrame(out, columns=["k", "d", "tie", "lo", "raw"])

    places = opened.groupBy("d", "tie").agg(F.collect_list(F.struct("k", "lo", "hi")).alias("places"))
    one = docs.join(places, ["d", "tie"])
    return one.mapInPandas(cut, "k long, d long, tie long, lo long, raw binary")


def _windows(batches: Iterator[pd.DataFrame], length: int, whole: bool) -> Iterator[pd.DataFrame]:
    """Contexts opened and compared gram by gram; if grams are not `whole` here, windows that don't repeat here are sent on."""
    held = _gathered(batches, ["k", "d", "tie", "lo", "raw"])
    order = multikey_order(held[:4])
    k, d, tie, lo, raw = (x[order] for x in held)
    if not len(k):
        return
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    load = np.concatenate(([0], np.cumsum(size)))
    cuts = [0]  # after whole grams, where they fit a step or have to be together
    for s in np.append(np.flatnonzero(_new(k))[1:], len(k)).tolist():
        if s == len(k) or load[s] - load[cuts[-1]] >= STEP:
            cuts.append(s)
    for i, j in zip(cuts, cuts[1:], strict=False):
        at = Fingerprints(b"".join(raw[i:j]))
        n = size[i:j] - length + 1
        which = np.repeat(np.arange(i, j), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        begin = nth + load[which] - load[i]
        cols = [k[which], at.of(begin, begin + length).view(np.int64), d[which], tie[which], lo[which] + nth]
        by = multikey_order(cols)
        kk, c, dd, tt, p = (x[by] for x in cols)
        first, other = _new(kk, c), _new(kk, c, dd, tt, p)
        again = ~first & other
        dd2, tt2, lo2, hi2 = merged(dd[again], tt[again], p[again], p[again] + length)
        yield pd.DataFrame({"kind": _SPAN, "k": 0, "c": 0, "d": dd2, "tie": tt2, "p": 0, "lo": lo2, "hi": hi2})
        if not whole:
            yield pd.DataFrame({"kind": _WINDOW, "k": kk[first], "c": c[first], "d": dd[first], "tie": tt[first], "p": p[first], "lo": p[first], "hi": p[first]})


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, tie, lo, hi): byte ranges of documents (d, tie, t) that repeat; they may overlap each other."""
    spans, opened = _sorted(_anchor_rows(docs, length, gram), length, "suffixes")
    contexts = written(_contexts(docs, opened, length), "contexts")
    hot = written(contexts.groupBy("k").count().filter(F.col("count") > SPLIT).select("k"), "hot_grams")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST else hot
    opened_here = lambda rows, whole: rows.mapInPandas(lambda batches: _windows(batches, length, whole), f"kind int, {_ROW}")
    cool = opened_here(contexts.join(hot, "k", "left_anti").repartition("k"), True)
    split = written(opened_here(contexts.join(hot, "k", "left_semi").repartitionByRange("k", "d", "tie", "lo"), False), "windows")
    ends, _ = _sorted(split.filter(F.col("kind") == _WINDOW).drop("kind"), length, "ends")
    settled = cool.union(split.filter(F.col("kind") == _SPAN)).select("d", "tie", "lo", "hi")
    return spans.union(settled).union(ends)


def without_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", gram: int = GRAM, keep: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with `keep` the bytes that remain as `kept`.

    The id has to be a whole number.
    """
    if not 0 < gram <= length:
        raise ValueError("gram has to be from 1 to length")
    low = -(1 << 63)
    rows = docs.select(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    repeated = rows.groupBy("d").count().filter("count > 1").limit(1).count() > 0
    rows = rows.withColumn("tie", F.xxhash64("t") if repeated else F.lit(0).cast("long"))
    texts = rows.select("d", "tie", "t").filter(F.octet_length("t") >= length)
    spans = repeated_spans(texts, length, gram).groupBy("d", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, found in zip(b["t"], b["spans"], strict=True):
                raw, at, kept, n = t.encode(), 0, [], 0
                for lo, hi in sorted((x["lo"], x["hi"]) for x in found) if found is not None else ():
                    if lo > at or not n:  # spans that touch are one
                        kept.append(raw[at:lo])
                        n += 1
                    at = max(at, hi)
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), *([kept] * keep)))
            found = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep])
            yield found.assign(d=b["d"].to_numpy(), none=b["none"].to_numpy())

    both = rows.join(spans, ["d", "tie"], "left").select("d", "none", "t", "spans")
    done = both.mapInPandas(cut, "d long, none boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
    return done.select(F.when(~F.col("none"), F.col("d")).cast(kind).alias(key), *done.columns[2:])
