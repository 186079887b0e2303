"""Tokens of two tokenizers, aligned by the bytes they cover.

A is a byte-level BPE file of `tokenizers`, B a `sentencepiece` model; both encode the
text with one blank before it. Interval coalescing: the tokens of both sides are sorted
together by start, the running maximum of their ends is accumulated, and a group breaks
where a start reaches it; within a group every overlap of an A token with a B token is a
link. How often each pair of ids is linked is counted over the whole corpus.

Neither tokenizer joins a character that is not white space with a blank, tab or line
feed after it, so a text is cut there into units (a word with the white space before it)
and tokens of a text are those of its units; a worker encodes and aligns a unit that it keeps once.
Texts with other white space, which one of the sides may join differently, are one unit.

Two scans: one counts links, one sums them up by document. The counts are broadcast up to
`PAIRS` pairs (48 MB); beyond that each document's pairs are joined with them by shuffle.

Defined results: null and empty texts, and those whose tokens' bytes are not the text's
(such as texts with U+2581), have no tokens, no links, and an empty digest; strings of
special tokens are plain text; whole texts are aligned; rows that repeat count each and
have a result each; rows of null id too; an empty table gives none; other columns, of any
name, play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.shared import written

PAIRS = 2_000_000
#: Units that a worker keeps; with more it forgets those that it met once.
UNITS = 400_000
_UNIT = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: White space besides blank, tab and line feed, and signs some take for it.
_OTHER = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")


def byte_of_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable bytes are themselves, others are numbered from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


# Fixed value: how byte-level vocabularies part a text before they merge.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that libraries may class differently, by their version of Unicode.
_RARE = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]")
_SPACE = np.frombuffer(b" \t\n", np.uint8)


def _merged_by_rank(path: str):
    """The same vocabulary for a faster library, if its pairs are merged in the order of the ids that they make and nothing else is set; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:  # a file of the tokenizer package, on each machine
        made = json.load(f)
    vocab, pairs, cut = made["model"]["vocab"], made["model"]["merges"], made["pre_tokenizer"] or {}
    pairs = [p.split(" ") if isinstance(p, str) else p for p in pairs]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not made["normalizer"] and not made["model"].get("ignore_merges")
    if not plain or any(vocab.get(x + y) != 256 + n for n, (x, y) in enumerate(pairs)) or any(n < 0 or n >= 256 + len(pairs) for n in vocab.values() if n != len(pairs) + 256):
        return None
    sign = byte_of_sign()
    ranks = {bytes(sign[c] for c in t): n for t, n in vocab.items() if n < 256 + len(pairs)}
    return tiktoken.Encoding("a", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})


class Sides:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already take all cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a_fast = _merged_by_rank(a_path)
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        sign = byte_of_sign()
        entries = {n: bytes(sign[c] for c in t) for t, n in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [entries.get(n, b"") for n in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(n)[1:-1], 16)]) if self.b.is_byte(n) else piece(n).replace("▁", " ").encode() for n in range(self.b.vocab_size())]
        self.blank = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # each id with the sign that may follow it: A's "," and "|", B's "," and ";"
        self.signed = [f"{n}{c}" for x, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for c in signs for n in range(len(x))]

    def _alone(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[:1] == " " else u for u in units], num_threads=1)
        for n, u in enumerate(units):
            if u == " ":
                b[n] = [self.blank]
            elif u[:1] != " ":  # the blank that B puts before it is not there
                b[n] = b[n][1:] if b[n][:1] == [self.blank] else [-1]
        for n, u in enumerate(units):
            raw = u.encode()
            if b[n] == [-1] or b"".join([self.a_bytes[x] for x in a[n]]) != raw or b"".join([self.b_bytes[x] for x in b[n]]) != raw or not raw:
                a[n] = b[n] = []
        return a, b

    def _a_ids(self, text: str) -> list[int]:
        return self.a_fast.encode_ordinary(text) if self.a_fast and not _RARE.search(text) else self.a.encode(text, add_special_tokens=False).ids

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, their number by unit, B's ids, their number); none of units that are not their tokens' bytes.

        Words with white space before them are encoded as one text, which is cut where they end.
        """
        text = "".join(units)
        whole = f" a{text}".encode()
        ends = np.cumsum([2, *map(len, units if text.isascii() else map(str.encode, units))])
        last, first = (np.frombuffer(whole, np.uint8)[x] for x in (ends[1:] - 1, ends[:-1]))
        if np.isin(first, _SPACE).all() and not np.isin(last, _SPACE).any() and not _OTHER.search(text):
            made = []
            for ids, parts, sizes in ((self._a_ids(f" a{text}"), self.a_bytes, self.a_size), (self.b.encode(f"a{text}", num_threads=1), self.b_bytes, self.b_size)):
                flat = np.array(ids, np.int64)
                done = np.cumsum(sizes[flat])
                at = np.searchsorted(done, ends)
                if done[-1] != ends[-1] or (done[at] != ends).any() or b"".join(map(parts.__getitem__, ids)) != whole:
                    break
                made += flat[at[0] + 1 :], np.diff(at)
            else:
                return tuple(made)
        a, b = self._alone(units)
        flat = lambda x: np.array([i for ids in x for i in ids], np.int64)
        return flat(a), np.array([len(x) for x in a], np.int64), flat(b), np.array([len(x) for x in b], np.int64)


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the A and B tokens, numbered from 0, and the links (places of A and B tokens), by sorted intervals."""
    start, end = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(b_end, a_start, "right")
    many = np.searchsorted(b_start, a_end, "left") - first
    a = np.repeat(np.arange(len(a_start)), many)
    nth = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
    return group[: len(a_start)], group[len(a_start) :], a, np.repeat(first, many) + nth


class Units:
    """Aligned units: for each the numbers of tokens, groups and links, its groups as text, and its links' pairs."""

    def __init__(self, sides: Sides) -> None:
        self.sides = sides
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # A, B, groups, links; a unit that is not its tokens' bytes has -1
        self.pairs = np.zeros(0, np.int64)
        self.begins = np.zeros(1, np.int64)
        self.times = np.zeros(0, np.int64)  # met in this task
        self.used = np.zeros(0, np.int64)  # met since the last prune()

    def prune(self) -> np.ndarray:
        """Forgets units met once or less, all if those are few; which ones stay, by number. Their times start anew."""
        stay = np.flatnonzero(self.used > 1)
        stay = stay if 2 * len(stay) < len(self.text) else stay[:0]
        keys = [*self.number]  # by number, as they were added
        self.number = {keys[x]: n for n, x in enumerate(stay.tolist())}
        self.text = [self.text[x] for x in stay.tolist()]
        many = np.diff(self.begins)
        kept = np.zeros(len(many), bool)
        kept[stay] = True
        self.pairs = self.pairs[np.repeat(kept, many)]
        self.begins = np.concatenate(([0], np.cumsum(many[stay])))
        self.sizes, self.times, self.used = self.sizes[stay], np.zeros(len(stay), np.int64), np.zeros(len(stay), np.int64)
        return stay

    def add(self, units: list[str]) -> None:
        for at in range(0, len(units), 4096):
            self._add(units[at : at + 4096])

    def _add(self, units: list[str]) -> None:
        side = self.sides
        a_ids, a_many, b_ids, b_many = side.ids(units)
        a_end, b_end = np.cumsum(side.a_size[a_ids]), np.cumsum(side.b_size[b_ids])
        a_group, b_group, a, b = coalesce(a_end - side.a_size[a_ids], a_end, b_end - side.b_size[b_ids], b_end)
        unit = np.repeat(np.arange(len(units)), a_many)  # of each A token
        links = np.bincount(unit[a], minlength=len(units))
        groups = np.bincount(unit[np.flatnonzero(np.diff(a_group, prepend=-1))], minlength=len(units))
        # A's and B's tokens by group, each with the sign after it
        ids, group = np.concatenate((a_ids, b_ids)), np.concatenate((a_group, b_group))
        of_b = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.lexsort((np.arange(len(ids)), of_b, group))
        last = np.ones(len(ids), np.int64)
        last[:-1] = (np.diff(group[order]) != 0) | (np.diff(of_b[order]) != 0)
        base = np.array([[0, len(side.a_size)], [2 * len(side.a_size), 2 * len(side.a_size) + len(side.b_size)]])
        said = [*map(side.signed.__getitem__, (base[of_b[order], last] + ids[order]).tolist())]
        ends = np.cumsum(a_many + b_many).tolist()
        texts = ["".join(said[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]
        sizes = np.stack((a_many, b_many, groups, links), axis=1)
        sizes[a_many == 0] = -1
        self.number.update(zip(units, range(len(self.text), len(self.text) + len(units)), strict=True))
        self.text += texts
        self.sizes = np.concatenate((self.sizes, sizes))
        self.pairs = np.concatenate((self.pairs, a_ids[a] << 32 | b_ids[b]))
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(links)))
        more = np.zeros(len(units), np.int64)
        self.times, self.used = np.concatenate((self.times, more)), np.concatenate((self.used, more))

    def of(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The units of each text, by number; None for those without tokens."""
        split = [([f" {t}"] if _OTHER.search(t) else _UNIT.findall(f" {t}")) if t and "▁" not in t else [] for t in texts]
        out = [np.fromiter(map(self.number.get, s, repeat(-1)), np.int64, len(s)) for s in split]
        missed = [np.flatnonzero(x < 0).tolist() for x in out]
        if fresh := {s[k] for s, places in zip(split, missed, strict=True) for k in places}:
            self.add([*fresh])
            for x, s, places in zip(out, split, missed, strict=True):
                x[places] = [self.number[s[k]] for k in places]
        for n, x in enumerate(out):
            if (self.sizes[x, 0] < 0).any():
                whole = f" {texts[n]}"  # judged as it stands, not by its units
                if whole not in self.number:
                    self.add([whole])
                out[n] = np.array([k for k in (self.number[whole],) if self.sizes[k, 0] >= 0], np.int64)
        met = np.bincount(np.concatenate(out), minlength=len(self.text))
        self.times += met
        self.used += met
        return [x if len(x) else None for x in out]


@lru_cache(maxsize=1)
def _of_worker(a_path: str, b_path: str) -> Units:
    return Units(Sides(a_path, b_path))


def units_of(a_path: str, b_path: str) -> Units:
    """Both tokenizers, loaded once per worker, with the units that its earlier tasks met."""
    units = _of_worker(a_path, b_path)
    units.times[:] = 0
    return units


def pair_counts(rows: DataFrame, a_path: str, b_path: str, kept_units: int = UNITS) -> DataFrame:
    """(pair, n, best): links of each pair of ids over all texts, and whether no other A id is linked more with its B id."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = units_of(a_path, b_path)

        def sums() -> pd.DataFrame:
            pair, where = np.unique(units.pairs, return_inverse=True)
            n = np.bincount(where, weights=np.repeat(units.times, np.diff(units.begins)), minlength=len(pair)).astype(np.int64)
            return pd.DataFrame({"pair": pair[n > 0], "n": n[n > 0]})

        for b in batches:
            if len(units.text) > kept_units:
                yield sums()
                units.prune()
            units.of([*b["t"]])
        yield sums()

    summed = rows.select("t").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    top = F.max("n").over(W.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1)))
    return summed.withColumn("best", F.col("n") == top)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", pairs: int = PAIRS, kept_units: int = UNITS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    counts = written(pair_counts(rows, a_path, b_path, kept_units), "pairs")
    kept = None
    if counts.count() <= pairs:
        table = counts.orderBy("pair").toPandas()
        kept = rows.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))

    def values(units: Units, since: int) -> np.ndarray:
        """(best links, sum of counts) of the units from number `since` on."""
        pair, n, best = kept.value if kept is not None else ([],) * 3
        if not len(pair):
            return np.zeros((len(units.text) - since, 2), np.int64)
        begins = units.begins[since:]
        at = np.minimum(np.searchsorted(pair, units.pairs[begins[0] :]), len(pair) - 1)  # units of other tables are not looked up
        sums = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(np.stack((best[at], n[at]), axis=1), axis=0, dtype=np.int64)))
        return np.diff(sums[begins - begins[0]], axis=0)

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, value = units_of(a_path, b_path), np.zeros((0, 2), np.int64)
        for b in batches:
            if len(units.text) > kept_units:
                value = value[units.prune()]
            found = units.of([*b["t"]])
            value = np.concatenate((value, values(units, len(value))))
            sums, digests = np.zeros((len(b), 6), np.int64), [""] * len(b)
            for n, at in enumerate(found):
                if at is not None:
                    sums[n, :4], sums[n, 4:] = units.sizes[at].sum(axis=0), value[at].sum(axis=0)
                    digests[n] = hashlib.sha256(";".join(map(units.text.__getitem__, at.tolist())).encode()).hexdigest()
            out = pd.DataFrame(sums, columns=["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"])
            yield out.assign(groups_sha256=digests, k=b["k"].to_numpy())

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each document's pairs with their times; pair -1 counts the document's rows."""
        units = units_of(a_path, b_path)
        for b in batches:
            if len(units.text) > kept_units:
                units.prune()
            for k, at in zip(b["k"], units.of([*b["t"]]), strict=True):
                met = [units.pairs[units.begins[x] : units.begins[x + 1]] for x in at] if at is not None else []
                pair, n = np.unique(np.concatenate([[-1], *met]).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"k": k, "pair": pair, "n": n})

    out = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = [c.split()[0] for c in out.split(", ")]
    # ids travel as text with a sign before them, so that null ids and large ones come back as they were
    tagged = rows.withColumn("k", F.concat(F.lit("="), F.col("key").cast("string")))
    if kept is not None:
        done = tagged.select(F.coalesce("k", F.lit("")).alias("k"), "t").mapInPandas(sum_up, f"k string, {out}")
    else:
        tagged = tagged.select(F.concat(F.coalesce("k", F.lit("")), F.lit("\n"), F.sha2(F.coalesce("t", F.lit("")), 256)).alias("k"), "t")
        each = tagged.mapInPandas(linked, "k string, pair long, n long").join(counts.withColumnRenamed("n", "all"), "pair", "left")
        sums = each.groupBy("k").agg(
            F.sum(F.when(F.col("pair") < 0, F.col("n"))).alias("rows"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.coalesce(F.col("n") * F.col("all"), F.lit(0))).alias("c")
        )
        done = tagged.mapInPandas(sum_up, f"k string, {out}").join(sums, "k").withColumns({"n_best": F.expr("b div rows"), "count_sum": F.expr("c div rows"), "k": F.substring_index("k", "\n", 1)})
    kind = docs.schema[key].dataType.simpleString()
    return done.select(F.when(F.col("k") != "", F.expr("substring(k, 2)")).cast(kind).alias(key), *names)
