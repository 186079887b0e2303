"""Token ids of texts, packed into matrices.

Packing is best-fit decreasing: pieces by falling length, each into the fullest
sequence that takes it. It works on the histogram of lengths, at most `capacity`
numbers however large the corpus: sequences with the same content are one class with a
count, and a segment tree over the free capacities finds the tightest class that fits.
The plan gives each piece a place by its rank among the pieces of its length.

Defined results: null text is empty and has only the end id; longer documents are cut
into pieces of the capacity, the last may be shorter, nothing is dropped; repeated rows
are packed each, rows of null id too (their members have a null key); an empty table gives
no sequence; other columns, of any name, play no part.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrowth.functions.shared import written
from docgrowth.llm.places import Plan, PlanBuilder, lengths, placed_by_part

#: Texts with other characters than these are encoded whole, without the cache of words.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-įı-ɏ‐-‧€]|<\|")


def _plain(text: str) -> bool:
    """Whether each word of the text, by Python's white space, gets the ids that it has in the text."""
    if text.isascii():
        return not any(sign in text for sign in ("<|", "\x1c", "\x1d", "\x1e", "\x1f"))
    return not _PLAIN.search(text)


#: A character that no plain text has; alone between blanks it parts words that are encoded at once.
_PARTING = "\u2603"


class Encoder:
    """Encodes texts by a `tokenizers` file; ids as little-endian unsigned 32-bit numbers.

    Where the vocabulary marks the ends of words and blanks are dropped, a text's ids are
    those of its words one after another, so the ids of `limit` words are kept. New words
    are encoded as one text, parted by a character whose first id no plain word can have.
    """

    def __init__(self, path: str, limit: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already take all cores
        from tokenizers import Tokenizer

        assert sys.byteorder == "little" and array("I").itemsize == 4

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:  # a file of the tokenizer package, on each machine
            self.by_word = bool(json.load(f)["model"].get("end_of_word_suffix"))
        mark = self.tokenizer.encode(_PARTING, add_special_tokens=False)
        # byte-level names of the character's first two bytes; plain characters have others
        self.mark = mark.ids if mark.tokens and mark.tokens[0].startswith("\u00e2\u013a") else None
        self.limit = limit
        self.known: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by few calls."""
        if not self.mark:
            return self._direct(words)
        out = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_PARTING} ".join(["", *part])], add_special_tokens=False)[0].ids, "<u4")
            start = np.flatnonzero(ids == self.mark[0])
            raw, skip = ids.tobytes(), len(self.mark)
            ends = [*(4 * start[1:]).tolist(), len(raw)]
            got = [raw[s:e] for s, e in zip((4 * (start + skip)).tolist(), ends, strict=True)]
            out += got if len(got) == len(part) else self._direct(part)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.known
        for at in range(0, len(texts), 200):
            part = [t or "" for t in texts[at : at + 200]]
            split = [t.lower().split() if self.by_word and _plain(t) else None for t in part]
            fresh = [*{w for s in split if s for w in s if w not in known}]
            ids = zip(fresh, self._words(fresh), strict=True)
            if len(known) < self.limit:
                known.update(ids)
                of = known.__getitem__
            else:  # words that came too late are kept for this part only
                own = dict(ids)
                of = lambda w: own[w] if w in own else known[w]  # noqa: B023, E731
            for t, s in zip(part, split, strict=True):
                yield self._direct([t])[0] if s is None else b"".join(map(of, s))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker, so that its words serve all tasks there."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str, text: str | Column, keep_ids: str = "") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids with the end id after them.

    With `keep_ids`, a number type, also the ids, the task's number, and the piece's rank among the task's pieces of its length.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows, held = [], 0
            for k, ids in zip(b["k"], known.encode([*b["t"]]), strict=True):
                ids += end
                for n, s in enumerate(range(0, len(ids), 4 * capacity)):
                    p = ids[s : s + 4 * capacity]
                    more = (np.frombuffer(p, "<u4").astype(keep_ids).tobytes(), task, seen[len(p)]) if keep_ids else ()
                    seen[len(p)] += 1
                    rows.append((k, n, s // 4, len(p) // 4, zlib.crc32(p), *more))
                held += len(ids)
                if held > 1 << 25:
                    yield pd.DataFrame(rows)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows)

    source = docs.select(F.col(key).alias("k"), (F.col(text) if isinstance(text, str) else text).alias("t"))
    return source.mapInPandas(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary, part int, rank long" * bool(keep_ids))


class _Tree:
    """Segment tree over capacities 0..n; finds the least one that holds a class and is at least x."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        k = at + self.size
        self.some[k] = value
        while k > 1:
            k //= 2
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def least_from(self, x: int) -> int | None:
        k = x + self.size
        if self.some[k]:
            return x
        while k > 1:
            if not k & 1 and self.some[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k + (not self.some[2 * k])
                return k - self.size
            k //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Classes of equal sequences, as one-by-one best-fit decreasing would fill them."""
    tree = _Tree(capacity)
    free: dict[int, list[list]] = {}  # capacity left -> [how many sequences, (length, run)...]

    def put(left: int, group: list) -> None:
        free.setdefault(left, []).append(group)
        tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rest = counts[length]
        while rest:
            left = tree.least_from(length)
            if left is None:
                each = capacity // length
                whole, over = divmod(rest, each)
                if whole:
                    put(capacity - each * length, [whole, (length, each)])
                if over:
                    put(capacity - over * length, [1, (length, over)])
                break
            group = free[left].pop()
            if not free[left]:
                tree.set(left, False)
            many, content = group[0], group[1:]
            each = left // length
            whole = min(many, rest // each)
            if whole:
                put(left - each * length, [whole, *content, (length, each)])
                rest -= whole * each
                many -= whole
            if many and 0 < rest < each:
                put(left - rest * length, [1, *content, (length, rest)])
                rest, many = 0, many - 1
            if many:
                put(left, [many, *content])
    plan = PlanBuilder()
    for left in sorted(free):
        for many, *content in free[left]:
            plan.add(content, many)
    return plan.done()


def packed(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, pad_id: int = 0, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per sequence: a row of the id matrix at full width, tokens used, cumulative lengths, and positions that restart at each piece.

    Columns: sequence_id, n_tokens, id_bytes (2 or 4, the width of a number), ids binary and position_ids binary (`capacity`
    little-endian unsigned numbers each, as a matrix file holds them), cu_seqlens array<int>, members array of (key, piece).
    Padding has `pad_id` and positions that restart once more.
    """
    wide = max(encoder(path).tokenizer.get_vocab_size(), end_id + 1, pad_id + 1, capacity)
    size = 2 if wide <= 1 << 16 else 4
    cut = written(pieces(docs, path, capacity, end_id, key, text, keep_ids=f"<u{size}"), "ids")
    put = placed_by_part(cut, best_fit_decreasing(lengths(cut), capacity))

    row = F.struct("offset", "length", "ids", F.col(key).alias("key"), "piece")
    whole = put.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("parts"), F.sum("length").cast("int").alias("n_tokens"))
    ramp, pad = (F.lit(x.astype(f"<u{size}").tobytes()) for x in (np.arange(capacity), np.full(capacity, pad_id)))
    first = lambda of, n: F.substring(of, F.lit(1), (size * n).cast("int"))  # noqa: E731  # the first n numbers
    joined = lambda of: F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, of(p)))
    rest = F.lit(capacity) - F.col("n_tokens")
    return whole.select(
        "sequence_id", "n_tokens", F.lit(size).alias("id_bytes"),
        F.concat(joined(lambda p: p["ids"]), first(pad, rest)).alias("ids"),
        F.concat(F.array(F.lit(0)), F.transform("parts", lambda p: (p["offset"] + p["length"]).cast("int"))).alias("cu_seqlens"),
        F.concat(joined(lambda p: first(ramp, p["length"])), first(ramp, rest)).alias("position_ids"),
        F.transform("parts", lambda p: F.struct(p["key"].alias("key"), p["piece"].alias("piece"))).alias("members"),
    )
