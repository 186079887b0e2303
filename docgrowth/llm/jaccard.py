"""Join of near copies by the Jaccard similarity of their word n-grams.

Parity-sketch join. Documents with equal sets are one class. Per band of set sizes, a
set's hashed tokens are dealt to B blocks and XORed; a token changes one block only, so
the number of differing blocks (and the Hamming distance of the one-bit-a-token parity
sketch) is at most the symmetric difference. Sets as similar as asked differ in at most
d tokens, so of B = d + slack blocks at least the slack are equal: classes are joined on
equal blocks. Blocks of few tokens are left out as long as enough equal ones must remain,
which keeps common tokens from making candidates. Candidates are verified on the sets
themselves.

Only what links need is compared: first every class with the centre it meets in most
blocks, then, exhaustively, what shares a block and is not connected yet. So a group of n near
copies takes about n comparisons, and no link between different texts that would join
two components is lost.

Blocks come from classes, not from rows: a task sends each class once, so a text copied
many times makes no more rows than there are tasks, and equal rows of a key are one.

Defined results: null text and text without words has an empty set and no links; the
component is the smallest id reachable, the id itself included; rows that repeat an id
are judged by their own text; an empty table gives no rows; other columns, of any name, play no part. Sets are of
64-bit hashes, classes of their 64-bit digest. Whole texts are read; a very long one is
hashed alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.graph import components
from docgrowth.functions.shared import written
from docgrowth.llm.hashing import gram_hashes, mix, word_hashes

_M = np.uint64(0x9E3779B97F4A7C15)
#: Ids up to this many are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Classes of a key that meet all others of it in one task; of more, shares of about so many do, two at a time.
MEETING = 2000
#: Classes whose sizes and sketches are broadcast (10 MB).
BROADCAST_FACTS = 50_000
#: Classes that a task remembers having sent (about 20 MB); beyond that it begins anew, and what comes twice is dropped later.
SEEN = 200_000
#: Bits of the parity sketch that is compared before sets are, in words of 64.
SKETCH_WORDS = 16


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word n-grams; of the whole sequence if it has fewer words."""
    for words, begins in word_hashes(texts):
        grams = gram_hashes(words, size)
        for s, e in itertools.pairwise(begins):
            n = e - s
            yield np.unique(grams[s : e - size + 1] if n >= size else gram_hashes(words[s:e], n) if n else words[:0])


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Bands:
    """Bands of set sizes, and for each the number of blocks that the pigeonhole needs.

    A set of n tokens meets sets of up to n * 100 / percent tokens, so it differs from a
    similar one in at most `differing` tokens and all other blocks are equal. From these
    `spare` equal blocks those of few tokens are left out while `need` of them stay: two
    similar sets share at least `need` keys.
    """

    def __init__(self, percent: int, ratio: float = 1.6) -> None:
        self.percent, self.ratio = percent, ratio

    def of(self, n: int) -> list[tuple[int, int, int, int]]:
        """(band, blocks, spare, need) of each band that a set of n tokens takes part in."""
        out = []
        for k in (k0 := self._band(n), k0 + 1):
            low, high = self._low(k), self._low(k + 1) - 1
            if 100 * n >= self.percent * low:
                most = self._differing(2 * high)
                blocks = most + 2 + math.ceil(0.2 * most)
                partner = min(high, n * 100 // self.percent)
                out.append((k, blocks, blocks - self._differing(n + partner), 1 + math.ceil(0.05 * most)))
        return out

    def need(self, n: int) -> int:
        return min((need for *_, need in self.of(n)), default=1) if n else 1

    def _differing(self, both: int) -> int:
        return both * (100 - self.percent) // (100 + self.percent)

    def _low(self, k: int) -> int:
        return math.ceil(self.ratio**k)

    def _band(self, n: int) -> int:
        k = max(0, int(math.log(n) / math.log(self.ratio)))
        while self._low(k + 1) <= n:
            k += 1
        while k and self._low(k) > n:
            k -= 1
        return k


def block_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the blocks by which a set can be found; equal sets of tokens in a block give equal keys."""
    out = []
    for band, blocks, spare, need in bands.of(len(s)):
        block = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with the sorted hashes
        count = np.bincount(block.astype(np.int64), minlength=blocks)
        start = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1))
        words = np.zeros(blocks, np.uint64)
        words[block[start].astype(np.int64)] = np.bitwise_xor.reduceat(mix(s), start)
        least = next((t for t in (3, 2, 1) if np.count_nonzero(count < t) <= spare - need), 0)
        keep = np.flatnonzero(count >= least)
        where = (keep.astype(np.uint64) + np.uint64(band * 1_000_003 + 17) * np.uint64(1 << 32)) * _M
        out.append(mix(words[keep] ^ mix(where)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """Bit sketch in which each token flips one bit."""
    bit = (mix(s ^ _M) & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _rows(docs: DataFrame, key: str, text: str | Column) -> DataFrame:
    return docs.select(F.col(key).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))


def class_of(docs: DataFrame, key: str, text: str | Column, size: int, percent: int) -> DataFrame:
    """(id, n, need, sig, sketch): size, keys it shares with a similar one, digest and parity sketch of each document's set."""
    bands = Bands(percent)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(len(s), bands.need(len(s)), _digest(s), parity(s)) for s in shingle_sets([*b["text"]], size)]
            yield pd.DataFrame(rows, columns=["n", "need", "sig", "sketch"]).assign(id=b["id"].to_numpy())

    return _rows(docs, key, text).mapInPandas(sign, f"n long, need long, sig long, sketch array<long>, id {docs.schema[key].dataType.simpleString()}")


def runs_of_keys(batches: Iterator[np.ndarray], common: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows (key, sig) sorted by both: the distinct ones of keys with at least two, and whether a key has more than `common`.

    Holds back at most `common` rows, so a key may have any number.
    """
    held = np.zeros((0, 2), np.int64)
    large = last = None  # key and last sig of a run that is known to be common and goes on
    for rows in batches:
        rows = np.concatenate([held, rows])
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        rows, held = rows[keep], held[:0]
        if large is not None and len(rows):
            n = int(np.searchsorted(rows[:, 0], large, "right"))
            ahead = rows[:n] if n and rows[0, 1] != last else rows[1:n]
            if len(ahead):
                yield ahead, np.ones(len(ahead), bool)
            last = rows[n - 1, 1] if n else last
            rows = rows[n:]
            if not len(rows):
                continue
            large = None
        if not len(rows):
            continue
        start = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        size = np.diff(np.append(start, len(rows)))
        each = np.repeat(size, size)
        whole = each > 1
        if size[-1] <= common:
            held = rows[start[-1] :]
            whole[start[-1] :] = False
        else:
            large, last = rows[-1]
        if whole.any():
            yield rows[whole], each[whole] > common
    if len(held) > 1:
        yield held, np.zeros(len(held), bool)


def shared_blocks(docs: DataFrame, text: str | Column, size: int, percent: int, common: int = 16) -> DataFrame:
    """(key, sig, common): classes in each block that at least two classes share; common if more than so many do."""
    bands = Bands(percent)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # classes that this task has sent; their copies need not be sent again
        for b in batches:
            for at in range(0, len(b), 500):
                sets = {_digest(s): s for s in shingle_sets([*b["text"].iloc[at : at + 500]], size) if len(s)}
                fresh = {sig: s for sig, s in sets.items() if sig not in seen}
                seen = (seen if len(seen) < SEEN else set()) | fresh.keys()
                if fresh:
                    yield pd.DataFrame({"sig": [*fresh], "keys": [block_keys(s, bands) for s in fresh.values()]})

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, often in runs_of_keys((b[["key", "sig"]].to_numpy(np.int64) for b in batches), common):
            yield pd.DataFrame({"key": rows[:, 0], "sig": rows[:, 1], "common": often})

    rows = docs.select((F.col(text) if isinstance(text, str) else text).alias("text")).mapInPandas(emit, "sig long, keys array<long>")
    dealt = rows.select(F.explode("keys").alias("key"), "sig").repartition("key").sortWithinPartitions("key", "sig")
    return dealt.mapInPandas(shared, "key long, sig long, common boolean")


def _sets(docs: DataFrame, key: str, text: str | Column, size: int, chosen: DataFrame) -> DataFrame:
    """(sig, n, tokens) of the chosen (id, sig); their number decides how they meet their texts."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                sets = [*shingle_sets([*part["text"]], size)]
                ok = [_digest(s) == g for s, g in zip(sets, part["sig"], strict=True)]  # of rows that repeat an id
                yield pd.DataFrame({"sig": part["sig"].to_numpy(), "n": [len(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]})[ok]

    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    return _rows(docs, key, text).join(chosen, "id").mapInPandas(expand, "sig long, n long, tokens array<long>").dropDuplicates(["sig"])


def _telling(blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, sig) without what no link needs.

    A class in fewer keys than it shares with any similar one has no link. Two similar
    classes share `need` keys, so if either has fewer keys than that among the common
    ones, they also share another: it leaves these out. A class has no more keys than tokens.
    """
    own = W.partitionBy("sig")
    marked = blocks.withColumn("keys", F.count("*").over(own)).withColumn("commons", F.count_if("common").over(own)).join(facts.select("sig", "need"), "sig")
    kept = marked.filter((F.col("keys") >= F.col("need")) & (~F.col("common") | (F.col("commons") >= F.col("need"))))
    return kept.select("key", "sig")


class Join:
    """What the rounds of one join share: the documents, and per class its size, sketch and one id."""

    def __init__(self, docs: DataFrame, key: str, text: str | Column, size: int, percent: int, facts: DataFrame) -> None:
        self.docs, self.key, self.text, self.size, self.percent, self.facts = docs, key, text, size, percent, facts
        self.small = facts.count() <= BROADCAST_FACTS

    def side(self, x: str) -> DataFrame:
        facts = F.broadcast(self.facts) if self.small else self.facts
        return facts.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"), F.col("least").alias(f"id_{x}"))

    def possible(self) -> Column:
        """Whether sizes and sketches of a and b allow the similarity."""
        apart = F.aggregate(F.zip_with("k_a", "k_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        fit = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        return fit & ((100 + self.percent) * apart <= (100 - self.percent) * (F.col("n_a") + F.col("n_b")))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) with n, id of both, all possible, those whose sets are as similar as asked."""
        pairs = written(pairs.select("a", "b", "id_a", "id_b"), "possible")
        if pairs.isEmpty():
            return pairs.select("a", "b")
        chosen = written(pairs.select(F.col("id_a").alias("id"), F.col("a").alias("sig")).union(pairs.select("id_b", "b")).distinct(), "chosen")
        sets = written(_sets(self.docs, self.key, self.text, self.size, chosen), "sets")
        one, two = (sets.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"s_{x}")) for x in "ab")
        met = pairs.select("a", "b").join(two, "b").join(one, "a").withColumn("i", F.size(F.array_intersect("s_a", "s_b")))
        return met.filter(100 * F.col("i") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")

    def links(self, blocks: DataFrame) -> DataFrame:
        """Verified links (a, b) between classes, enough of them to connect all that is connected.

        In each shared block the class that meets most others in all its blocks is the
        centre (a copy's original meets all copies); each class is tested with the centre
        that it meets in most blocks. Then every pair is tested that shares a block
        and is not connected by way of one or two centres.
        """
        size = blocks.groupBy("key").count().filter("count > 1")
        blocks = written(blocks.join(size, "key"), "met")
        weight = blocks.groupBy("sig").agg(F.sum("count").alias("weight"))
        centre = blocks.join(weight, "sig").groupBy("key").agg(F.max_by("sig", F.struct("weight", "sig")).alias("a"))
        met = blocks.join(centre, "key").filter("sig <> a").groupBy(F.col("sig").alias("b"), "a").count()
        pairs = met.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        star = written(self.linked(pairs.join(self.side("a"), "a").join(self.side("b"), "b").filter(self.possible())), "star")
        once = star.select("b", "a").join(star.select(F.col("b").alias("a"), F.col("a").alias("top")), "a", "left")
        label = once.select(F.col("b").alias("sig"), F.coalesce("top", "a").alias("component"))
        marked = blocks.select("key", "sig").join(label, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        mixed = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        live = written(marked.join(mixed, "key"), "live")
        # a key with many classes is dealt to shares, and each two shares meet in a task of their own
        large = live.groupBy("key").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("shares")).filter("shares > 1")
        met = live.join(large, "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("shares").cast("long")).cast("int"))
        pair = {"a": F.sequence(F.col("own"), F.col("shares") - 1), "b": F.sequence(F.lit(0), F.col("own"))}
        place = {"a": ("own", "other"), "b": ("other", "own")}

        def meeting(x: str) -> DataFrame:
            dealt = met.withColumn("other", F.explode(pair[x]))
            return dealt.select(F.col("key").alias(f"key_{x}"), *(F.col(c).alias(f"{n}_{x}") for c, n in zip(place[x], ("p", "q"), strict=True)), F.col("sig").alias(x), F.col("component").alias(f"c_{x}")).join(self.side(x), x)

        one, two = meeting("a"), meeting("b")
        # within one share each two classes meet once; of two shares the smaller number is on the side of a, whichever digest is smaller
        order = (F.col("p_a") < F.col("q_a")) | (F.col("a") < F.col("b"))
        near = (F.col("key_a") == F.col("key_b")) & (F.col("p_a") == F.col("p_b")) & (F.col("q_a") == F.col("q_b")) & order & (F.col("c_a") != F.col("c_b")) & self.possible()
        pairs = one.join(two, near).select("a", "b", "id_a", "id_b").distinct()
        return star.select("a", "b").union(self.linked(pairs))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str | Column = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, class_id, component_id) for every row of docs."""
    signed = written(class_of(docs, key, text, size, percent), "signed")
    blocks = written(shared_blocks(docs, text, size, percent), "blocks")
    first = signed.filter("n > 0").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n", "need", "sketch")))
    facts = written(first.join(blocks.select("sig").distinct(), "sig", "left_semi"), "facts")
    label = components(Join(docs, key, text, size, percent, facts).links(_telling(blocks, facts))).withColumnRenamed("node", "sig")
    least = label.join(facts.select("sig", "least"), "sig")
    joined = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("sig", "component_id", "least")
    copied = first.filter("rows > 1").select("sig", F.col("least").alias("own"))
    known = written(copied.join(joined, "sig", "full").select("sig", F.coalesce("component_id", "own").alias("component_id"), F.coalesce("own", "least").alias("class_id")), "known")
    out = signed.select("id", "n", "sig").join(known, "sig", "left")
    pick = lambda c: F.when(F.col("n") > 0, F.coalesce(c, "id")).otherwise(F.col("id")).alias(c)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), pick("class_id"), pick("component_id"))
