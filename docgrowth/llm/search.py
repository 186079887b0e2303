"""Many ranked searches at once over all documents, their common parts computed once.

Items (queries) that share terms share work. Each term of an item, with its number of
repeats, is a leaf. Pairs of nodes that several items hold are mined greedily, the most
frequent first, and become a node of their own, until no pair stands in two items: a DAG
of shared term sets. For a batch of documents each leaf's scores are looked up, each
shared set's partial accumulator is the sum of its two parts' and is made once, and an
item's scores are the sum of the few nodes it is left with.

Items are taken in passes of at most `PASS` and in blocks of at most `BLOCK`, so a plan
is bounded by these, whatever the number of items; each pass scans the documents twice
(statistics, scores). A task keeps the best `top` documents of each item it met, with
ties, and sends nothing else on.

Terms are runs of digits, A-Z as a-z, and characters outside ASCII. Defined results: null
and empty texts have no term and are never found, but need no row; items of null id or
without terms have no row; of rows that repeat an item's id the one of smallest text
counts; rows that repeat a document are documents of their own; documents of null id
count, and come after others of the same score; empty tables give an empty result; other
columns, of any name, play no part. The documents' id has to be a whole number.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, PASS = 256, 4096
#: Documents scored at once.
STEP = 128
_TERM = bytes(ord(" ") if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 * (0x41 <= b <= 0x5A) for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM).split()


class Sharing:
    """The DAG of a block: node i of the first `leaves` is a leaf, later ones are the sum of two earlier nodes."""

    def __init__(self, items: list[set[int]], leaves: int) -> None:
        held = [set(x) for x in items]
        where: dict[int, set[int]] = defaultdict(set)
        together: Counter = Counter()
        for n, nodes in enumerate(held):
            for x in nodes:
                where[x].add(n)
            together.update(combinations(sorted(nodes), 2))
        heap = [(-n, pair) for pair, n in together.items() if n > 1]
        heapify(heap)
        pairs, depth = [], [0] * leaves
        while heap:
            n, (x, y) = heappop(heap)
            both = where[x] & where[y]
            if len(both) < 2:
                continue
            if len(both) != -n:  # it was more frequent before other pairs were taken out
                heappush(heap, (-len(both), (x, y)))
                continue
            new = leaves + len(pairs)
            pairs.append((x, y))
            depth.append(1 + max(depth[x], depth[y]))
            met: Counter = Counter()
            for item in both:
                held[item] -= {x, y}
                where[x].discard(item)
                where[y].discard(item)
                met.update(held[item])
                held[item].add(new)
            where[new] = set(both)
            for z, times in met.items():
                if times > 1:
                    heappush(heap, (-times, (z, new)))
        self.pairs = np.array(pairs, np.int64).reshape(-1, 2)
        level = np.array(depth[leaves:], np.int64)
        self.levels = [np.flatnonzero(level == d) for d in range(1, int(level.max(initial=0)) + 1)]
        self.leaves = leaves
        self.nodes = np.array([x for nodes in held for x in sorted(nodes)], np.int64)
        self.begins = np.cumsum([0, *(len(nodes) for nodes in held)])[:-1]

    def scores(self, leaf: np.ndarray) -> np.ndarray:
        """(items, documents) of (leaves, documents)."""
        made = np.empty((self.leaves + len(self.pairs), leaf.shape[1]), np.int64)
        made[: self.leaves] = leaf
        for level in self.levels:
            made[self.leaves + level] = made[self.pairs[level, 0]] + made[self.pairs[level, 1]]
        return np.add.reduceat(made[self.nodes], self.begins, axis=0)


class Plan:
    """Items' terms, numbered, and the shared sets of each block of items."""

    def __init__(self, items: list[list[bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        self.blocks = []
        for at in range(0, len(items), BLOCK):
            leaf: dict[tuple[int, int], int] = {}
            sets = []
            for found in items[at : at + BLOCK]:
                counts = Counter(self.number.setdefault(t, len(self.number)) for t in found)
                sets.append({leaf.setdefault(x, len(leaf)) for x in counts.items()})
            self.blocks.append((at, np.array([*leaf], np.int64), Sharing(sets, len(leaf))))

    def frequencies(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """(documents, terms of the plan) of occurrences, and all terms of each document."""
        tf, lengths = np.zeros((len(texts), len(self.number)), np.int64), []
        for row, text in zip(tf, texts, strict=True):
            found = terms(text)
            lengths.append(len(found))
            at = np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))
            row += np.bincount(at + 1, minlength=len(row) + 1)[1:]
        return tf, lengths


def _statistics(rows: DataFrame, plan: Plan) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms of all documents, and documents of each of the plan's terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(plan.number) + 2, np.int64)
        for b in batches:
            for at in range(0, len(b), STEP):
                tf, lengths = plan.frequencies([*b["t"].iloc[at : at + STEP]])
                sums[2:] += (tf > 0).sum(axis=0)
                sums[:2] += sum(n > 0 for n in lengths), sum(lengths)
        yield pd.DataFrame({"at": np.flatnonzero(sums), "n": sums[sums > 0]})

    found = rows.select("t").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    sums = np.zeros(len(plan.number) + 2, np.int64)
    for r in found.collect():  # a row a term of the pass
        sums[r["at"]] = r["n"]
    return int(sums[0]), int(sums[1]), sums[2:]


class Best:
    """The best rows of each item so far: score, then id; null ids last."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, null, id
        self.bar = np.ones(items, np.int64)  # scores below it can't come in

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.bar[first : first + len(scores), None])
        if not len(item):
            return
        new = (item + first, scores[item, doc], null[doc], ids[doc])
        rows = [np.concatenate(x) for x in zip(self.rows, new, strict=True)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        begins = np.flatnonzero(np.diff(rows[0], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        self.rows = [x[rank < self.top] for x in rows]
        last = rank == self.top - 1
        self.bar[rows[0][last]] = rows[1][last]


def _scored(rows: DataFrame, plan: Plan, items: int, top: int) -> DataFrame:
    n_docs, n_terms, df = _statistics(rows, plan)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(items, top)
        for b in batches:
            null, ids = b["none"].to_numpy().astype(np.int64), b["d"].to_numpy(np.int64)
            for at in range(0, len(b), STEP):
                tf, lengths = plan.frequencies([*b["t"].iloc[at : at + STEP]])
                m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths], np.int64) if n_terms else np.ones(len(lengths), np.int64)
                part = weight * (1_000_000_000 * tf // (1000 * tf + 8 * m[:, None]))
                for first, leaf, sharing in plan.blocks:
                    best.add(first, sharing.scores((part[:, leaf[:, 0]] * leaf[:, 1]).T), ids[at : at + STEP], null[at : at + STEP])
        item, score, null, doc = best.rows
        yield pd.DataFrame({"item": item, "score": score, "none": null > 0, "d": doc})

    return rows.mapInPandas(score, "item long, score long, none boolean, d long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents, all whose score is above 0 if fewer."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("d"), F.col(text).alias("t"))
    asked = items.select(F.col(item).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).filter("i is not null").groupBy("i").agg(F.min("t").alias("t"))
    parts, rest = [], asked.orderBy("i").toLocalIterator()  # a pass of items at a time
    while some := [*islice(rest, PASS)]:
        found = [(r["i"], t) for r in some if (t := terms(r["t"]))]
        if not found:
            continue
        met = _scored(rows, Plan([t for _, t in found]), len(found), top)
        order = W.partitionBy("item").orderBy(F.desc("score"), "none", "d")
        ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(found)], f"item long, item_id {items.schema[item].dataType.simpleString()}")
        parts.append(ranked.join(F.broadcast(names), "item"))  # at most PASS rows
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema[item].dataType.simpleString()}, rank int, `{key}` {kind}, score long")
    done = parts[0]
    for part in parts[1:]:
        done = done.union(part)
    return done.select("item_id", "rank", F.when(~F.col("none"), F.col("d")).cast(kind).alias(key), "score")


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS terms FROM documents),
e AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS t FROM d),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms)) AS terms FROM d),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM e GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT item_id, {_SPLIT} AS terms FROM (SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)),
wanted AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(terms) AS t FROM q) GROUP BY ALL),
weighed AS (SELECT item_id, t, times * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM wanted JOIN df USING (t), total),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // CAST(terms AS BIGINT))))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (t), total GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
