"""Best-fit packing by exact complements.

Works on the histogram of piece lengths. Single lengths, sums of pairs and sums of
triples that are still available are indexed; a sequence starts with the longest piece
left and its gap is filled exactly by one, two or three pieces if any do, as often as the
counts allow; else the longest piece that fits goes in (best fit) and the new gap is
looked up again. Each pattern uses up a length, so their number is bounded by the
capacity. Pieces get their places by rank within their length.

Defined results: as in docgrowth.llm.tokens (null ids, repeated rows, empty tables, other
columns too); every piece has one place, offsets of a
sequence have no gaps, ties go to the longer piece.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame

from docgrowth.functions.shared import written
from docgrowth.llm.places import Plan, PlanBuilder, lengths, placed
from docgrowth.llm.tokens import pieces


class _Sums:
    """Which sums one, two or three available lengths make; that of pairs is renewed now and then, as lengths run out."""

    def __init__(self, counts: np.ndarray, renew: int = 64) -> None:
        self.counts, self.renew, self.age = counts, renew, renew

    def _pair(self, gap: int) -> tuple[int, int] | None:
        c = self.counts
        some = c[: gap + 1] > 0
        both = some & some[::-1]
        if gap % 2 == 0 and c[gap // 2] < 2:
            both[gap // 2] = False
        at = np.flatnonzero(both)
        return (int(at[-1]), int(gap - at[-1])) if len(at) else None

    def _triple(self, gap: int) -> tuple[int, int, int] | None:
        c = self.counts
        if self.age >= self.renew:
            some = c > 0
            self.pairs = np.zeros(len(c), bool)
            for a in np.flatnonzero(some):
                self.pairs[a:] |= some[: len(c) - a]
            self.age = 0
        self.age += 1
        tried = np.flatnonzero((c[: gap + 1] > 0) & self.pairs[: gap + 1][::-1])
        for a in tried[::-1]:
            c[a] -= 1
            rest = self._pair(int(gap - a))
            c[a] += 1
            if rest:
                return int(a), *rest
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to gap."""
        return (gap,) if self.counts[gap] else self._pair(gap) or self._triple(gap)


def exact_complements(counts: dict[int, int], capacity: int) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, plan = _Sums(left), PlanBuilder()
    while len(available := np.flatnonzero(left)):
        taken = [int(available[-1])]
        left[taken[0]] -= 1
        gap = capacity - taken[0]
        while gap:
            more = sums.exact(gap)
            if not more:
                fits = np.flatnonzero(left[: gap + 1])
                if not len(fits):
                    break
                more = (int(fits[-1]),)
            taken += more
            for n in more:
                left[n] -= 1
            gap -= sum(more)
        content = Counter(taken)
        many = 1 + min(int(left[n]) // run for n, run in content.items())
        for n, run in content.items():
            left[n] -= run * (many - 1)
        plan.add(sorted(content.items(), reverse=True), many)
    return plan.done()


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cut = written(pieces(docs, path, capacity, end_id, key, text), "pieces")
    return placed(cut, exact_complements(lengths(cut), capacity), [key, "piece"])
