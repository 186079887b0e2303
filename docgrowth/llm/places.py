"""Places of pieces in sequences, from a plan over the histogram of their lengths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.shared import written


@dataclass(frozen=True)
class Plan:
    """Runs of equal pieces: ranks [first, first + run * many) of `length` fill `many` sequences from `sequence`, `run` in each, from `offset`.

    There are no more runs than classes of sequences times distinct lengths in one, which
    the capacity bounds, not the corpus.
    """

    length: np.ndarray
    first: np.ndarray
    run: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


class PlanBuilder:
    def __init__(self) -> None:
        self.used: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def add(self, content: list[tuple[int, int]], many: int) -> None:
        """`many` sequences that each hold `run` pieces of each length, in this order."""
        offset = 0
        for length, run in content:
            first = self.used.get(length, 0)
            self.rows.append((length, first, run, self.sequences, offset))
            self.used[length] = first + run * many
            offset += run * length
        self.sequences += many

    def done(self) -> Plan:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5)
        return Plan(*rows.T, self.sequences)


def lengths(pieces: DataFrame) -> dict[int, int]:
    """How many pieces have each length: as many rows as there are lengths, at most the capacity."""
    return {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}


def _place(plan: Plan):
    """A function of length and rank that gives the place; the plan goes to the tasks, its size is bounded."""
    stride = np.int64(1 << 44)
    starts = plan.length * stride + plan.first

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(starts, n * stride + r, "right") - 1
        along = r - plan.first[k]
        return pd.DataFrame({"sequence_id": plan.sequence[k] + along // plan.run[k], "offset": plan.offset[k] + along % plan.run[k] * n})

    return place


def placed(pieces: DataFrame, plan: Plan, order: list[str]) -> DataFrame:
    """pieces with sequence_id and offset.

    Ranks within a length are counted in `salts` shares by hash, so that a length of very
    many pieces is spread; the shares' sizes are summed up before them.
    """
    salts = 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = W.partitionBy("length").orderBy("_share").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("length", "_share").count().select("length", "_share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_share").orderBy(*order)) - 1)
    place = _place(plan)
    put = ranked.join(base, ["length", "_share"]).withColumn("_at", place("length", F.col("_base") + F.col("_rank")))
    return put.select(*pieces.columns, "_at.sequence_id", "_at.offset")


#: Offsets of (length, part) up to this many are broadcast (12 MB); more are joined by a shuffle.
BROADCAST_OFFSETS = 500_000


def placed_by_part(pieces: DataFrame, plan: Plan) -> DataFrame:
    """As placed(), for pieces that carry their part and their rank within part and length: the pieces themselves are not shuffled."""
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = written(pieces.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")), "offsets")
    base = F.broadcast(base) if base.count() <= BROADCAST_OFFSETS else base
    put = pieces.join(base, ["length", "part"]).withColumn("_at", _place(plan)("length", F.col("_base") + F.col("rank")))
    return put.select(*pieces.columns, "_at.sequence_id", "_at.offset")
