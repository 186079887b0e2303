"""Folds over the ordered items of a group, for rules whose next step depends on what the last ones decided."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A row a group: the values in order, one array each (`order` breaks no ties, the values do). Groups are pages or paragraphs, which are bounded."""
    items = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_{n}") for n, c in enumerate(order)), *values)))
    held = rows.groupBy(*keys).agg(items.alias("_items"))
    each = lambda c: F.transform("_items", lambda i: i[c]).alias(c)
    return held.select(*keys, *map(each, values))


def folded(groups: DataFrame, keys: list[str], fold: Callable[..., Iterable[tuple]], out: str) -> DataFrame:
    """The rows that `fold` makes of each group's arrays, with the group's keys before them."""
    kinds = dict(groups.dtypes)
    names = [c for c in groups.columns if c not in keys]
    columns = [*keys, *(c.strip().split(" ")[0] for c in out.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = zip(*(b[c] for c in keys), strict=True), zip(*(b[c] for c in names), strict=True)
            made = [(*key, *row) for key, lists in zip(*held, strict=True) for row in fold(*([] if x is None else [*x] for x in lists))]
            if made:
                yield pd.DataFrame(made, columns=columns)

    return groups.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {out}")
