"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrowth.functions.shared import forgotten, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, and the smallest node it reaches.

    Alternates large-star and small-star steps until the edges no longer change; every
    step is a grouped minimum and a join, so no neighbourhood is gathered in a list and
    the number of rounds is logarithmic. Null ends and loops are ignored.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    stars = written(edges.dropna(subset=[a, b]).filter(F.col(a) != F.col(b)).select(hi.alias("hi"), lo.alias("lo")), "edges")
    before = None
    while True:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = written(large, "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        next_stars = written(low.select("hi", F.col("m").alias("lo")).union(small).distinct(), "small")
        for done in (stars, large):
            forgotten(done)
        stars = next_stars
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    out = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return out.union(stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
