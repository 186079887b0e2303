"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to a bucket: the cells of `k` Gaussian projections, shifted
and cut to `width` standard deviations, 2 * `reach` cells a projection (the outer ones
are open). A query visits the buckets in the order of estimated success: the squared
distance of its projections to the bucket's cells, its own bucket first, the least
perturbed next, until they hold `visit` of the index and at least `LEAST` times as many
rows as are asked for. Candidates of all tables are merged and ranked by exact distance.

Of equal vectors only the `top` + 1 smallest ids can be in a result; the others are not
indexed, so a vector that a third of all rows have is a few rows. Small buckets are put
together, large ones dealt to shares, in groups of about `BLOCK` rows; a query is sent to
the groups that hold buckets it visits, and a group that over `ASKED` queries visit is
copied for the rest of them. Each group returns the `top` best per query, never pairs.
The number of buckets, (2 * reach) ** k a table, is fixed, so their sizes go to the tasks.
Only the scale of the projections is taken from a sample, the `SAMPLE` vectors whose ids have
the smallest hashes, so that it doesn't depend on the order of the rows.

Defined results: vectors that are null, zero, of another length than most, or that hold a
null or non-finite number take no part, as query or candidate; a null id takes no part;
ties go to the smaller id; rows that repeat an id are candidates each, but not of that
id's own queries; fewer candidates than `top` are all returned; an empty table gives no rows; other
columns, of any name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.shared import written

BLOCK = 16_384
ASKED = 32_768
LEAST = 20
SAMPLE = 2000


class Hashes:
    """The tables' projections, and the cells of vectors."""

    def __init__(self, dims: int, scale: float, tables: int, k: int, width: float, reach: int, seed: int = 20240117) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dims, k)) / (width * scale)
        self.b = rng.uniform(0, 1, size=(tables, k))
        self.k, self.reach = k, reach

    def values(self, table: int, x: np.ndarray) -> np.ndarray:
        return x @ self.a[table] + self.b[table]

    def buckets(self, values: np.ndarray) -> np.ndarray:
        cell = np.clip(np.floor(values), -self.reach, self.reach - 1).astype(np.int64) + self.reach
        return cell @ (2 * self.reach) ** np.arange(self.k)

    def gaps(self, values: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Squared distance of each row of values to the cells of each bucket."""
        cell = buckets[:, None] // (2 * self.reach) ** np.arange(self.k) % (2 * self.reach) - self.reach
        low = np.where(cell == -self.reach, -np.inf, cell)
        high = np.where(cell == self.reach - 1, np.inf, cell + 1.0)
        off = np.maximum(0, np.maximum(low[None] - values[:, None], values[:, None] - high[None]))
        return (off**2).sum(axis=2)


def _best(rough: np.ndarray, n: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of rough squared distances the places of the n smallest, and of those as small within the slack."""
    n = min(n, rough.shape[1])
    bound = np.partition(rough, n - 1, axis=1)[:, n - 1]
    return np.nonzero(rough <= (bound + slack)[:, None])


def nearest_in(ids: np.ndarray, x: np.ndarray, buckets: np.ndarray, query_ids: np.ndarray, q: np.ndarray, visited: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's `top` nearest rows but itself in the buckets that it visits: exact, ties to the smaller id."""
    scale = max(float(np.abs(x).max(initial=0)), float(np.abs(q).max(initial=0))) or 1.0  # so that squares stay finite
    a, b = x / scale, q / scale
    asker = np.repeat(np.arange(len(q)), [len(v) for v in visited])
    wanted = np.concatenate(visited) if len(visited) else np.zeros(0, np.int64)
    order = np.argsort(wanted, kind="stable")
    asker, wanted = asker[order], wanted[order]
    row_order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[row_order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bucket in np.unique(sorted_buckets):
        rows = row_order[slice(*np.searchsorted(sorted_buckets, [bucket, bucket + 1]))]
        asking = asker[slice(*np.searchsorted(wanted, [bucket, bucket + 1]))]
        for at in range(0, len(asking), 512):
            some = asking[at : at + 512]
            rough = (a[rows] ** 2).sum(axis=1)[None] + (b[some] ** 2).sum(axis=1)[:, None] - 2 * b[some] @ a[rows].T
            rough[query_ids[some][:, None] == ids[rows][None]] = np.inf
            who, which = _best(rough, top, 1e-9 * (1 + (b[some] ** 2).sum(axis=1)))
            own = query_ids[some[who]] != ids[rows[which]]
            found.append((some[who[own]], rows[which[own]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, row = (np.concatenate(c) for c in zip(*found, strict=True))
    exact = np.concatenate([np.linalg.norm(a[row[k : k + 65_536]] - b[who[k : k + 65_536]], axis=1) for k in range(0, len(row), 65_536)] or [np.zeros(0)])
    order = np.lexsort((ids[row], exact, who))
    who, row = who[order], row[order]
    first = np.searchsorted(who, who)
    keep = np.arange(len(who)) - first < 2 * top  # some to spare for ties that scaling blurs
    who, row = who[keep], row[keep]
    with np.errstate(over="ignore"):
        exact = np.sqrt(((x[row] - q[who]) ** 2).sum(axis=1))
    exact = np.where(np.isfinite(exact) & (exact > 1e-150), exact, np.linalg.norm(a[row] - b[who], axis=1) * scale)  # squares beyond a double's range
    return query_ids[who], ids[row], exact


def nearest(
    rows: DataFrame, every: int = 100, top: int = 10, key: str = "vec_id", vector: str = "embedding", tables: int = 4, k: int = 6, width: float = 0.8, reach: int = 2, visit: float = 0.18
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its nearest rows."""
    v = F.col("v")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(sound)
    sizes = valid.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 1
    valid = valid.filter(F.size("v") == dims)
    sample = np.array([r["v"] for r in valid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]).reshape(-1, dims)
    scale = float(sample.std(axis=0).mean()) * np.sqrt(dims) if len(sample) else 0.0
    hashes = Hashes(dims, scale if 0 < scale < np.inf else 1.0, tables, k, width, reach)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"])
                for t in range(tables):
                    yield pd.DataFrame({"t": t, "bucket": hashes.buckets(hashes.values(t, x)), "id": b["id"], "v": b["v"]})

    able = valid.withColumn("_n", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= top + 1).drop("_n")
    index = written(able.mapInPandas(assign, "t int, bucket long, id long, v array<double>"), "index")
    held = index.groupBy("t", "bucket").count().collect()  # at most tables * (2 * reach) ** k rows
    buckets, count, group, shares = [], [], [], []
    for t in range(tables):
        own = sorted((r["bucket"], r["count"]) for r in held if r["t"] == t)
        buckets.append(np.array([b for b, _ in own], np.int64))
        count.append(np.array([n for _, n in own], np.int64))
        shares.append(np.maximum(1, -(-count[t] // BLOCK)))
        big, before = shares[t] > 1, np.cumsum(count[t])
        group.append(np.where(big, -1 - np.arange(len(own)), before // BLOCK))  # a large bucket is a group of its own
    queries = valid.filter(F.col("id") % every == 0)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                x = np.stack(part["v"])
                for t in range(tables):
                    order = np.argsort(hashes.gaps(hashes.values(t, x), buckets[t]), axis=1, kind="stable")
                    before = np.cumsum(count[t][order], axis=1) - count[t][order]
                    row, nth = np.nonzero(before < max(visit * count[t].sum(), LEAST * (top + 1)))
                    got = order[row, nth]
                    of = pd.DataFrame({"row": row, "grp": group[t][got], "shares": shares[t][got], "bucket": buckets[t][got]}).groupby(["row", "grp", "shares"])["bucket"].agg(list).reset_index()
                    yield pd.DataFrame({"t": t, "grp": of["grp"], "shares": of["shares"], "visited": of["bucket"], "id": part["id"].to_numpy()[of["row"]], "v": part["v"].to_numpy()[of["row"]]})

    asked = written(queries.mapInPandas(probe, "t int, grp long, shares int, visited array<long>, id long, v array<double>"), "asked")
    known = [(t, int(b), int(g), int(n)) for t in range(tables) for b, g, n in zip(buckets[t], group[t], shares[t], strict=True)]
    spark = rows.sparkSession
    places = spark.createDataFrame(known, "t int, bucket long, grp long, shares int")
    crowds = asked.groupBy("t", "grp").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("crowds"))  # as few rows as groups
    laid = index.join(F.broadcast(places), ["t", "bucket"]).join(F.broadcast(crowds), ["t", "grp"])  # groups that no query visits are left out
    laid = laid.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares").cast("long"))).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
    asked = asked.join(F.broadcast(crowds), ["t", "grp"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)))
    asked = asked.withColumn("crowd", F.pmod(F.xxhash64("id"), F.col("crowds").cast("long")).cast("int"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = nearest_in(left["id"].to_numpy(), np.stack(left["v"]), left["bucket"].to_numpy(), right["id"].to_numpy(), np.stack(right["v"]), [*right["visited"]], top)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    by = ["t", "grp", "share", "crowd"]
    columns = lambda df, *more: df.select(*by, "id", "v", *more)
    found = columns(laid, "bucket").groupBy(*by).cogroup(columns(asked, "visited").groupBy(*by)).applyInPandas(rank, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
