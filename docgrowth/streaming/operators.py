"""Structured Streaming operators: running counts, windows, keyed state with expiry, and a helper to run them to their end.

Every operator with a watermark gives its windows once they are closed (append), so its state
is dropped; rows later than the watermark are left out. Keyed operators keep a small state per
key and forget it when the watermark is `idle` past the key's last row; of one trigger's rows
those of a single key have to fit a worker, so bound triggers at the source (maxFilesPerTrigger).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from docgrowth.functions.shared import located, shared_dir


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All rows of a stream's available input, by way of a table in the shared folder; of complete output the last state.

    A batch has a folder of its own, so one that is run again after a failure replaces its rows.
    """
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/in_batch={n}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/in_batch=-1")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns)


class KeyedTable:
    """A table of one row a key in a folder, kept up to date by batches: each writes the keys it changes, and no others.

    A batch has a folder by its number, so one that runs again after a failure replaces its own rows and changes nothing
    else. A key's row is that of the last batch that has it. compact() folds batches into one, for few files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/in_batch=-1")

    def write(self, batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/in_batch={n}")

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path + "/in_batch=*")
        rows = rows.withColumn("_batch", F.regexp_extract(F.input_file_name(), "in_batch=(-?[0-9]+)", 1).cast("long"))
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "_batch").alias("r"))
        return last.select("r.*")

    def compact(self, upto: int) -> None:
        """One batch for all up to this number; to be called between batches, after it is written."""
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/in_batch={n}" for n in self.batches() if n <= upto))
        rows = rows.withColumn("_batch", F.regexp_extract(F.input_file_name(), "in_batch=(-?[0-9]+)", 1).cast("long"))
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "_batch").alias("r")).select("r.*")
        old = [n for n in self.batches() if n < upto]
        last.write.mode("overwrite").parquet(f"{self.path}/_compacted")
        self.spark.read.schema(self.schema).parquet(f"{self.path}/_compacted").write.mode("overwrite").parquet(f"{self.path}/in_batch={upto}")
        for name in [*(f"in_batch={n}" for n in old), "_compacted"]:
            at, files = located(self.spark, f"{self.path}/{name}")
            files.delete(at, True)

    def batches(self) -> list[int]:
        at, files = located(self.spark, self.path)
        return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(at) if f.getPath().getName().startswith("in_batch="))


def updated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key of a stream's available input, in update mode, by way of a keyed table in the shared folder."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/keyed-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{path}/rows", stream.schema, keys)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(table.write).start()
    query.awaitTermination()
    return table.read()


def ab_counts(events: DataFrame) -> DataFrame:
    """Running impressions and clicks per variant; in update mode only of variants that changed."""
    return events.groupBy("variant").agg(F.count_if(F.col("event_type") == "view").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))


def daily_summary(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows and errors per tumbling day, closed once the watermark has passed it."""
    day = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return day.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.to_date("w.start").alias("day"), "n", "errors")


def event_rates(events: DataFrame, width: str = "6 hours", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts per window and type; tumbling, or sliding if a slide is given."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts per user and session: bursts parted by a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def export_coverage(events: DataFrame) -> DataFrame:
    return events.groupBy("outcome").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """The first row of each id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_funnel(events: DataFrame, width: str = "1 day", late: str = "1 day", key: str = "event_id") -> DataFrame:
    """Stages of the funnel per window, each event once: duplicates within the watermark go, and windows come when they are closed.

    Both keep their state in one streaming query, and drop it as the watermark passes.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    at = lambda e: F.count_if(F.col("event") == e)
    counts = once.groupBy(F.window("ts", width).alias("w")).agg(
        at("upload").alias("uploads"), F.count_if((F.col("event") == "analyze") & (F.col("value_flag") == "YES")).alias("yes"), at("open_loop_view").alias("open_loop_views"),
        at("click_action").alias("clicks"), at("download").alias("downloads"), F.count("*").alias("total"),
    )
    return counts.select(F.unix_timestamp("w.start").alias("start"), *counts.columns[1:])


def evidence_capture(events: DataFrame, samples: DataFrame, least: float = 1.0) -> DataFrame:
    """Events whose value is further than `least` from their sample's, by a join with the static table."""
    return events.join(samples, "user_id").filter(F.abs(F.col("expected") - F.col("value")) > least)


Rows = Iterator[pd.DataFrame]


def _ordered(batches: Rows, *by: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values([*by])


_DAY = 86_400_000


def _stateful(
    events: DataFrame, keys: list[str], step: Callable[[tuple, pd.DataFrame, tuple], tuple[pd.DataFrame, tuple]], out: str, state: str, start: tuple, late: str, idle: int,
    closed: Callable[[tuple, tuple], pd.DataFrame] | None = None,
) -> DataFrame:
    """Groups' rows in order of time through `step`, with the state that it returns kept until the watermark is `idle` milliseconds past the last row; `closed` tells what a state gives then."""

    def run(key: tuple, batches: Rows, kept: GroupState) -> Rows:
        if kept.hasTimedOut:
            last = tuple(kept.get)
            kept.remove()
            if closed:
                yield closed(key, last)
            return
        rows = _ordered(batches, "ts", "event_id")
        made, new = step(key, rows, tuple(kept.get) if kept.exists else start)
        kept.update(new)
        kept.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000) + idle, kept.getCurrentWatermarkMs() + 1))
        yield made

    return events.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


_NOBODY = -(2**63)


def quota(exports: DataFrame, limit: int = 3, late: str = "1 day", shares: int = 64) -> DataFrame:
    """(user_id, event_id, n, free): numbered per user and day; a day's count is forgotten once it is past.

    Users are dealt to `shares` shares by a hash, and a share's counts of a day are one state, so the number of states and
    calls does not grow with the users. A row of a day that is past is late, so it makes no difference that a share's last
    row is not each user's. No user is a user, too.
    """

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        before = dict(zip(*state, strict=True))
        n = rows.groupby("_user").cumcount() + 1 + rows["_user"].map(before).fillna(0).astype("int64")
        counts = before | n.groupby(rows["_user"]).max().to_dict()
        user = rows["_user"].astype("Int64").mask(rows["_user"] == _NOBODY)
        return pd.DataFrame({"user_id": user, "event_id": rows["event_id"], "n": n, "free": n <= limit}), ([int(u) for u in counts], [int(c) for c in counts.values()])

    user = F.coalesce(F.col("user_id").cast("long"), F.lit(_NOBODY))
    dealt = exports.select("ts", "event_id", "day", user.alias("_user"), F.pmod(F.xxhash64("user_id"), F.lit(shares)).alias("_share"))
    return _stateful(dealt, ["_share", "day"], step, "user_id long, event_id long, n long, free boolean", "users array<long>, counts array<long>", ([], []), late, _DAY)


def rolling_cvr(log: DataFrame, n: int = 10, late: str = "1 day", idle: int = 30 * _DAY) -> DataFrame:
    """(user_id, event_id, cvr): conversions over clicks of the key's last n rows."""

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        clicks, wins, out = list(state[0]), list(state[1]), []
        for c, w in zip(rows["clicks"], rows["conversions"], strict=True):
            clicks, wins = [*clicks, int(c)][-n:], [*wins, int(w)][-n:]
            out.append(sum(wins) / max(sum(clicks), 1))
        return pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "cvr": out}), (clicks, wins)

    return _stateful(log, ["user_id"], step, "user_id long, event_id long, cvr double", "clicks array<long>, wins array<long>", ([], []), late, idle)


def multi_click(clicks: DataFrame, gap_seconds: float, reach: float, most: int = 3, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, level): length of the burst so far, at most `most`; a burst goes on while clicks are near in time and place."""

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        at, x, level, out = *state, []
        for ts, px in zip(rows["ts"], rows["x"], strict=True):
            now = ts.timestamp()
            level = level + 1 if level and now - at <= gap_seconds and abs(px - x) <= reach else 1
            at, x = now, float(px)
            out.append(min(level, most))
        return pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "level": out}), (at, x, level)

    return _stateful(clicks, ["user_id"], step, "user_id long, event_id long, level long", "at double, x double, level long", (0.0, 0.0, 0), late, int(1000 * gap_seconds) + 1)


def settled_clicks(clicks: DataFrame, gap_seconds: float, reach: float, most: int = 3, late: str = "1 day") -> DataFrame:
    """(user_id, first_event, clicks, level) of each burst once it is over: when the next click is too far, or when the watermark is past its interval."""
    names = ["user_id", "first_event", "clicks", "level"]

    def over(key: tuple, state: tuple) -> tuple:
        return key[0], state[2], state[3], min(state[3], most)

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        out = []
        for ts, px, event in zip(rows["ts"], rows["x"], rows["event_id"], strict=True):
            now, goes_on = ts.timestamp(), state[3] and ts.timestamp() - state[0] <= gap_seconds and abs(px - state[1]) <= reach
            if state[3] and not goes_on:
                out.append(over(key, state))
            state = (now, float(px), state[2] if goes_on else int(event), state[3] + 1 if goes_on else 1)
        return pd.DataFrame(out, columns=names), state

    closed = lambda key, state: pd.DataFrame([over(key, state)], columns=names)
    form = "user_id long, first_event long, clicks long, level long"
    return _stateful(clicks, ["user_id"], step, form, "at double, x double, first long, n long", (0.0, 0.0, 0, 0), late, int(1000 * gap_seconds) + 1, closed)


def recent_events(events: DataFrame, most: int = 200, late: str = "1 day", idle: int = 30 * _DAY) -> DataFrame:
    """(doc, last, ring): after each trigger, of the documents it touched, the ids of the last `most` events; the row of greatest `last` counts."""

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        ring = [*state[0], *(int(e) for e in rows["event_id"])][-most:]
        return pd.DataFrame({"doc": [key[0]], "last": [rows["ts"].max()], "ring": [ring]}), (ring,)

    return _stateful(events, ["doc"], step, "doc long, last timestamp, ring array<long>", "ring array<long>", ([],), late, idle)


def auto_stop(events: DataFrame, late: str = "1 day", idle: int = 30 * _DAY) -> DataFrame:
    """(doc, event_id, reason): the first suspect event of each key, once; later ones don't change the latch until the key was idle."""

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        bad = rows[rows["outcome"] == "legacy-fallback"].head(0 if state[0] else 1)
        return pd.DataFrame({"doc": key[0], "event_id": bad["event_id"], "reason": bad["reason"]}), (bool(state[0] or len(bad)),)

    return _stateful(events, ["doc"], step, "doc long, event_id long, reason string", "stopped boolean", (False,), late, idle)


def workspace_state(events: DataFrame, most: int = 1000, late: str = "1 day", idle: int = 30 * _DAY) -> DataFrame:
    """(user_id, event_id, state, actions): uploaded, intent_set once a sign-up came, action_done from the first purchase after it; the actions done so far, the last `most`."""

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        now, actions, out, done = state[0], list(state[1]), [], []
        for e, event in zip(rows["event_type"], rows["event_id"], strict=True):
            now = "intent_set" if e == "signup" and now == "uploaded" else "action_done" if e == "purchase" and now == "intent_set" else now
            if e == "purchase" and now == "action_done":
                actions = [*actions, f"{e}:{event}"][-most:]
            out.append(now)
            done.append(actions)
        return pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "state": out, "actions": done}), (now, actions)

    return _stateful(events, ["user_id"], step, "user_id long, event_id long, state string, actions array<string>", "state string, actions array<string>", ("uploaded", []), late, idle)
