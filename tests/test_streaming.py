"""Streams over several micro-batches, with late rows and expiry."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docgrowth.streaming import operators as o

FORM = "event_id long, user_id long, ts timestamp, event_type string, x long"


@pytest.fixture
def stream(spark, tmp_path):
    """A function that writes each list of rows as a file of its own and reads them as a stream, one file a trigger."""

    def make(*batches):
        for n, rows in enumerate(batches):
            made = [(i, u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), e, x) for i, u, h, e, x in rows]
            spark.createDataFrame(made, FORM).coalesce(1).write.mode("append").parquet(str(tmp_path / f"batch-{n:03}"))
        return spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "batch-*"))

    return make


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_state_goes_on_across_batches(stream):
    s = stream([(1, 7, 0, "click", 1), (2, 7, 1, "click", 2)], [(3, 7, 2, "click", 3), (4, 8, 2, "purchase", 9)], [(5, 7, 30, "click", 4), (6, 7, 31, "click", 500)])
    day = s.withColumn("day", F.to_date("ts"))
    assert rows(o.drained(o.quota(day, limit=2), "append"), "event_id", "n", "free") == [(1, 1, True), (2, 2, True), (3, 3, False), (4, 1, True), (5, 1, True), (6, 2, True)]
    assert rows(o.drained(o.multi_click(s.filter("event_type = 'click'"), 7200, 50), "append"), "event_id", "level") == [(1, 1), (2, 2), (3, 3), (5, 1), (6, 1)]
    flags = s.withColumn("clicks", (F.col("event_type") == "click").cast("long")).withColumn("conversions", (F.col("x") > 3).cast("long"))
    assert rows(o.drained(o.rolling_cvr(flags, n=2), "append"), "event_id", "cvr")[-1] == (6, 1.0)


def test_bursts_settle_by_a_later_click_or_by_time(stream):
    s = stream([(1, 7, 0, "click", 1), (2, 7, 1, "click", 2)], [(3, 7, 5, "click", 2)], [(4, 9, 100, "click", 0)], [(5, 9, 101, "click", 0)])
    got = rows(o.drained(o.settled_clicks(s, 7200, 50, late="1 hour"), "append"), "user_id", "first_event", "clicks", "level")
    assert got == [(7, 1, 2, 2), (7, 3, 1, 1)]  # the burst of user 9 is still open


def test_idle_keys_are_forgotten(stream):
    s = stream([(1, 7, 0, "click", 1)], [(2, 8, 500, "click", 1)], [(3, 8, 501, "click", 1)], [(4, 7, 502, "click", 1)]).withColumn("doc", F.col("user_id"))
    rings = o.drained(o.recent_events(s, most=2, late="1 hour", idle=3_600_000), "append").groupBy("doc").agg(F.max_by("ring", "last").alias("ring"))
    assert rows(rings, "doc", "ring") == [(7, [4]), (8, [2, 3])]
    bad = s.withColumn("outcome", F.lit("legacy-fallback")).withColumn("reason", F.concat(F.lit("r"), F.col("event_id").cast("string")))
    assert rows(o.drained(o.auto_stop(bad), "append"), "doc", "reason") == [(7, "r1"), (8, "r2")]


def test_windows_close_once_and_late_rows_are_left_out(stream):
    s = stream([(1, 1, 1, "error", 0), (2, 1, 2, "view", 0)], [(3, 1, 60, "view", 0)], [(7, 1, 61, "view", 0)], [(4, 1, 3, "view", 0), (5, 1, 100, "view", 0)], [(6, 1, 130, "view", 0)])
    got = rows(o.drained(o.daily_summary(s, late="1 day"), "append"), "day", "n", "errors")
    assert got == [(dt.date(2024, 1, 1), 2, 1), (dt.date(2024, 1, 3), 2, 0)]  # row 4 came when its day was closed; later days are open


def test_workspace_actions_are_appended(stream):
    s = stream([(1, 1, 0, "purchase", 0), (2, 1, 1, "signup", 0)], [(3, 1, 2, "purchase", 0)], [(4, 1, 3, "view", 0), (5, 1, 4, "purchase", 0)])
    got = rows(o.drained(o.workspace_state(s), "append"), "event_id", "state", "actions")
    assert got == [(1, "uploaded", []), (2, "intent_set", []), (3, "action_done", ["purchase:3"]), (4, "action_done", ["purchase:3"]), (5, "action_done", ["purchase:3", "purchase:5"])]


def test_duplicates_across_batches_and_an_empty_stream(stream):
    s = stream([(1, 1, 0, "view", 0)], [(1, 1, 0, "view", 0), (2, 1, 1, "view", 0)], [])
    assert rows(o.drained(o.deduplicated(s), "append"), "event_id") == [(1,), (2,)]
    assert o.drained(s.filter("event_id > 99"), "append").count() == 0


def test_a_funnel_of_windows_counts_each_event_once(stream):
    s = stream(
        [(1, 1, 1, "upload", 0), (2, 1, 2, "analyze", 0), (1, 1, 1, "upload", 0)], [(1, 1, 2, "upload", 0), (3, 1, 3, "click_action", 0)], [(4, 1, 40, "download", 0)], [(5, 1, 80, "upload", 0)],
        [(6, 1, 2, "upload", 0), (4, 1, 41, "download", 0)], [(7, 1, 130, "upload", 0)],
    ).selectExpr("event_id", "ts", "event_type AS event", "if(event_type = 'analyze', 'YES', null) AS value_flag")
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    got = [(r["start"] - start, *tuple(r)[1:]) for r in o.drained(o.windowed_funnel(s), "append").orderBy("start").collect()]
    assert got == [(0, 1, 1, 0, 1, 0, 3), (86400, 0, 0, 0, 0, 1, 1), (3 * 86400, 1, 0, 0, 0, 0, 1)]  # 6 came when its day was closed


def test_quota_of_many_users_by_shares(stream):
    first = [(n, n, 1, "purchase", 0) for n in range(300)] + [(2000, None, 2, "purchase", 0)]
    then = [(300 + n, n, 2, "purchase", 0) for n in range(300)] + [(2001, None, 3, "purchase", 0), (2**53 + 1, 2**53 + 1, 3, "purchase", 0)]
    s = stream(first, then).withColumn("day", F.to_date("ts"))
    got = {r["event_id"]: (r["user_id"], r["n"], r["free"]) for r in o.drained(o.quota(s, limit=1, shares=4), "append").collect()}
    assert got == {e: (u, 1, True) for e, u, *_ in first} | {e: (u, 2, False) for e, u, *_ in then} | {2**53 + 1: (2**53 + 1, 1, True)}
