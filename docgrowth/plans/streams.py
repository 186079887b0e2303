"""Queries of the streaming operators: the events table read as a stream to its end, against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrowth.operators import growth as g
from docgrowth.plans import growth as _growth  # noqa: F401  # whose twin of value_funnel is used
from docgrowth.plans.base import ORACLE, query
from docgrowth.plans.views import Views
from docgrowth.streaming import operators as o


def _events(v: Views) -> DataFrame:
    """The events table as a stream; the pattern lets the source read a single file as well as a folder."""
    path = v.tables["events"].removeprefix("parquet.`").removesuffix("t`") + "[t]"
    return v.spark.readStream.schema(v.events.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _k(name: str = "props"):
    return F.regexp_extract(name, "[0-9]+", 0).cast("long")


_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'core' WHEN 'error' THEN 'legacy-fallback' ELSE 'legacy-only' END"
query("stream_ab_counts", lambda v: o.updated(o.ab_counts(_events(v).filter("event_type in ('view', 'click')").withColumn("variant", F.col("user_id") % 4)), ["variant"]),
      "SELECT user_id % 4 AS variant, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM {events} e WHERE event_type IN ('view', 'click') GROUP BY 1")
_ROLL = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
query("stream_rolling_cvr", lambda v: o.drained(o.rolling_cvr(_events(v).withColumn("clicks", (F.col("event_type") == "click").cast("long")).withColumn("conversions", (F.col("event_type") == "purchase").cast("long"))), "append"),
      f"SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'purchase') {_ROLL} / greatest(count(*) FILTER (WHERE event_type = 'click') {_ROLL}, 1)::DOUBLE AS cvr FROM {{events}} e")
#: Windows are given once the watermark, a day before the last event, has passed their end.
_CLOSED = "(SELECT epoch(max(ts)) - 86400 FROM {events} w)"
query("stream_daily_summary", lambda v: o.drained(o.daily_summary(_events(v)), "append"), f"SELECT cast(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM {{events}} e GROUP BY 1 HAVING epoch(cast(ts AS DATE)) + 86400 <= {_CLOSED}")
query("stream_quota", lambda v: o.drained(o.quota(_events(v).filter("event_type = 'purchase'").withColumn("day", F.to_date("ts"))), "append"), "SELECT user_id, event_id, n, n <= 3 AS free FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS n FROM {exports} e) t")
query("stream_multi_click", lambda v: o.drained(o.multi_click(_events(v).filter("event_type = 'click'").withColumn("x", _k()), 21600, 50), "append"), """SELECT user_id, event_id, least(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id), 3) AS level FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
    SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 21600 AND abs(x - lag(x) OVER w) <= 50 THEN 0 ELSE 1 END AS fresh FROM {clicks} c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) f) r""")
_BURSTS = """(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 21600 AND abs(x - lag(x) OVER w) <= 50 THEN 0 ELSE 1 END AS fresh FROM {clicks} c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) f)"""
query("stream_settled_clicks", lambda v: o.drained(o.settled_clicks(_events(v).filter("event_type = 'click'").withColumn("x", _k()), 21600, 50), "append"), f"""SELECT user_id, first_event, n AS clicks, least(n, 3) AS level FROM (SELECT user_id, run, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS n, max(epoch(ts)) AS last,
    max(run) OVER (PARTITION BY user_id) AS runs FROM {_BURSTS} r GROUP BY user_id, run) t WHERE run < runs OR last + 21600 <= (SELECT epoch(max(ts)) - 86400 FROM {{clicks}} w)""")
query("stream_evidence_capture", lambda v: o.drained(o.evidence_capture(_events(v).select("event_id", "user_id", "value"), v.sql("SELECT DISTINCT user_id, user_id % 90 AS expected FROM {events} e")), "append").select("event_id", "value"),
      "SELECT event_id, value FROM {events} e WHERE abs(user_id % 90 - value) > 1")
query("stream_export_coverage", lambda v: o.updated(o.export_coverage(_events(v).withColumn("outcome", F.expr(_OUTCOME))), ["outcome"]), f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM {{events}} e GROUP BY 1")
query("stream_recent_events", lambda v: o.drained(o.recent_events(_events(v).withColumn("doc", F.col("user_id")), most=5), "append").groupBy("doc").agg(F.max_by("ring", "last").alias("ring")).select("doc", F.array_join("ring", ",").alias("ring")),
      "SELECT user_id AS doc, string_agg(event_id, ',' ORDER BY ts, event_id) AS ring FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {events} e) t WHERE n <= 5 GROUP BY user_id")
query("stream_auto_stop", lambda v: o.drained(o.auto_stop(_events(v).withColumn("doc", F.col("user_id")).withColumn("outcome", F.expr(_OUTCOME)).withColumn("reason", F.when(_k() % 5 == 0, "missing-original-bounds").when(_k() % 5 > 1, F.concat(F.lit("r"), (_k() % 5).cast("string"))))), "append"),
      "SELECT doc, arg_min(event_id, (ts, event_id)) AS event_id, arg_min_null(reason, (ts, event_id)) AS reason FROM {export_events} e WHERE outcome = 'legacy-fallback' GROUP BY doc")
query("stream_workspace_state", lambda v: o.drained(o.workspace_state(_events(v)), "append").withColumn("actions", F.array_join("actions", ",")), """SELECT user_id, event_id, CASE WHEN done > 0 THEN 'action_done' WHEN set_ > 0 THEN 'intent_set' ELSE 'uploaded' END AS state, coalesce(actions, '') AS actions FROM (
    SELECT *, sum(CASE WHEN event_type = 'purchase' AND set_ > 0 THEN 1 ELSE 0 END) OVER w AS done, string_agg(CASE WHEN event_type = 'purchase' AND set_ > 0 THEN concat('purchase:', event_id) END, ',') OVER w AS actions FROM (
    SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS set_ FROM {events} e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) b""")
_STAGED = (
    "event_id", "user_id AS doc_id", "ts", "CASE event_type WHEN 'view' THEN 'upload' WHEN 'signup' THEN 'analyze' WHEN 'click' THEN 'open_loop_view' WHEN 'purchase' THEN 'click_action' ELSE 'download' END AS event",
    "CASE WHEN event_type = 'signup' THEN CASE WHEN value > 50 THEN 'YES' ELSE 'NO' END END AS value_flag",
)
#: Every event comes twice; the funnel counts each once. The closed days in one streaming query, and the batch funnel over deduplicated rows.
_TWICE = lambda v: _events(v).union(_events(v)).selectExpr(*_STAGED)
query("stream_funnel", lambda v: g.value_funnel(o.drained(o.deduplicated(_TWICE(v)), "append")), ORACLE["value_funnel"])
query("stream_windowed_funnel", lambda v: o.drained(o.windowed_funnel(_TWICE(v)), "append"), f"""SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT AS start, count(*) FILTER (WHERE event = 'upload') AS uploads, count(*) FILTER (WHERE event = 'analyze' AND value_flag = 'YES') AS yes, count(*) FILTER (WHERE event = 'open_loop_view') AS open_loop_views,
    count(*) FILTER (WHERE event = 'click_action') AS clicks, count(*) FILTER (WHERE event = 'download') AS downloads, count(*) AS total FROM {{value_events}} e GROUP BY 1 HAVING start + 86400 <= {_CLOSED}""")
query("windowed_event_rates", lambda v: o.drained(o.event_rates(_events(v)), "append"), f"SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS start, event_type, count(*) AS n FROM {{events}} e GROUP BY 1, 2 HAVING start + 21600 <= {_CLOSED}")
query("sliding_event_rates", lambda v: o.drained(o.event_rates(_events(v), slide="3 hours"), "append"), f"SELECT ((floor(epoch(ts) / 10800) - i) * 10800)::BIGINT AS start, event_type, count(*) AS n FROM {{events}} e, range(2) r(i) GROUP BY 1, 2 HAVING start + 21600 <= {_CLOSED}")
query("session_event_counts", lambda v: o.drained(o.sessions(_events(v)), "append"), """SELECT user_id, floor(min(epoch(ts)))::BIGINT AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
    SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS fresh FROM {events} e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) f) r GROUP BY user_id, run HAVING max(epoch(ts)) + 21600 <= (SELECT epoch(max(ts)) - 86400 FROM {events} w)""")
