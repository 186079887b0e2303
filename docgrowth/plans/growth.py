"""Queries of the growth operators, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docgrowth.functions.shared import shared_dir
from docgrowth.operators import growth as g
from docgrowth.plans.base import query
from docgrowth.plans.views import TABLES

_ROAS = "CASE WHEN spend > 0 THEN revenue / spend ELSE 0e0 END"
_ACTED = f"(SELECT *, {_ROAS} AS roas, CASE WHEN {_ROAS} < 1 THEN 'STOP' WHEN {_ROAS} >= 2 THEN 'SCALE' ELSE 'HOLD' END AS action FROM {{campaigns}} c)"

query("campaign_roi", lambda v: g.campaign_roi(v.campaigns), f"""SELECT id, CASE WHEN impressions > 0 THEN clicks / impressions::DOUBLE * 100 ELSE 0e0 END AS ctr,
    CASE WHEN clicks > 0 THEN spend / clicks ELSE 0e0 END AS cpc, CASE WHEN clicks > 0 THEN conversions / clicks::DOUBLE * 100 ELSE 0e0 END AS conversion_rate,
    CASE WHEN spend > 0 THEN (revenue - spend) / spend ELSE 0e0 END AS roi, {_ROAS} AS roas FROM {{campaigns}} c""")
query("roas_action", lambda v: g.roas_action(v.campaigns), f"""SELECT id, roas, action, CASE WHEN action = 'SCALE' THEN least(30, floor((roas - 2) * 15 + 20 + 0.5)::BIGINT) END AS budget_rise,
    CASE WHEN action = 'HOLD' THEN (2 - roas) / roas * 100 END AS potential FROM {_ACTED} a""")
query("auto_optimize_budget", lambda v: g.auto_optimize_budget(v.campaigns), f"""SELECT id, CASE WHEN status = 'ACTIVE' AND action = 'STOP' THEN 'PAUSED' ELSE status END AS status,
    CASE WHEN status = 'ACTIVE' AND action = 'SCALE' THEN floor(daily_budget * 1.25e0 + 0.5e0) ELSE daily_budget END AS daily_budget, CASE WHEN status = 'ACTIVE' THEN action END AS action FROM {_ACTED} a""")
query("active_campaigns", lambda v: g.active_campaigns(v.campaigns).select("id", "clicks", "spend"), "SELECT id, clicks, spend FROM {campaigns} c WHERE status = 'ACTIVE'")
query(
    "campaign_upsert",
    lambda v: g.upsert(v.campaigns.filter("id < 60").select("id", "status", "clicks"), v.campaigns.filter("id >= 40").select("id", F.lit("NEW").alias("status"), "clicks"), "id"),
    "SELECT id, CASE WHEN id >= 40 THEN 'NEW' ELSE status END AS status, clicks FROM {campaigns} c",
)
query(
    "campaign_patch",
    lambda v: g.patch(v.campaigns.select("id", "status", "clicks"), v.campaigns.filter("id % 2 = 0").select((F.col("id") + 50).alias("id"), F.when(F.col("id") % 4 == 0, "PATCHED").alias("status")), "id"),
    "SELECT c.id, coalesce(p.status, c.status) AS status, c.clicks FROM {campaigns} c LEFT JOIN (SELECT id + 50 AS id, CASE WHEN id % 4 = 0 THEN 'PATCHED' END AS status FROM {campaigns} b WHERE id % 2 = 0) p ON c.id = p.id",
)
query("click_conversion_signal", lambda v: g.click_conversion_signal(v.campaigns).select("id", "signal"), """SELECT id, CASE WHEN conversions / greatest(clicks, 1)::DOUBLE < 0.5 THEN 'STOP'
    WHEN conversions / greatest(clicks, 1)::DOUBLE > 2 THEN 'SCALE' ELSE 'HOLD' END AS signal FROM {campaigns} c""")
query("roi_decision", lambda v: g.roi_decision(v.page_perf).select("user_id", "day", "roi", "decision"), """SELECT user_id, day, revenue / greatest(cost, 1) AS roi,
    CASE WHEN revenue / greatest(cost, 1) >= 2 THEN 'SCALE' WHEN revenue / greatest(cost, 1) >= 1 THEN 'HOLD' ELSE 'PAUSE' END AS decision FROM {page_perf} p""")
_DEAD = """(impressions < 100 AND clicks = 0 AND revenue = 0) OR (impressions > 500 AND clicks / greatest(impressions, 1)::DOUBLE < 0.005) OR (cost > 50 AND revenue / greatest(cost, 1) < 0.5)"""
query("dead_pages", lambda v: g.dead_pages(v.page_perf).select("user_id", "day", "dead"), f"SELECT user_id, day, {_DEAD} AS dead FROM {{page_perf}} p")
query("decision_summary", lambda v: g.decision_summary(g.roas_action(v.campaigns)), f"SELECT action, count(*) AS n FROM {_ACTED} a GROUP BY action")
query("collection_counts", lambda v: g.collection_counts({t: getattr(v, t) for t in TABLES}), " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {{{t}}} t" for t in TABLES))

_CVR = "conversions / greatest(clicks, 1)::DOUBLE"
query("conversion_status", lambda v: g.conversion_status(v.click_campaigns), f"SELECT *, {_CVR} AS cvr, CASE WHEN {_CVR} < 0.01 THEN 'FAIL' WHEN {_CVR} < 0.05 THEN 'OK' ELSE 'GOOD' END AS status FROM {{click_campaigns}} c")


def _rate(n: int) -> str:
    w = f"OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"sum(conversions) {w}::DOUBLE / greatest(sum(clicks) {w}, 1)::DOUBLE"


query("rolling_cvr", lambda v: g.rolling_cvr(v.conv_log).select("user_id", "day", "cvr"), f"SELECT user_id, day, {_rate(10)} AS cvr FROM {{conv_log}} c")
query("cvr_trend", lambda v: g.cvr_trend(v.conv_log).select("user_id", "day", "recent", "older", "trend"), f"""SELECT user_id, day, recent, older, CASE WHEN n < 10 THEN 'stable' WHEN recent > 1.1e0 * older THEN 'improving'
    WHEN recent < 0.9e0 * older THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT user_id, day, {_rate(5)} AS recent, {_rate(10)} AS older, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM {{conv_log}} c) t""")
_DECIDED = f"""SELECT *, CASE WHEN decision = 'SCALE_ADS' THEN least(1.5e0, cvr / 0.08e0) END AS factor, CASE WHEN clicks >= 100 AND decision = 'HOLD' THEN (0.08e0 - cvr) / cvr * 100 END AS potential FROM (
    SELECT *, {_CVR} AS cvr, CASE WHEN clicks < 100 THEN 'HOLD' WHEN {_CVR} < 0.01e0 THEN 'PAUSE_ADS' WHEN {_CVR} > 0.08e0 THEN 'SCALE_ADS' ELSE 'HOLD' END AS decision FROM {{click_campaigns}} c) d"""
query("auto_decide", lambda v: g.auto_decide(v.click_campaigns), _DECIDED)
query("auto_decide_batch", lambda v: g.auto_decide_batch(v.click_campaigns)[1], "SELECT name AS page, clicks, conversions FROM {click_campaigns} c")

_TOTALS = """SELECT variant, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM {ab_events} e GROUP BY ROLLUP (variant)"""
_CTR = f"(SELECT *, clicks / greatest(impressions, 1)::DOUBLE AS ctr FROM ({_TOTALS}) t WHERE variant IS NOT NULL)"
query("ab_variant_totals", lambda v: g.ab_variant_totals(v.ab_events), _TOTALS)
query("ab_rank", lambda v: g.ab_rank(g.ab_variant_totals(v.ab_events)).withColumn("rank", F.col("rank").cast("long")), f"SELECT *, row_number() OVER (ORDER BY ctr DESC, variant) AS rank FROM {_CTR} c")
query("ab_winner", lambda v: g.ab_winner(g.ab_variant_totals(v.ab_events)), f"SELECT variant, ctr FROM {_CTR} c ORDER BY ctr DESC, variant LIMIT 1")


def _snapshot(v):
    """Writes two snapshots of a test, and one of an empty test, and reads them back."""
    path, ranked = f"{shared_dir(v.spark)}/snapshots-{uuid.uuid4().hex}", g.ab_rank(g.ab_variant_totals(v.ab_events))
    for stamp in ("2024-01-01", "2024-01-02"):
        g.ab_snapshot(ranked, path, "titles", stamp)
    g.ab_snapshot(ranked.limit(0), path, "empty", "2024-01-01")
    return v.spark.read.parquet(path).select("test", F.col("stamp").cast("string").alias("stamp"), "variant", "rank")


query("ab_snapshot", _snapshot, f"SELECT 'titles' AS test, stamp, variant, row_number() OVER (PARTITION BY stamp ORDER BY ctr DESC, variant)::INT AS rank FROM {_CTR} c, (SELECT unnest(['2024-01-01', '2024-01-02']) AS stamp) s")
query("variant_assignment", lambda v: g.variant_assignment(v.events.select("user_id").distinct(), hashed=False), "SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS variant FROM {events} e")
query("variant_funnel", lambda v: g.variant_funnel(v.value_events), "SELECT variant, " + ", ".join(f"count(*) FILTER (WHERE event = '{s}') AS {s}" for s in g.STAGES) + " FROM {value_events} e GROUP BY variant")


def _funnel(count: str) -> str:
    one = lambda cond: (f"count(DISTINCT CASE WHEN {cond} THEN doc_id END)" if count == "distinct" else f"count(*) FILTER (WHERE {cond})")
    return f"""SELECT *, CASE WHEN uploads > 0 THEN floor(yes / uploads::DOUBLE * 100 * 10 + 0.5) / 10 ELSE 0e0 END AS yes_ratio,
        CASE WHEN open_loop_views > 0 THEN floor(clicks / open_loop_views::DOUBLE * 100 * 10 + 0.5) / 10 ELSE 0e0 END AS click_rate FROM (
        SELECT {one("event = 'upload'")} AS uploads, {one("event = 'analyze' AND value_flag = 'YES'")} AS yes, {one("event = 'open_loop_view'")} AS open_loop_views,
        {one("event = 'click_action'")} AS clicks, {one("event = 'download'")} AS downloads, count(*) AS total FROM {{value_events}} e) f"""


query("value_funnel", lambda v: g.value_funnel(v.value_events), _funnel("all"))
query("funnel_dedup", lambda v: g.value_funnel(v.value_events, distinct=True), _funnel("distinct"))
query("funnel_kpis", lambda v: g.funnel_kpis(v.value_events), f"SELECT CASE WHEN yes > 0 THEN clicks / yes::DOUBLE ELSE 0e0 END AS click_rate, CASE WHEN clicks > 0 THEN downloads / clicks::DOUBLE ELSE 0e0 END AS secondary_intent FROM ({_funnel('all')}) f")
query("collection_find", lambda v: g.collection_find(v.value_events, event="upload", variant="B").select("event_id", "doc_id"), "SELECT event_id, doc_id FROM {value_events} e WHERE event = 'upload' AND variant = 'B'")
query(
    "insert_if_absent",
    lambda v: g.insert_if_absent(v.campaigns.filter("id < 60").select("id", "clicks"), v.campaigns.filter("id >= 40").select("id", "clicks"), "id"),
    "SELECT id, clicks, id >= 60 AS inserted FROM {campaigns} c",
)
query("daily_quota", lambda v: g.daily_quota(v.exports).select("user_id", "event_id", F.col("n").cast("long").alias("n"), "free", F.col("remaining").cast("long").alias("remaining")), """SELECT user_id, event_id, n, n <= 3 AS free, greatest(3 - n, 0) AS remaining
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS n FROM {exports} e) t""")
# Limits of the plans by tier.
_PLANS = "SELECT * FROM VALUES ('FREE', 10e0, 3, false, false, false), ('PRO', 100e0, 100, true, true, false), ('ENTERPRISE', 500e0, 9999, true, true, true) AS t(tier, max_size, max_exports, ocr, no_watermark, priority)"
_TIER = """SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'PRO' WHEN 'MACHINERY' THEN 'ENTERPRISE' ELSE 'FREE' END AS tier, c_acctbal / 20 AS size, coalesce(n, 0) AS exports, c_custkey % 4 = 0 AS wants_ocr, c_custkey % 5 = 0 AS wants_priority
    FROM {customer} c LEFT JOIN (SELECT o_custkey, max(n) AS n FROM (SELECT o_custkey, o_orderdate, count(*) AS n FROM {orders} o GROUP BY o_custkey, o_orderdate) d GROUP BY o_custkey) o ON c_custkey = o_custkey"""
query("plan_limits_check", lambda v: g.plan_limits_check(v.sql(_TIER), v.spark.sql(_PLANS), features=("ocr", "priority")).select("id", "tier", "allowed"),
      f"SELECT id, t.tier, size <= CASE t.tier WHEN 'PRO' THEN 100e0 WHEN 'ENTERPRISE' THEN 500e0 ELSE 10e0 END AND exports < CASE t.tier WHEN 'PRO' THEN 100 WHEN 'ENTERPRISE' THEN 9999 ELSE 3 END AND (NOT wants_ocr OR t.tier <> 'FREE') AND (NOT wants_priority OR t.tier = 'ENTERPRISE') AS allowed FROM ({_TIER}) t")
_PAID = "SELECT o_orderkey AS id, o_orderpriority AS product, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'PENDING' END AS status FROM {orders} o"
_PRICES = "SELECT DISTINCT o_orderpriority AS product, cast(substr(o_orderpriority, 1, 1) AS BIGINT) * 99 AS cents FROM {orders} p"
query("payment_rollup", lambda v: g.payment_rollup(v.sql(_PAID), v.sql(_PRICES)), f"""SELECT t.product, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, sum(CASE WHEN status = 'COMPLETED' THEN cents ELSE 0 END)::BIGINT AS cents
    FROM ({_PAID}) t JOIN ({_PRICES}) p ON t.product = p.product GROUP BY t.product""")
_PREVIOUS = "SELECT p_partkey AS id, p_brand AS value, p_size % 3 = 0 AS projection FROM {part} p WHERE p_partkey % 2 = 0"
_PROJECTED = "SELECT p_partkey AS id, p_type AS value, true AS projection FROM {part} p WHERE p_partkey % 5 = 0"
query("merge_projection", lambda v: g.merge_projection(v.sql(_PREVIOUS), v.sql(_PROJECTED)), f"SELECT * FROM ({_PREVIOUS}) a WHERE NOT projection AND id NOT IN (SELECT id FROM ({_PROJECTED}) b) UNION ALL SELECT * FROM ({_PROJECTED}) c")
