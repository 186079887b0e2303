"""Advertising, conversion, experiment and funnel operators: DataFrame in, DataFrame out.

Every threshold is a parameter. Ratios whose denominator is not positive are 0; ties are
broken by the sequence column that each operator names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.numbers import at_least, half_up, ratio


def campaign_roi(c: DataFrame) -> DataFrame:
    """ctr, cpc, conversion rate, roi and roas of each campaign."""
    return c.select(
        "id", ratio("clicks", "impressions", 100).alias("ctr"), ratio("spend", "clicks").alias("cpc"), ratio("conversions", "clicks", 100).alias("conversion_rate"),
        ratio(F.col("revenue") - F.col("spend"), "spend").alias("roi"), ratio("revenue", "spend").alias("roas"),
    )


def _action(roas: Column, stop: float, scale: float) -> Column:
    return F.when(roas < stop, "STOP").when(roas >= scale, "SCALE").otherwise("HOLD")


def roas_action(c: DataFrame, stop: float = 1.0, scale: float = 2.0, most: int = 30) -> DataFrame:
    """STOP, HOLD with what is missing to the scaling return (%), or SCALE with a budget rise (%)."""
    roas = ratio("revenue", "spend")
    act = _action(roas, stop, scale)
    rise = F.when(act == "SCALE", F.least(F.lit(most).cast("long"), half_up((roas - scale) * 15 + 20)))
    return c.select("id", roas.alias("roas"), act.alias("action"), rise.alias("budget_rise"), F.when(act == "HOLD", (scale - roas) / roas * 100).alias("potential"))


def auto_optimize_budget(c: DataFrame, factor: float = 1.25, stop: float = 1.0, scale: float = 2.0) -> DataFrame:
    """Active campaigns: stopped ones paused, scaled ones with a raised budget; all others as they are."""
    active = F.col("status") == "ACTIVE"
    act = F.when(active, _action(ratio("revenue", "spend"), stop, scale))
    budget = F.when(act == "SCALE", half_up(F.col("daily_budget") * factor).cast("double")).otherwise(F.col("daily_budget"))
    return c.select("id", F.when(act == "STOP", "PAUSED").otherwise(F.col("status")).alias("status"), budget.alias("daily_budget"), act.alias("action"))


def active_campaigns(c: DataFrame) -> DataFrame:
    return c.filter(F.col("status") == "ACTIVE")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of base replaced by rows of new with their key, and the other rows of new."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def patch(base: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """base with the given non-null fields laid over; unknown keys are ignored."""
    fields = [c for c in given.columns if c != key]
    renamed = given.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return base.join(renamed, key, "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else c for c in base.columns))


def click_conversion_signal(c: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    r = F.col("conversions") / at_least("clicks", 1)
    return c.withColumn("signal", F.when(r < low, "STOP").when(r > high, "SCALE").otherwise("HOLD"))


def roi_decision(pages: DataFrame, scale: float = 2.0, hold: float = 1.0) -> DataFrame:
    roi = F.col("revenue") / at_least("cost", 1)
    return pages.withColumn("roi", roi).withColumn("decision", F.when(roi >= scale, "SCALE").when(roi >= hold, "HOLD").otherwise("PAUSE"))


def dead_pages(pages: DataFrame) -> DataFrame:
    """Pages to kill (no traffic, low click rate on many impressions, or losing money), flagged."""
    idle = (F.col("impressions") < 100) & (F.col("clicks") == 0) & (F.col("revenue") == 0)
    ignored = (F.col("impressions") > 500) & (F.col("clicks") / at_least("impressions", 1) < 0.005)
    losing = (F.col("cost") > 50) & (F.col("revenue") / at_least("cost", 1) < 0.5)
    return pages.withColumn("dead", idle | ignored | losing)


def decision_summary(c: DataFrame, by: str = "action") -> DataFrame:
    return c.groupBy(by).agg(F.count("*").alias("n"))


def collection_counts(named: dict[str, DataFrame]) -> DataFrame:
    """One row of name and row count per collection."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in named.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def conversion_status(c: DataFrame, fail: float = 0.01, good: float = 0.05) -> DataFrame:
    cvr = F.col("conversions") / at_least("clicks", 1)
    return c.withColumn("cvr", cvr).withColumn("status", F.when(cvr < fail, "FAIL").when(cvr < good, "OK").otherwise("GOOD"))


def rolling_cvr(log: DataFrame, n: int = 10, by: str = "user_id", seq: str = "day") -> DataFrame:
    """Conversion rate over each key's last n log rows, as it runs."""
    last = W.partitionBy(by).orderBy(seq).rowsBetween(-(n - 1), 0)
    return log.withColumn("cvr", F.sum("conversions").over(last) / at_least(F.sum("clicks").over(last), 1))


def cvr_trend(log: DataFrame, w: int = 5, by: str = "user_id", seq: str = "day") -> DataFrame:
    """Of each row: recent against older window (which includes the recent rows); stable before 2w rows."""
    order = W.partitionBy(by).orderBy(seq)
    rate = lambda n: F.sum("conversions").over(order.rowsBetween(-(n - 1), 0)) / at_least(F.sum("clicks").over(order.rowsBetween(-(n - 1), 0)), 1)
    out = log.withColumn("recent", rate(w)).withColumn("older", rate(2 * w)).withColumn("rows", F.row_number().over(order))
    trend = F.when(F.col("rows") < 2 * w, "stable").when(F.col("recent") > 1.1 * F.col("older"), "improving").when(F.col("recent") < 0.9 * F.col("older"), "declining").otherwise("stable")
    return out.withColumn("trend", trend).drop("rows")


def auto_decide(c: DataFrame, enough: int = 100, pause: float = 0.01, scale: float = 0.08, most: float = 1.5) -> DataFrame:
    cvr = F.col("conversions") / at_least("clicks", 1)
    out = c.withColumn("cvr", cvr).withColumn("decision", F.when(F.col("clicks") < enough, "HOLD").when(cvr < pause, "PAUSE_ADS").when(cvr > scale, "SCALE_ADS").otherwise("HOLD"))
    out = out.withColumn("factor", F.when(F.col("decision") == "SCALE_ADS", F.least(F.lit(most), cvr / scale)))
    return out.withColumn("potential", F.when((F.col("clicks") >= enough) & (F.col("decision") == "HOLD"), (scale - cvr) / cvr * 100))


def auto_decide_batch(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions, and the rows to append to the conversion log (page = campaign name)."""
    return auto_decide(c), c.select(F.col("name").alias("page"), "clicks", "conversions")


def ab_variant_totals(events: DataFrame) -> DataFrame:
    """Impressions and clicks per variant, and of the whole test (variant null)."""
    return events.rollup("variant").agg(F.count_if(F.col("event_type") == "view").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))


def _ctr(totals: DataFrame) -> DataFrame:
    return totals.filter(F.col("variant").isNotNull()).withColumn("ctr", F.col("clicks") / at_least("impressions", 1))


def ab_rank(totals: DataFrame) -> DataFrame:
    """Variants by click rate; ties keep the order of variants. One row per variant, few of them."""
    return _ctr(totals).withColumn("rank", F.row_number().over(W.orderBy(F.desc("ctr"), "variant")))


def ab_winner(totals: DataFrame) -> DataFrame:
    """The variant of strictly greatest click rate; the first one wins a tie."""
    return _ctr(totals).agg(F.max_by(F.struct("variant", "ctr"), F.struct("ctr", (-F.col("variant")).alias("v"))).alias("w")).select("w.variant", "w.ctr")


def ab_snapshot(ranked: DataFrame, path: str, test: str, stamp: str) -> None:
    """Appends ranked results under test and stamp; an empty test writes nothing."""
    if not ranked.isEmpty():
        ranked.withColumn("test", F.lit(test)).withColumn("stamp", F.lit(stamp)).write.mode("append").partitionBy("test", "stamp").parquet(path)


def variant_assignment(users: DataFrame, key: str = "user_id", variants: tuple[str, ...] = ("A", "B", "C"), hashed: bool = True) -> DataFrame:
    """A fixed variant for each key, by hash or by remainder."""
    at = F.pmod(F.xxhash64(key) if hashed else F.col(key), F.lit(len(variants))).cast("int")
    return users.withColumn("variant", F.element_at(F.array(*map(F.lit, variants)), at + 1))


STAGES = ("upload", "analyze", "open_loop_view", "click_action", "download")


def variant_funnel(events: DataFrame) -> DataFrame:
    return events.groupBy("variant").pivot("event", list(STAGES)).agg(F.count(F.lit(1))).na.fill(0, list(STAGES))


def _percent(num: Column, den: Column) -> Column:
    return F.when(den > 0, half_up(num / den * 100, 1)).otherwise(F.lit(0.0))


def value_funnel(events: DataFrame, distinct: bool = False) -> DataFrame:
    """Counts of each stage in one pass, of events or of distinct documents, and their rates in percent."""
    of = lambda e: F.count_distinct(F.when(e, F.col("doc_id"))) if distinct else F.count_if(e)
    at = lambda s: F.col("event") == s
    counts = events.agg(
        of(at("upload")).alias("uploads"), of(at("analyze") & (F.col("value_flag") == "YES")).alias("yes"), of(at("open_loop_view")).alias("open_loop_views"),
        of(at("click_action")).alias("clicks"), of(at("download")).alias("downloads"), F.count("*").alias("total"),
    )
    return counts.withColumn("yes_ratio", _percent(F.col("yes"), F.col("uploads"))).withColumn("click_rate", _percent(F.col("clicks"), F.col("open_loop_views")))


def funnel_kpis(events: DataFrame) -> DataFrame:
    """Click rate per YES document and secondary intent (downloads per click)."""
    f = value_funnel(events)
    return f.select(ratio("clicks", "yes").alias("click_rate"), ratio("downloads", "clicks").alias("secondary_intent"))


def collection_find(rows: DataFrame, **fields) -> DataFrame:
    """Rows equal in every given field; all rows if none is given."""
    for name, value in fields.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def insert_if_absent(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base and those rows of new whose key it lacks, marked as inserted."""
    fresh = new.join(base.select(key), key, "left_anti").dropDuplicates([key])
    return base.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def daily_quota(exports: DataFrame, limit: int = 3) -> DataFrame:
    """Each export's number in its user's day, whether it is free, and how many are left after it."""
    n = F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return exports.withColumn("n", n).withColumn("free", F.col("n") <= limit).withColumn("remaining", F.greatest(limit - F.col("n"), F.lit(0)))


def plan_limits_check(rows: DataFrame, plans: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """Whether each row keeps its tier's limits on size and exports, and whether its tier has each of the features it wants.

    A feature is a boolean column of plans; a row wants it where its own column `wants_<feature>` is true. Rows of unknown
    tiers stay, with a null verdict.
    """
    allowed = (F.col("size") <= F.col("max_size")) & (F.col("exports") < F.col("max_exports"))
    for f in features:
        allowed = allowed & (~F.coalesce(F.col(f"wants_{f}"), F.lit(False)) | F.col(f))
    return rows.join(plans, "tier", "left").withColumn("allowed", allowed)


def payment_rollup(payments: DataFrame, prices: DataFrame) -> DataFrame:
    """Completed payments and their sum per product; payments are summed first, so few rows meet the prices."""
    done = payments.groupBy("product").agg(F.count_if(F.col("status") == "COMPLETED").alias("completed"))
    return done.join(prices.select("product", "cents"), "product").select("product", "completed", (F.col("completed") * F.col("cents")).alias("cents"))


def merge_projection(previous: DataFrame, projected: DataFrame, key: str = "id") -> DataFrame:
    """Previous rows that are neither projections nor projected anew, then all projected rows."""
    kept = previous.filter(~F.col("projection")).join(projected.select(key), key, "left_anti")
    return kept.unionByName(projected)
