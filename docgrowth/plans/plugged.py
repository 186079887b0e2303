"""Queries through users' own table functions, and through the library's sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docgrowth.functions import plugged
from docgrowth.functions.shared import shared_dir
from docgrowth.operators import catalog as c
from docgrowth.operators import growth as g
from docgrowth.operators import quality as q
from docgrowth.plans.base import query
from docgrowth.plans.views import Views
from docgrowth.sources import files

# --- a user's policy, bucket strategy and rules, from SQL


def _half(r) -> str:
    """A stricter judge: what came after has to be at most half of what was before."""
    return "ERROR" if r.failed else "UNKNOWN" if r.after_delta is None else "PASS" if r.after_delta <= r.before_delta / 2 else "FAIL"


def _level(value: float) -> str | None:
    return None if value < 0 else "low" if value < 2.5 else "middle" if value < 7.5 else "high"


_RULES = {"wide": lambda r: "wrap" if r.w > 80 else None, "stamped": lambda r: "keep" if r.label == "stamp" else None, "low": lambda r: f"footer {r.block}" if r.y > 180 else None}


def _sql(v: Views, name: str, make: Callable[[StructType], Any], rows: str, text: str) -> DataFrame:
    """The result of text, with the table function made for the rows of a query, which text names {rows}."""
    v.spark.udtf.register(name, make(v.sql(rows).schema))
    return v.sql(text.replace("{rows}", rows))


query("judge_by_policy", lambda v: _sql(v, "judge", lambda rows: plugged.judging({"half": _half}, rows=rows), "SELECT l_orderkey, row, before_delta, after_delta, failed FROM {replays} r", "SELECT l_orderkey, row, status FROM judge(TABLE({rows}), 'half')"), """SELECT l_orderkey, row, CASE WHEN failed THEN 'ERROR' WHEN after_delta IS NULL THEN 'UNKNOWN' WHEN after_delta <= before_delta / 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM {replays} r""")
#: A category has any number of rows, so it is counted in parts, which are added up; a part's values are a list of about a sixteenth of a task's rows at most.
query("buckets_by_strategy", lambda v: _sql(v, "buckets", lambda rows: plugged.bucketing({"levels": (["low", "middle", "high", "never"], _level)}, rows), f"SELECT key, collect_list(before_delta) AS deltas FROM (SELECT /*+ REPARTITION({v.tasks}, key) */ * FROM (SELECT named_struct('category', category, 'part', pmod(xxhash64(l_orderkey), {16 * v.tasks})) AS key, before_delta FROM {{replays}} r) k) p GROUP BY key", "SELECT key.category AS category, bucket, sum(n) AS n FROM buckets(TABLE({rows}), 'levels') GROUP BY key.category, bucket"), """SELECT category, bucket, count(*) FILTER (WHERE CASE WHEN before_delta < 2.5 THEN 'low' WHEN before_delta < 7.5 THEN 'middle' ELSE 'high' END = bucket) AS n FROM {replays} r, (SELECT unnest(['low', 'middle', 'high', 'never']) AS bucket) b GROUP BY category, bucket""")
query("decide_by_rules", lambda v: _sql(v, "decide", lambda rows: plugged.deciding(_RULES, rows), "SELECT page, block, label, w, y FROM {text_blocks} b", "SELECT page, block, rule, decision FROM decide(TABLE({rows}))"), """SELECT page, block, 'wide' AS rule, 'wrap' AS decision FROM {text_blocks} a WHERE w > 80
    UNION ALL SELECT page, block, 'stamped', 'keep' FROM {text_blocks} b WHERE label = 'stamp' UNION ALL SELECT page, block, 'low', concat('footer ', block) FROM {text_blocks} c WHERE y > 180""")

# --- written through a sink, and what is read back


def _folder(v: Views, name: str) -> str:
    files.register(v.spark)
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def _evidence(v: Views, **options: str) -> DataFrame:
    path = _folder(v, "evidence")
    rows = v.sql("SELECT event_id AS id, event_id + 1 AS seq, CASE WHEN event_id % 4 > 0 THEN event_type END AS tag, CASE WHEN event_id % 5 > 0 THEN props END AS payload FROM {events} e")
    rows.write.format("evidence").mode("append").save(path)
    return v.spark.read.format("evidence").options(**options).load(path).drop("_corrupt")


query("evidence_files", _evidence, "SELECT event_id AS id, event_id + 1 AS seq, CASE WHEN event_id % 4 > 0 THEN event_type END AS tag, CASE WHEN event_id % 5 > 0 THEN props END AS payload FROM {events} e")


def _lines(v: Views, rows: DataFrame, form: str, **options: str) -> DataFrame:
    path = _folder(v, form)
    rows.write.format(form).options(**options).mode("append").save(path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


query("sitemap_files", lambda v: _lines(v, c.sitemap(v.keywords, "2024-01-01", root="https://a.example/?q=1&k=").drop("seq"), "sitemap", base="https://a.example").filter("line LIKE '<url>%'"),
      """SELECT concat('<url><loc>https://a.example/?q=1&amp;k=', regexp_replace(lower(keyword), '\\s+', '-', 'g'), '</loc><lastmod>2024-01-01</lastmod><priority>', CASE WHEN coalesce(difficulty, 100) < 30 THEN '1.0' WHEN coalesce(difficulty, 100) < 50 THEN '0.8' ELSE '0.6' END, '</priority></url>') AS line FROM {keywords} k""")
query("report_files", lambda v: _lines(v, q.daily_summary(v.telemetry).select("day", "n", "passed", "failed").coalesce(1), "report", title="Days"), """SELECT concat('| ', day, ' | ', count(*), ' | ', count(*) FILTER (WHERE passed), ' | ', count(*) FILTER (WHERE NOT passed), ' |') AS line FROM {telemetry} t GROUP BY day
    UNION ALL SELECT unnest(['# Days', '', '| day | n | passed | failed |', '|---|---|---|---|'])""")
query("table_line_files", lambda v: _lines(v, v.statement_lines.select(F.split("line", r" \| ").alias("cells")), "csvlines"), """SELECT concat('"', replace(line, ' | ', '","'), '"') AS line FROM {statement_lines} s""")
query("found_in_files", lambda v: _find(v), "SELECT event_id AS id, event_type AS tag FROM {events} e WHERE event_type = 'purchase' AND event_id % 4 > 0")


def _find(v: Views) -> DataFrame:
    """Equality on a field, applied while reading."""
    v.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return g.collection_find(_evidence(v, pushdown="true"), tag="purchase").select("id", "tag")
