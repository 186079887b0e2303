"""Views over the driver's tables that feed the operators, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_K = "cast(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_CENTS = "cast(round(value * 100) AS BIGINT)"

VIEWS: dict[str, str] = {
    "campaigns": f"""SELECT k AS id, CASE WHEN k % 10 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status, 10e0 + k AS daily_budget,
        count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks,
        count(*) FILTER (WHERE event_type = 'purchase') AS conversions,
        coalesce(cast(sum(c) FILTER (WHERE event_type = 'purchase') AS BIGINT), 0) / 100e0 AS revenue,
        coalesce(cast(sum(c) FILTER (WHERE event_type = 'click') AS BIGINT), 0) / 100e0 AS spend
        FROM (SELECT {_K} AS k, event_type, {_CENTS} AS c FROM {{events}}) e GROUP BY k""",
    "click_campaigns": """SELECT concat('s', cast(l_suppkey AS VARCHAR(20))) AS name, count(*) AS clicks,
        count(*) FILTER (WHERE round(l_discount, 2) = 0.05 AND (l_suppkey % 3 = 0 OR round(l_tax, 2) = 0.02)) AS conversions
        FROM {lineitem} l GROUP BY l_suppkey
        UNION ALL SELECT concat('s', cast(l_suppkey AS VARCHAR(20)), '-', cast(l_linenumber AS VARCHAR(20))) AS name, count(*) AS clicks,
        count(*) FILTER (WHERE round(l_discount, 2) = 0.05 AND (l_suppkey % 3 = 0 OR round(l_tax, 2) = 0.02)) AS conversions
        FROM {lineitem} l WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey, l_linenumber""",
    "page_perf": f"""SELECT user_id, day, 300 * count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks,
        coalesce(cast(sum(c) FILTER (WHERE event_type = 'purchase') AS BIGINT), 0) / 100e0 AS revenue,
        coalesce(cast(sum(c) FILTER (WHERE event_type = 'error') AS BIGINT), 0) / 100e0 AS cost
        FROM (SELECT user_id, cast(ts AS DATE) AS day, event_type, {_CENTS} AS c FROM {{events}}) e GROUP BY user_id, day""",
    "conv_log": """SELECT user_id, cast(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') AS clicks,
        count(*) FILTER (WHERE event_type = 'purchase') AS conversions FROM {events} e GROUP BY user_id, cast(ts AS DATE)""",
    "ab_events": "SELECT user_id % 4 AS variant, user_id, event_id, ts, event_type FROM {events} e WHERE event_type IN ('view', 'click')",
    "value_events": """SELECT event_id, user_id AS doc_id, ts, CASE event_type WHEN 'view' THEN 'upload' WHEN 'signup' THEN 'analyze' WHEN 'click' THEN 'open_loop_view'
        WHEN 'purchase' THEN 'click_action' ELSE 'download' END AS event,
        CASE WHEN event_type = 'signup' THEN CASE WHEN value > 50 THEN 'YES' ELSE 'NO' END END AS value_flag,
        CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS variant FROM {events} e""",
    "exports": "SELECT user_id, event_id, ts, cast(ts AS DATE) AS day FROM {events} e WHERE event_type = 'purchase'",
    "keywords": """SELECT p_partkey AS seq, p_name AS keyword, p_type AS category, p_partkey * 37 % 50000 AS volume, p_size + 20 AS difficulty,
        cast(p_size AS DOUBLE) / 15 AS cpc FROM {part} p""",
    "doc_texts": "SELECT doc_id, text, lang, source FROM {documents} d WHERE text IS NOT NULL",
    "order_lines": """SELECT l_orderkey, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS row, l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM {lineitem} l""",
    "statement_lines": """SELECT l_orderkey, row, concat('Item ', cast(l_partkey AS VARCHAR(20)), ' | ', cast(cast(l_quantity AS BIGINT) AS VARCHAR(20)), ' | ',
        cast(cast(round(l_extendedprice) AS BIGINT) AS VARCHAR(20))) AS line FROM {order_lines} l""",
    "statements": """SELECT o_orderkey AS doc_id, o_orderstatus, n AS lines, ceil(n / 3e0) AS pages, concat('Invoice no ', cast(o_orderkey AS VARCHAR(20)), ' date ', CASE o_orderkey % 4
        WHEN 0 THEN concat(d, '/', m, '/', y) WHEN 1 THEN concat(y, '-', m, '-', d) WHEN 2 THEN concat(d, '-', m, '-', y) ELSE concat(d, '.', m, '.', y) END,
        ' Bill to PATIENT: MARIA SILVA postcode ', lpad(cast(o_custkey AS VARCHAR(20)), 5, '0'), '-', lpad(cast(o_custkey % 1000 AS VARCHAR(20)), 3, '0'),
        CASE WHEN o_orderstatus = 'P' THEN ' This agreement between party and party. Signature: doctor' ELSE '' END, ' Total due', CASE o_orderkey % 7
        WHEN 0 THEN '; CID: B20.1, CPF 123.456-7' WHEN 1 THEN '; MARIA SOUZA LIMA wrote' WHEN 2 THEN '; Signed: PAULO REIS' WHEN 3 THEN '; report: summary, figure, chart, appendix, introduction, findings and conclusion'
        WHEN 4 THEN '; Dear sir, enclosed our resume: skills, education, employment, experience' WHEN 5 THEN '; account, balance, deposit, statement, fee and interest' ELSE '' END) AS head
        FROM (SELECT o_orderkey, o_custkey, o_orderstatus, substr(cast(o_orderdate AS VARCHAR(30)), 9, 2) AS d, substr(cast(o_orderdate AS VARCHAR(30)), 6, 2) AS m,
        substr(cast(o_orderdate AS VARCHAR(30)), 1, 4) AS y FROM {orders}) o JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey""",
    "text_items": """SELECT l_orderkey AS page, row, col, 40e0 + 100 * col + l_partkey % 3 AS x, 100e0 + 20 * row AS y, cast(CASE col WHEN 0 THEN cast(l_quantity AS BIGINT)
        WHEN 1 THEN cast(round(l_extendedprice * 100) AS BIGINT) WHEN 2 THEN cast(round(l_discount * 100) AS BIGINT) ELSE cast(round(l_tax * 100) AS BIGINT) END AS VARCHAR(30)) AS text
        FROM (SELECT *, unnest([0, 1, 2, 3]) AS col FROM {order_lines} o) l""",
    # Words of paragraphs, five in each line that they were read in; CASE picks words that form protected pairs now and then.
    "paragraph_words": """SELECT page, (row - 1) * 5 + k AS n, row AS source, word, 40e0 + sum(6e0 * length(word) + 4) OVER (PARTITION BY page, row ORDER BY k) - (6e0 * length(word) + 4) AS x, 6e0 * length(word) AS w
        FROM (SELECT l_orderkey AS page, row, k, CASE (l_partkey * 7 + l_suppkey + k * 5 + row * k) % 18 WHEN 0 THEN 'a' WHEN 1 THEN 'partir' WHEN 2 THEN 'de' WHEN 3 THEN 'trabalho,' WHEN 4 THEN 'Junto' WHEN 5 THEN 'ao' WHEN 6 THEN 'do' WHEN 7 THEN 'acordo.'
        WHEN 8 THEN 'contabilidade' WHEN 9 THEN 'abril' WHEN 10 THEN 'fim' WHEN 11 THEN 'em' WHEN 12 THEN 'vez' WHEN 13 THEN ',' WHEN 14 THEN 'trabalho' WHEN 15 THEN 'e' WHEN 16 THEN 'pagamentos' ELSE 'x' END AS word
        FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS k FROM {order_lines} o) l) w""",
    # Glyphs with y upwards: the baseline drifts within a row, gaps differ by page, sizes and families within a row.
    "glyphs": """SELECT page, row, col, 40e0 + CASE page % 3 WHEN 0 THEN 70 * col WHEN 1 THEN 22 * col ELSE 24 * col + CASE WHEN col = 3 THEN 27 ELSE 0 END END + 150 * (row % 2) AS x, 700 - 9e0 * row - CASE page % 4 WHEN 1 THEN 3e0 * col WHEN 2 THEN 0.9e0 * col ELSE 0 END AS y,
        20e0 AS w, 8e0 + 2 * (row % 3) AS size, CASE WHEN col = 0 THEN 'Bold' WHEN (page + row) % 2 = 0 THEN 'Book' ELSE 'Light' END AS family, text FROM {text_items} i""",
    "table_words": """SELECT page, row, x, 20e0 AS w, concat('w', cast(k AS VARCHAR(5))) AS text FROM (SELECT page, row, k, CASE row % 4 WHEN 0 THEN 40e0 + 80 * k WHEN 1 THEN 40e0 + 25 * k + CASE WHEN k > 1 THEN 75 ELSE 0 END
        WHEN 2 THEN 40e0 + 23 * k + k * k ELSE 40e0 + CASE WHEN k < 5 THEN 80 * k ELSE 345 END END AS x FROM (SELECT l_orderkey AS page, row, unnest([0, 1, 2, 3, 4, 5]) AS k FROM {order_lines} o) a WHERE k < CASE row % 4 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 6 END) b""",
    "text_blocks": """SELECT l_orderkey AS page, row AS block, 40e0 + l_partkey % 3 AS x, 100e0 + 20 * row AS y, 60e0 + l_linenumber * 5 AS w, 12e0 AS h,
        CASE l_returnflag WHEN 'A' THEN 'stamp' WHEN 'N' THEN 'text' END AS label, p_name AS text, 8e0 + p_size % 5 AS font
        FROM {order_lines} l JOIN {part} p ON l_partkey = p_partkey""",
    "fidelity_original": "SELECT l_orderkey AS doc, cast(floor((row - 1) / 3e0) AS BIGINT) AS page, (row - 1) % 3 AS seq, 40e0 + l_partkey % 3 AS x, 100e0 + 20 * row AS y, concat('Q ', cast(cast(l_quantity AS BIGINT) AS VARCHAR(20))) AS text, l_returnflag AS font FROM {order_lines} l",
    "fidelity_export": """SELECT l_orderkey AS doc, cast(floor((row - 1) / 3e0) AS BIGINT) AS page, (row - 1) % 3 AS seq, 40e0 + l_partkey % 3 + CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 0 END AS x,
        100e0 + 20 * row AS y, CASE WHEN round(l_tax, 2) = 0 THEN 'changed' ELSE concat(CASE WHEN l_suppkey % 3 = 0 THEN 'Q' ELSE 'Q ' END, cast(cast(l_quantity AS BIGINT) AS VARCHAR(20))) END AS text,
        CASE WHEN l_linestatus = 'F' THEN lower(l_returnflag) ELSE 'x' END AS font FROM (SELECT *, max(row) OVER (PARTITION BY l_orderkey) AS n FROM {order_lines} o) l
        WHERE NOT (l_returnflag = 'R' AND row = n)""",
    "replays": """SELECT l_orderkey, row, l_returnflag AS category, l_quantity / 5 AS before_delta,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE round(l_tax * 50 + (l_linenumber - 1) * 0.75e0, 4) END AS after_delta,
        round(l_tax, 2) = 0 AND l_linenumber = 7 AS failed FROM {order_lines} l""",
    "glyph_diffs": """SELECT o_orderkey AS doc, o_orderpriority AS category, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE max_discount * 20 END AS rotation,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE min_tax END AS bbox, CASE WHEN o_orderstatus = 'P' OR q % 11 = 0 THEN NULL ELSE cast(q % 4 AS DOUBLE) / 200 END AS coverage, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE cast(n % 5 AS DOUBLE) END AS baseline,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE cast(q % 3 AS DOUBLE) END AS pixel, n AS glyphs, CASE WHEN n % 7 = 0 THEN n + 1 WHEN n % 5 = 0 THEN n - 1 ELSE n END AS expected_glyphs
        FROM {orders} o JOIN (SELECT l_orderkey, round(max(l_discount), 2) AS max_discount, round(min(l_tax), 2) AS min_tax, count(*) AS n,
        cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS q FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey""",
    "trend": """SELECT cast(substr(cast(o_orderdate AS VARCHAR(30)), 1, 4) AS BIGINT) * 12 + cast(substr(cast(o_orderdate AS VARCHAR(30)), 6, 2) AS BIGINT) AS month,
        round(cast(sum(cast(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100e0 / count(*), 4) AS value FROM {orders} o GROUP BY 1""",
    "telemetry": """SELECT l_orderkey, row, cast(o_orderdate AS DATE) AS day, l_returnflag <> 'R' AS passed, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS reason
        FROM {order_lines} l JOIN {orders} o ON l_orderkey = o_orderkey""",
    "export_events": """SELECT event_id, user_id AS doc, ts, CASE event_type WHEN 'purchase' THEN 'core' WHEN 'error' THEN 'legacy-fallback' ELSE 'legacy-only' END AS outcome,
        CASE k % 5 WHEN 0 THEN 'missing-original-bounds' WHEN 1 THEN NULL ELSE concat('r', cast(k % 5 AS VARCHAR(5))) END AS reason, CASE k % 3 WHEN 0 THEN 'eligibility' WHEN 1 THEN 'validation' ELSE 'write' END AS stage, value FROM (SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}) e""",
    "clicks": "SELECT event_id, cast(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS x, user_id AS y, user_id, ts FROM {events} e WHERE event_type = 'click'",
    "size_rows": "SELECT o_orderkey AS id, o_totalprice AS original, o_totalprice * (0.9e0 + (o_orderkey % 5) / 10e0) AS rewritten FROM {orders} o",
    "text_pairs": """SELECT conv_id, turn, text AS expected, CASE WHEN turn % 2 = 1 THEN concat(text, ' more') ELSE text END AS actual FROM {conversations} c WHERE text IS NOT NULL""",
    "edited_pairs": """SELECT conv_id, turn, expected, regexp_extract(expected, '[A-Za-z]+', 0) AS target, CASE (conv_id + turn) % 6 WHEN 0 THEN expected WHEN 1 THEN concat(expected, ' extra') WHEN 2 THEN substr(expected, 2)
        WHEN 3 THEN concat(substr(expected, 1, length(expected) - 1), '#') WHEN 4 THEN concat('one two ', cast(turn AS VARCHAR(20))) ELSE replace(expected, 'e', 'E') END AS actual
        FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('one two ', cast(turn AS VARCHAR(20))) ELSE text END AS expected FROM {conversations} c WHERE text IS NOT NULL) t""",
    "next_texts": """SELECT a, b, ta, tb FROM (SELECT item_id AS a, lead(item_id) OVER (PARTITION BY item_id % 8 ORDER BY item_id) AS b, text AS ta, lead(text) OVER (PARTITION BY item_id % 8 ORDER BY item_id) AS tb FROM {benchmark} b) n WHERE b IS NOT NULL
        UNION ALL SELECT 1000000 + conv_id * 100 + turn, 1000001 + conv_id * 100 + turn, expected, actual FROM {edited_pairs} e""",
}


def expand(text: str, tables: dict[str, str]) -> str:
    """text with each {name} replaced by its table, or by its view in brackets."""

    def one(m: re.Match[str]) -> str:
        name = m[1]
        return tables[name] if name in tables else f"({expand(VIEWS[name], tables)})" if name in VIEWS else m[0]

    return re.sub(r"\{(\w+)\}", one, text)


#: Order lines in one task of the views by page; so a task's memory stays the same as the tables grow.
LINES_A_TASK = 50_000
#: Views whose rows are dealt to so many tasks by a column: those of the table that the view reads, or its own, which a join has put elsewhere.
_DEALT = {"order_lines": ("lineitem", "l_orderkey"), "text_blocks": ("text_blocks", "page")}


class Views:
    """The views and tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}

    @cached_property
    def tasks(self) -> int:
        """So many tasks do the views by page need; the rows are counted from the files' footers. Adaptive execution leaves a number that is given as it is."""
        return max(1, -(-self.spark.sql(f"SELECT count(*) FROM {self.tables['lineitem']}").first()[0] // LINES_A_TASK))

    def _dealt(self, text: str) -> str:
        """text with its views expanded, those of _DEALT over rows dealt by their column."""
        for name, (rows, by) in reversed(_DEALT.items()):
            text = expand(text, self.tables | {n: f"{{{n}}}" for n in _DEALT})
            if f"{{{name}}}" in text:
                source = self.tables.get(rows) or f"({VIEWS[name]})"
                dealt = f"(SELECT /*+ REPARTITION({self.tasks}, {by}) */ * FROM {source})"
                text = text.replace(f"{{{name}}}", dealt if rows == name else f"({VIEWS[name].replace(f'{{{rows}}}', dealt)})")
        return text

    def sql(self, text: str) -> DataFrame:
        """The result of SQL that names views and tables as {name}."""
        return self.spark.sql(re.sub(r"unnest\(\[([0-9, ]+)\]\)", r"explode(array(\1))", self._dealt(text)))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in TABLES:
            return self.spark.sql(f"SELECT * FROM {self.tables[name]}")
        raise AttributeError(name)


def twin(text: str) -> str:
    return expand(text, {t: t for t in TABLES})
