"""Queries of the layout and similarity operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrowth.operators import breaks
from docgrowth.operators import layout as h
from docgrowth.operators import lines as ln
from docgrowth.operators import similar as s
from docgrowth.plans.base import query

# The order grid has its rows 20 apart and its columns 100 apart, so the twins can state rows and columns outright.
_UNEVEN = "SELECT page, row, x, y + CASE WHEN col = 0 THEN 2 ELSE 0 END AS y, text, 8e0 + col AS font FROM {text_items} i"
query("line_groups", lambda v: h.line_groups(v.sql(_UNEVEN)).drop("left"), "SELECT page, (row - 1)::INT AS line, min(y) + 2 AS y, string_agg(text, '' ORDER BY x) AS text, count(*)::INT AS n, avg(8e0 + col) AS font FROM {text_items} i GROUP BY page, row")
_STEPPED = "SELECT page, row, x, y + CASE WHEN col = 3 THEN 5 ELSE 0 END AS y, text FROM {text_items} i"
query("row_centres", lambda v: h.row_centres(v.sql(_STEPPED)).select("page", F.posexplode("rows").alias("n", "y")), "SELECT l_orderkey AS page, (row - 1)::INT AS n, (floor((100 + 20 * row) / 3e0 + 0.5) + floor((105 + 20 * row) / 3e0 + 0.5)) * 1.5e0 AS y FROM {order_lines} l")
_GX = "(SELECT page, col, floor(x / 4 + 0.5) * 4 AS gx, min(x) AS x, count(*) AS n FROM {text_items} i GROUP BY ALL)"
query("column_centres", lambda v: h.column_centres(v.text_items).select("page", F.posexplode("columns").alias("n", "x")), f"SELECT page, col AS n, CASE WHEN max(max(n)) OVER (PARTITION BY page) > 1 THEN min(gx) FILTER (WHERE n > 1) ELSE min(x) END AS x FROM {_GX} g GROUP BY page, col")
query("grid_assign", lambda v: h.grid_assign(v.text_items).select("page", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text"), "SELECT page, row - 1 AS r, col::BIGINT AS c, text FROM {text_items} i")
_SPARSE = "SELECT page, row AS r, col + CASE WHEN row % 3 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN row % 4 = 0 THEN '' ELSE text END AS text FROM {text_items} i"
query("grid_fix", lambda v: h.grid_fix(v.sql(_SPARSE)).select("page", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text"), f"""SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY r) - 1 AS r, (CASE WHEN first BETWEEN 1 AND 2 THEN c - first ELSE c END)::BIGINT AS c, text
    FROM (SELECT *, min(c) OVER (PARTITION BY page, r) AS first FROM ({_SPARSE}) g WHERE trim(text) <> '') t""")
_CELL = "SELECT l_orderkey, row, concat(cast(l_partkey AS VARCHAR(20)), ' ', cast(l_suppkey AS VARCHAR(20)), CASE WHEN row % 2 = 0 THEN ' kg' ELSE '' END) AS cell FROM {order_lines} l"
query("cell_normalise", lambda v: v.sql(_CELL).select("l_orderkey", "row", h.cell_normalise(F.col("cell"), "invoice").alias("cell")), rf"SELECT l_orderkey, row, regexp_replace(cell, '^([0-9]+)\s+([0-9]+)', '\1\2') AS cell FROM ({_CELL}) c")
_TYPED = """SELECT l_orderkey, row, CASE row % 6 WHEN 0 THEN concat('$', cast(l_partkey AS VARCHAR(20)), '.50') WHEN 1 THEN concat(cast(l_suppkey AS VARCHAR(20)), '%') WHEN 2 THEN concat('(', cast(l_partkey AS VARCHAR(20)), ')') WHEN 3 THEN cast(l_partkey AS VARCHAR(20))
    WHEN 4 THEN '2024-01-05' ELSE l_returnflag END AS cell FROM {order_lines} l"""
query("cell_types", lambda v: v.sql(_TYPED).select("l_orderkey", "row", h.cell_type(F.col("cell")).alias("t")).select("l_orderkey", "row", "t.kind", "t.number"), f"""SELECT l_orderkey, row, CASE row % 6 WHEN 0 THEN 'currency' WHEN 1 THEN 'percent' WHEN 2 THEN 'negative' WHEN 3 THEN 'number' WHEN 4 THEN 'date' ELSE 'text' END AS kind,
    CASE row % 6 WHEN 0 THEN l_partkey + 0.5e0 WHEN 1 THEN l_suppkey / 100e0 WHEN 2 THEN -l_partkey::DOUBLE WHEN 3 THEN l_partkey::DOUBLE END AS number FROM {{order_lines}} l""".replace("{{", "{").replace("}}", "}"))
_HOLES = "SELECT page, row - 1 AS r, col AS c, text FROM {text_items} i WHERE (row + col) % 5 <> 0"
query("table_quality", lambda v: h.table_quality(v.sql(_HOLES)), f"""SELECT page, floor((0.6e0 * items / (rows * cols) + 0.4e0 * greatest(0, 1 - 4 * v)) * 100 + 0.5) / 100 AS quality, CASE WHEN rows > 2 AND cols > 1 THEN least(1e0, rows * cols / greatest(0.8e0 * items, 1)) ELSE 0.3e0 END AS confidence
    FROM (SELECT s.page, var_pop(filled / cols::DOUBLE) AS v, any_value(rows) AS rows, any_value(cols) AS cols, any_value(items) AS items FROM (SELECT page, r, count(*) AS filled FROM ({_HOLES}) h GROUP BY page, r) f
    JOIN (SELECT page, max(r) + 1 AS rows, max(c) + 1 AS cols, count(*) AS items FROM ({_HOLES}) h GROUP BY page) s ON f.page = s.page GROUP BY s.page) t""")
query("table_region", lambda v: h.table_region(v.text_items), """SELECT page, min(x) - 5 AS "left", max(x) + 5 AS "right", min(y) - 5 AS top, max(y) + 5 AS bottom FROM {text_items} i WHERE page IN (SELECT page FROM (SELECT page, floor(x / 3) AS b FROM {text_items} i GROUP BY page, floor(x / 3) HAVING count(*) >= 3) c
    GROUP BY page HAVING count(*) >= 2) GROUP BY page HAVING count(*) >= 10""")
# Left edges off the grid, pages with gaps in columns, and pages with a single column.
_COLS = "SELECT page, row * 4 + col AS block, x + CASE WHEN (row * 7 + col * 3) % 5 = 0 THEN 36 ELSE 0 END + CASE WHEN page % 7 = 0 THEN row ELSE 0 END AS x, y + (row * col) % 3 AS y FROM {text_items} i WHERE (page % 5 > 0 OR col = 0) AND (page % 3 > 0 OR (row + col) % 4 > 0)"
query("text_columns", lambda v: h.text_columns(v.sql(_COLS)).select("page", "block", F.col("column").cast("long").alias("col"), F.col("place").cast("long").alias("place")), f"""WITH c AS (
    SELECT page, list_reduce(list_transform(list_sort(list_distinct(list(floor(x / 10 + 0.5) * 10))), lambda x: [x]), lambda kept, x: CASE WHEN x[1] - kept[len(kept)] > 30 THEN list_concat(kept, x) ELSE kept END) AS cols FROM ({_COLS}) l GROUP BY page),
    n AS (SELECT l.page, block, x, y, CASE WHEN len(cols) < 2 THEN 1 ELSE list_position(list_transform(cols, lambda c: abs(x - c)), list_min(list_transform(cols, lambda c: abs(x - c)))) END::BIGINT AS col FROM ({_COLS}) l JOIN c ON l.page = c.page)
    SELECT page, block, col, row_number() OVER (PARTITION BY page ORDER BY rank, col) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page, col ORDER BY y, x, block) AS rank FROM n) r""")
_SAME = "{text_blocks} b"
query("paragraph_merge", lambda v: h.paragraph_merge(v.text_blocks).groupBy("page").agg(F.max("paragraph").alias("n")), """SELECT page, sum(CASE WHEN near THEN 0 ELSE 1 END)::BIGINT AS n FROM (SELECT page, coalesce(y - (lag(y) OVER w + lag(h) OVER w) <= 2.5 * (font + lag(font) OVER w) / 2 AND abs(x - lag(x) OVER w) <= 20
    AND abs(font - lag(font) OVER w) <= 2, false) AS near FROM {text_blocks} b WINDOW w AS (PARTITION BY page ORDER BY y, x, block)) t GROUP BY page""")
# Three edges in turns, with lines between them that no edge has.
_MIXED = "SELECT page, row * 4 + col AS block, CASE WHEN (row + col) % 5 = 0 OR page % 6 = 1 AND (row + 2 * col) % 3 = 0 THEN 300e0 + 17 * row + 6 * col WHEN (page + row) % 3 = 0 THEN 40e0 WHEN (page + row) % 3 = 1 THEN 92.4e0 ELSE 147.5e0 END AS x, 100e0 + 10 * (row * 4 + col) AS y FROM {text_items} i"
query("table_blocks", lambda v: h.table_blocks(v.sql(_MIXED)).select("page", "block", F.col("run").cast("long").alias("run"), "kind"), f"""WITH RECURSIVE l AS (SELECT page, block, floor(x / 5 + 0.5) AS a, row_number() OVER (PARTITION BY page ORDER BY y, x, block) AS k FROM ({_MIXED}) m),
    f AS (SELECT *, count(*) OVER (PARTITION BY page, a) >= 3 AS often FROM l), g AS (SELECT page FROM f GROUP BY page HAVING count(*) >= 3 AND count(DISTINCT CASE WHEN often THEN a END) >= 2),
    r AS (SELECT page, k, a, 1 AS n, 1 AS run FROM f WHERE k = 1 AND page IN (SELECT page FROM g) UNION ALL SELECT page, k, a, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN run + 1 ELSE run END
      FROM (SELECT f.page, f.k, f.a, r.n, r.run, CASE WHEN f.often THEN f.a <> r.a ELSE r.n > 2 END AS cut FROM r JOIN f ON f.page = r.page AND f.k = r.k + 1) s),
    t AS (SELECT f.page, f.block, f.k, run, count(run) OVER (PARTITION BY f.page, run) > 2 AS big FROM f LEFT JOIN r ON f.page = r.page AND f.k = r.k)
    SELECT page, block, dense_rank() OVER (PARTITION BY page ORDER BY first) AS run, CASE WHEN big THEN 'table' ELSE 'paragraph' END AS kind FROM (SELECT *, CASE WHEN big THEN min(k) OVER (PARTITION BY page, run) ELSE k END AS first FROM t) z""")
_FONTED = "SELECT page, block, font + block % 4 * 4 AS font, CASE WHEN block % 5 = 0 THEN concat('- ', text) ELSE text END AS text FROM {text_blocks} b"
_KIND = r"CASE WHEN block % 5 = 0 THEN 'list' WHEN font > 22 THEN 'h1' WHEN font > 18 THEN 'h2' ELSE 'paragraph' END"
query("block_types", lambda v: h.block_types(v.sql(_FONTED)).select("page", "block", "kind"), f"SELECT page, block, {_KIND} AS kind FROM ({_FONTED}) f")
query("doc_quality", lambda v: h.doc_quality(h.block_types(v.sql(_FONTED))), f"""SELECT page, floor((CASE WHEN heads > 0 THEN least(1e0, 0.15e0 * heads + 0.7e0 * paras / n) ELSE paras / n::DOUBLE END) * 100 + 0.5) / 100 AS quality FROM (SELECT page, count(*) AS n, count(*) FILTER (WHERE kind IN ('h1', 'h2')) AS heads,
    count(*) FILTER (WHERE kind = 'paragraph') AS paras FROM (SELECT page, {_KIND} AS kind FROM ({_FONTED}) f) k GROUP BY page) t""")
query("merge_initial", lambda v: h.merge_initial(v.text_items.withColumn("x", 40 + F.col("col") * 9.0)).groupBy("page").agg(F.count("*").alias("n")), """SELECT page, count(*) - count(*) FILTER (WHERE length(text) = 1 AND length(next) >= 2) AS n FROM (SELECT *, lead(text) OVER (PARTITION BY page, row ORDER BY col) AS next FROM {text_items} i) t GROUP BY page""")
query("visual_right", lambda v: h.visual_right(v.text_items.withColumn("right", F.col("x") + F.length("text") * 6)), 'SELECT page, "right" FROM (SELECT page, x + length(text) * 6 AS "right", row_number() OVER (PARTITION BY page ORDER BY x + length(text) * 6, row, col) AS k, count(*) OVER (PARTITION BY page) AS n FROM {text_items} i) t WHERE k = least(n, floor(0.9 * n) + 1)')
_SAID = "SELECT page, row * 4 + col AS at_, CASE WHEN col = 3 THEN ',' ELSE text END AS word FROM {text_items} i"
query("join_words", lambda v: h.join_words(v.sql(_SAID), "page", "at_", "word"), f"SELECT page, replace(string_agg(word, ' ' ORDER BY at_), ' ,', ',') AS text FROM ({_SAID}) s GROUP BY page")
_FAMILY = "SELECT *, substr(text, 1, 1) AS family FROM {text_blocks} b"
query("page_style_stats", lambda v: h.page_style_stats(v.sql(_FAMILY)), f"""SELECT f.page, font, font * 1.3e0 AS line_height, family FROM (SELECT page, list_sort(list(font))[(count(*) // 2 + 1)::INT] AS font FROM {{text_blocks}} b GROUP BY page) f
    JOIN (SELECT page, arg_max(family, (n, -first)) AS family FROM (SELECT page, family, count(*) AS n, min(block) AS first FROM ({_FAMILY}) x GROUP BY page, family) g GROUP BY page) m ON f.page = m.page""")
query("dominant_font", lambda v: h.dominant_font(v.sql(_FAMILY)), f"SELECT page, arg_max(family, (n, -first)) AS family, max(size) AS size FROM (SELECT page, family, sum(greatest(length(text), 1)) AS n, min(block) AS first, max(font) AS size FROM ({_FAMILY}) x GROUP BY page, family) g GROUP BY page")
_BOX = "SELECT page, block, x, y, w, h FROM {text_blocks} b"
_BOX2 = "SELECT page, block, x + 25 AS x, y + 7 AS y, w / 2 AS w, h FROM {text_blocks} b WHERE block % 3 <> 1"
_AREA = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_FAR = "((a.x + a.w / 2) - (b.x + b.w / 2)) * ((a.x + a.w / 2) - (b.x + b.w / 2)) + ((a.y + a.h / 2) - (b.y + b.h / 2)) * ((a.y + a.h / 2) - (b.y + b.h / 2))"
_DRAWN = "SELECT page, block, x, y, w, h, font, substr(text, 1, 1) AS family FROM {text_blocks} b"
_DRAWN2 = "SELECT page, block, x + 25 AS x, y + 7 AS y, w / 2 AS w, h, font, substr(text, 2, 1) AS family FROM {text_blocks} b WHERE block % 3 <> 1"
_NATIVE, _NEAR, _STATED = f"SELECT * FROM ({_DRAWN2}) s WHERE page % 4 = 0", f"SELECT * FROM ({_DRAWN2}) s WHERE page % 4 < 2 AND block % 2 = 0", f"SELECT * FROM ({_DRAWN}) s WHERE page % 4 < 3"
query("style_match", lambda v: h.style_match(v.sql(_DRAWN), v.sql(_NATIVE), v.sql(_NEAR), h.page_style_stats(v.sql(_STATED))).withColumn("line_height", F.round("line_height", 6)), f"""WITH o AS (SELECT page, block, style, family FROM (SELECT a.page, a.block, b.block AS style, b.family, row_number() OVER (PARTITION BY a.page, a.block ORDER BY {_AREA} DESC, b.block) AS n
    FROM ({_DRAWN}) a JOIN ({_NATIVE}) b ON a.page = b.page WHERE {_AREA} > 0) t WHERE n = 1), c AS (SELECT page, block, style, family FROM (SELECT a.page, a.block, b.block AS style, b.family, row_number() OVER (PARTITION BY a.page, a.block ORDER BY {_FAR}, b.block) AS n
    FROM ({_DRAWN}) a JOIN ({_NEAR}) b ON a.page = b.page) t WHERE n = 1), m AS (SELECT page, list_sort(list(font))[(count(*) // 2 + 1)::INT] AS font FROM ({_STATED}) s GROUP BY page), f AS (SELECT page, arg_max(family, (n, -first)) AS family FROM
    (SELECT page, family, count(*) AS n, min(block) AS first FROM ({_STATED}) s GROUP BY page, family) g GROUP BY page), r AS (SELECT a.page, a.block, CASE WHEN o.style IS NOT NULL THEN 'overlap' WHEN c.style IS NOT NULL THEN 'nearest' WHEN f.family IS NOT NULL THEN 'page' ELSE 'default' END AS how, coalesce(o.style, c.style) AS style,
    coalesce(o.family, c.family, f.family, '''Arial'', ''Helvetica'', ''Noto Sans SC'', ''Microsoft YaHei'', ''PingFang SC'', sans-serif') AS family, CASE WHEN o.style IS NULL AND c.style IS NULL THEN coalesce(m.font, a.font) ELSE a.font END AS size FROM ({_DRAWN}) a
    LEFT JOIN o ON a.page = o.page AND a.block = o.block LEFT JOIN c ON a.page = c.page AND a.block = c.block LEFT JOIN m ON a.page = m.page LEFT JOIN f ON a.page = f.page) SELECT page, block, how, style, family, size, round(size * 1.3e0, 6) AS line_height FROM r""")
_EDITED = "SELECT page, block, x, y, w, h FROM {text_blocks} b WHERE block % 4 = 0"
query("mask_impact", lambda v: h.mask_impact(v.sql(_BOX).withColumn("h", F.lit(19.0)), v.sql(_EDITED)), f"SELECT DISTINCT a.page, a.block FROM (SELECT page, block, x, y, w, 19e0 AS h FROM {{text_blocks}} b) a JOIN (SELECT page, block, x - 2 AS x, y - 2 AS y, w + 4 AS w, h + 4 AS h FROM ({_EDITED}) e) b ON a.page = b.page AND a.block <> b.block AND {_AREA} > 0")
query("redaction_hits", lambda v: h.redact(v.sql(_BOX), v.sql(_BOX2)).select("page", "block"), f"SELECT page, block FROM ({_BOX}) a WHERE NOT EXISTS (SELECT 1 FROM ({_BOX2}) b WHERE a.page = b.page AND {_AREA} > 0)")
_SEG = "SELECT page, row AS seg, x AS start, x + 30 + row % 3 * 60 AS \"end\" FROM {text_items} i WHERE col = 1"
_CELLS = "SELECT page, col AS cell, min(x) - 10 AS low, min(x) + 80 AS high FROM {text_items} i GROUP BY page, col"
query("cell_lookup", lambda v: h.cell_lookup(v.sql(_SEG.replace('"', '`')), v.sql(_CELLS)), f"""SELECT page, seg, CASE WHEN holds = 1 THEN 'in-cell' WHEN holds > 1 THEN 'ambiguous' WHEN touches > 1 THEN 'spans-multiple' ELSE 'no-cell' END AS result, CASE WHEN holds = 1 THEN cell END AS cell FROM (SELECT s.page, seg,
    count(*) FILTER (WHERE start >= low AND "end" <= high) AS holds, count(*) FILTER (WHERE start < high AND "end" > low) AS touches, min(cell) FILTER (WHERE start >= low AND "end" <= high) AS cell FROM ({_SEG}) s LEFT JOIN ({_CELLS}) c ON s.page = c.page GROUP BY s.page, seg) t""")
query("render_source", lambda v: h.render_source(v.sql(_BOX), v.sql(_EDITED), v.sql(_BOX2)), f"""SELECT page, block, CASE WHEN coalesce(i, 0) < 0.7 THEN 'vector' WHEN coalesce(t, 0) >= 0.3 THEN 'image-ocr' ELSE 'image' END AS source FROM (SELECT a.page, a.block, (SELECT max({_AREA} / (a.w * a.h)) FROM ({_EDITED}) b WHERE a.page = b.page) AS i,
    (SELECT max({_AREA} / (a.w * a.h)) FROM ({_BOX2}) b WHERE a.page = b.page) AS t FROM ({_BOX}) a) s""")
_SLANT = "SELECT page, row, col, x, y + col * (row % 3) * 0.5e0 AS y FROM {text_items} i"
_ANGLES = f"(SELECT page, row, CASE WHEN max(x) > min(x) THEN -degrees(atan(regr_slope(y, x))) END AS a FROM ({_SLANT}) s GROUP BY page, row HAVING count(*) >= 3)"
query("page_regression", lambda v: h.page_regression(v.sql(_SLANT)), f"SELECT page, floor(round(quantile_cont(a, 0.5), 9) * 10 + 0.5) / 10 AS angle, round(greatest(0, least(1, 1 - stddev_pop(a) / 5)), 9) AS confidence FROM {_ANGLES} r GROUP BY page")
_CAND = "SELECT page, block, (block * 7 % 11)::DOUBLE AS angle, (block % 5) / 10e0 AS confidence FROM {text_blocks} b"
query("candidate_agreement", lambda v: h.candidate_agreement(v.sql(_CAND.replace("(block * 7 % 11)::DOUBLE", "cast(block * 7 % 11 AS DOUBLE)"))), f"SELECT page, agreement, CASE WHEN c + 0.6e0 * agreement >= 0.5 THEN a END AS angle FROM (SELECT page, floor(exp(-(max(angle) - min(angle)) / 20) * 100 + 0.5) / 100 AS agreement, max(confidence) AS c, arg_max(angle, (confidence, angle)) AS a FROM ({_CAND}) x GROUP BY page) t")
query("multi_column_lines", lambda v: h.multi_column_lines(v.text_items).select("page", "row", "gap", "multi"), "SELECT page, row, max(gap) AS gap, coalesce(max(gap) > 15, false) AS multi FROM (SELECT page, row, x - (lag(x) OVER (PARTITION BY page, row ORDER BY x) + 20) AS gap FROM {text_items} i) t GROUP BY page, row")
query("reading_order", lambda v: h.reading_order(v.text_items).select("page", "row", "col", F.col("flow").cast("long").alias("flow")), "SELECT page, row, col, (row - 1) * 4 + col + 1 AS flow FROM {text_items} i")
_NAMES = """SELECT p_partkey, concat(CASE WHEN p_size % 2 = 0 THEN 'ABCDEF+' ELSE '' END, CASE p_partkey % 7 WHEN 0 THEN 'TimesNewRoman' WHEN 1 THEN 'Arial' WHEN 2 THEN 'SimHei' WHEN 3 THEN 'MyGeorgiaPro' WHEN 4 THEN 'FangFoo' WHEN 5 THEN 'Unknown' ELSE 'Courier_New' END,
    CASE p_size % 5 WHEN 0 THEN '-Bold' WHEN 1 THEN '-LightItalic' WHEN 2 THEN '-Black' WHEN 3 THEN '-Oblique' ELSE '' END) AS name FROM {part} p"""
query("font_name_parse", lambda v: h.font_name_parse(v.sql(_NAMES)).select("p_partkey", "weight", "italic", "family"), """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 700 WHEN 1 THEN 300 WHEN 2 THEN 900 ELSE 400 END AS weight, p_size % 5 IN (1, 3) AS italic, CASE p_partkey % 7 WHEN 0 THEN '''Times New Roman'', Times, serif'
    WHEN 1 THEN 'Arial, sans-serif' WHEN 2 THEN '''SimHei'', ''Heiti SC'', sans-serif' WHEN 3 THEN 'Georgia, serif' WHEN 4 THEN '''SimSun'', ''Songti SC'', serif' WHEN 5 THEN 'Arial, Helvetica, sans-serif' ELSE '''Courier New'', Courier, monospace' END AS family FROM {part} p""")
query("style_dictionary", lambda v: h.style_dictionary(v.part, ("p_brand", "p_type"), "p_partkey")[1].select("p_partkey", F.col("style").cast("long").alias("style")), "SELECT p_partkey, style FROM {part} p JOIN (SELECT p_brand, p_type, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS style FROM {part} q GROUP BY ALL) s ON p.p_brand = s.p_brand AND p.p_type = s.p_type")
_SPANS = "SELECT page, block AS n, CASE WHEN block % 7 = 0 THEN -1 ELSE block * 10 + block % 3 * 4 END AS start, block * 10 + 12 AS \"end\" FROM {text_blocks} b"
query("coverage_gaps", lambda v: h.coverage_gaps(v.sql(_SPANS.replace('"', '`')), "page").select("page", "n", "gap"), f"""SELECT page, n, start - cursor AS gap FROM (SELECT *, coalesce(max("end") OVER (PARTITION BY page ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM ({_SPANS}) s) t WHERE start <> cursor""")
query("coverage_summary", lambda v: h.coverage_summary(v.sql(_SPANS.replace('"', '`')).filter("page % 3 < 2 OR n = 1").withColumn("start", F.expr("CASE WHEN page % 3 = 0 THEN 12 * (n - 1) ELSE start END")).withColumn("end", F.expr("CASE WHEN page % 3 = 0 THEN 12 * n ELSE `end` END")).withColumn("h", F.expr("n * 1.25e0")), "page", "h"),
      f"""SELECT page, NOT bool_or(start <> cursor) AS contiguous, max("end") AS covered, round(sum(n * 1.25e0), 2) AS height, count(*) AS lines FROM (SELECT *, coalesce(max("end") OVER (PARTITION BY page ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor
    FROM (SELECT page, n, CASE WHEN page % 3 = 0 THEN 12 * (n - 1) ELSE start END AS start, CASE WHEN page % 3 = 0 THEN 12 * n ELSE "end" END AS "end" FROM ({_SPANS}) s WHERE page % 3 < 2 OR n = 1) r) t GROUP BY page""")
#: Each page but one in eight breaks one rule, by its number.
_PARAS = "SELECT page, CASE WHEN page % 8 = 0 THEN -1 ELSE 10 * max(block) + CASE WHEN page % 8 = 5 THEN 4 ELSE 9 END END AS length FROM {text_blocks} b GROUP BY page"
_OWNED = """SELECT page, block AS n, CASE WHEN page % 8 = 2 THEN 1 ELSE block END AS id, CASE WHEN page % 8 = 3 THEN -5 WHEN page % 8 = 4 THEN 10 * block + 9 WHEN page % 8 = 6 THEN 10 * block - 3 ELSE 10 * block END AS start, 10 * block + 8 AS "end" FROM {text_blocks} b WHERE page % 8 <> 1"""
_PARTED = """SELECT page, block AS n, 10 * block + CASE WHEN page % 8 = 7 AND page % 3 = 0 THEN 7 ELSE 8 END AS start, 10 * block + CASE WHEN page % 24 = 23 THEN 7 ELSE 9 END AS "end" FROM {text_blocks} b"""
_tick = lambda t: t.replace('"', "`")
query("range_integrity", lambda v: h.range_integrity(v.sql(_PARAS), v.sql(_tick(_OWNED)), v.sql(_tick(_PARTED)), "page"), f"""SELECT page, reason FROM (SELECT page, reason, row_number() OVER (PARTITION BY page ORDER BY part, n) AS k FROM (
    SELECT page, 0 AS part, 0 AS n, CASE WHEN length < 0 THEN 'paragraph-length-mismatch' WHEN NOT EXISTS (SELECT 1 FROM ({_OWNED}) s WHERE s.page = p.page) THEN 'empty-segments' END AS reason FROM ({_PARAS}) p
    UNION ALL SELECT s.page, 1, n, CASE WHEN row_number() OVER (PARTITION BY s.page, id ORDER BY n) > 1 THEN 'duplicate-segment-id' WHEN start < 0 OR "end" < 0 THEN 'negative-offset' WHEN start > "end" THEN 'start-gt-end' WHEN "end" > length THEN 'out-of-paragraph'
    WHEN start < lag("end") OVER (PARTITION BY s.page ORDER BY n) THEN 'overlap' END FROM ({_OWNED}) s JOIN ({_PARAS}) p ON s.page = p.page
    UNION ALL SELECT d.page, 2, n, CASE WHEN start < 0 OR "end" < start THEN 'separator-overlap' WHEN "end" > length THEN 'out-of-paragraph' WHEN EXISTS (SELECT 1 FROM ({_OWNED}) s WHERE s.page = d.page AND d.start < s."end" AND s.start < d."end") THEN 'separator-overlap' END
    FROM ({_PARTED}) d JOIN ({_PARAS}) p ON d.page = p.page) r WHERE reason IS NOT NULL) t WHERE k = 1""")
_ONE = "SELECT doc, page * 3 + seq AS line, y FROM {fidelity_original} o"
_TWO = "SELECT doc, y + (page % 3) * 0.4e0 AS y, text FROM {fidelity_export} e"
query("residual_band", lambda v: h.residual_band(v.sql(_ONE), v.sql(_TWO)), f"SELECT a.doc, line, sum(length(text))::BIGINT AS residual FROM ({_ONE}) a JOIN ({_TWO}) b ON a.doc = b.doc AND abs(a.y - b.y) <= 0.6e0 GROUP BY a.doc, line")
_RUNS = "SELECT doc, page, seq, x, replace(text, ' ', '') AS text FROM {fidelity_original} o"
_SRC = "SELECT doc, page, seq AS cseq, x AS cx, text FROM {fidelity_export} e"
query("bind_runs", lambda v: h.bind_runs(v.sql(_RUNS), v.sql(_SRC)), f"""SELECT doc, page, seq, CASE WHEN n = 1 THEN 'strong' WHEN n > 1 AND close = 1 THEN 'placed' ELSE 'none' END AS binding, CASE WHEN n = 1 THEN only_ WHEN n > 1 AND close = 1 THEN at_ END AS source
    FROM (SELECT r.doc, r.page, r.seq, count(cseq) AS n, count(*) FILTER (WHERE abs(x - cx) <= 3) AS close, min(cseq) AS only_, min(cseq) FILTER (WHERE abs(x - cx) <= 3) AS at_ FROM ({_RUNS}) r LEFT JOIN ({_SRC}) c ON r.doc = c.doc AND r.page = c.page AND r.text = c.text GROUP BY r.doc, r.page, r.seq) t""")
query("split_paragraph", lambda v: h.split_paragraph(v.doc_texts.withColumn("lines", F.lit(2))).filter("n = 0").select("doc_id", F.col("parts").alias("n")), "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 2 THEN len(string_split(text, chr(10))) ELSE least(2, len(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '))) END AS n FROM {doc_texts} d")

query("text_similarity", lambda v: s.text_similarity(v.next_texts).select("a", "b", F.round("score", 9).alias("score")), """WITH n AS (SELECT a, b, trim(regexp_replace(regexp_replace(translate(lower(ta), 'áàâãäéèêëíìîïóòôõöúùûüçñß', 'aaaaaeeeeiiiiooooouuuucns'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS x,
    trim(regexp_replace(regexp_replace(translate(lower(tb), 'áàâãäéèêëíìîïóòôõöúùûüçñß', 'aaaaaeeeeiiiiooooouuuucns'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS y FROM {next_texts} p),
    gx AS (SELECT a, b, substr(x, i::INT, 2) AS g, count(*) AS n FROM n, unnest(range(1, length(x))) u(i) GROUP BY ALL), gy AS (SELECT a, b, substr(y, i::INT, 2) AS g, count(*) AS n FROM n, unnest(range(1, length(y))) u(i) GROUP BY ALL),
    gj AS (SELECT coalesce(gx.a, gy.a) AS a, coalesce(gx.b, gy.b) AS b, sum(least(coalesce(gx.n, 0), coalesce(gy.n, 0))) / sum(greatest(coalesce(gx.n, 0), coalesce(gy.n, 0)))::DOUBLE AS j FROM gx FULL JOIN gy ON gx.a = gy.a AND gx.b = gy.b AND gx.g = gy.g GROUP BY 1, 2),
    w AS (SELECT a, b, list_filter(list_distinct(string_split(x, ' ')), lambda t: length(t) > 1) AS wx, list_filter(list_distinct(string_split(y, ' ')), lambda t: length(t) > 1) AS wy FROM n)
    SELECT n.a, n.b, round(CASE WHEN x = '' OR y = '' THEN 0e0 WHEN x = y THEN 1e0 ELSE 0.4e0 * coalesce(j, 0) + 0.6e0 * CASE WHEN len(wx) + len(wy) = 0 THEN 0e0 ELSE len(list_intersect(wx, wy)) / len(list_distinct(list_concat(wx, wy)))::DOUBLE END END, 9) AS score
    FROM n JOIN w ON n.a = w.a AND n.b = w.b LEFT JOIN gj ON n.a = gj.a AND n.b = gj.b""")
_NORMAL = "trim(regexp_replace(regexp_replace(translate(lower(text), 'áàâãäéèêëíìîïóòôõöúùûüçñß', 'aaaaaeeeeiiiiooooouuuucns'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
# Every pair of different texts that shares a word is compared by words; bigrams add at most 0.4.
query("near_duplicates", lambda v: s.near_duplicates(v.doc_texts, "doc_id", "text").select("a", "b", F.round("score", 6).alias("score")), f"""WITH n AS MATERIALIZED (SELECT * FROM (SELECT doc_id, {_NORMAL} AS x FROM {{doc_texts}} d) t WHERE x <> ''), c AS MATERIALIZED (SELECT x, min(doc_id) AS c FROM n GROUP BY x),
    w AS MATERIALIZED (SELECT DISTINCT c, w FROM (SELECT c, unnest(string_split(x, ' ')) AS w FROM c) t WHERE length(w) > 1), z AS (SELECT c, count(*) AS n FROM w GROUP BY c),
    near AS MATERIALIZED (SELECT p, q, i::DOUBLE / (a.n + b.n - i) AS j FROM (SELECT a.c AS p, b.c AS q, count(*) AS i FROM w a JOIN w b ON a.w = b.w AND a.c < b.c GROUP BY a.c, b.c) i JOIN z a ON a.c = p JOIN z b ON b.c = q WHERE 0.4e0 + 0.6e0 * i / (a.n + b.n - i) > 0.6e0),
    g AS MATERIALIZED (SELECT c, g, count(*) AS n FROM (SELECT c, substr(x, k, 2) AS g FROM (SELECT c, x, unnest(range(1, length(x))) AS k FROM c WHERE c IN (SELECT p FROM near UNION SELECT q FROM near)) t) u GROUP BY c, g), t AS (SELECT c, sum(n) AS n FROM g GROUP BY c),
    scored AS (SELECT p, q, 0.4e0 * coalesce(low / (a.n + b.n - low)::DOUBLE, 0) + 0.6e0 * j AS score FROM (SELECT near.p, near.q, any_value(j) AS j, sum(least(x.n, y.n)) AS low FROM near LEFT JOIN (g x JOIN g y ON x.g = y.g) ON x.c = near.p AND y.c = near.q GROUP BY near.p, near.q) s JOIN t a ON a.c = p JOIN t b ON b.c = q),
    m AS (SELECT doc_id, c FROM n JOIN c USING (x))
    SELECT least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b, round(score, 6) AS score FROM scored JOIN m a ON a.c = p JOIN m b ON b.c = q WHERE score > 0.6e0 UNION ALL SELECT a.doc_id, b.doc_id, 1e0 FROM m a JOIN m b ON a.c = b.c AND a.doc_id < b.doc_id""")
query("trigram_similarity", lambda v: s.trigram_similarity(v.next_texts).select("a", "b", F.round("score", 9).alias("score")), """SELECT a, b, round(CASE WHEN ta = '' OR tb = '' THEN 0e0 WHEN lower(ta) = lower(tb) THEN 1e0 WHEN contains(lower(ta), lower(tb)) OR contains(lower(tb), lower(ta)) THEN 0.9e0
    WHEN least(length(ta), length(tb)) < 3 THEN 0e0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 9) AS score FROM (SELECT a, b, ta, tb, list_distinct(list_transform(range(1, length(ta) - 1), lambda i: substr(lower(ta), i::INT, 3))) AS x,
    list_distinct(list_transform(range(1, length(tb) - 1), lambda i: substr(lower(tb), i::INT, 3))) AS y FROM {next_texts} p) t""")
query("stamp_normalise", lambda v: v.part.select("p_partkey", s.stamp_normalise(F.concat(F.lit("Dr. "), F.col("p_name"), F.lit(" CRM 12"))).alias("stamp")), "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '12' AS stamp FROM {part} p")
query("number_keys", lambda v: s.number_keys(v.statements, "doc_id", "head"), "SELECT DISTINCT doc_id, unnest(regexp_extract_all(head, '[0-9]{4,}')) AS number FROM {statements} s")
_LINKED = f"""SELECT a.page, a.block AS a, b.block AS b FROM {{text_blocks}} a JOIN {{text_blocks}} b ON a.page = b.page AND a.block < b.block WHERE ({{0}})"""
_SHARED = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / least(a.w, b.w)"
_YGAP, _XGAP = "greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h))", "greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w))"


def _clusters(rule: str) -> str:
    link = _LINKED.replace("{0}", rule)
    return f"""WITH RECURSIVE e AS ({link}), g AS (SELECT page, a, b FROM e UNION SELECT page, b, a FROM e), r AS (SELECT page, block, block AS seen FROM {{text_blocks}} t UNION SELECT r.page, r.block, g.b FROM r JOIN g ON r.page = g.page AND r.seen = g.a)
        SELECT page, block, min(seen) AS cluster FROM r GROUP BY page, block"""


_APART = "SELECT page, block, x + block % 2 * 300 AS x, y * (1 + block % 3) AS y, w, h FROM {text_blocks} b"
query("block_clusters", lambda v: s.block_clusters(v.sql(_APART)), _clusters(f"({_SHARED} > 0.1 AND {_YGAP} < 80) OR ({_SHARED} > 0.3 AND {_YGAP} < 80) OR ({_YGAP} < 20 AND {_XGAP} < 20)").replace("{text_blocks}", f"({_APART})"))
query("block_clusters_simple", lambda v: s.block_clusters(v.sql(_APART), s.SIMPLE_LINKS), _clusters(f"({_SHARED} > 0.3 AND {_YGAP} < 40) OR {_YGAP} < 20").replace("{text_blocks}", f"({_APART})"))
query("region_candidates", lambda v: s.region_candidates(v.text_blocks, ("gear", "bolt"), 300).groupBy("reason").count().withColumnRenamed("count", "n"), "SELECT CASE WHEN trim(text) = '' THEN 'blank' WHEN contains(text, 'gear') OR contains(text, 'bolt') THEN 'keyword' WHEN y > 210 THEN 'low' ELSE 'dropped' END AS reason, count(*) AS n FROM {text_blocks} b GROUP BY 1")
# Capitals for whole pages, for every other block, or for the first letters only; blocks without letters; words of signatures.
_CASED = """SELECT page, block, CASE WHEN block % 5 = 3 THEN '12 - 34' WHEN page % 3 = 0 AND page % 2 = 0 THEN concat('ASSINADO ', upper(text)) WHEN page % 3 = 0 OR page % 3 = 1 AND block % 2 = 0 THEN upper(text)
    WHEN page % 7 = 1 THEN concat(upper(substr(text, 1, length(text) - block)), substr(text, length(text) - block + 1)) ELSE text END AS text FROM {text_blocks} b WHERE page % 3 > 0 OR block % 5 < 3"""
query("uppercase_share", lambda v: s.uppercase_share(v.sql(_CASED), "page"), f"""SELECT page, CASE h WHEN 0 THEN 'printed' WHEN n THEN 'handwritten' ELSE 'mixed' END AS kind, CASE h WHEN 0 THEN 0.7e0 WHEN n THEN CASE WHEN signed THEN 0.8e0 ELSE 0.5e0 END ELSE 0.9e0 END AS confidence, n AS blocks, h AS capitals
    FROM (SELECT page, count(*) AS n, count(*) FILTER (WHERE 10 * ups > 7 * letters) AS h, bool_or(regexp_matches(text, '(?i)DR|CRM|M[ÉE]DICO|AGUIAR|ASSINAD[OA]|ASSINATURA|SIGNATURE|SIGNED|FIRMA')) AS signed
    FROM (SELECT *, len(regexp_extract_all(text, '[A-Z]')) AS ups, len(regexp_extract_all(text, '[A-Za-z]')) AS letters FROM ({_CASED}) c) l GROUP BY page) g WHERE n > 1""")
_BY4 = "SELECT page, block, block % 4 AS cluster FROM {text_blocks} b"
query("cluster_bbox", lambda v: s.cluster_bbox(v.text_blocks, v.sql(_BY4)), 'SELECT page, block % 4 AS cluster, min(x) AS "left", min(y) AS top, max(x + w) AS "right", max(y + h) AS bottom, count(*) AS n FROM {text_blocks} b GROUP BY 1, 2')

query("y_cluster", lambda v: ln.y_cluster(v.text_blocks), "SELECT page, (block - 1)::INT AS line, block FROM {text_blocks} b")
_SPOKEN = "SELECT page, block, w, CASE WHEN block % 2 = 0 THEN concat(text, '.') ELSE text END AS text FROM {text_blocks} b"
query("line_stability", lambda v: ln.line_stability(v.sql(_SPOKEN)), f"""SELECT page, floor(round((0.35e0 * avg(fit) + 0.35e0 * avg(phrase) + 0.2e0 * greatest(0, 1 - coalesce(var_pop(words) / pow(avg(words), 2), 0)) + 0.1e0) * 100, 6) + 0.5)::BIGINT AS score FROM (SELECT page, exp(-pow((w / max(w) OVER (PARTITION BY page) - 0.9e0) / 0.1e0, 2) / 2) AS fit,
    len(string_split(text, ' ')) AS words, regexp_matches(text, '[.,;:!?]$')::INT AS phrase FROM ({_SPOKEN}) s) t GROUP BY page""")
_BARE = "regexp_replace(lower({0}), '[,.;:!?)]$', '')"
_PAIRS = ", ".join(f"('{x}', '{y}')" for x, y in (("trabalho", "a"), ("a", "partir"), ("partir", "de"), ("junto", "ao"), ("de", "abril"), ("do", "trabalho"), ("de", "acordo"), ("em", "vez"), ("a", "fim"), ("de", "03/04/2026")))
_PREPOSED = "'a', 'de', 'do', 'da', 'dos', 'das', 'para', 'por', 'com', 'em', 'no', 'na', 'nos', 'nas', 'ao', 'à', 'pelo', 'pela', 'e', 'ou', 'que'"
_SHORT = "'a', 'de', 'do', 'da', 'dos', 'das', 'e', 'ou', 'que', 'em', 'no', 'na', 'ao', 'à', 'com', 'por', 'para', 'se', 'mas', 'nem'"
# i and s are places of words: s the first of the open line, i the first beyond the edge, e the last before a break.
_BREAKS = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT page, n AS i, word, {_BARE.format("word")} AS bare, x, x + w AS r, source FROM {{paragraph_words}} p),
    q AS MATERIALIZED (SELECT *, lead(bare) OVER o AS next, lead(source) OVER o AS next_source FROM w WINDOW o AS (PARTITION BY page ORDER BY i)),
    p AS MATERIALIZED (SELECT a.page, a.i AS s, b.i AS e, a.x, b.source, b.next_source, b.bare, b.next, max(b.r) OVER (PARTITION BY a.page, a.i ORDER BY b.i) AS reach FROM q a JOIN q b ON a.page = b.page AND a.i <= b.i),
    c AS MATERIALIZED (SELECT o.page, o.s, o.e AS i, e.e, round(0.35e0 * exp(-0.5e0 * pow(((e.reach - e.x) / (190 - e.x) - 0.92e0) / 0.08e0, 2)) + 0.35e0 * greatest(0, CASE WHEN e.e + 1 < o.e AND (e.bare, e.next) IN ({_PAIRS}) THEN 0 WHEN e.bare IN ({_PREPOSED}) THEN 0.98e0 ELSE 1 END
        - CASE WHEN o.e - e.e = 2 AND e.next IN ({_SHORT}) THEN 0.15e0 ELSE 0 END) + 0.1e0 * CASE WHEN l.source = o.source THEN 0.5e0 WHEN e.source <> e.next_source THEN 1 ELSE 0 END, 9) AS score
        FROM p o JOIN p l ON l.page = o.page AND l.s = o.s AND l.e = o.e - 1 JOIN p e ON e.page = o.page AND e.s = o.s AND e.e < o.e AND e.reach <= 190 WHERE o.reach > 190 AND o.e > o.s),
    best AS MATERIALIZED (SELECT page, s, i, arg_max(e, (score, -e)) AS e, max(score) AS score FROM c GROUP BY page, s, i),
    r AS (SELECT page, 0::BIGINT AS s, 0::BIGINT AS i, NULL::BIGINT AS ls, NULL::BIGINT AS le, NULL::DOUBLE AS score FROM w WHERE i = 0
        UNION ALL SELECT r.page, CASE WHEN p.reach > 190 AND p.e > p.s THEN coalesce(b.e, p.e - 1) + 1 ELSE r.s END, p.e, CASE WHEN p.reach > 190 AND p.e > p.s THEN r.s END, CASE WHEN p.reach > 190 AND p.e > p.s THEN coalesce(b.e, p.e - 1) END, b.score
        FROM r JOIN p ON p.page = r.page AND p.s = r.s AND p.e = r.i + 1 LEFT JOIN best b ON b.page = r.page AND b.s = r.s AND b.i = r.i + 1),
    lines AS MATERIALIZED (SELECT page, ls, le, score, row_number() OVER (PARTITION BY page ORDER BY ls) AS k FROM (SELECT page, ls, le, score FROM r WHERE le IS NOT NULL UNION ALL SELECT page, arg_max(s, i), max(i), NULL FROM r GROUP BY page) u)"""
_TOLD = "regexp_replace(string_agg(word, ' ' ORDER BY i), ' ([,.;:!?)\\]}%])', '\\1', 'g')"
query("break_scores", lambda v: breaks.break_lines(v.paragraph_words, 190.0, merge=False).select("page", "line", "text", "words", "right", F.round("score", 6).alias("score")), f"""{_BREAKS}
    SELECT l.page, (k - 1)::INT AS line, {_TOLD} AS text, count(*)::INT AS words, max(r) AS "right", round(any_value(score), 6) AS score FROM lines l JOIN w ON w.page = l.page AND w.i BETWEEN ls AND le GROUP BY l.page, k""")
query("merge_short_lines", lambda v: breaks.break_lines(v.paragraph_words, 190.0).drop("score"), f"""{_BREAKS},
    m AS (SELECT page, k, ls AS s, le AS e FROM lines WHERE k = 1 UNION ALL SELECT l.page, l.k, CASE WHEN l.ls = l.le AND (p.reach <= 190 OR (a.bare, a.next) IN ({_PAIRS})) THEN m.s ELSE l.ls END, l.le
        FROM m JOIN lines l ON l.page = m.page AND l.k = m.k + 1 JOIN p ON p.page = l.page AND p.s = m.s AND p.e = l.le JOIN q a ON a.page = l.page AND a.i = m.e),
    kept AS (SELECT page, s, max(e) AS e FROM m GROUP BY page, s)
    SELECT page, line, {_TOLD} AS text, count(*)::INT AS words, max(r) AS "right" FROM (SELECT page, s, e, (row_number() OVER (PARTITION BY page ORDER BY s) - 1)::INT AS line FROM kept) t JOIN w USING (page) WHERE i BETWEEN s AND e GROUP BY page, line""")
query("block_text", lambda v: ln.block_text(v.text_blocks).select("page", "left", "right", "lines"), 'SELECT page, min(x) AS "left", max(x + w) AS "right", count(*)::INT AS lines FROM {text_blocks} b GROUP BY page')
query("table_row_cells", lambda v: ln.table_row_cells(v.table_words, 10.0).select("page", "row", "how", F.array_join("cells", "|").alias("cells")), """SELECT l_orderkey AS page, row, CASE row % 4 WHEN 1 THEN 'gap' ELSE 'even' END AS how,
    CASE row % 4 WHEN 0 THEN 'w0|w1|w2|w3|w4|w5' WHEN 1 THEN 'w0 w1|w2 w3' ELSE 'w0|w1|w2|w3|w4 w5' END AS cells FROM {order_lines} l WHERE row % 4 <> 2""")
_LAYER = "SELECT page, y + block % 3 * 30 AS y, label AS text FROM {text_blocks} b WHERE label IS NOT NULL AND page % 3 > 0"
_TALL = "SELECT page, block, y, CASE WHEN block % 7 = 6 THEN 0e0 ELSE w END AS w, CASE block % 3 WHEN 0 THEN 12e0 WHEN 1 THEN 29e0 ELSE 43e0 END AS h, CASE WHEN block % 5 = 4 THEN '' WHEN block % 4 = 2 THEN concat(text, chr(10), chr(10), 'second line', chr(10), 'third') WHEN block % 4 = 3 THEN concat(text, ' of four or  more words') ELSE text END AS text FROM {text_blocks} b"
query("fuse_text_layers", lambda v: ln.fuse_text_layers(v.sql(_TALL), v.sql(_LAYER)), f"""WITH b AS (SELECT *, greatest(1, floor(h / 12 + 0.5))::INT AS n, list_filter(string_split(text, chr(10)), lambda t: t <> '') AS own, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS words FROM ({_TALL}) t),
    found AS (SELECT b.page, block, (row_number() OVER (PARTITION BY b.page, block ORDER BY l.y, l.text) - 1)::INT AS line, l.y - 0.8e0 * 12 AS y, l.text, 'layer' AS how FROM b JOIN ({_LAYER}) l ON b.page = l.page AND l.y BETWEEN b.y - 12 AND b.y + h + 12),
    rest AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.page = b.page AND f.block = b.block)),
    split AS (SELECT page, block, y, CASE WHEN len(own) >= n THEN own[1:n] WHEN n = 1 OR len(words) = 0 THEN [text] ELSE list_filter(list_transform(range(0, n), lambda k: array_to_string(words[(k * ceil(len(words) / n) + 1)::INT:((k + 1) * ceil(len(words) / n))::INT], ' ')), lambda t: t <> '') END AS parts FROM rest WHERE text <> '' AND w <> 0)
    SELECT * FROM found UNION ALL SELECT page, block, 0, y, text, 'whole' FROM rest WHERE text = '' OR w = 0 UNION ALL SELECT page, block, (i - 1)::INT, y + (i - 1) * 12, parts[i], 'split' FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM split) s""")
query("glyph_lines", lambda v: breaks.glyph_lines(v.glyphs), """WITH RECURSIVE b AS (SELECT *, sum(CASE WHEN above - y <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y DESC, x) AS band FROM (SELECT *, lag(y) OVER (PARTITION BY page ORDER BY y DESC, x) AS above FROM {glyphs} g) t),
    o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY band, x, y DESC) AS k FROM b),
    r AS (SELECT page, k, 0 AS line, y AS first_y, size AS first_size, x + w AS done FROM o WHERE k = 1 UNION ALL SELECT page, k, CASE WHEN fresh THEN line + 1 ELSE line END, CASE WHEN fresh THEN y ELSE first_y END, CASE WHEN fresh THEN size ELSE first_size END, x + w
        FROM (SELECT o.*, r.line, r.first_y, r.first_size, abs(o.y - r.first_y) > r.first_size / 2 OR o.x - r.done > 3 * r.first_size AS fresh FROM r JOIN o ON o.page = r.page AND o.k = r.k + 1) s),
    l AS (SELECT o.*, r.line FROM o JOIN r ON o.page = r.page AND o.k = r.k),
    f AS (SELECT page, line, arg_max(family, (n, -first)) AS family FROM (SELECT page, line, family, sum(greatest(length(text), 1)) AS n, min(k) AS first FROM l GROUP BY page, line, family) c GROUP BY page, line)
    SELECT page, line, string_agg(text, '' ORDER BY k) AS text, arg_min(x, k) AS x, arg_min(y, k) AS y, arg_max(x + w, k) - arg_min(x, k) AS width, max(size) AS size, any_value(f.family) AS family, count(*)::INT AS n FROM l JOIN f USING (page, line) GROUP BY page, line""")
# Exported items that are parted, moved or changed: two for one, one too many, words that grow.
_UNALIKE = """SELECT doc, page, seq * 2 AS seq, CASE WHEN doc % 3 = 0 THEN 'Q' WHEN doc % 7 = 1 THEN concat(text, ' and more') ELSE text END AS text FROM {fidelity_export} a WHERE doc % 5 > 0 OR seq > 0
    UNION ALL SELECT doc, page, seq * 2 + 1, CASE WHEN doc % 3 = 0 THEN substr(text, 2) ELSE '--' END FROM {fidelity_export} b WHERE doc % 3 = 0 OR doc % 11 = 2"""
query("observation_align", lambda v: breaks.observation_align(v.fidelity_original, v.sql(_UNALIKE)), f"""WITH RECURSIVE ex AS (SELECT doc, page, seq, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS k, regexp_extract_all(text, '[A-Za-z0-9]+') AS words FROM {{fidelity_original}} o),
    ac AS (SELECT doc, page, seq, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS k, regexp_extract_all(text, '[A-Za-z0-9]+') AS words FROM ({_UNALIKE}) p),
    r AS (SELECT doc, page, 1::BIGINT AS e, 1::BIGINT AS a, []::VARCHAR[] AS got, []::BIGINT[] AS used, NULL::VARCHAR[] AS took, NULL::BIGINT[] AS took_items, NULL::BIGINT AS ended FROM (SELECT DISTINCT doc, page FROM ex SEMI JOIN ac USING (doc, page)) s
        UNION ALL SELECT doc, page, CASE WHEN takes AND NOT whole OR e IS NULL THEN e ELSE e + 1 END, CASE WHEN takes THEN a + 1 ELSE a END, CASE WHEN takes AND NOT whole THEN more ELSE [] END, CASE WHEN takes AND NOT whole THEN list_append(used, item) ELSE [] END,
        CASE WHEN takes AND NOT whole THEN NULL WHEN takes THEN more ELSE got END, CASE WHEN takes AND NOT whole THEN NULL WHEN takes THEN list_append(used, item) ELSE used END, CASE WHEN takes AND NOT whole THEN NULL ELSE e END
        FROM (SELECT r.doc, r.page, r.e, r.a, r.got, r.used, ac.seq AS item, list_concat(r.got, ac.words) AS more, coalesce(len(r.got) + len(ac.words) <= len(ex.words), false) AS takes, coalesce(list_concat(r.got, ac.words) = ex.words, false) AS whole
        FROM r JOIN ex ON ex.doc = r.doc AND ex.page = r.page AND ex.k = r.e LEFT JOIN ac ON ac.doc = r.doc AND ac.page = r.page AND ac.k = r.a) t)
    SELECT doc, page, seq AS e, coalesce(nullif(array_to_string(took_items, '+'), ''), '(no match)') AS items, took = words OR len(took) = 0 AS matched,
    CASE WHEN took = words OR len(took) = 0 THEN NULL ELSE concat('text differs: "', array_to_string(words, ' '), '" vs "', array_to_string(took, ' '), '"') END AS note FROM r JOIN ex USING (doc, page) WHERE ended = k""")
