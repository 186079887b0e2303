"""Queries of the fidelity, replay and telemetry operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrowth.operators import quality as q
from docgrowth.plans.base import query

_items = lambda v: q.fidelity_items(v.fidelity_original, v.fidelity_export)
_ITEMS = r"""(SELECT o.doc, o.page, o.seq, o.font AS o_font, e.doc IS NULL AS missing, coalesce(regexp_replace(o.text, '\s', '', 'g') = regexp_replace(e.text, '\s', '', 'g'), false) AS text_ok,
    coalesce(lower(trim(o.font)) = lower(trim(e.font)), false) AS font_ok, coalesce(abs(o.x - e.x) <= 1 AND abs(o.y - e.y) <= 1, false) AS place_ok
    FROM {fidelity_original} o LEFT JOIN {fidelity_export} e ON o.doc = e.doc AND o.page = e.page AND o.seq = e.seq)"""
_SHARE = "count(*) AS items, count(*) FILTER (WHERE missing) AS missing, avg(text_ok::INT) AS text, avg(font_ok::INT) AS font, avg(place_ok::INT) AS place"
query("fidelity_pages", lambda v: q.fidelity_pages(_items(v)), f"SELECT *, 0.5 * text + 0.5 * place >= 0.95 AS passed FROM (SELECT doc, page, {_SHARE} FROM {_ITEMS} i GROUP BY doc, page) p")
query("fidelity_documents", lambda v: q.fidelity_documents(_items(v)), f"SELECT *, 0.5 * text + 0.5 * place >= 0.95 AND missing = 0 AS passed FROM (SELECT doc, {_SHARE} FROM {_ITEMS} i GROUP BY doc) p")
_MISS = f"""(SELECT doc, page, seq, o_font, dimension FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, seq, k) AS n FROM (SELECT *, 0 AS k, 'text' AS dimension FROM {_ITEMS} a WHERE NOT text_ok
    UNION ALL SELECT *, 1, 'font' FROM {_ITEMS} b WHERE NOT font_ok UNION ALL SELECT *, 2, 'place' FROM {_ITEMS} c WHERE NOT place_ok) u) r WHERE n <= 200)"""
query("fidelity_mismatches", lambda v: q.fidelity_mismatches(_items(v)), f"SELECT * FROM {_MISS} m")
query("fidelity_benchmark", lambda v: q.fidelity_benchmark(_items(v)).select(*(F.round(c, 9).alias(c) for c in ("text", "font", "place", "missing_rate", "text_gap")), "met"), f"""SELECT round(text, 9) AS text, round(font, 9) AS font, round(place, 9) AS place, round(missing_rate, 9) AS missing_rate, round(0.99 - text, 9) AS text_gap,
    text >= 0.99 AND font >= 0.99 AND place >= 0.99 AND missing_rate <= 0.005 AS met FROM (SELECT sum(text * items) / sum(items) AS text, sum(font * items) / sum(items) AS font, sum(place * items) / sum(items) AS place, sum(missing) / sum(items)::DOUBLE AS missing_rate
    FROM (SELECT doc, avg(text) AS text, avg(font) AS font, avg(place) AS place, sum(items) AS items, sum(missing) AS missing FROM (SELECT doc, page, {_SHARE} FROM {_ITEMS} i GROUP BY doc, page) p GROUP BY doc) d) t""")
query("top_problems", lambda v: q.top_problems(q.fidelity_mismatches(_items(v))), f"SELECT dimension, CASE WHEN dimension = 'font' THEN o_font ELSE dimension END AS label, count(*) AS n FROM {_MISS} m GROUP BY ALL ORDER BY n DESC, dimension, label LIMIT 20")
query("text_diff_note", lambda v: q.text_diff_note(v.text_pairs).select("conv_id", "turn", "first"), "SELECT conv_id, turn, CASE WHEN expected = actual THEN -1 ELSE length(expected) END::INT AS first FROM {text_pairs} t")
query("change_range", lambda v: q.change_range(v.text_pairs).select("conv_id", "turn", "prefix", "kind"), "SELECT conv_id, turn, length(expected)::INT AS prefix, 'insert' AS kind FROM {text_pairs} t")
_PAGE = "(SELECT doc, page, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS boxes FROM {{{0}}} x GROUP BY doc, page)"
_O, _E = _PAGE.format("fidelity_original"), _PAGE.format("fidelity_export")
_WORDED = lambda c: f"array_to_string(regexp_extract_all({c}, '[A-Za-z0-9]+'), ' ')"
query("observation_diff", lambda v: q.observation_diff(v.fidelity_original, v.fidelity_export), f"""WITH p AS (SELECT coalesce(o.doc, e.doc) AS doc, coalesce(o.page, e.page) AS page, {_WORDED("o.text")} AS a, {_WORDED("e.text")} AS b, o.boxes AS x, e.boxes AS y
    FROM {_O} o FULL JOIN {_E} e ON o.doc = e.doc AND o.page = e.page)
    SELECT doc, page, unnest(list_filter([CASE WHEN a <> b THEN 'text-mismatch' END, CASE WHEN a <> b AND NOT starts_with(a, b) AND NOT starts_with(b, a) THEN 'word-count-mismatch' END,
    CASE WHEN string_split(a, ' ')[1] <> string_split(b, ' ')[1] THEN 'first-word-mismatch' END, CASE WHEN x <> y THEN 'bbox-count-mismatch' END], lambda k: k IS NOT NULL)) AS kind FROM p WHERE x IS NOT NULL AND y IS NOT NULL
    UNION ALL SELECT doc, NULL, 'page-count' FROM p GROUP BY doc HAVING count(x) <> count(y)""")
_TOLD = """(SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY seq, k) - 1 AS n, word, concat(seq, '.Word', k) AS loc FROM (SELECT doc, page, seq, u.i AS k, w[u.i] AS word FROM (SELECT doc, page, seq, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM {{{0}}} x) t, unnest(range(1, len(w) + 1)) u(i)) q)"""
_OF = "(SELECT DISTINCT doc, page FROM {{{0}}} x)"
#: Both sides dealt to as many tasks as their rows need, by what they are joined on.
_sides = lambda v, *by: (d.repartition(v.tasks, *by) for d in (v.fidelity_original, v.fidelity_export))
query("word_trace", lambda v: q.word_trace(*_sides(v, "doc", "page")).withColumnRenamed("at", "place"), f"""SELECT doc, page, place::INT AS place, expected, actual, coalesce(l1, 'Word' || (place + 1)) AS expected_loc, coalesce(l2, 'Word' || (place + 1)) AS actual_loc FROM (
    SELECT coalesce(o.doc, e.doc) AS doc, coalesce(o.page, e.page) AS page, coalesce(o.n, e.n) AS place, coalesce(o.word, '') AS expected, coalesce(e.word, '') AS actual, o.loc AS l1, e.loc AS l2
    FROM {_TOLD.format("fidelity_original")} o FULL JOIN {_TOLD.format("fidelity_export")} e ON o.doc = e.doc AND o.page = e.page AND o.n = e.n) t
    JOIN {_OF.format("fidelity_original")} a USING (doc, page) JOIN {_OF.format("fidelity_export")} b USING (doc, page) WHERE expected <> actual""")
_RULED = "SELECT event_id, event_type AS rule FROM {events} e"
_POLICY = "SELECT 'view' AS rule, 'lenient' AS policy UNION ALL SELECT 'click' AS rule, 'warn' AS policy"
query("contract_policy", lambda v: q.contract_policy(v.sql(_RULED), v.sql(_POLICY)).select("event_id", "policy"), f"SELECT event_id, CASE rule WHEN 'view' THEN 'lenient' WHEN 'click' THEN 'warn' ELSE 'strict' END AS policy FROM ({_RULED}) r")
_MET = "{fidelity_original} o FULL JOIN {fidelity_export} e ON o.doc = e.doc AND o.page = e.page AND o.seq = e.seq"
_SHAPED = "SELECT *, 20e0 + seq * 5 + {1} AS w, 12e0 AS h, CASE WHEN page % 2 = 0 THEN seq * 0.1e0 + {1} END AS rotation, CASE seq WHEN 0 THEN 'mask' WHEN 1 THEN 'patch' ELSE 'text' END AS kind FROM {{{0}}} s"
_SHAPES = [_SHAPED.format("fidelity_original", "0"), _SHAPED.format("fidelity_export", "CASE WHEN doc % 3 = 0 THEN 1 ELSE 0 END")]
query("geometry_diff", lambda v: q.geometry_diff(*map(v.sql, _SHAPES)), f"""SELECT doc, error, rotation, count_gap, masks, patches, count_gap = 0 AND error < 0.01 AS passed FROM (SELECT coalesce(o.doc, e.doc) AS doc,
    round(sum(CASE WHEN o.doc IS NULL OR e.doc IS NULL THEN 0 ELSE (abs(o.x - e.x) + abs(o.y - e.y) + abs(o.w - e.w) + abs(o.h - e.h)) / greatest(o.w, e.w, 1) END) / greatest(count(o.doc), count(e.doc)), 9) AS error,
    round(coalesce(avg(CASE WHEN o.doc IS NOT NULL AND e.doc IS NOT NULL AND (o.rotation IS NOT NULL OR e.rotation IS NOT NULL) THEN abs(coalesce(o.rotation, 0) - coalesce(e.rotation, 0)) END), 0), 9) AS rotation, abs(count(o.doc) - count(e.doc)) AS count_gap,
    abs(count(*) FILTER (WHERE o.kind = 'mask') - count(*) FILTER (WHERE e.kind = 'mask')) AS masks, abs(count(*) FILTER (WHERE o.kind = 'patch') - count(*) FILTER (WHERE e.kind = 'patch')) AS patches
    FROM ({_SHAPES[0]}) o FULL JOIN ({_SHAPES[1]}) e ON o.doc = e.doc AND o.page = e.page AND o.seq = e.seq GROUP BY 1) t""")
query("command_diff", lambda v: q.command_diff(v.fidelity_original, v.fidelity_export), f"""SELECT doc, page, seq, field, before, after FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, seq, field) AS n FROM (
    SELECT o.doc, o.page, o.seq, 'x' AS field, o.x AS before, e.x AS after FROM {_MET.replace('FULL', '')} WHERE abs(o.x - e.x) > 1e-6 UNION ALL SELECT o.doc, o.page, o.seq, 'y', o.y, e.y FROM {_MET.replace('FULL', '')} WHERE abs(o.y - e.y) > 1e-6) u) t WHERE n <= 50""")
_TURNED = "SELECT doc, page, seq, CASE WHEN seq > 0 THEN seq * 0.5e0 + {1} END AS rotation, CASE WHEN doc % 4 > 0 THEN array(1e0, 0e0, x * {2}) END AS matrix FROM {{{0}}} s"
_RUNS = [_TURNED.format("fidelity_original", "0", "1"), _TURNED.format("fidelity_export", "CASE WHEN doc % 5 = 0 THEN 0.1e0 ELSE 0 END", "CASE WHEN doc % 7 = 0 THEN 1.5e0 ELSE 1e0 END")]
_RUNS_SQL = [r.replace("array(1e0, 0e0, x *", "list_value(1e0, 0e0, x *") for r in _RUNS]
query("dual_run", lambda v: q.dual_run(*map(v.sql, _RUNS)), f"""SELECT doc, rotation, matrix, same_count, same_count AND rotation <= 0.01 AND matrix <= 1e-4 AS agree FROM (SELECT coalesce(o.doc, e.doc) AS doc, max(abs(coalesce(o.rotation, 0) - coalesce(e.rotation, 0))) AS rotation,
    coalesce(max(greatest(abs(coalesce(o.matrix[1], 0) - coalesce(e.matrix[1], 0)), abs(coalesce(o.matrix[2], 0) - coalesce(e.matrix[2], 0)), abs(coalesce(o.matrix[3], 0) - coalesce(e.matrix[3], 0)))), 0) AS matrix, count(o.doc) = count(e.doc) AS same_count
    FROM ({_RUNS_SQL[0]}) o FULL JOIN ({_RUNS_SQL[1]}) e ON o.doc = e.doc AND o.page = e.page AND o.seq = e.seq GROUP BY 1) t""")
_CHANGED = f"(SELECT o.*, CASE WHEN e.doc IS NULL THEN 'missing' WHEN o.text <> e.text THEN 'text' WHEN o.x <> e.x THEN 'moved' ELSE 'same' END AS category FROM {_MET.replace('FULL', 'LEFT')})"
query("pixel_compliance", lambda v: q.pixel_compliance(v.fidelity_original, v.fidelity_export), f"""SELECT *, CASE WHEN changed > 0 THEN floor(changed_other / changed::DOUBLE * 1000 + 0.5) / 10 ELSE 0 END AS other_ratio, floor(changed / cells::DOUBLE * 1000 + 0.5) / 10 AS coverage, changed_other = 0 AS compliant FROM (SELECT doc, count(*) AS cells,
    count(*) FILTER (WHERE category <> 'same') AS changed, count(*) FILTER (WHERE category = 'text') AS changed_text, count(*) FILTER (WHERE category IN ('missing', 'moved')) AS changed_other, min(x) FILTER (WHERE category <> 'same') AS "left",
    max(x) FILTER (WHERE category <> 'same') AS "right", min(y) FILTER (WHERE category <> 'same') AS top, max(y) FILTER (WHERE category <> 'same') AS bottom FROM {_CHANGED} c GROUP BY doc) t""")
query("compliance_violations", lambda v: q.compliance_violations(v.fidelity_original, v.fidelity_export, most=2), f"SELECT doc, n, page, seq, category FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, seq) AS n FROM {_CHANGED} c WHERE category IN ('missing', 'moved')) t WHERE n <= 2")
query("cell_compliance", lambda v: q.cell_compliance(v.fidelity_original, v.fidelity_export), f"""SELECT category, n, "left", "right", top, bottom, floor(n / sum(n) OVER () * 100 * 10 + 0.5) / 10 AS share FROM (SELECT CASE WHEN e.doc IS NULL THEN 'missing' WHEN o.text <> e.text THEN 'text' WHEN o.x <> e.x THEN 'moved' ELSE 'same' END AS category,
    count(*) AS n, min(o.x) AS "left", max(o.x) AS "right", min(o.y) AS top, max(o.y) AS bottom FROM {_MET} GROUP BY 1) t""")
query("content_fingerprint", lambda v: q.content_fingerprint(v.order_lines, "l_orderkey", "row", ("l_partkey", "l_suppkey", "l_returnflag")), "SELECT l_orderkey, md5(string_agg(concat_ws('|', l_partkey, l_suppkey, l_returnflag), chr(10) ORDER BY row)) AS digest FROM {order_lines} l GROUP BY l_orderkey")
query("pseudonymise", lambda v: q.pseudonymise(v.events.select("event_id", F.col("user_id").cast("string").alias("s"), "event_type"), "s", "event_type").select("event_id", "pseudonym"))
_SEEN = "SELECT DISTINCT l_orderkey, concat(l_returnflag, l_linestatus) AS kind FROM {order_lines} l"
query("scene_completeness", lambda v: q.scene_completeness(v.sql(_SEEN), v.sql(_SEEN).filter("kind <> 'NO'"), "l_orderkey", "kind"), f"SELECT l_orderkey, count(*) AS expected, count(*) FILTER (WHERE kind <> 'NO') AS matched, floor(count(*) FILTER (WHERE kind <> 'NO') / count(*)::DOUBLE * 100 * 10 + 0.5) / 10 AS ratio FROM ({_SEEN}) s GROUP BY l_orderkey")
_HAS = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "taxed": "l_tax > 0", "large": "l_quantity > 40"}
query("document_completeness", lambda v: q.document_completeness(v.order_lines, "l_orderkey", {n: F.expr(c) for n, c in _HAS.items()}), f"""SELECT l_orderkey, array_to_string(m, ',') AS missing, 1 - len(m) / 4e0 AS ratio FROM (SELECT l_orderkey,
    list_filter([{", ".join(f"CASE WHEN NOT bool_or({c}) THEN '{n}' END" for n, c in _HAS.items())}], lambda k: k IS NOT NULL) AS m FROM {{order_lines}} l GROUP BY l_orderkey) t""")
_BREAKS = {"missing-layer": "l_linenumber % 4 = 3", "editable-in-base": "l_tax = 0 AND l_linenumber % 4 = 0", "bad-type": "l_returnflag = 'N' AND l_linestatus = 'F'"}
query("layer_validation", lambda v: q.layer_validation(v.order_lines, {n: F.expr(c) for n, c in _BREAKS.items()}).select("l_orderkey", "row", "issue"), " UNION ALL ".join(f"SELECT l_orderkey, row, '{n}' AS issue FROM {{order_lines}} l WHERE {c}" for n, c in _BREAKS.items()))
query("dom_benchmark", lambda v: q.dom_benchmark(v.order_lines, "l_orderkey", "l_returnflag", ("A", "N", "R")), """SELECT l_orderkey, count(*) AS objects, count(*) FILTER (WHERE l_returnflag = 'A') AS A, count(*) FILTER (WHERE l_returnflag = 'N') AS N, count(*) FILTER (WHERE l_returnflag = 'R') AS R,
    (bool_or(l_returnflag = 'A')::INT + bool_or(l_returnflag = 'N')::INT + bool_or(l_returnflag = 'R')::INT) / 3e0 AS score FROM {order_lines} l GROUP BY l_orderkey""")

query("failure_scope", lambda v: q.failure_scope(v.order_lines, "l_orderkey", F.col("l_returnflag") == "R"), """SELECT *, CASE WHEN total = 0 THEN 'no-data' WHEN errors = 0 THEN 'none' WHEN errors / total::DOUBLE < 0.05 THEN 'single-glyph' WHEN errors / total::DOUBLE < 0.15 THEN 'line' WHEN errors / total::DOUBLE < 0.6 THEN 'paragraph' ELSE 'whole-page' END AS scope
    FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS errors, count(*) AS total FROM {order_lines} l GROUP BY l_orderkey) t""")
query("systematic", lambda v: q.systematic(v.order_lines, "l_orderkey", "l_quantity"), "SELECT l_orderkey, avg(l_quantity) = 0 OR stddev_pop(l_quantity) < 0.5 * abs(avg(l_quantity)) AS systematic FROM {order_lines} l GROUP BY l_orderkey")
_FAILS = "(" + " UNION ALL ".join(f"SELECT doc, category, '{m}' AS metric, CASE WHEN {m} IS NULL THEN 'data-missing' ELSE '{r}' END AS root FROM {{glyph_diffs}} g WHERE {m} IS NULL OR {m} > {x}" for m, x, r in (
    ("rotation", 1, "rotation-estimator"), ("bbox", 0.01, "typography-estimator"), ("coverage", 0.01, "coverage-estimator"), ("baseline", 2, "baseline-estimator"), ("pixel", 1, "pixel-noise"))) + """
    UNION ALL SELECT doc, category, 'glyphs', CASE WHEN glyphs < expected_glyphs THEN 'glyph-lost' ELSE 'glyph-extra' END FROM {glyph_diffs} g WHERE glyphs <> expected_glyphs)"""
_failures = lambda v: q.failure_dimensions(v.glyph_diffs)
query("failure_dimensions", _failures, f"SELECT * FROM {_FAILS} f")
query("actionable_documents", lambda v: q.actionable_documents(_failures(v)), f"SELECT doc, count(*) AS failures, bool_or(root <> 'data-missing') AS actionable FROM {_FAILS} f GROUP BY doc")
query("failed_by_metric", lambda v: q.failed_by_metric(_failures(v)), f"SELECT metric, count(*) AS n FROM {_FAILS} f GROUP BY metric")
_report = lambda v: q.root_cause_report(_failures(v), v.glyph_diffs)
_FIXES = """(SELECT unnest(['rotation-estimator', 'typography-estimator', 'coverage-estimator', 'baseline-estimator', 'glyph-lost', 'glyph-extra', 'pixel-noise', 'data-missing']) AS root, unnest([1.0, 0.9, 0.9, 0.8, 1.0, 0.7, 0.6, 0.1]::DOUBLE[]) AS severity,
    unnest(['P0', 'P0', 'P0', 'P1', 'P0', 'P1', 'P1', 'P2']) AS priority, unnest(['RotationEstimator', 'TypographyEstimator', 'CoverageEstimator', 'BaselineEstimator', 'OCR/Layout', 'Layout', 'PixelDiff/NoiseFilter', '']) AS target,
    unnest(['重新校准旋转估计（基线/方向置信度）', '重新估计字体/字号/字形宽度（影响 bbox）', '调整 mask/padding/coverage 边界', '重新估计文本基线（y 偏移）', '修复 glyph 丢失（OCR 漏检 / 布局裁剪）', '清理多余 glyph（覆盖 / 重复）', '检查噪点过滤 / mask / 字体加载导致的像素差异', '']) AS action)"""
_REPORT = f"(SELECT root, n, percent, target, action, severity, priority FROM (SELECT root, count(*) AS n, count(*) / (SELECT count(*) FROM {{glyph_diffs}} g)::DOUBLE * 100 AS percent FROM (SELECT DISTINCT doc, root FROM {_FAILS} f) d GROUP BY root) c JOIN {_FIXES} x USING (root))"
query("root_cause_report", _report, f"SELECT root, n, percent, target, action FROM {_REPORT} r")
query("root_cause_priority", lambda v: q.root_cause_priority(_report(v)).select("root", "n", "severity", "impact", "actionable", "top", "only_data_missing"), f"""SELECT root, n, severity, impact, actionable, actionable AND row_number() OVER (ORDER BY actionable DESC, impact DESC, n DESC, root) = 1 AS top, NOT bool_or(actionable) OVER () AS only_data_missing
    FROM (SELECT *, floor(percent * severity * 100 + 0.5) / 100 AS impact, root <> 'data-missing' AND severity >= 0.5 AS actionable FROM {_REPORT} r) t""")
query("fix_list", lambda v: q.fix_list(_report(v)), f"SELECT root, priority, target, action FROM {_REPORT} r WHERE root <> 'data-missing'")
_SETS = f"(SELECT doc, string_agg(DISTINCT root, ',' ORDER BY root) AS roots FROM {_FAILS} f GROUP BY doc)"
query("root_sets", lambda v: q.shared_roots(_failures(v)), f"SELECT roots, count(*) AS docs, min(doc) AS first FROM {_SETS} s GROUP BY roots")
_ORDER = "['rotation-estimator', 'typography-estimator', 'coverage-estimator', 'baseline-estimator', 'glyph-lost', 'glyph-extra', 'pixel-noise', 'ocr-noise', 'data-missing']"
_CLASSES = f"(SELECT string_split(roots, ',') AS roots, min(doc) AS class, count(*) AS n, list_sum(list_transform(string_split(roots, ','), lambda r: 1 << (list_position({_ORDER}, r) - 1))) AS mask FROM {_SETS} s GROUP BY roots)"
query("shared_root_pairs", lambda v: q.shared_root_pairs(_failures(v))[0], f"""SELECT a.class AS class_a, b.class AS class_b, array_to_string(list_filter({_ORDER}, lambda r: list_contains(a.roots, r) AND list_contains(b.roots, r)), ',') AS shared,
    CASE WHEN a.class = b.class THEN a.n ELSE a.n + b.n END AS documents, CASE WHEN a.class = b.class THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS pairs FROM {_CLASSES} a JOIN {_CLASSES} b ON a.mask <= b.mask WHERE list_has_any(a.roots, b.roots)""")
query("root_membership", lambda v: q.shared_root_pairs(_failures(v))[1], f"SELECT doc, min(doc) OVER (PARTITION BY roots) AS class, roots FROM {_SETS} s")
query("trend_fit", lambda v: q.trend_fit(v.trend.select((F.col("month") - 23940).alias("x"), F.col("value").alias("y"))), """SELECT round(s, 6) AS slope, round(i, 4) AS intercept, round(r, 6) AS r2, CASE WHEN s > 0 THEN greatest(ceil((99 - i) / s - last), 0)::BIGINT END AS steps
    FROM (SELECT regr_slope(value, month - 23940) AS s, regr_intercept(value, month - 23940) AS i, regr_r2(value, month - 23940) AS r, max(month - 23940) AS last FROM {trend} t) f""")
_META = """SELECT d.doc_id, d.lang AS category, CASE WHEN doc_id % 6 > 0 THEN d.source END AS font, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN '' END AS engine, l.quality IS NOT NULL AS with_metadata, l.quality = 0 AS scanned, l.quality = 1 AS digital,
    CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 300 END AS dpi, CASE WHEN doc_id % 3 > 0 THEN 72 + doc_id % 7 END AS resolution, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 9 - 4) / 4e0 END AS rotation FROM {documents} d LEFT JOIN (SELECT doc_id AS lid, max(quality) AS quality FROM {labels} l GROUP BY doc_id) l ON d.doc_id = l.lid"""
query("corpus_profile", lambda v: q.corpus_profile(v.sql(_META)), f"""SELECT category, count(*) AS n, count(*) FILTER (WHERE with_metadata) AS with_metadata, count(*) FILTER (WHERE scanned) AS scanned, count(*) FILTER (WHERE digital) AS digital,
    floor(avg(coalesce(dpi, resolution)) FILTER (WHERE coalesce(dpi, resolution) > 0) + 0.5)::BIGINT AS mean_dpi, floor(coalesce(avg(abs(rotation)), 0) * 100 + 0.5) / 100 AS mean_rotation FROM ({_META}) m GROUP BY category""")
query("corpus_histograms", lambda v: q.corpus_histograms(v.sql(_META)), f"SELECT 'font' AS kind, font AS name, count(*) AS n FROM ({_META}) m WHERE font <> '' GROUP BY font UNION ALL SELECT 'engine', engine, count(*) FROM ({_META}) m WHERE engine <> '' GROUP BY engine")
_VERDICT = "SELECT doc, rotation <= 1 AS geometry, pixel <= 1 AS pixel, glyphs = expected_glyphs AS matched FROM {glyph_diffs} g"
query("artifact_verdict", lambda v: q.artifact_verdict(v.sql(_VERDICT)).select("doc", "verdict", "actionable"), f"SELECT doc, verdict, verdict = 'real' AS actionable FROM (SELECT doc, CASE WHEN geometry IS NULL OR pixel IS NULL OR NOT matched THEN 'artifact' WHEN geometry AND pixel THEN 'real' ELSE 'unknown' END AS verdict FROM ({_VERDICT}) g) t")
query("failure_stats", lambda v: q.failure_stats(v.replays, "after_delta"), """SELECT count(*) AS n, round(avg(after_delta), 6) AS mean, max(after_delta) AS max, count(*) FILTER (WHERE after_delta < 1) AS under_1, count(*) FILTER (WHERE after_delta >= 1 AND after_delta < 5) AS to_5,
    count(*) FILTER (WHERE after_delta >= 5 AND after_delta < 10) AS to_10, count(*) FILTER (WHERE after_delta >= 10) AS over_10 FROM {replays} r WHERE after_delta IS NOT NULL""")
query("delta_histogram", lambda v: q.delta_histogram(v.replays, "before_delta"), """SELECT bucket::INT AS bucket, low, count(before_delta) AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS bucket, unnest([0e0, 1e0, 2e0, 5e0, 10e0]) AS low, unnest([1e0, 2e0, 5e0, 10e0, 'inf'::DOUBLE]) AS high) b
    LEFT JOIN {replays} r ON before_delta >= low AND before_delta < high GROUP BY bucket, low""")
_JUDGED = "(SELECT *, CASE WHEN failed THEN 'ERROR' WHEN after_delta IS NULL THEN 'UNKNOWN' WHEN after_delta > before_delta THEN 'REGRESSION' WHEN after_delta <= 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM {replays} r)"
query("replay_judge", lambda v: q.replay_judge(v.replays).select("l_orderkey", "row", "status"), f"SELECT l_orderkey, row, status FROM {_JUDGED} j")
query("replay_stats", lambda v: q.replay_stats(q.replay_judge(v.replays), "category"), f"""SELECT category, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE status = '{s}') / count(*)::DOUBLE AS {s.lower()}" for s in ("PASS", "FAIL", "REGRESSION", "UNKNOWN", "ERROR"))},
    count(*) FILTER (WHERE after_delta < before_delta) / count(*)::DOUBLE AS improved, round(avg(after_delta), 6) AS mean, round(quantile_cont(after_delta, 0.5), 6) AS p50, round(quantile_cont(after_delta, 0.95), 6) AS p95, round(quantile_cont(after_delta, 0.99), 6) AS p99 FROM {_JUDGED} j GROUP BY category""")
# Sketches of each month, merged by category; the twin says that the ranks of their values are within the stated error.
_MONTHLY = "SELECT r.*, substr(cast(o_orderdate AS VARCHAR(30)), 1, 7) AS month FROM {replays} r JOIN {orders} o ON l_orderkey = o_orderkey"


def _sketched(v):
    rows = v.sql(_MONTHLY)
    stats = q.sketched_stats(q.replay_sketches(rows, ["category", "month"]), ["category"])
    within = lambda p, at: (F.avg((F.col("after_delta") < F.col(p)).cast("double")) <= at + q.RANK_ERROR) & (F.avg((F.col("after_delta") <= F.col(p)).cast("double")) >= at - q.RANK_ERROR)
    return rows.join(F.broadcast(stats), "category").groupBy("category").agg(F.first("rows").alias("rows"), F.first("n").alias("n"), *(within(p, at).alias(f"{p}_within") for p, at in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


query("replay_sketch_stats", _sketched, "SELECT category, count(*) AS rows, count(after_delta) AS n, true AS p50_within, true AS p95_within, true AS p99_within FROM {replays} r GROUP BY category")
query("replay_regressions", lambda v: q.replay_regressions(q.replay_judge(v.replays), ("l_orderkey", "row")), f"SELECT l_orderkey, row, round(after_delta - before_delta, 6) AS delta FROM {_JUDGED} j WHERE status = 'REGRESSION' ORDER BY delta DESC, l_orderkey, row LIMIT 10")
query("replay_summary", lambda v: q.replay_summary(v.replays), "SELECT CASE WHEN after_delta IS NULL THEN 'UNKNOWN' WHEN after_delta <= 1 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n, round(avg(before_delta), 6) AS before, round(avg(after_delta), 6) AS after FROM {replays} r GROUP BY 1")
query("replay_dashboard", lambda v: q.replay_dashboard(q.replay_judge(v.replays), ("l_orderkey", "row")))
_OBS = "SELECT user_id % 90 AS expected, value AS observed, 10e0 AS tolerance FROM {events} e"
query("benchmark_summary", lambda v: q.benchmark_summary(v.sql(_OBS)), f"SELECT count(*) AS n, count(*) FILTER (WHERE abs(observed - expected) <= tolerance) AS passed, count(*) FILTER (WHERE abs(observed - expected) <= tolerance) / count(*)::DOUBLE AS accuracy, round(avg(abs(observed - expected)), 6) AS error FROM ({_OBS}) o")
_EV = "SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS tag, value FROM {events} e"
query("evidence_index", lambda v: q.evidence_index(v.sql(_EV)), f"SELECT coalesce(tag, 'unknown') AS tag, count(*) AS n, max(seq) AS latest FROM ({_EV}) e GROUP BY 1")
_STORED = "SELECT CASE WHEN event_id % 9 = 0 THEN event_id - 1 ELSE event_id END AS id, event_id AS seq, CASE event_id % 50 WHEN 7 THEN '{{\"k\": ' WHEN 8 THEN NULL ELSE props END AS payload FROM {events} e"
query("evidence_validate", lambda v: q.evidence_validate(v.sql(_STORED.replace("{{", "{")), v.sql("SELECT event_id + 3 AS id FROM {events} e"), count=v.events.count(), next_seq=v.events.count()), f"""WITH s AS ({_STORED.replace("{{", "{")}), g AS (SELECT id, count(*) AS n, max(seq) AS seq, count(*) FILTER (WHERE payload IS NULL OR NOT json_valid(payload)) AS bad FROM s GROUP BY id)
    SELECT sum(n)::BIGINT AS rows, count(*) AS ids, count(*) FILTER (WHERE n > 1) AS duplicates, sum(bad)::BIGINT AS corrupt, (SELECT count(*) FROM g WHERE id NOT IN (SELECT event_id + 3 FROM {{events}} e)) AS unindexed,
    (SELECT count(*) FROM {{events}} e WHERE event_id + 3 NOT IN (SELECT id FROM g)) AS missing, count(*) = (SELECT count(*) FROM {{events}} e) AS index_consistent, max(seq) + 1 = (SELECT count(*) FROM {{events}} e) AS continuous,
    count(*) = (SELECT count(*) FROM {{events}} e) AND max(seq) + 1 = (SELECT count(*) FROM {{events}} e) AND sum(bad) = 0 AND count(*) FILTER (WHERE n > 1) = 0 AS healthy FROM g""")
query("evidence_upsert", lambda v: q.evidence_upsert(v.sql(_EV)), f"SELECT id, seq, tag, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM ({_EV}) e) t WHERE n = 1")

_DAILY = "(SELECT day, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE reason = 'F') AS reason_f, count(*) FILTER (WHERE reason = 'O') AS reason_o FROM {telemetry} t GROUP BY day)"
query("daily_summary", lambda v: q.daily_summary(v.telemetry), f"SELECT * FROM {_DAILY} d")
query("observation_window", lambda v: q.observation_window(q.daily_summary(v.telemetry)), f"SELECT count(*) AS days, sum(n)::BIGINT AS documents, max(day) AS last_day FROM {_DAILY} d")
query("daily_report", lambda v: q.daily_report(q.daily_summary(v.telemetry)), f"SELECT day, '| ' || concat_ws(' | ', day, n, passed, failed) || ' |' AS line FROM {_DAILY} d")
query("export_coverage", lambda v: q.export_coverage(v.export_events), """SELECT *, CASE WHEN core + fallback > 0 THEN core / (core + fallback)::DOUBLE ELSE 0e0 END AS success, CASE WHEN total > 0 THEN (core + fallback) / total::DOUBLE ELSE 0e0 END AS eligibility
    FROM (SELECT count(*) FILTER (WHERE outcome = 'core') AS core, count(*) FILTER (WHERE outcome = 'legacy-fallback') AS fallback, count(*) AS total, count(*) FILTER (WHERE outcome = 'legacy-fallback' AND stage = 'validation') AS validation_failures,
    count(*) FILTER (WHERE outcome = 'legacy-fallback' AND stage = 'eligibility' AND reason = 'missing-original-bounds') AS missing_bounds FROM {export_events} e) t""")
_BACK = "FROM {export_events} e WHERE outcome = 'legacy-fallback'"
query("export_reasons", lambda v: q.export_reasons(v.export_events), f"""SELECT 'reason' AS kind, reason AS name, count(*) AS n {_BACK} AND reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'stage', stage, count(*) {_BACK} GROUP BY stage
    UNION ALL SELECT 'ineligible', reason, count(*) {_BACK} AND stage = 'eligibility' AND reason IS NOT NULL GROUP BY reason""")
query("document_state", lambda v: q.document_state(v.order_lines, "l_orderkey", F.expr("l_returnflag = 'R'")), "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'edited' ELSE 'pristine' END AS state FROM {order_lines} l GROUP BY l_orderkey")
# Failed pages differ by count, mask, patch or box, or by something else; some that passed differ too.
_PAINT = """SELECT l_orderkey, l_returnflag <> 'R' AS ok, row AS legacy, row + CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END AS painter, CASE WHEN l_suppkey % 7 = 0 THEN 0.5e0 ELSE 0e0 END AS mask_diff, CASE WHEN l_suppkey % 9 = 0 THEN 1e0 ELSE 0e0 END AS patch_diff,
    l_tax / 4 AS bbox_diff, cast(l_quantity AS DOUBLE) AS paint_time, l_discount > 0.095 AND l_orderkey % 2 = 0 AS error FROM {order_lines} l"""
query("page_health", lambda v: q.page_health(v.sql(_PAINT), "l_orderkey"), f"""SELECT l_orderkey, passed, failed, max_diff, paint_time, CASE WHEN errors + structural > 0 THEN 'unhealthy' WHEN boxes > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM (SELECT l_orderkey, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, max(bbox_diff) AS max_diff,
    avg(paint_time) AS paint_time, count(*) FILTER (WHERE error) AS errors, count(*) FILTER (WHERE NOT ok AND (legacy <> painter OR mask_diff > 0 OR patch_diff > 0)) AS structural, count(*) FILTER (WHERE NOT ok AND legacy = painter AND mask_diff = 0 AND patch_diff = 0 AND bbox_diff > 0.01) AS boxes FROM ({_PAINT}) p GROUP BY l_orderkey) t""")
_pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
query("monitor_totals", lambda v: q.monitor_totals(v.export_events).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss")).withColumn("reasons", _pairs(F.col("reasons"))), """SELECT outcome, n, reasons, last_reason, last_ts FROM (SELECT outcome, count(*) AS n, arg_max_null(reason, (ts, event_id)) AS last_reason, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM {export_events} e GROUP BY outcome) a
    JOIN (SELECT outcome, string_agg(concat(reason, '=', k), ',' ORDER BY reason) AS reasons FROM (SELECT outcome, reason, count(*) AS k FROM {export_events} e WHERE reason IS NOT NULL GROUP BY outcome, reason) c GROUP BY outcome) b USING (outcome)""")
query("workspace_events", lambda v: q.workspace_events(v.conversations), "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM {conversations} c GROUP BY role")
