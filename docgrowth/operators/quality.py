"""Fidelity diffs, failure and replay corpora, benchmarks and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.numbers import half_up, ratio


def _pairs(original: DataFrame, export: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of both sides at the same place; an absent side is null, and `there` tells."""
    o = original.select(*keys, *(F.col(c).alias(f"o_{c}") for c in original.columns if c not in keys), F.lit(True).alias("in_o"))
    e = export.select(*keys, *(F.col(c).alias(f"e_{c}") for c in export.columns if c not in keys), F.lit(True).alias("in_e"))
    return o.join(e, list(keys), "full")


def fidelity_items(original: DataFrame, export: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Original items with what holds for their partner: text equal without white space, font, coordinates; extras are left out."""
    squeezed = lambda c: F.regexp_replace(c, r"\s", "")
    font = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("unknown"))
    p = _pairs(original, export, ("doc", "page", "seq")).filter("in_o")
    here = F.col("in_e").isNotNull()
    near = (F.abs(F.col("o_x") - F.col("e_x")) <= tolerance) & (F.abs(F.col("o_y") - F.col("e_y")) <= tolerance)
    return p.select("doc", "page", "seq", "o_font", (~here).alias("missing"), (here & (squeezed("o_text") == squeezed("e_text"))).alias("text_ok"), (here & (font("o_font") == font("e_font"))).alias("font_ok"), (here & near).alias("place_ok"))


def _shares() -> list[Column]:
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c.replace("_ok", ""))
    return [F.count("*").alias("items"), F.count_if("missing").alias("missing"), share("text_ok"), share("font_ok"), share("place_ok")]


def fidelity_pages(items: DataFrame, least: float = 0.95) -> DataFrame:
    return items.groupBy("doc", "page").agg(*_shares()).withColumn("passed", 0.5 * F.col("text") + 0.5 * F.col("place") >= least)


def fidelity_documents(items: DataFrame, least: float = 0.95) -> DataFrame:
    out = items.groupBy("doc").agg(*_shares())
    return out.withColumn("passed", (0.5 * F.col("text") + 0.5 * F.col("place") >= least) & (F.col("missing") == 0))


def fidelity_mismatches(items: DataFrame, most: int = 200) -> DataFrame:
    """A row per item and failing dimension, the first `most` of each document in order."""
    bad = F.array_compact(F.array(*(F.when(~F.col(f"{d}_ok"), d) for d in ("text", "font", "place"))))
    rows = items.select("doc", "page", "seq", "o_font", F.posexplode(bad).alias("k", "dimension"))
    n = F.row_number().over(W.partitionBy("doc").orderBy("page", "seq", "k"))
    return rows.withColumn("n", n).filter(F.col("n") <= most).select("doc", "page", "seq", "o_font", "dimension")


def fidelity_benchmark(items: DataFrame, targets: tuple[float, float, float, float] = (0.99, 0.99, 0.99, 0.005)) -> DataFrame:
    """Per document the plain mean of its pages, over documents weighted by their items; gaps to the targets."""
    docs = fidelity_pages(items).groupBy("doc").agg(*(F.avg(c).alias(c) for c in ("text", "font", "place")), F.sum("items").alias("items"), F.sum("missing").alias("missing"))
    w = F.greatest("items", F.lit(1))
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    out = docs.agg(mean("text"), mean("font"), mean("place"), (F.sum("missing") / F.sum(w)).alias("missing_rate"))
    met = (F.col("text") >= targets[0]) & (F.col("font") >= targets[1]) & (F.col("place") >= targets[2]) & (F.col("missing_rate") <= targets[3])
    return out.withColumn("text_gap", targets[0] - F.col("text")).withColumn("met", met)


def top_problems(mismatches: DataFrame, top: int = 20) -> DataFrame:
    label = F.when(F.col("dimension") == "font", F.col("o_font")).otherwise(F.col("dimension"))
    return mismatches.groupBy("dimension", label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dimension", "label").limit(top)


def text_diff_note(pairs: DataFrame) -> DataFrame:
    """First index at which expected and actual differ; -1 if they are equal."""
    e, a = F.col("expected"), F.col("actual")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(e), F.length(a), F.lit(1))), lambda i: ~F.substring(e, i, F.lit(1)).eqNullSafe(F.substring(a, i, F.lit(1))))
    return pairs.withColumn("first", F.coalesce(F.try_element_at(at, F.lit(1)) - 1, F.lit(-1)))


def change_range(pairs: DataFrame) -> DataFrame:
    """Common prefix and suffix, and whether the change inserts, deletes or replaces."""
    b, a = F.col("expected"), F.col("actual")
    n = F.least(F.length(b), F.length(a))
    head = lambda x, y: F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1))), F.lit(1)) - 1, n)
    prefix = head(b, a)
    suffix = F.least(head(F.reverse(b), F.reverse(a)), n - prefix)
    kind = F.when(a.contains(b), "insert").when(b.contains(a) | (F.length(a) == 0), "delete").otherwise("replace")
    return pairs.withColumn("prefix", prefix).withColumn("suffix", suffix).withColumn("kind", kind)


def _words(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))


def observation_diff(original: DataFrame, export: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """(doc, page, kind) of differences: the number of pages (page null); on pages of both the words, their number unless one text goes on where the other ends, the first word, the number of boxes."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    gather = lambda d: d.groupBy(doc, page).agg(text.alias("text"), F.count("*").alias("boxes"))
    p = _pairs(gather(original), gather(export), (doc, page))
    counted = p.groupBy(doc).agg(F.count("in_o").alias("o"), F.count("in_e").alias("e")).filter("o <> e")
    both = p.filter("in_o and in_e").select(doc, page, "o_boxes", "e_boxes", *(F.array_join(_words(f"{s}_text"), " ").alias(s) for s in "oe"))
    o, e = F.col("o"), F.col("e")
    kinds = F.array(
        F.when(o != e, "text-mismatch"), F.when((o != e) & ~o.startswith(e) & ~e.startswith(o), "word-count-mismatch"),
        F.when(F.substring_index(o, " ", 1) != F.substring_index(e, " ", 1), "first-word-mismatch"), F.when(F.col("o_boxes") != F.col("e_boxes"), "bbox-count-mismatch"),
    )
    rows = both.select(doc, page, F.explode(F.array_compact(kinds)).alias("kind"))
    return rows.union(counted.select(doc, F.lit(None).cast(original.schema[page].dataType).alias(page), F.lit("page-count").alias("kind")))


def word_trace(original: DataFrame, export: DataFrame) -> DataFrame:
    """(doc, page, at, expected, actual, expected_loc, actual_loc): words of a page that differ at the same place, and their places within their items.

    Pages that only one side has are left out; beyond a side's last word its word is empty. A page's words are gathered, so that pages and not words are joined.
    """

    def words(d: DataFrame, name: str) -> DataFrame:
        of = lambda i: F.transform(F.coalesce(_words(i["text"]), F.array()), lambda w, k: F.struct(i["seq"].alias("seq"), (k + 1).alias("k"), w.alias("word")))
        return d.groupBy("doc", "page").agg(F.array_sort(F.flatten(F.transform(F.collect_list(F.struct("seq", "text")), of))).alias(name))

    met = words(original, "o").join(words(export, "e"), ["doc", "page"]).select("doc", "page", F.posexplode(F.arrays_zip("o", "e")).alias("at", "w"))
    beyond = F.concat(F.lit("Word"), (F.col("at") + 1).cast("string"))
    word = lambda s: F.coalesce(f"w.{s}.word", F.lit(""))
    loc = lambda s: F.coalesce(F.concat(F.col(f"w.{s}.seq").cast("string"), F.lit(".Word"), F.col(f"w.{s}.k").cast("string")), beyond)
    return met.filter(word("o") != word("e")).select("doc", "page", "at", word("o").alias("expected"), word("e").alias("actual"), loc("o").alias("expected_loc"), loc("e").alias("actual_loc"))


def contract_policy(rows: DataFrame, policies: DataFrame, default: str = "strict") -> DataFrame:
    """Each row's policy by rule."""
    return rows.join(policies, "rule", "left").withColumn("policy", F.coalesce("policy", F.lit(default)))


def geometry_diff(original: DataFrame, export: DataFrame, most: float = 0.01) -> DataFrame:
    """Per document, over records at the same place: box error as a share of the width, mean rotation error where either has one, and gaps in the counts of all records, masks and patches."""
    p = _pairs(original, export, ("doc", "page", "seq"))
    both, d = F.col("in_o") & F.col("in_e"), lambda c: F.abs(F.col(f"o_{c}") - F.col(f"e_{c}"))
    error = (d("x") + d("y") + d("w") + d("h")) / F.greatest("o_w", "e_w", F.lit(1.0))
    turned = both & (F.col("o_rotation").isNotNull() | F.col("e_rotation").isNotNull())
    turn = F.abs(F.coalesce("o_rotation", F.lit(0.0)) - F.coalesce("e_rotation", F.lit(0.0)))
    gap = lambda kind: F.abs(F.count_if(F.col("o_kind") == kind) - F.count_if(F.col("e_kind") == kind))
    out = p.groupBy("doc").agg(
        F.count("in_o").alias("o"), F.count("in_e").alias("e"), F.sum(F.when(both, error).otherwise(0.0)).alias("sum"),
        F.round(F.coalesce(F.avg(F.when(turned, turn)), F.lit(0.0)), 9).alias("rotation"), gap("mask").alias("masks"), gap("patch").alias("patches"),
    )
    out = out.withColumn("error", F.round(F.col("sum") / F.greatest("o", "e"), 9)).withColumn("count_gap", F.abs(F.col("o") - F.col("e")))
    return out.select("doc", "error", "rotation", "count_gap", "masks", "patches", ((F.col("count_gap") == 0) & (F.col("error") < most)).alias("passed"))


def command_diff(original: DataFrame, export: DataFrame, fields: tuple[str, ...] = ("x", "y"), epsilon: float = 1e-6, most: int = 50) -> DataFrame:
    """(doc, page, seq, field, before, after) of numeric fields that differ, the first `most` per document."""
    p = _pairs(original, export, ("doc", "page", "seq")).filter("in_o and in_e")
    rows = p.select("doc", "page", "seq", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("before"), F.col(f"e_{f}").alias("after")) for f in fields))).alias("d")).select("doc", "page", "seq", "d.*")
    rows = rows.filter(F.abs(F.col("before") - F.col("after")) > epsilon)
    return rows.withColumn("n", F.row_number().over(W.partitionBy("doc").orderBy("page", "seq", "field"))).filter(F.col("n") <= most).drop("n")


def dual_run(original: DataFrame, export: DataFrame, most: float = 0.01, most_matrix: float = 1e-4) -> DataFrame:
    """Per document the largest difference of two runs in rotation and in any matrix element (missing ones are 0), and whether they agree."""
    p = _pairs(original, export, ("doc", "page", "seq"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    apart = F.array_max(F.zip_with("o_matrix", "e_matrix", lambda x, y: F.abs(zero(x) - zero(y))))
    none = lambda c: F.coalesce(c, F.array().cast("array<double>"))
    p = p.withColumn("o_matrix", none("o_matrix")).withColumn("e_matrix", none("e_matrix"))
    out = p.groupBy("doc").agg(
        F.max(F.abs(zero(F.col("o_rotation")) - zero(F.col("e_rotation")))).alias("rotation"), F.coalesce(F.max(apart), F.lit(0.0)).alias("matrix"),
        (F.count("in_o") == F.count("in_e")).alias("same_count"),
    )
    agree = F.col("same_count") & (F.col("rotation") <= most) & (F.col("matrix") <= most_matrix)
    return out.withColumn("agree", agree)


def _changed(original: DataFrame, export: DataFrame) -> DataFrame:
    """Original cells with their category: missing, text, moved or same."""
    kind = F.when(F.col("in_e").isNull(), "missing").when(F.col("o_text") != F.col("e_text"), "text").when(F.col("o_x") != F.col("e_x"), "moved").otherwise("same")
    return _pairs(original, export, ("doc", "page", "seq")).filter("in_o").withColumn("category", kind)


def cell_compliance(original: DataFrame, export: DataFrame) -> DataFrame:
    """Cells by category: how many, their share to one decimal, and their bounding box."""
    out = _changed(original, export).groupBy("category").agg(F.count("*").alias("n"), F.min("o_x").alias("left"), F.max("o_x").alias("right"), F.min("o_y").alias("top"), F.max("o_y").alias("bottom"))
    return out.withColumn("share", half_up(F.col("n") / F.sum("n").over(W.partitionBy()) * 100, 1))


def pixel_compliance(original: DataFrame, export: DataFrame, by: str = "doc") -> DataFrame:
    """Per document the changed cells, of these text and others, both shares to one decimal, and their bounding box; compliant if only text changed."""
    c = _changed(original, export)
    changed = F.col("category") != "same"
    text, box = F.col("category") == "text", lambda f, v: f(F.when(changed, F.col(v)))
    out = c.groupBy(by).agg(
        F.count("*").alias("cells"), F.count_if(changed).alias("changed"), F.count_if(text).alias("changed_text"), F.count_if(changed & ~text).alias("changed_other"),
        box(F.min, "o_x").alias("left"), box(F.max, "o_x").alias("right"), box(F.min, "o_y").alias("top"), box(F.max, "o_y").alias("bottom"),
    )
    share = lambda a, b: half_up(ratio(F.col(a), F.col(b)) * 1000) / 10
    return out.withColumns({"other_ratio": share("changed_other", "changed"), "coverage": share("changed", "cells"), "compliant": F.col("changed_other") == 0})


def compliance_violations(original: DataFrame, export: DataFrame, most: int = 10) -> DataFrame:
    """(doc, n, page, seq, category) of the first `most` changes of each document that are not of text."""
    bad = _changed(original, export).filter(F.col("category").isin("missing", "moved"))
    n = F.row_number().over(W.partitionBy("doc").orderBy("page", "seq"))
    return bad.withColumn("n", n).filter(F.col("n") <= most).select("doc", "n", "page", "seq", "category")


def content_fingerprint(rows: DataFrame, by: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """Digest of a group's rows in order; equal digests mean equal content."""
    line = F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    return rows.groupBy(by).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")).alias("digest"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII string, as a number."""
    step = lambda h, x: ((h.bitwiseXOR(F.ascii(x).cast("long"))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(2166136261).cast("long"), step)


def pseudonymise(rows: DataFrame, session: str, unit: str) -> DataFrame:
    """Eight hex digits in place of "session:unit"."""
    return rows.withColumn("pseudonym", F.lower(F.lpad(F.hex(fnv1a(F.concat_ws(":", session, unit))), 8, "0")))


def scene_completeness(expected: DataFrame, actual: DataFrame, by: str, kind: str) -> DataFrame:
    """Share of expected kinds that are there at all, in percent to one decimal; 100 if none is expected."""
    e, a = (d.select(by, kind).distinct() for d in (expected, actual))
    met = e.join(a.withColumn("there", F.lit(True)), [by, kind], "left").groupBy(by).agg(F.count("*").alias("expected"), F.count("there").alias("matched"))
    return met.withColumn("ratio", half_up(F.col("matched") / F.col("expected") * 100, 1))


def document_completeness(rows: DataFrame, by: str, rules: dict[str, Column]) -> DataFrame:
    """Which categories a document has, those it lacks, and their share."""
    out = rows.groupBy(by).agg(*(F.bool_or(c).alias(n) for n, c in rules.items()))
    lacks = F.array_compact(F.array(*(F.when(~F.col(n), n) for n in rules)))
    return out.select(by, F.array_join(lacks, ",").alias("missing"), (1 - F.size(lacks) / len(rules)).alias("ratio"))


def layer_validation(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row per rule that a row breaks."""
    return rows.select("*", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))).alias("issue"))


def dom_benchmark(rows: DataFrame, by: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    out = rows.groupBy(by).agg(F.count("*").alias("objects"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds))
    return out.withColumn("score", sum(((F.col(k) > 0).cast("int") for k in kinds), F.lit(0)) / len(kinds))


# --- failures and replays


def failure_scope(rows: DataFrame, by: str, failed: Column) -> DataFrame:
    out = rows.groupBy(by).agg(F.count_if(failed).alias("errors"), F.count("*").alias("total"))
    r = F.col("errors") / F.greatest("total", F.lit(1))
    scope = F.when(F.col("total") == 0, "no-data").when(F.col("errors") == 0, "none").when(r < 0.05, "single-glyph").when(r < 0.15, "line").when(r < 0.6, "paragraph").otherwise("whole-page")
    return out.withColumn("scope", scope)


def systematic(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Whether errors are alike: spread under half the mean, or a mean of 0; null without errors.

    A spread that is half the mean, as far as its rounding can tell, is judged by sums (4 n times that of squares against 5
    times the squared one), which are exact for whole numbers; the deviation itself depends on the order in which rows are met.
    """
    v = F.col(value).cast("double")
    out = rows.groupBy(by).agg(F.stddev_pop(v).alias("sd"), F.avg(v).alias("mean"), F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("squares"))
    sd, half = F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")), 0.5 * F.abs("mean")  # one value has no spread, be it infinite
    near = (F.abs(sd - half) <= 1e-9 * half) & (half < float("inf"))
    alike = F.when(near, 4 * F.col("n") * F.col("squares") < 5 * F.col("sum") * F.col("sum")).otherwise(sd < half)
    return out.select(by, ((F.col("mean") == 0) | alike).alias("systematic"))


# Thresholds of the failure dimensions and the root cause of each.
LIMITS = {"rotation": (1.0, "rotation-estimator"), "bbox": (0.01, "typography-estimator"), "coverage": (0.01, "coverage-estimator"), "baseline": (2.0, "baseline-estimator"), "pixel": (1.0, "pixel-noise")}
# Severity, priority, target and action of each root cause.
ROOTS = {
    "rotation-estimator": (1.0, "P0", "RotationEstimator", "重新校准旋转估计（基线/方向置信度）"),
    "typography-estimator": (0.9, "P0", "TypographyEstimator", "重新估计字体/字号/字形宽度（影响 bbox）"),
    "coverage-estimator": (0.9, "P0", "CoverageEstimator", "调整 mask/padding/coverage 边界"),
    "baseline-estimator": (0.8, "P1", "BaselineEstimator", "重新估计文本基线（y 偏移）"),
    "glyph-lost": (1.0, "P0", "OCR/Layout", "修复 glyph 丢失（OCR 漏检 / 布局裁剪）"),
    "glyph-extra": (0.7, "P1", "Layout", "清理多余 glyph（覆盖 / 重复）"),
    "pixel-noise": (0.6, "P1", "PixelDiff/NoiseFilter", "检查噪点过滤 / mask / 字体加载导致的像素差异"),
    "ocr-noise": (0.4, "P2", "OCR", "降低 OCR 噪点（扫描件预处理）"),
    "data-missing": (0.1, "P2", "Dataset", "采集真实数据后重新 Benchmark（当前数据缺失）"),
}


def failure_dimensions(diffs: DataFrame) -> DataFrame:
    """(doc, category, metric, root) of every failed dimension; a dimension without data fails as data-missing."""
    fail = lambda metric, root: F.struct(F.lit(metric).alias("metric"), F.lit(root).alias("root"))
    fails = [F.when(F.col(d).isNull(), fail(d, "data-missing")).when(F.col(d) > x, fail(d, root)) for d, (x, root) in LIMITS.items()]
    glyphs, expected = F.col("glyphs"), F.col("expected_glyphs")
    fails.append(F.when(glyphs.isNull() | expected.isNull(), fail("glyphs", "data-missing")).when(glyphs < expected, fail("glyphs", "glyph-lost")).when(glyphs > expected, fail("glyphs", "glyph-extra")))
    return diffs.select("doc", "category", F.explode(F.array_compact(F.array(*fails))).alias("f")).select("doc", "category", "f.metric", "f.root")


def actionable_documents(failures: DataFrame) -> DataFrame:
    """(doc, failures, actionable): whether any failure is not for want of data."""
    return failures.groupBy("doc").agg(F.count("*").alias("failures"), F.bool_or(F.col("root") != "data-missing").alias("actionable"))


def failed_by_metric(failures: DataFrame) -> DataFrame:
    """Failures per metric, counted per row."""
    return failures.groupBy("metric").agg(F.count("*").alias("n"))


def _root(at: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for r, v in ROOTS.items() for x in (r, v[at]))), F.col("root"))


def root_cause_report(failures: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents per root cause (each once), their percent of all documents, and the fix: (root, n, percent, target, action)."""
    n = documents.agg(F.count("*").alias("all"))
    found = failures.select("doc", "root").distinct().groupBy("root").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n))
    fix = lambda at: F.when(F.col("root") != "data-missing", _root(at)).otherwise("")
    return found.select("root", "n", (F.col("n") / F.col("all") * 100).alias("percent"), fix(2).alias("target"), fix(3).alias("action"))


def root_cause_priority(report: DataFrame) -> DataFrame:
    """Root causes by impact, percent times severity; `top` marks the first actionable one, `only_data_missing` holds if there is none. A row per root cause: a short table."""
    out = report.withColumn("severity", _root(0)).withColumn("impact", half_up(F.col("percent") * F.col("severity"), 2))
    out = out.withColumn("actionable", (F.col("root") != "data-missing") & (F.col("severity") >= 0.5))
    first = F.row_number().over(W.orderBy(F.desc("actionable"), F.desc("impact"), F.desc("n"), "root"))
    out = out.withColumn("top", F.col("actionable") & (first == 1)).withColumn("only_data_missing", ~F.bool_or("actionable").over(W.partitionBy()))
    return out.orderBy(F.desc("impact"), F.desc("n"), "root")


def fix_list(report: DataFrame) -> DataFrame:
    """(root, priority, target, action), most urgent first; want of data has no fix."""
    return report.filter(F.col("root") != "data-missing").select("root", _root(1).alias("priority"), _root(2).alias("target"), _root(3).alias("action")).orderBy("priority", "root")


def root_sets(failures: DataFrame, roots: tuple[str, ...] = tuple(ROOTS)) -> DataFrame:
    """(doc, mask, roots): each document's root causes as bits, in the order of `roots` (at most 63), and as text."""
    bit = F.create_map(*(F.lit(x) for n, r in enumerate(roots) for x in (r, 1 << n)))
    known = failures.withColumn("_bit", bit[F.col("root")].cast("long")).filter("_bit is not null")
    return known.groupBy("doc").agg(F.bit_or("_bit").alias("mask"), F.array_join(F.array_sort(F.collect_set("root")), ",").alias("roots"))


def shared_roots(failures: DataFrame) -> DataFrame:
    """Documents by their set of root causes: members of one set share all."""
    return root_sets(failures).groupBy("roots").agg(F.count("*").alias("docs"), F.min("doc").alias("first"))


def shared_root_pairs(failures: DataFrame, roots: tuple[str, ...] = tuple(ROOTS)) -> tuple[DataFrame, DataFrame]:
    """Documents that share any root cause, without listing their pairs.

    (class_a, class_b, shared, documents, pairs): classes of documents with equal sets, each named by its smallest document,
    that share the causes in `shared`, how many documents they have, and how many pairs of documents that makes. And the
    members (doc, class, roots). Sets meet by a bit that both have, so only they are joined (at most 511 of nine causes).
    """
    members = root_sets(failures, roots)
    classes = members.groupBy("mask", "roots").agg(F.min("doc").alias("class"), F.count("*").alias("n"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(roots) - 1)), lambda k: F.getbit("mask", k) == 1)
    side = lambda x: classes.select(F.explode(bits).alias("bit"), F.struct("class", "mask", "n").alias(x))
    met = side("a").join(side("b"), "bit").filter(F.col("a.mask") <= F.col("b.mask")).select("a", "b").distinct()
    same = F.col("a.mask") == F.col("b.mask")
    named = F.filter(F.array(*map(F.lit, roots)), lambda r, k: F.getbit(F.col("a.mask").bitwiseAND(F.col("b.mask")), k) == 1)
    pairs = F.when(same, F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
    out = met.select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b"), F.array_join(named, ",").alias("shared"), F.when(same, F.col("a.n")).otherwise(F.col("a.n") + F.col("b.n")).alias("documents"), pairs.alias("pairs"))
    return out, members.join(classes.select("mask", "class"), "mask").select("doc", "class", "roots")


def trend_fit(points: DataFrame, target: float = 99.0) -> DataFrame:
    """Least squares over (index, value): slope, intercept, fit, and steps from the last index to the target."""
    out = points.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.regr_r2("y", "x").alias("r"), F.var_pop("y").alias("v"), F.max("x").alias("last"))
    slope, base = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("s", F.lit(0.0))), F.coalesce("i", F.lit(0.0))
    out = out.withColumn("slope", slope).withColumn("intercept", base).withColumn("r2", F.when((F.col("n") < 2) | (F.col("v") == 0), 0.0).otherwise(F.coalesce("r", F.lit(0.0))))
    steps = F.when(F.col("slope") > 0, F.greatest(F.ceil((target - F.col("intercept")) / F.col("slope") - F.col("last")), F.lit(0)))
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), steps.alias("steps"))


def corpus_profile(docs: DataFrame, flags: tuple[str, ...] = ("scanned", "digital")) -> DataFrame:
    """Per category: documents, those with metadata, how many have each flag, mean resolution (dpi, else resolution; positive ones, rounded) and mean absolute rotation."""
    dpi = F.coalesce("dpi", "resolution")
    return docs.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if("with_metadata").alias("with_metadata"), *(F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in flags),
        half_up(F.avg(F.when(dpi > 0, dpi))).cast("long").alias("mean_dpi"), half_up(F.coalesce(F.avg(F.abs("rotation")), F.lit(0.0)), 2).alias("mean_rotation"),
    )


def corpus_histograms(docs: DataFrame, columns: tuple[str, ...] = ("font", "engine")) -> DataFrame:
    """(kind, name, n): documents per font and engine, where they have one."""
    each = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in columns))
    return docs.select(F.explode(each).alias("v")).filter("v.name <> ''").groupBy("v.kind", "v.name").agg(F.count("*").alias("n"))


def artifact_verdict(rows: DataFrame) -> DataFrame:
    v = F.when(F.col("geometry").isNull() | F.col("pixel").isNull() | ~F.col("matched"), "artifact").when(F.col("geometry") & F.col("pixel"), "real").otherwise("unknown")
    return rows.withColumn("verdict", v).withColumn("actionable", v == "real")


def failure_stats(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return rows.filter(v.isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("max"), F.count_if(v < 1).alias("under_1"), F.count_if((v >= 1) & (v < 5)).alias("to_5"), F.count_if((v >= 5) & (v < 10)).alias("to_10"), F.count_if(v >= 10).alias("over_10"))


BUCKETS = (0.0, 1.0, 2.0, 5.0, 10.0)


def delta_histogram(rows: DataFrame, value: str, edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Counts between edges, with empty buckets; negatives are left out. A short table of buckets, joined to counts."""
    v = F.col(value)
    at = sum(((v >= e).cast("int") for e in edges), F.lit(0)) - 1
    n = rows.filter(v >= 0).groupBy(at.alias("bucket")).count()
    every = rows.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bucket"), F.element_at(F.array(*map(F.lit, edges)), F.col("id").cast("int") + 1).alias("low"))
    return F.broadcast(every).join(n, "bucket", "left").select("bucket", "low", F.coalesce("count", F.lit(0)).alias("n"))


def replay_judge(r: DataFrame, tolerance: float = 1.0) -> DataFrame:
    b, a = F.col("before_delta"), F.col("after_delta")
    return r.withColumn("status", F.when(F.col("failed"), "ERROR").when(a.isNull(), "UNKNOWN").when(a > b, "REGRESSION").when(a <= tolerance, "PASS").otherwise("FAIL"))


def replay_stats(judged: DataFrame, by: str | None = None, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Rates per status over all rows, improvement, mean, and p50, p95, p99 of what came after.

    Exact percentiles are interpolated and gather a group's distinct values in one task; with `exact` off
    they are approximate, by sketches that merge, and values that occur. Of no rows all rates are 0.
    """
    share = lambda n: F.coalesce(n / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    rate = lambda s: share(F.count_if(F.col("status") == s)).alias(s.lower())
    of = lambda x: F.percentile("after_delta", F.lit(x)) if exact else F.percentile_approx("after_delta", x, accuracy)
    q = lambda x: F.round(of(x), 6).alias(f"p{int(x * 100)}")
    better = share(F.count_if(F.col("after_delta") < F.col("before_delta"))).alias("improved")
    rows = judged.groupBy(*([by] if by else []))
    return rows.agg(F.count("*").alias("n"), *map(rate, ("PASS", "FAIL", "REGRESSION", "UNKNOWN", "ERROR")), better, F.round(F.avg("after_delta"), 6).alias("mean"), q(0.5), q(0.95), q(0.99))


#: Of a KLL sketch of this size: its ranks are off by at most 0.4 % of the rows (with 99 % of confidence), however many are merged.
SKETCH_K, RANK_ERROR = 800, 0.004


def replay_sketches(judged: DataFrame, by: list[str], value: str = "after_delta", k: int = SKETCH_K) -> DataFrame:
    """(by, rows, sketch): a mergeable sketch of each group's values, some kilobytes however many rows it has; groups without values have none."""
    return judged.groupBy(*by).agg(F.count("*").alias("rows"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def sketched_stats(sketches: DataFrame, by: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = SKETCH_K) -> DataFrame:
    """(by, rows, n, p50...): quantiles of coarser groups from sketches that are kept (of days, say), without their rows.

    Values that occur, whose rank is off by at most RANK_ERROR of the rows; exact in groups of no more than k values. No task
    sees all values: sketches are merged before and after the shuffle.
    """
    merged = sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch", k).alias("_s"))
    n = F.coalesce(F.kll_sketch_get_n_double("_s"), F.lit(0))
    quantile = lambda q: F.when(n > 0, F.kll_sketch_get_quantile_double("_s", F.lit(q))).alias(f"p{q * 100:g}")
    return merged.select(*by, "rows", n.alias("n"), *map(quantile, at))


def replay_regressions(judged: DataFrame, keys: tuple[str, ...], top: int = 10) -> DataFrame:
    d = judged.filter(F.col("status") == "REGRESSION").withColumn("delta", F.round(F.col("after_delta") - F.col("before_delta"), 6))
    return d.orderBy(F.desc("delta"), *keys).limit(top).select(*keys, "delta")


def replay_summary(r: DataFrame) -> DataFrame:
    a = F.col("after_delta")
    s = F.when(a.isNull(), "UNKNOWN").when(a <= 1, "PASS").otherwise("FAIL")
    return r.groupBy(s.alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("before_delta"), 6).alias("before"), F.round(F.avg(a), 6).alias("after"))


def replay_dashboard(judged: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Statistics, histogram and worst regressions in one nested row."""
    row = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    return row(replay_stats(judged), "stats").crossJoin(row(delta_histogram(judged, "after_delta"), "histogram")).crossJoin(row(replay_regressions(judged, keys), "regressions"))


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """Rows within their tolerance, accuracy over all, and mean error over observed ones."""
    e = F.abs(F.col("observed") - F.col("expected"))
    return rows.agg(F.count("*").alias("n"), F.count_if(e <= F.col("tolerance")).alias("passed"), (F.count_if(e <= F.col("tolerance")) / F.count("*")).alias("accuracy"), F.round(F.avg(e), 6).alias("error"))


def evidence_index(rows: DataFrame, tag: str = "tag") -> DataFrame:
    return rows.groupBy(F.coalesce(tag, F.lit("unknown")).alias("tag")).agg(F.count("*").alias("n"), F.max("seq").alias("latest"))


def evidence_validate(rows: DataFrame, index: DataFrame, count: int, next_seq: int, key: str = "id", payload: str = "payload", schema: str = "k long") -> DataFrame:
    """One row on stored evidence against its index (ids, their number, the next sequence number).

    rows, ids, duplicates (ids stored more than once), corrupt (payloads that are no JSON of the schema), unindexed and
    missing ids, whether the index's count is right and its next number follows the last, and whether all is well.
    """
    parsed = F.from_json(payload, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    marked = rows.select(key, "seq", (parsed["_corrupt"].isNotNull() | F.col(payload).isNull()).alias("corrupt"))
    each = marked.groupBy(key).agg(F.count("*").alias("n"), F.max("seq").alias("seq"), F.count_if("corrupt").alias("corrupt"))
    one = each.agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("duplicates"), F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"), F.sum("corrupt").alias("corrupt"))
    lost = each.join(index.select(key), key, "left_anti").agg(F.count("*").alias("unindexed"))
    gone = index.select(key).distinct().join(rows.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    out = one.crossJoin(lost).crossJoin(gone).withColumn("index_consistent", F.col("ids") == count).withColumn("continuous", F.col("last_seq") + 1 == next_seq)
    return out.withColumn("healthy", F.col("index_consistent") & F.col("continuous") & (F.col("corrupt") == 0) & (F.col("duplicates") == 0)).drop("last_seq")


def evidence_upsert(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row of each id."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq)))).filter("_n = 1").drop("_n")


# --- telemetry


def daily_summary(t: DataFrame) -> DataFrame:
    """Per day rows, passes, fails, and fails per reason."""
    return t.groupBy("day").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("reason") == "F").alias("reason_f"), F.count_if(F.col("reason") == "O").alias("reason_o"))


def observation_window(daily: DataFrame) -> DataFrame:
    return daily.agg(F.count("*").alias("days"), F.sum("n").alias("documents"), F.max("day").alias("last_day"))


def daily_report(daily: DataFrame) -> DataFrame:
    """Markdown table rows, one a day."""
    return daily.select("day", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("day").cast("string"), F.col("n").cast("string"), F.col("passed").cast("string"), F.col("failed").cast("string")), F.lit(" |")).alias("line"))


def export_coverage(e: DataFrame) -> DataFrame:
    """Totals per outcome, success and eligibility; of the fallbacks those in validation, and those for want of bounds."""
    core, back = F.count_if(F.col("outcome") == "core"), F.col("outcome") == "legacy-fallback"
    unbound = back & (F.col("stage") == "eligibility") & (F.col("reason") == "missing-original-bounds")
    out = e.agg(
        core.alias("core"), F.count_if(back).alias("fallback"), F.count("*").alias("total"), F.count_if(back & (F.col("stage") == "validation")).alias("validation_failures"), F.count_if(unbound).alias("missing_bounds")
    )
    tried = F.col("core") + F.col("fallback")
    return out.withColumn("success", ratio(F.col("core"), tried)).withColumn("eligibility", ratio(tried, F.col("total")))


def export_reasons(e: DataFrame) -> DataFrame:
    """(kind, name, n): fallbacks by reason, by stage, and those found ineligible by reason, in one pass."""
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    each = F.array(pair("reason", "reason"), pair("stage", "stage"), F.when(F.col("stage") == "eligibility", pair("ineligible", "reason")))
    return e.filter(F.col("outcome") == "legacy-fallback").select(F.explode(F.array_compact(each)).alias("v")).filter("v.name is not null").groupBy("v.kind", "v.name").agg(F.count("*").alias("n"))


def document_state(rows: DataFrame, by: str, edited: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.when(F.count("*") == 0, "empty").when(F.bool_or(edited), "edited").otherwise("pristine").alias("state"))


def page_health(rows: DataFrame, by: str, most: float = 0.01) -> DataFrame:
    """Pages that passed and failed, the largest box difference, the mean paint time, and the state of the renderer.

    A failed page whose counts, masks or patches differ, or any error, is unhealthy; one whose boxes alone differ by more
    than `most` makes it degraded. Needs ok, legacy, painter (counts), mask_diff, patch_diff, bbox_diff, paint_time and error.
    """
    same = (F.col("legacy") == F.col("painter")) & (F.col("mask_diff") == 0) & (F.col("patch_diff") == 0)
    broken = F.bool_or(~F.col("ok") & ~((F.col("legacy") == F.col("painter")) & (F.col("mask_diff") <= 0) & (F.col("patch_diff") <= 0)))
    return rows.groupBy(by).agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.max("bbox_diff").alias("max_diff"), F.avg("paint_time").alias("paint_time"),
        F.when(F.bool_or("error") | broken, "unhealthy").when(F.bool_or(~F.col("ok") & same & (F.col("bbox_diff") > most)), "degraded").otherwise("healthy").alias("health"),
    )


def monitor_totals(e: DataFrame) -> DataFrame:
    """Per outcome: rows, how many of each reason (a map), the last reason and its time; ties by event id."""
    last = F.struct("ts", "event_id", "reason")
    each = e.groupBy("outcome", "reason").agg(F.count("*").alias("n"), F.max(last).alias("last"))
    named = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return each.groupBy("outcome").agg(F.sum("n").alias("n"), named.alias("reasons"), F.max("last").alias("l")).select("outcome", "n", "reasons", F.col("l.reason").alias("last_reason"), F.col("l.ts").alias("last_ts"))


def workspace_events(e: DataFrame) -> DataFrame:
    return e.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
