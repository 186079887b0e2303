"""Edges of the library's operators: nulls, ties, thresholds, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docgrowth.operators import catalog as c
from docgrowth.operators import documents as d
from docgrowth.operators import growth as g
from docgrowth.operators import layout as h
from docgrowth.operators import lines as ln
from docgrowth.operators import quality as q
from docgrowth.operators import similar as s


def made(spark, rows, form):
    return spark.createDataFrame(rows, form)


def test_products_and_tiers_beyond_a_thousand_stay(spark):
    prices = spark.range(3000).select(F.col("id").cast("string").alias("product"), (F.col("id") * 2).alias("cents"))
    paid = prices.select("product", F.lit("COMPLETED").alias("status"))
    got = g.payment_rollup(paid, prices)
    assert got.count() == 3000 and got.agg(F.sum("cents")).first()[0] == 3000 * 2999
    plans = prices.select(F.col("product").alias("tier"), F.lit(10.0).alias("max_size"), F.lit(3).alias("max_exports"), F.lit(False).alias("ocr"))
    rows = made(spark, [("2999", 10.0, 2, False), ("2999", 10.1, 2, False), ("2999", 1.0, 3, False), ("2999", 1.0, 0, True), ("none", 1.0, 0, False)], "tier string, size double, exports int, wants_ocr boolean")
    assert sorted((r["allowed"] is None, bool(r["allowed"])) for r in g.plan_limits_check(rows, plans, features=("ocr",)).collect()) == [(False, False)] * 3 + [(False, True), (True, False)]
    policies = prices.select(F.col("product").alias("rule"), F.lit("warn").alias("policy"))
    assert {r["policy"] for r in q.contract_policy(made(spark, [("2500",), ("x",), (None,)], "rule string"), policies).collect()} == {"warn", "strict"}


def test_styles_beyond_ten_thousand_are_numbered_in_order(spark):
    rows = spark.range(20_001).select((20_000 - F.col("id")).alias("seq"), F.when(F.col("id") > 0, F.col("id") % 15_000).alias("a"), F.lit(None).cast("string").alias("b"))
    styles, joined = h.style_dictionary(rows, ("a", "b"), "seq")
    numbers = [r["style"] for r in styles.orderBy("first").collect()]
    assert numbers == [*range(len(numbers))] and joined.count() == 20_001 and joined.filter("style is null").isEmpty()


def test_signals_at_their_thresholds(spark):
    rows = [(1, "x" * 2000, 5), (2, "x" * 2001, 4), (3, "INVOICE|", 1), (4, None, 1), (5, "", 9), (6, "ab" * 100, 1), (7, "12%", 1), (8, "a 5% share", 1), (9, "Amount due; confidential", 6)]
    got = {r["id"]: (r["score"], [*(r["signals"] or [])], r["flag"]) for r in d.document_signals(made(spark, rows, "id int, text string, pages int"), images=F.lit(True)).collect()}
    assert got[1] == (2, ["multi_page"], "NO") and got[2] == (2, ["rich_text"], "NO") and got[4] == (0, [], "NO") and got[6] == (0, [], "NO")
    assert got[3] == (7, ["table_like_structure", "financial_document", "likely_scanned"], "YES") and got[5] == (4, ["multi_page", "likely_scanned"], "UNCERTAIN")
    assert got[7][1] == ["table_like_structure", "likely_scanned"] and got[8][1] == ["likely_scanned"] and got[9][:2] == (10, ["multi_page", "financial_document", "contract_document", "likely_scanned"])
    hints = {r["id"]: [x["action"] for x in r["hints"]] for r in d.workspace_hints(made(spark, [(1, "x" * 300, 6), (2, "party|usd", 9), (3, "x" * 300, 5)], "id int, text string, pages int")).collect()}
    assert hints == {1: ["compress"], 2: ["extract_tables", "extract_tables"], 3: []}


def test_domains_and_ties(spark):
    texts = made(spark, [(1, "nothing"), (2, "invoice total"), (3, "balance deposit invoice total"), (4, "report summary"), (5, None), (6, "dear sincerely")], "id int, text string")
    assert [r["domain"] for r in d.document_domain(texts).orderBy("id").collect()] == ["unknown", "invoice", "invoice", "report", "unknown", "unknown"]
    assert [r["domain"] for r in d.document_domain5(texts).orderBy("id").collect()] == ["resume", "invoice", "invoice", "report", "resume", "letter"]


def test_entities_queries_and_replacement(spark):
    docs = made(spark, [(1, "Patient: ANA LIMA, 01/02/2024 and 2024-3-4; Dr JO"), (2, None), (3, "MARIA SOUZA, MARIA SOUZA CID A10.1 RG: 12-3 12345-678 signature"), (4, "")], "doc_id int, head string")
    found = d.entities(docs)
    first = lambda **how: {r["doc_id"]: r["value"] for r in d.semantic_query(found, first=True, **how).collect()}
    assert first(kind="dateField") == {1: "01/02/2024"} and first(role="PATIENT") == {1: "ANA LIMA"} and first(label_words=("cid", "none")) == {3: "A10.1"}
    assert first(kind="nameField", role="unknown") == {3: "MARIA SOUZA"} and first(value="^12") == {3: "12-3"} and first(kind="tableField") == {}
    got = {r["doc_id"]: (r["replaced"], r["head"]) for r in d.entity_replace(docs, d.semantic_query(found, kind="dateField"), "TODAY").collect()}
    assert got[1] == (True, "Patient: ANA LIMA, TODAY and 2024-3-4; Dr JO") and got[2] == (None, None) or got[2][1] is None
    again = d.entities(d.entity_replace(docs, d.semantic_query(found, kind="dateField"), "2025-01-01"))
    assert [r["value"] for r in d.semantic_query(again, kind="dateField").filter("doc_id = 1").orderBy("place").collect()] == ["2025-01-01", "2024-3-4"]


@pytest.mark.parametrize(
    ("expected", "actual", "target", "want"),
    [
        ("a b", "a b", "x", (1.0, True, False, False, True)), ("a b", "a b b", "x", (1.0, True, True, False, False)), ("new b", "old b", "old", (0.4, False, False, True, False)), ("", "", "x", (1.0, True, False, False, True)),
        ("a b", "A B", "b", (1 / 3, True, False, False, False)),
    ],
)
def test_replacements(spark, expected, actual, target, want):
    r = d.replace_check(made(spark, [(expected, actual)], "expected string, actual string"), target).first()
    assert (pytest.approx(r["accuracy"]), r["gone"], r["doubled"], r["leaked"], r["met"]) == want


def test_catalogue_edges(spark):
    k = made(spark, [(1, "edit pdf", None, 0, None), (2, "edit pdf", "", 5, 29), (3, "x", "c", None, 50)], "seq int, keyword string, category string, volume int, difficulty int")
    assert c.expand_keywords(k, 10).count() == 10 and c.expand_keywords(k, None).count() == 2 * 384 and c.expand_keywords(k.limit(0)).count() == 0
    assert [(r["category"], r["volume"], r["difficulty"]) for r in c.page_factory(k).orderBy("seq").collect()] == [("general", 1000, 30), ("general", 5, 29), ("c", 1000, 50)]
    assert [r["priority"] for r in c.sitemap(k, "2024-01-01").orderBy("seq").collect()] == [0.6, 1.0, 0.6]
    phrases = [r["phrase"] for r in c.keyword_discovery(k.filter("seq = 3"), 3).orderBy("place").collect()]
    assert phrases == ["x", "x free", "x online"] and c.keyword_search(k, "EDIT", first=1).first()["total"] == 2


def test_ranges(spark):
    paragraphs = made(spark, [(n, 20) for n in range(1, 9)] + [(9, -1), (10, None)], "p int, length int")
    ok = [(0, 1, 0, 5), (1, 2, 6, 20)]
    spans = [(p, *s) for p in (1, 8) for s in ok] + [(2, 0, 1, 0, 5), (2, 1, 1, 6, 9), (3, 0, 1, -1, 5), (4, 0, 1, 5, 4), (5, 0, 1, 0, 21), (6, 0, 1, 0, 8), (6, 1, 2, 7, 9)]
    spans = made(spark, spans, "p int, n int, id int, start int, end int")
    parts = made(spark, [(1, 0, 5, 6), (8, 0, 5, 7)], "p int, n int, start int, end int")
    got = {r["p"]: r["reason"] for r in h.range_integrity(paragraphs, spans, parts, "p").collect()}
    assert got == {
        2: "duplicate-segment-id", 3: "negative-offset", 4: "start-gt-end", 5: "out-of-paragraph", 6: "overlap", 7: "empty-segments", 8: "separator-overlap", 9: "paragraph-length-mismatch", 10: "paragraph-length-mismatch",
    }


def test_root_causes_without_data(spark):
    form = "doc int, category string, rotation double, bbox double, coverage double, baseline double, pixel double, glyphs int, expected_glyphs int"
    diffs = made(spark, [(1, "a", None, None, None, None, None, None, None), (2, "a", 1.0, 0.01, 0.01, 2.0, 1.0, 5, 5)], form)
    failures = q.failure_dimensions(diffs)
    assert failures.count() == 6 and {r["actionable"] for r in q.actionable_documents(failures).collect()} == {False}
    top = q.root_cause_priority(q.root_cause_report(failures, diffs)).collect()
    assert [(r["root"], r["percent"], r["impact"], r["top"], r["only_data_missing"], r["action"]) for r in top] == [("data-missing", 50.0, 5.0, False, True, "")] and q.fix_list(q.root_cause_report(failures, diffs)).count() == 0
    more = made(spark, [(3, "b", 1.1, 0.02, 0.02, 2.1, 1.1, 5, 6)], form)
    assert [r["root"] for r in q.failure_dimensions(more).collect()] == ["rotation-estimator", "typography-estimator", "coverage-estimator", "baseline-estimator", "pixel-noise", "glyph-lost"]
    assert q.fix_list(q.root_cause_report(q.failure_dimensions(more), more)).first()["priority"] == "P0"


def test_fonts(spark):
    names = made(spark, [("ABCDEF+Arial-Bold",), ("abcdef+Times",), ("HeavyBold",), ("Foo_Oblique",), ("SimSong",), (None,)], "name string")
    got = [(r["weight"], r["italic"], r["family"]) for r in h.font_name_parse(names).collect()]
    assert got[0] == (700, False, "Arial, sans-serif") and got[1][2].startswith("'Times New Roman'") and got[2][0] == 700 and got[3][:2] == (400, True) and got[4][2] == "'SimSun', 'Songti SC', serif"


ITEM = "page int, x double, y double, text string"


def test_a_late_group_joins_the_line_it_is_level_with(spark):
    # values less than 3 apart are one band, in which x decides: 18 is 8 off the first y and starts a line, from which 12 is not far enough to start another
    rows = [(1, 0.0, 10.0, "a"), (1, 5.0, 18.0, "b"), (1, 10.0, 12.0, "c"), (1, 60.0, 14.0, "d"), (1, 70.0, 16.0, "e"), (2, 0.0, 0.0, "p"), (2, 0.0, 7.9, "q"), (2, 0.0, 8.0, "r"), (2, 1.0, 40.0, "s")]
    got = [(r["page"], r["line"], r["y"], r["text"], r["left"], r["n"]) for r in h.line_groups(made(spark, rows, ITEM)).orderBy("page", "line").collect()]
    assert got == [(1, 0, 10.0, "a", 0.0, 1), (1, 1, 18.0, "bcde", 5.0, 4), (2, 0, 0.0, "pq", 0.0, 2), (2, 1, 8.0, "r", 0.0, 1), (2, 2, 40.0, "s", 1.0, 1)]
    # here 10 starts a third group, level with the first line
    late = [(1, 0.0, 10.0, "a"), (1, 5.0, 18.0, "b"), (1, 10.0, 10.0, "c"), (1, 11.0, 12.5, "m"), (1, 12.0, 15.2, "n"), (1, 90.0, 10.0, "z")]
    assert [(r["y"], r["text"]) for r in h.line_groups(made(spark, late, ITEM)).orderBy("line").collect()] == [(10.0, "acmnz"), (18.0, "b")]
    assert h.line_groups(made(spark, [], ITEM)).count() == 0


def test_centres_at_their_thresholds(spark):
    form = "page int, x double, y double, h double, text string"
    tall = made(spark, [(1, 1.0, 0.0, 20.0, "a"), (1, 14.0, 12.0, 20.0, "b"), (1, 30.0, 27.0, 20.0, "c"), (2, 2.0, 0.0, 1.0, "d"), (2, 2.0, 9.0, 1.0, "e")], form)
    assert {r["page"]: r["rows"] for r in h.row_centres(tall).collect()} == {1: [6.0, 27.0], 2: [0.0, 9.0]}  # 0.6 of 20 is 12, that of 1 less than 8
    assert {r["page"]: r["columns"] for r in h.column_centres(tall).collect()} == {1: [1.0, 30.0], 2: [2.0]}  # off the grid, over 15 apart


def test_cells_of_rows(spark):
    def row(n, *at, w=20.0):
        return [(1, n, float(x), w, chr(97 + k)) for k, x in enumerate(at)]

    rows = row(1, 0, 50) + row(2, 0, 49) + row(3, 0) + row(4, 0, 26, 52, 78, 104) + row(5, 0, 25.9, 51.8, 77.7, 103.6) + row(6, 0, 60, 120) + row(7, 0, 80, 160, 240.9, 321) + row(8, 0, 80, 160, 243, 321)
    got = {r["row"]: (r["how"], r["cells"]) for r in ln.table_row_cells(made(spark, rows, "page int, row int, x double, w double, text string"), 10.0).collect()}
    assert got == {1: ("gap", ["a", "b"]), 4: ("even", [*"abcde"]), 7: ("even", [*"abcde"])}  # 5: blanks of 5.9 are too narrow; 6: two wide blanks; 8: over 2 % off


def test_styles_fall_through_to_the_default(spark):
    box = "page int, block int, x double, y double, w double, h double, font double, family string"
    blocks = made(spark, [(p, 1, 0.0, 0.0, 10.0, 10.0, 12.0, "own") for p in range(1, 5)], box)
    native = made(spark, [(1, 7, 5.0, 5.0, 9.0, 9.0, 1.0, "N"), (1, 8, 5.0, 5.0, 9.0, 9.0, 1.0, "M"), (2, 7, 10.0, 0.0, 9.0, 9.0, 1.0, "touching")], box)
    near = made(spark, [(1, 9, 0.0, 0.0, 10.0, 10.0, 1.0, "X"), (2, 9, 50.0, 0.0, 10.0, 10.0, 1.0, "X")], box)
    stats = made(spark, [(p, 20.0, 26.0, "S") for p in (1, 2, 3)], "page int, font double, line_height double, family string")
    got = {r["page"]: (r["how"], r["style"], r["family"], r["size"]) for r in h.style_match(blocks, native, near, stats).collect()}
    assert got == {1: ("overlap", 7, "N", 12.0), 2: ("nearest", 9, "X", 12.0), 3: ("page", None, "S", 20.0), 4: ("default", None, h.DEFAULT_FAMILY, 12.0)}
    assert h.style_match(blocks, native.limit(0)).filter("how <> 'default'").count() == 0


def test_slope_of_rows(spark):
    rows = [(1, float(x), 100.0 + x, "") for x in (0, 1, 2)] + [(1, float(x), 110.0, "") for x in (0, 1, 2)] + [(2, 0.0, 1.0, ""), (2, 1.0, 1.0, "")] + [(3, 5.0, float(y), "") for y in range(3)]
    got = {r["page"]: (r["angle"], r["confidence"]) for r in h.page_regression(made(spark, rows, ITEM)).collect()}
    assert got == {1: (-22.5, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_grams(spark):
    texts = made(spark, [("",), ("ab",), ("abc",), ("aé😀b",), (None,)], "t string")
    assert [r[0] for r in texts.select(s.grams(F.col("t"), 3)).collect()] == [[], [], ["abc"], ["aé😀", "é😀b"], None]


def test_a_filter_on_the_flag_searches_texts_once(spark):
    docs = spark.createDataFrame([(1, "Invoice total 5", 6), (2, "plain", 1), (3, None, 6)], "doc_id long, text string, pages int")
    found = d.recommend_action(d.document_signals(docs))
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("lower(") == 1
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_entities_of_one_kind_have_the_places_they_have_among_all(spark):
    docs = spark.createDataFrame([(1, "2024-1-2 and 03/04/2024 patient: ANA LIMA, MARIA SOUZA CID: B20.1 CPF 12.3 at 01234-567, signature"), (2, None), (3, "")], "doc_id long, head string")
    every = d.entities(docs).collect()
    assert len({r["kind"] for r in every}) == 5
    for kind in {r["kind"] for r in every}:
        assert d.entities(docs, only=kind).collect() == [r for r in every if r["kind"] == kind]
    with pytest.raises(ValueError, match="only one of"):
        d.entities(docs, only="tableField")
