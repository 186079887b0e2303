"""Rules whose next step depends on the last ones, and classes at their limits."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from docgrowth.operators import breaks
from docgrowth.operators import documents as d
from docgrowth.operators import layout as h
from docgrowth.operators import lines as ln
from docgrowth.operators import quality as q
from docgrowth.operators import similar as s


def made(spark, rows, form):
    return spark.createDataFrame(rows, form)


def test_capitals_are_handwriting(spark):
    rows = [(1, "JOAO SILVA"), (1, "ABC"), (2, "Joao"), (2, "12"), (3, "JOAO"), (3, "Joao Silva"), (4, "ASSINADO"), (4, "CRM 12"), (5, "ALONE"), (6, "ABCDEFGhij"), (6, "ABCDEFGHij"), (7, None), (7, "X")]
    got = {r["p"]: (r["kind"], r["confidence"], r["capitals"]) for r in s.uppercase_share(made(spark, rows, "p int, text string"), "p").collect()}
    assert got == {1: ("handwritten", 0.5, 2), 2: ("printed", 0.7, 0), 3: ("mixed", 0.9, 1), 4: ("handwritten", 0.8, 2), 6: ("mixed", 0.9, 1), 7: ("mixed", 0.9, 1)}  # .7 itself is not enough; one block is no cluster
    assert s.uppercase_share(made(spark, [], "p int, text string"), "p").count() == 0


LINE = "page int, block int, x double, y double"


def test_runs_of_lines(spark):
    def page(n, *xs):
        return [(n, k, float(x), float(10 * k)) for k, x in enumerate(xs)]

    rows = page(1, 40, 40, 40, 90, 90, 90) + page(2, 40, 40, 40, 41) + page(3, 40, 90) + page(4, 40, 40, 40, 200, 90, 90, 90, 300, 90) + page(5, 40, 300, 350, 40, 40, 90, 90, 90)
    got = {}
    for r in h.table_blocks(made(spark, rows, LINE)).orderBy("page", "block").collect():
        got.setdefault(r["page"], []).append((r["run"], r["kind"][0]))
    assert got[1] == [(1, "t")] * 3 + [(2, "t")] * 3
    assert got[2] == [(k, "p") for k in (1, 2, 3, 4)] and got[3] == [(1, "p"), (2, "p")]  # one aligned edge, too few lines
    assert got[4] == [(1, "t")] * 3 + [(2, "p")] + [(3, "t")] * 3 + [(4, "p"), (5, "p")]  # 200 and 300 follow three lines, so they are cut; the next 90 has another edge
    assert got[5] == [(1, "t")] * 3 + [(2, "p"), (3, "p")] + [(4, "t")] * 3  # two unaligned lines join the aligned one before them


def test_a_line_goes_to_the_nearest_column(spark):
    rows = [(1, 1, 40.0, 0.0), (1, 2, 100.0, 0.0), (1, 3, 84.0, 10.0), (1, 4, 60.0, 20.0), (2, 1, 50.0, 5.0), (2, 2, 61.0, 1.0)]
    got = {(r["page"], r["block"]): (r["column"], r["place"]) for r in h.text_columns(made(spark, rows, LINE)).collect()}
    assert got[1, 3][0] == got[1, 2][0] and got[1, 4][0] == 1  # columns begin at 40 and 80; 60 is as far from one as from the other
    assert got[2, 2] == (1, 1) and got[2, 1] == (1, 2)  # one column keeps the order


def test_image_classes_at_their_limits(spark):
    rows = [
        (1, 0.0, 90.0, 100.0, 100.0, 100.0, None, None), (2, 0.0, 10.0, 10.0, 100.0, 100.0, None, 0.0011), (3, 0.0, 10.0, 10.0, 100.0, 100.0, "signature", None), (4, 9.9, 10.0, 19.9, 100.0, 100.0, None, 0.001),
        (5, 10.0, 10.0, 19.0, 100.0, 100.0, None, None), (6, 80.0, 10.0, 10.1, 100.0, 100.0, "stamp", None), (7, 80.0, 10.0, 10.0, 100.0, 100.0, None, None), (8, 5.0, 10.0, 20.0, 100.0, 100.0, None, None), (9, 0.0, 1.0, 1.0, 0.0, 100.0, None, None),
        (10, 0.0, 1.0, 1.0, None, 100.0, None, None),
    ]
    images = made(spark, rows, "n int, y double, w double, h double, page_w double, page_h double, label string, rotation double")
    got = {r["n"]: (r["class"], r["confidence"]) for r in d.image_class(images).collect()}
    assert [got[n][0] for n in range(1, 11)] == ["pdf-fallback", "signature", "signature", "decoration", "image", "decoration", "image", "image", "image", "image"]
    assert got[9][1] == got[10][1] == 0.3 and got[7][1] == 0.5
    counts = {r["class"]: r["n"] for r in d.object_counts(d.image_class(images).withColumn("g", F.lit(1)), "g").collect()}
    assert counts == {"glyph": 0, "vector": 0, "pdf-fallback": 1, "signature": 2, "decoration": 2, "image": 5, "annotation": 0}


def test_health_tells_structure_from_boxes(spark):
    form = "p int, ok boolean, legacy int, painter int, mask_diff double, patch_diff double, bbox_diff double, paint_time double, error boolean"
    row = lambda p, ok=False, painter=1, mask=0.0, patch=0.0, bbox=0.0, error=False: (p, ok, 1, painter, mask, patch, bbox, float(p), error)
    rows = [row(1, True), row(2, bbox=0.5), row(3, painter=2), row(4, mask=0.1), row(5, patch=0.1), row(6, True, painter=2, mask=1.0), row(7, error=True), row(8, bbox=0.01), row(2, True)]
    got = {r["p"]: (r["health"], r["passed"], r["paint_time"]) for r in q.page_health(made(spark, rows, form), "p").collect()}
    assert {p: x[0] for p, x in got.items()} == {1: "healthy", 2: "degraded", 3: "unhealthy", 4: "unhealthy", 5: "unhealthy", 6: "healthy", 7: "unhealthy", 8: "healthy"}
    assert got[2][1:] == (1, 2.0)


WORD = "page int, n int, word string, x double, w double, source int"


def test_lines_break_where_they_are_full_and_keep_pairs(spark):
    def page(p, text, gap=10, source=lambda n: 0):
        out, x = [], 0.0
        for n, word in enumerate(text.split()):
            out.append((p, n, word, x, 10.0 * len(word), source(n)))
            x += 10.0 * len(word) + gap
        return out

    def lines(rows, edge, merge=True):
        return [r["text"] for r in breaks.break_lines(made(spark, rows, WORD), edge, merge=merge).orderBy("page", "line").collect()]

    assert lines(page(1, "aaaa bbbb cccc dddd"), 150) == ["aaaa bbbb cccc", "dddd"]
    # a line that ends with the third word is fullest, but not where a pair would part
    full = lambda word: [(1, 0, "aaaa", 0.0, 40.0, 0), (1, 1, "bbb", 50.0, 30.0, 0), (1, 2, word, 120.0, 64.0, 0), (1, 3, "de", 190.0, 9.0, 0), (1, 4, "cccc", 200.0, 40.0, 0)]
    assert lines(full("partir"), 200) == ["aaaa bbb partir de", "cccc"] and lines(full("other"), 200) == ["aaaa bbb other", "de cccc"]
    assert lines([(1, 0, "junto", 0.0, 50.0, 0), (1, 1, "ao", 95.0, 20.0, 0)], 100, merge=False) == ["junto", "ao"]
    assert lines([(1, 0, "junto", 0.0, 50.0, 0), (1, 1, "ao", 95.0, 20.0, 0)], 100) == ["junto ao"]  # a pair joins although a little too wide
    assert lines([(1, 0, "other", 0.0, 50.0, 0), (1, 1, "ao", 95.0, 20.0, 0)], 100) == ["other", "ao"]
    assert lines([(1, 0, "huge", 0.0, 500.0, 0), (1, 1, "x", 0.0, 10.0, 0), (1, 2, None, 0.0, 1.0, 0)], 100) == ["huge", "x"]
    assert lines([(1, 0, "one", 0.0, 30.0, 0), (1, 1, ",", 31.0, 5.0, 0)], 100) == ["one,"]
    # two breaks as full as each other: the one where the source breaks wins
    even = lambda n: [(1, k, "abcd", x, 10.0, int(k >= n)) for k, x in enumerate((0.0, 82.0, 81.0, 95.0))]
    assert lines(even(3), 100, merge=False) == ["abcd abcd abcd", "abcd"] and lines(even(9), 100, merge=False) == ["abcd abcd", "abcd abcd"]
    assert lines([], 100) == []


def test_a_drifting_baseline_breaks_at_its_anchor(spark):
    form = "page int, x double, y double, w double, size double, family string, text string"
    drift = [(1, 10.0 * k, 100.0 - 3.0 * k, 10.0, 10.0, "A" if k else "B", "ab" if k == 1 else "c") for k in range(5)]
    gaps = [(2, 0.0, 50.0, 10.0, 10.0, "A", "x"), (2, 40.0, 50.5, 10.0, 12.0, "B", "yy"), (2, 80.1, 50.0, 10.0, 10.0, "A", "z"), (3, 5.0, 9.0, 1.0, 1.0, "A", None)]
    got = [(r["page"], r["line"], r["text"], r["x"], r["y"], r["width"], r["size"], r["family"]) for r in breaks.glyph_lines(made(spark, drift + gaps, form)).orderBy("page", "line").collect()]
    assert got == [
        (1, 0, "cab", 0.0, 100.0, 20.0, 10.0, "A"), (1, 1, "cc", 20.0, 94.0, 20.0, 10.0, "A"), (1, 2, "c", 40.0, 88.0, 10.0, 10.0, "A"),
        (2, 0, "xyy", 0.0, 50.0, 50.0, 12.0, "B"), (2, 1, "z", 80.1, 50.0, 10.0, 10.0, "A"), (3, 0, "", 5.0, 9.0, 1.0, 1.0, "A"),
    ]


def test_items_are_used_up(spark):
    form = "doc int, page int, seq int, text string"
    expected = [(1, 0, 0, "Invoice Number"), (1, 0, 1, "A 1"), (1, 0, 2, "--"), (1, 0, 3, "end"), (2, 0, 0, "only here"), (3, 0, 0, "one"), (3, 0, 1, None)]
    actual = [(1, 0, 0, "Invoice"), (1, 0, 1, "Number"), (1, 0, 2, "A"), (1, 0, 3, "2"), (1, 0, 4, "the end"), (3, 0, 0, "one two"), (4, 0, 0, "x")]
    got = {(r["doc"], r["e"]): (r["items"], r["matched"], r["note"]) for r in breaks.observation_align(made(spark, expected, form), made(spark, actual, form)).collect()}
    assert got == {
        (1, 0): ("0+1", True, None), (1, 1): ("2+3", False, 'text differs: "A 1" vs "A 2"'), (1, 2): ("(no match)", True, None), (1, 3): ("(no match)", True, None),
        (3, 0): ("(no match)", True, None), (3, 1): ("(no match)", True, None),
    }


def test_layers_and_even_splits(spark):
    blocks = made(spark, [(1, 1, 0.0, 10.0, 36.0, "a b c d e"), (1, 2, 500.0, 10.0, 30.0, "x\n\ny\nz"), (1, 3, 900.0, 0.0, 24.0, "kept"), (1, 4, 900.0, 5.0, 24.0, None), (2, 1, 0.0, 5.0, 12.0, "own")], "page int, block int, y double, w double, h double, text string")
    lines = made(spark, [(2, 24.0, "second"), (2, -12.0, "first"), (2, 24.1, "too low")], "page int, y double, text string")
    got = [(r["page"], r["block"], r["line"], round(r["y"], 6), r["text"], r["how"]) for r in ln.fuse_text_layers(blocks, lines).orderBy("page", "block", "line").collect()]
    assert [g[4] for g in got if g[:2] == (1, 1)] == ["a b", "c d", "e"] and [g[4] for g in got if g[:2] == (1, 2)] == ["x", "y", "z"]
    assert [g[4:] for g in got if g[1] in (3, 4)] == [("kept", "whole"), (None, "whole")]
    assert [g[2:] for g in got if g[0] == 2] == [(0, -21.6, "first", "layer"), (1, 14.4, "second", "layer")]


def test_offsets_of_entities_equal_those_of_matches(spark):
    rows = [(r["doc_id"], r["head"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "concat('Dr ANA LIMA; ', text, ' CID: A10.1 patient JOE') AS head").collect()]
    found = {}
    for r in d.entities(made(spark, rows, "doc_id long, head string")).filter("kind IN ('dateField', 'addressField') OR label = 'ID'").collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["value"]))
    for i, t in rows:
        want = [(m.start(), m.end(), m[0]) for p in [*d.DATES.values(), d.POSTCODE] for m in re.finditer(p, t, re.ASCII)] + [(*m.span(1), m[1]) for m in re.finditer(d.NUMBER, t, re.ASCII)]
        assert sorted(found.get(i, [])) == sorted(want)


def test_edits_by_id(spark):
    docs = made(spark, [(1, "ANA wrote. PATIENT: ANA"), (2, "01/02/2024 then 01/02/2024, 12345-678"), (3, None), (4, "nothing")], "doc_id int, head string")
    found = d.entities(docs)
    assert {r["doc_id"]: r["head"] for r in d.entity_replace(docs, d.semantic_query(found, role="patient"), "EVA").collect()}[1] == "ANA wrote. PATIENT: EVA"
    new = d.entity_edits(docs, found, made(spark, [(2, 1, "2025-01-01"), (2, 2, "99999-999!"), (1, 0, "X"), (4, 0, "none")], "doc_id int, place int, by string"))
    got = {r["doc_id"]: (r["edits"], r["head"]) for r in new.collect()}
    assert got == {1: (1, "ANA wrote. PATIENT: X"), 2: (2, "01/02/2024 then 2025-01-01, 99999-999!"), 3: (0, None), 4: (0, "nothing")}
    again = [(r["value"], r["start"]) for r in d.entities(new).filter("doc_id = 2").orderBy("start").collect()]
    assert again == [("01/02/2024", 0), ("2025-01-01", 16), ("99999-999", 28)]
    edits = [(4, 0, 3, "A"), (4, 2, 5, "overlaps"), (4, 3, 3, "+"), (4, -1, 2, "before"), (4, 6, 99, "beyond"), (4, 7, 7, "."), (3, 0, 0, "x"), (4, None, 1, "null")]
    got = {r["doc_id"]: (r["edits"], r["head"]) for r in d.apply_edits(docs, made(spark, edits, "doc_id int, start int, end int, by string")).collect()}
    assert got[4] == (3, "A+hing.") and got[3] == (0, None)


def test_spread_of_exactly_half_the_mean_in_any_order(spark):
    rows = [(k, x) for k, order in enumerate(itertools.permutations([18.0, 30.0, 50.0, 14.0])) for x in order]  # mean 28, spread 14
    near = [(100, 18.0), (100, 30.0), (100, 49.0), (100, 14.0), (101, 1e200), (101, 1.2e200), (102, 5.0)]
    got = dict(q.systematic(spark.createDataFrame(rows, "k long, x double").coalesce(1).union(spark.createDataFrame(near, "k long, x double")).coalesce(1), "k", "x").collect())
    assert not any(got[k] for k in range(24)) and got[100] and got[102]
