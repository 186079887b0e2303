"""Layout of positioned text: rows, columns, tables, paragraphs, boxes. Pages are bounded and are the keys."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.folds import folded, gathered
from docgrowth.functions.numbers import half_up
from docgrowth.functions.shared import written

_CENTRES = "array<double>"


def _kept(values: Column, gap: float) -> Column:
    """Of sorted values those more than `gap` from the last one kept."""
    return F.aggregate(values, F.array().cast(_CENTRES), lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) > gap), F.concat(kept, F.array(v))).otherwise(kept))


def _rows_of(items: Column, grid: float, least: float, share: float) -> Column:
    """Centres of the rows of a page's items, on a grid; a value within the threshold moves the last centre to the mean."""
    near = F.greatest(F.lit(least), share * F.coalesce(F.aggregate(items, F.lit(0.0), lambda s, i: s + i["h"]) / F.size(items), F.lit(0.0)))
    ys = F.array_distinct(F.array_sort(F.transform(items, lambda i: half_up(i["y"] / grid) * float(grid))))
    start = F.struct(near.alias("near"), F.array().cast(_CENTRES).alias("c"))
    last = lambda s: F.try_element_at(s["c"], F.lit(-1))
    fold = lambda s, y: F.struct(s["near"].alias("near"), F.when((F.size(s["c"]) > 0) & (y - last(s) <= s["near"]), F.concat(F.slice(s["c"], 1, F.size(s["c"]) - 1), F.array((last(s) + y) / 2))).otherwise(F.concat(s["c"], F.array(y))).alias("c"))
    return F.aggregate(ys, start, fold)["c"]


def _page_items(items: DataFrame) -> DataFrame:
    """(page, items): the positioned items of each page in one array; items without a height have none."""
    h = F.col("h").cast("double") if "h" in items.columns else F.lit(0.0)
    return items.groupBy("page").agg(F.collect_list(F.struct("x", "y", h.alias("h"), "text")).alias("items"))


def row_centres(items: DataFrame, grid: float = 3, least: float = 8.0, share: float = 0.6) -> DataFrame:
    """(page, rows): centres of text rows; rows nearer than `least`, or `share` of the mean height, are one."""
    return _page_items(items).select("page", _rows_of(F.col("items"), grid, least, share).alias("rows"))


def _columns_of(page: DataFrame, grid: float, gap: float, alone: float) -> DataFrame:
    """Pages with the centres of their columns: x values that recur on a grid; where fewer than two stay, all x values, off the grid."""
    xs = F.array_sort(F.transform("items", lambda i: half_up(i["x"] / grid) * float(grid)))
    page = page.withColumn("_xs", xs)
    page = page.withColumn("_often", _kept(F.array_distinct(F.filter("_xs", lambda v, i: F.get("_xs", i + 1) == v)), gap))
    every = _kept(F.array_sort(F.array_distinct(F.transform("items", lambda i: i["x"].cast("double")))), alone)
    return page.withColumn("columns", F.when(F.size("_often") >= 2, F.col("_often")).otherwise(every)).drop("_xs", "_often")


def column_centres(items: DataFrame, grid: float = 4, gap: float = 12, alone: float = 15) -> DataFrame:
    """(page, columns): x values that recur, at a distance; where fewer than two do, the distinct x values themselves."""
    return _columns_of(_page_items(items), grid, gap, alone).select("page", "columns")


def _nearest(v: Column, centres: Column) -> Column:
    """(distance, index) of the nearest centre, the first on ties."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(v - c).alias("d"), i.alias("i"))))


def grid_assign(items: DataFrame, most: float = 20.0) -> DataFrame:
    """(page, r, c, text): each item in its nearest row and column, texts of a cell joined by a blank.

    Pages are gathered once; rows, columns and cells need no further shuffle.
    """
    page = _columns_of(_page_items(items), 4, 12, 15).withColumn("rows", _rows_of(F.col("items"), 3, 8.0, 0.6))
    met = page.select("page", "rows", "columns", F.explode("items").alias("i"))
    put = met.withColumn("_r", _nearest(F.col("i.y"), F.col("rows"))).withColumn("_c", _nearest(F.col("i.x"), F.col("columns"))).filter((F.col("_r.d") < most) & (F.col("_c.d") < most))
    cell = put.groupBy("page", F.col("_r.i").alias("r"), F.col("_c.i").alias("c"))
    return cell.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i.x", "i.text"))), lambda t: t["text"]), " ").alias("text"))


def grid_fix(cells: DataFrame) -> DataFrame:
    """Rows without text dropped and the others numbered anew; rows that begin with one or two empty cells moved left."""
    rows = cells.filter(F.trim("text") != "").withColumn("_first", F.min("c").over(W.partitionBy("page", "r")))
    rank = F.dense_rank().over(W.partitionBy("page").orderBy("r")) - 1
    return rows.select("page", rank.alias("r"), F.when(F.col("_first").between(1, 2), F.col("c") - F.col("_first")).otherwise(F.col("c")).alias("c"), "text")


def cell_normalise(c: Column, domain: str) -> Column:
    """Invoices: no blanks between digits. Bank statements: leading runs of x masked."""
    if domain == "invoice":
        return F.regexp_replace(c, r"(?<=[0-9])\s+(?=[0-9])", "")
    return F.regexp_replace(c, "^[xX]+", "****") if domain == "bank_statement" else c


def cell_type(c: Column) -> Column:
    """kind, number and text of a cell: currency, percent, bracketed negative, number, date kept as text, or text."""
    t = F.trim(c)
    bare = F.replace(F.regexp_replace(t, r"[$€£%()\s]", ""), F.lit(","), F.lit(""))
    num = bare.try_cast("double")
    kind = F.when(t.rlike(r"^[$€£]\s*[0-9][0-9,]*(\.[0-9]+)?$|^[0-9][0-9,]*(\.[0-9]+)?\s*[$€£]$"), "currency").when(t.rlike(r"^[0-9]+(\.[0-9]+)?%$"), "percent").when(t.rlike(r"^\([0-9][0-9,]*(\.[0-9]+)?\)$"), "negative")
    kind = kind.when(t.rlike(r"^-?[0-9][0-9,]*(\.[0-9]+)?$"), "number").when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$"), "date").otherwise("text")
    value = F.when(kind == "percent", num / 100).when(kind == "negative", -num).when(kind.isin("currency", "number"), num)
    return F.struct(kind.alias("kind"), value.alias("number"), t.alias("text"))


def table_quality(cells: DataFrame) -> DataFrame:
    """Filled share and evenness of rows, and how sure a table is."""
    rows = cells.groupBy("page", "r").agg(F.count("*").alias("filled"))
    shape = cells.groupBy("page").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count("*").alias("items"))
    spread = rows.join(shape, "page").groupBy("page").agg(F.var_pop(F.col("filled") / F.col("cols")).alias("v"), F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.first("items").alias("items"))
    share = F.col("items") / (F.col("rows") * F.col("cols"))
    quality = half_up(0.6 * share + 0.4 * F.greatest(F.lit(0.0), 1 - 4 * F.col("v")), 2)
    sure = F.when((F.col("rows") > 2) & (F.col("cols") > 1), F.least(F.lit(1.0), F.col("rows") * F.col("cols") / F.greatest(0.8 * F.col("items"), F.lit(1.0)))).otherwise(0.3)
    return spread.select("page", quality.alias("quality"), sure.alias("confidence"))


def table_region(items: DataFrame, least: int = 10, grid: float = 3, pad: float = 5) -> DataFrame:
    """Padded bounding box of pages with enough items in at least two columns of three or more."""
    columns = items.groupBy("page", F.floor(F.col("x") / grid).alias("b")).agg(F.count("*").alias("n")).filter("n >= 3").groupBy("page").agg(F.count("*").alias("columns"))
    box = items.groupBy("page").agg(F.count("*").alias("n"), (F.min("x") - pad).alias("left"), (F.max("x") + pad).alias("right"), (F.min("y") - pad).alias("top"), (F.max("y") + pad).alias("bottom"))
    return box.join(columns.filter("columns >= 2").select("page"), "page", "left_semi").filter(F.col("n") >= least).drop("n")


def text_columns(lines: DataFrame, grid: float = 10, gap: float = 30) -> DataFrame:
    """Lines with their column and place: the k-th lines of all columns together, row by row.

    Columns begin at left edges, on a grid, more than `gap` from the last one; a line is in the nearest, the first on ties.
    Pages with a single column keep the order of y, x and block.
    """
    starts = lines.groupBy("page").agg(F.array_sort(F.collect_set(half_up(F.col("x") / grid) * float(grid))).alias("xs")).select("page", _kept(F.col("xs"), gap).alias("columns"))
    met = lines.join(starts, "page").withColumn("column", F.when(F.size("columns") > 1, _nearest(F.col("x"), F.col("columns"))["i"] + 1).otherwise(1))
    rank = F.row_number().over(W.partitionBy("page", "column").orderBy("y", "x", "block"))
    return met.withColumn("rank", rank).withColumn("place", F.row_number().over(W.partitionBy("page").orderBy("rank", "column")))


def islands(rows: DataFrame, by: str, order: list[str], starts: Column, name: str) -> DataFrame:
    """rows with the number of the run they are in; `starts` says where a new run begins (null: it does)."""
    return rows.withColumn(name, F.sum(F.when(starts, 0).otherwise(1)).over(W.partitionBy(by).orderBy(*order)))


def paragraph_merge(blocks: DataFrame, gap: float = 2.5, shift: float = 20.0, font: float = 2.0) -> DataFrame:
    """Blocks joined to paragraphs: near below, aligned, of like size, neither blank."""
    w = W.partitionBy("page").orderBy("y", "x", "block")
    p = lambda c: F.lag(c).over(w)
    near = (F.col("y") - (p("y") + p("h")) <= gap * (F.col("font") + p("font")) / 2) & (F.abs(F.col("x") - p("x")) <= shift) & (F.abs(F.col("font") - p("font")) <= font) & (F.trim("text") != "") & (F.trim(p("text")) != "")
    marked = blocks.withColumn("_near", F.coalesce(near, F.lit(False)))
    return islands(marked, "page", ["y", "x", "block"], F.col("_near"), "paragraph").drop("_near")


def table_blocks(lines: DataFrame, least: int = 3, grid: float = 5) -> DataFrame:
    """(page, block, run, kind): the run that each line is in, and whether that is a table.

    Left edges on a grid that `least` lines of the page share are aligned; a page of fewer lines, or with fewer than two
    aligned edges, has paragraphs only. From top to bottom, a run is cut before an aligned line whose edge is not that of
    the line before, and before an unaligned line once the run has more than two; so the cut depends on the run's length,
    which a fold keeps. Runs of more than two lines are tables; every other line is a run of its own.
    """

    def runs(block: list, at: list) -> Iterator[tuple]:
        often = {x for x, n in Counter(at).items() if n >= least}
        held: list[list[int]] = []
        for k, x in enumerate(at):
            if held and not (x != at[k - 1] if x in often else len(held[-1]) > 2):
                held[-1].append(k)
            else:
                held.append([k])
        table = len(at) >= 3 and len(often) >= 2
        n = 0
        for run in held:
            parts = [run] if table and len(run) > 2 else [[k] for k in run]
            for part in parts:
                n += 1
                for k in part:
                    yield block[k], n, "table" if len(part) > 1 else "paragraph"

    kind = lines.schema["block"].dataType.simpleString()
    rows = lines.select("page", "y", "x", "block", half_up(F.col("x") / grid).cast("long").alias("at"))
    return folded(gathered(rows, ["page"], ["y", "x", "block"], ["block", "at"]), ["page"], runs, f"block {kind}, run long, kind string")


def block_types(blocks: DataFrame) -> DataFrame:
    mark = F.col("text").rlike(r"^\s*(?:[-*•]|[0-9]+[.)])\s")
    return blocks.filter(F.trim("text") != "").withColumn("kind", F.when(mark, "list").when(F.col("font") > 22, "h1").when(F.col("font") > 18, "h2").otherwise("paragraph"))


def doc_quality(typed: DataFrame) -> DataFrame:
    n, heads = F.count("*"), F.count_if(F.col("kind").isin("h1", "h2"))
    share = F.count_if(F.col("kind") == "paragraph") / n
    return typed.groupBy("page").agg(half_up(F.when(heads > 0, F.least(F.lit(1.0), 0.15 * heads + 0.7 * share)).otherwise(share), 2).alias("quality"))


def line_groups(items: DataFrame, near: float = 8.0, level: float = 3.0, right: float = 30.0) -> DataFrame:
    """(page, line, y, text, left, n, font): items folded into lines; texts joined without blanks, the font their mean (null where items have none).

    Items follow each other by y, those less than `level` below the one before by x. A group holds items while they are
    near its first y; a later group joins the first line whose first y is near its own and whose last item is not more
    than `right` left of it.
    """
    font = F.col("font").cast("double") if "font" in items.columns else F.lit(None).cast("double")
    above = F.lag("y").over(W.partitionBy("page").orderBy("y", "x", "text"))
    banded = islands(items.withColumn("_above", above), "page", ["y", "x", "text"], F.col("y") - F.col("_above") < level, "_band")
    page = banded.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("_band", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text", font.alias("font")))).alias("items"))
    last = lambda a: F.try_element_at(a, F.lit(-1))

    def line(y: Column, first: Column, end: Column, text: Column, left: Column, n: Column, fonts: Column) -> Column:
        return F.struct(y.alias("y"), first.alias("first"), end.alias("end"), text.alias("text"), left.alias("left"), n.alias("n"), fonts.alias("fonts"))

    def joined(a: Column, b: Column) -> Column:
        return line(a["y"], a["first"], b["end"], F.concat(a["text"], b["text"]), F.least(a["left"], b["left"]), a["n"] + b["n"], a["fonts"] + b["fonts"])

    def group(groups: Column, i: Column) -> Column:
        one = line(i["y"], i["x"], i["x"], i["text"], i["x"], F.lit(1), i["font"])
        held = (F.size(groups) > 0) & (F.abs(i["y"] - last(groups)["y"]) < near)
        return F.when(held, F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(joined(last(groups), one)))).otherwise(F.concat(groups, F.array(one)))

    def late(lines: Column, g: Column) -> Column:
        fits = F.transform(lines, lambda m: (F.abs(g["y"] - m["y"]) < near) & (g["first"] - m["end"] < right))
        at = F.array_position(fits, F.lit(True))
        return F.when(at > 0, F.transform(lines, lambda m, k: F.when(k + 1 == at, joined(m, g)).otherwise(m))).otherwise(F.concat(lines, F.array(g)))

    empty = F.array().cast("array<struct<y:double,first:double,end:double,text:string,left:double,n:int,fonts:double>>")
    grouped = page.select("page", F.aggregate("items", empty, group).alias("groups"))
    lines = grouped.select("page", F.aggregate("groups", empty, late).alias("lines"))
    order = F.array_sort(F.transform("lines", lambda m, k: F.struct(m["y"].alias("y"), k.alias("k"), m.alias("m"))))
    return lines.select("page", F.posexplode(order).alias("line", "l")).select("page", "line", "l.m.y", "l.m.text", "l.m.left", "l.m.n", (F.col("l.m.fonts") / F.col("l.m.n")).alias("font"))


def merge_initial(items: DataFrame, gap: float = 5.0, width: float = 6.0) -> DataFrame:
    """Items of a line where a single character joins the longer item right after it."""
    w = W.partitionBy("page", "row").orderBy("x")
    lone = (F.length("text") == 1) & (F.length(F.lead("text").over(w)) >= 2) & (F.lead("x").over(w) - (F.col("x") + width) < gap)
    marked = items.withColumn("_lone", F.coalesce(lone, F.lit(False))).withColumn("_before", F.lag("text").over(w))
    joined = marked.withColumn("_join", F.coalesce(F.lag("_lone").over(w), F.lit(False)))
    return joined.filter(~F.col("_lone")).withColumn("text", F.regexp_replace(F.when(F.col("_join"), F.concat("_before", "text")).otherwise(F.col("text")), r"\s+", " ")).drop("_lone", "_before", "_join")


def visual_right(items: DataFrame, share: float = 0.9) -> DataFrame:
    """Per page the right edge at index floor(share * n), clamped."""
    w = W.partitionBy("page")
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy("right", "row", "col"))
    return items.withColumn("_n", n).withColumn("_k", rank).filter(F.col("_k") == F.least(F.col("_n"), F.floor(share * F.col("_n")) + 1)).select("page", "right")


def join_words(rows: DataFrame, by: str, order: str, word: str) -> DataFrame:
    """Words in one text, with a blank before each but those that begin with closing punctuation."""
    words = F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word])
    return rows.groupBy(by).agg(F.regexp_replace(F.array_join(words, " "), r" (?=[,.;:!?)\]}%])", "").alias("text"))


def page_style_stats(blocks: DataFrame) -> DataFrame:
    """Upper median of font size, line height from it, and the most frequent family, the first seen on ties."""
    fonts = F.array_sort(F.collect_list("font"))
    mid = blocks.groupBy("page").agg(F.element_at(fonts, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("font"))
    family = blocks.groupBy("page", "family").agg(F.count("*").alias("n"), F.min("block").alias("first")).groupBy("page").agg(F.max_by("family", F.struct("n", (-F.col("first")).alias("f"))).alias("family"))
    return mid.join(family, "page").select("page", "font", (F.col("font") * 1.3).alias("line_height"), "family")


def _overlap(a: str, b: str) -> Column:
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(F.col(f"{a}_{p}") + F.col(f"{a}_{s}"), F.col(f"{b}_{p}") + F.col(f"{b}_{s}")) - F.greatest(F.col(f"{a}_{p}"), F.col(f"{b}_{p}")))
    return side("x", "w") * side("y", "h")


def _two(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boxes of two sets that share a page."""
    name = lambda d, k: d.select("page", F.col("block").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in d.columns if c not in ("page", "block")))
    return name(a, "a").join(name(b, "b"), "page")


# The style of a block that nothing else gives one, and line heights in font sizes.
DEFAULT_FAMILY = "'Arial', 'Helvetica', 'Noto Sans SC', 'Microsoft YaHei', 'PingFang SC', sans-serif"
LINE_HEIGHT = 1.3


def style_match(blocks: DataFrame, styles: DataFrame, neighbours: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(page, block, how, style, family, size, line_height): each block's style, by the first step that has one.

    The box of `styles` with the greatest overlap; the nearest centre of `neighbours` (of `styles`, if there are none), the
    smaller block on ties; the page's `stats` (page_style_stats), with their median size; a default. The first two and the
    last keep the block's own size. Blocks need page, block, x, y, w, h and font; boxes page, block, x, y, w, h and family.
    """
    centre = lambda k: (F.col(f"{k}_x") + F.col(f"{k}_w") / 2, F.col(f"{k}_y") + F.col(f"{k}_h") / 2)
    (ax, ay), (bx, by) = centre("a"), centre("b")
    far = (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    sides = ["x", "y", "w", "h"]
    boxes = lambda d, drawn, beside: d.select("page", F.col("block").alias("b"), F.col("family").alias("b_family"), *(F.col(c).cast("double").alias(f"b_{c}") for c in sides), F.lit(drawn).alias("drawn"), F.lit(beside).alias("beside"))
    other = boxes(styles, True, True) if neighbours is None else boxes(styles, True, False).union(boxes(neighbours, False, True))
    # one join of a page's boxes, and both choices from it; what follows keeps the partitions by page
    met = blocks.select("page", F.col("block").alias("a"), "font", *(F.col(c).cast("double").alias(f"a_{c}") for c in sides)).join(other, "page", "left")
    chosen = F.struct("b", "b_family")
    area = _overlap("a", "b")
    met = met.groupBy("page", "a", "font").agg(F.min_by(chosen, F.when(F.col("drawn") & (area > 0), F.struct(-area, "b"))).alias("over"), F.min_by(chosen, F.when(F.col("beside"), F.struct(far, "b"))).alias("near"))
    met = met.join(stats.select("page", F.struct(F.col("family").alias("b_family"), F.col("font").alias("size")).alias("stat")), "page", "left") if stats is not None else met.withColumn("stat", F.lit(None).cast("struct<b_family:string,size:double>"))
    how = F.when(F.col("over").isNotNull(), "overlap").when(F.col("near").isNotNull(), "nearest").when(F.col("stat").isNotNull(), "page").otherwise("default")
    family = F.when(how == "overlap", F.col("over.b_family")).when(how == "nearest", F.col("near.b_family")).when(how == "page", F.col("stat.b_family")).otherwise(DEFAULT_FAMILY)
    size = F.when(how == "page", F.col("stat.size")).otherwise(F.col("font"))
    return met.select("page", F.col("a").alias("block"), how.alias("how"), F.coalesce("over.b", "near.b").alias("style"), family.alias("family"), size.alias("size"), (size * LINE_HEIGHT).alias("line_height"))


def mask_impact(lines: DataFrame, edited: DataFrame, pad: float = 2.0) -> DataFrame:
    """Lines whose box strictly meets the padded box of an edited line of the page."""
    grown = edited.select("page", "block", (F.col("x") - pad).alias("x"), (F.col("y") - pad).alias("y"), (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h"))
    return _two(lines.select(*grown.columns), grown).filter((_overlap("a", "b") > 0) & (F.col("a") != F.col("b"))).select("page", F.col("a").alias("block")).distinct()


def redact(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """Blocks that meet no redaction area of their page."""
    hit = _two(blocks.select("page", "block", "x", "y", "w", "h"), areas).filter(_overlap("a", "b") > 0).select("page", F.col("a").alias("block")).distinct()
    return blocks.join(hit, ["page", "block"], "left_anti")


def cell_lookup(segments: DataFrame, cells: DataFrame) -> DataFrame:
    """Each segment's cell, if one cell holds it whole; else how many it meets tells why not."""
    met = segments.join(cells, "page", "left")
    whole = (F.col("start") >= F.col("low")) & (F.col("end") <= F.col("high"))
    touch = (F.col("start") < F.col("high")) & (F.col("end") > F.col("low"))
    out = met.groupBy("page", "seg").agg(F.count_if(whole).alias("holds"), F.count_if(touch).alias("touches"), F.min(F.when(whole, F.col("cell"))).alias("cell"))
    why = F.when(F.col("holds") == 1, "in-cell").when(F.col("holds") > 1, "ambiguous").when(F.col("touches") > 1, "spans-multiple").otherwise("no-cell")
    return out.select("page", "seg", why.alias("result"), F.when(F.col("holds") == 1, F.col("cell")).alias("cell"))


def render_source(lines: DataFrame, images: DataFrame, texts: DataFrame) -> DataFrame:
    """vector, image or image-ocr by how much of a line's box images (0.7) and text boxes (0.3) cover."""
    share = lambda other, name: _two(lines, other).groupBy("page", "a").agg(F.max(_overlap("a", "b") / (F.col("a_w") * F.col("a_h"))).alias(name))
    met = lines.select("page", F.col("block").alias("a")).join(share(images, "image"), ["page", "a"], "left").join(share(texts, "text"), ["page", "a"], "left")
    image, text = F.coalesce("image", F.lit(0.0)) >= 0.7, F.coalesce("text", F.lit(0.0)) >= 0.3
    return met.select("page", F.col("a").alias("block"), F.when(~image, "vector").when(text, "image-ocr").otherwise("image").alias("source"))


def page_regression(points: DataFrame, factor: float = 2.5, least: float = 3.0) -> DataFrame:
    """(page, angle, confidence): median slope angle of the page's rows in degrees, clockwise, to one decimal; how alike they are.

    A point whose y is over `least`, and over `factor` times the lower-fifth gap, below the one before starts a row; rows of
    three points on more than one x count. Pages without any have angle 0 and confidence 0.
    """
    w = W.partitionBy("page").orderBy("y", "x")
    stepped = points.select("page", "x", "y", (F.col("y") - F.lag("y").over(w)).alias("_gap"))
    gaps = F.array_sort(F.collect_list("_gap").over(W.partitionBy("page")))
    wide = F.greatest(factor * F.get("_gaps", F.floor(F.size("_gaps") * 0.2).cast("int")), F.lit(least))
    rows = islands(stepped.withColumn("_gaps", gaps).withColumn("_wide", wide).drop("_gaps"), "page", ["y", "x"], F.col("_gap") <= F.col("_wide"), "row")
    fitted = rows.groupBy("page", "row").agg(F.regr_slope("y", "x").alias("s"), F.count("*").alias("n"), (F.max("x") > F.min("x")).alias("wide"))
    angle = F.when((F.col("n") >= 3) & F.col("wide"), -F.degrees(F.atan("s")))
    page = fitted.groupBy("page").agg(F.percentile(angle, F.lit(0.5)).alias("m"), F.stddev_pop(angle).alias("d"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / 5))
    return page.select("page", F.coalesce(half_up(F.round("m", 9), 1), F.lit(0.0)).alias("angle"), F.round(F.when(F.col("d").isNull(), 0.0).otherwise(sure), 9).alias("confidence"))


def candidate_agreement(rows: DataFrame) -> DataFrame:
    """How near a group's candidates are, and the best by confidence and agreement, if good enough."""
    out = rows.groupBy("page").agg(half_up(F.exp(-(F.max("angle") - F.min("angle")) / 20), 2).alias("agreement"), F.max(F.struct("confidence", "angle")).alias("b"))
    return out.select("page", "agreement", F.when(F.col("b.confidence") + 0.6 * F.col("agreement") >= 0.5, F.col("b.angle")).alias("angle"))


def multi_column_lines(items: DataFrame, factor: float = 1.5, font: float = 10.0, width: float = 20.0) -> DataFrame:
    """Lines whose largest gap between neighbours is over `factor` font sizes."""
    gap = F.col("x") - (F.lag("x").over(W.partitionBy("page", "row").orderBy("x")) + width)
    return items.filter(F.trim("text") != "").withColumn("gap", gap).groupBy("page", "row").agg(F.max("gap").alias("gap")).withColumn("multi", F.coalesce(F.col("gap") > factor * font, F.lit(False)))


def dominant_font(blocks: DataFrame) -> DataFrame:
    """Per page the family with most characters (each block counts at least one), the first seen on ties, and the largest size."""
    each = blocks.groupBy("page", "family").agg(F.sum(F.greatest(F.length("text"), F.lit(1))).alias("n"), F.min("block").alias("first"), F.max("font").alias("size"))
    return each.groupBy("page").agg(F.max_by("family", F.struct("n", (-F.col("first")).alias("f"))).alias("family"), F.max("size").alias("size"))


def reading_order(items: DataFrame) -> DataFrame:
    return items.withColumn("flow", F.row_number().over(W.partitionBy("page").orderBy("y", "x", "col")))


# Words of weight in their order, and font families by name.
WEIGHTS = (("bold", 700), ("heavy", 800), ("black", 900), ("light", 300), ("thin", 200), ("medium", 500), ("regular", 400), ("normal", 400))
FAMILIES = {
    "helvetica": "Helvetica, Arial, sans-serif", "arial": "Arial, sans-serif", "times": "'Times New Roman', Times, serif", "timesnewroman": "'Times New Roman', Times, serif",
    "courier": "'Courier New', Courier, monospace", "verdana": "Verdana, sans-serif", "georgia": "Georgia, serif", "calibri": "Calibri, sans-serif", "tahoma": "Tahoma, sans-serif",
    "trebuchetms": "'Trebuchet MS', sans-serif", "simsun": "'SimSun', 'Songti SC', serif", "songti": "'Songti SC', 'SimSun', serif", "stsong": "'STSong', 'SimSun', serif",
    "simhei": "'SimHei', 'Heiti SC', sans-serif", "heiti": "'Heiti SC', 'SimHei', sans-serif", "stheiti": "'Heiti SC', 'SimHei', sans-serif", "microsoftyahei": "'Microsoft YaHei', sans-serif",
    "msyh": "'Microsoft YaHei', sans-serif", "kaiti": "'KaiTi', 'STKaiti', serif", "stkaiti": "'STKaiti', 'KaiTi', serif", "fangsong": "'FangSong', 'STFangsong', serif",
    "stfangsong": "'STFangsong', 'FangSong', serif", "youyuan": "'YouYuan', sans-serif", "mincho": "'Hiragino Mincho ProN', 'Yu Mincho', serif", "gothic": "'Hiragino Sans', 'Yu Gothic', sans-serif",
    "batang": "'Batang', serif", "dotum": "'Dotum', sans-serif",
}


def font_name_parse(names: DataFrame, name: str = "name") -> DataFrame:
    """weight, italic and family of a font's name: a subset's prefix is dropped, the first word of weight counts, the family is that of the bare name, else of the first name within it, else a default."""
    low = F.lower(F.regexp_replace(name, r"^[A-Z]{6}\+", ""))
    bare = F.regexp_replace(F.regexp_replace(low, "-(?:bold|heavy|black|light|thin|medium|regular|normal)", ""), "italic|oblique", "")
    known = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    weight = F.coalesce(*(F.when(F.col("_low").contains(word), w) for word, w in WEIGHTS), F.lit(400))
    within = F.coalesce(*(F.when(F.col("_bare").contains(f), css) for f, css in FAMILIES.items()))
    default = F.when(F.col("_bare").rlike("sim|song|hei|kai|fang"), "'SimSun', 'Songti SC', serif").otherwise("Arial, Helvetica, sans-serif")
    out = names.withColumn("_low", low).withColumn("_bare", F.trim(F.regexp_replace(bare, "[-_]", "")))
    out = out.withColumn("weight", weight).withColumn("italic", F.col("_low").rlike("italic|oblique")).withColumn("family", F.coalesce(F.try_element_at(known, "_bare"), within, default))
    return out.drop("_low", "_bare")


def style_dictionary(rows: DataFrame, fields: tuple[str, ...], seq: str) -> tuple[DataFrame, DataFrame]:
    """Distinct styles numbered by first appearance, and rows that refer to them.

    Numbers are counted within ranges of the first appearance, with the sizes of the ranges before added, so no task sees all styles.
    """
    styles = rows.groupBy(*fields).agg(F.min(seq).alias("first")).repartitionByRange("first")
    styles = written(styles.withColumn("_part", F.spark_partition_id()), "styles")
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = styles.groupBy("_part").agg(F.count("*").alias("n"), F.min("first").alias("low")).select("_part", before.alias("_base"))  # a row per range
    within = F.row_number().over(W.partitionBy("_part").orderBy("first"))
    styles = styles.join(F.broadcast(base), "_part").withColumn("style", F.col("_base") + within - 1).select(*fields, "first", "style")
    pairs = [rows[f].eqNullSafe(styles[f]) for f in fields]
    return styles, rows.join(styles, pairs).select(rows["*"], "style")


def coverage_gaps(spans: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """A row wherever the next span does not begin where the furthest one so far ended; negative where they overlap."""
    before = F.max(end).over(W.partitionBy(by).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("cursor", F.coalesce(before, F.lit(0))).withColumn("gap", F.col(start) - F.col("cursor")).filter("gap <> 0")


def coverage_summary(spans: DataFrame, by: str, height: str, start: str = "start", end: str = "end") -> DataFrame:
    """Per group: whether its spans follow each other without gap or overlap, how far they reach, and their total height."""
    before = F.max(end).over(W.partitionBy(by).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    off = spans.withColumn("_off", F.col(start) != F.coalesce(before, F.lit(0)))
    return off.groupBy(by).agg((~F.bool_or("_off")).alias("contiguous"), F.max(end).alias("covered"), F.round(F.sum(height), 2).alias("height"), F.count("*").alias("lines"))


def range_integrity(paragraphs: DataFrame, spans: DataFrame, separators: DataFrame, by: str) -> DataFrame:
    """(by, reason) of the first violation of each paragraph, in the order of the checks.

    `paragraphs` has (by, length), `spans` (by, n, id, start, end) and `separators` (by, n, start, end). A bad length, then no
    spans; per span in order a repeated id, a negative or missing offset, start after end, an end beyond the paragraph,
    overlap with the span before; then per separator the same, and overlap with any span.
    """
    start, end, size = F.col("start"), F.col("end"), F.col("length")
    whole = paragraphs.select(by, F.when(size.isNull() | (size < 0), "paragraph-length-mismatch").alias("why")).filter("why is not null")
    whole = whole.union(paragraphs.join(spans, by, "left_anti").filter(size >= 0).select(by, F.lit("empty-segments")))
    negative = start.isNull() | end.isNull() | (start < 0) | (end < 0)
    again = F.row_number().over(W.partitionBy(by, "id").orderBy("n")) > 1
    before = F.lag("end").over(W.partitionBy(by).orderBy("n"))
    why = F.when(again, "duplicate-segment-id").when(negative, "negative-offset").when(start > end, "start-gt-end").when(end > size, "out-of-paragraph").when(start < before, "overlap")
    bad = spans.join(paragraphs, by).select(by, F.lit(1).alias("part"), "n", why.alias("why"))
    s = spans.select(by, F.col("start").alias("s0"), F.col("end").alias("s1"))
    hit = separators.join(s, by).filter((start < F.col("s1")) & (F.col("s0") < end)).select(by, "n").distinct().withColumn("hit", F.lit(True))
    wrong = F.when(start.isNull() | end.isNull(), "negative-offset").when((start < 0) | (end < start), "separator-overlap").when(end > size, "out-of-paragraph").when(F.col("hit"), "separator-overlap")
    parted = separators.join(paragraphs, by).join(hit, [by, "n"], "left").select(by, F.lit(2).alias("part"), "n", wrong.alias("why"))
    every = whole.select(by, F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), "why").union(bad).union(parted).filter("why is not null")
    return every.groupBy(by).agg(F.min_by("why", F.struct("part", "n")).alias("reason"))


def residual_band(before: DataFrame, after: DataFrame, band: float = 0.6) -> DataFrame:
    """Characters still near a line's baseline: rows meet on whole-number buckets of y and their neighbours."""
    b = before.select("doc", "line", F.col("y").alias("y0"), F.explode(F.array(F.floor("y") - 1, F.floor("y"), F.floor("y") + 1)).alias("bucket"))
    a = after.select("doc", F.col("y").alias("y1"), "text", F.floor("y").alias("bucket"))
    return b.join(a, ["doc", "bucket"]).filter(F.abs(F.col("y0") - F.col("y1")) <= band).groupBy("doc", "line").agg(F.sum(F.length("text")).alias("residual")).filter("residual > 0")


def bind_runs(runs: DataFrame, candidates: DataFrame, near: float = 3.0) -> DataFrame:
    """Each run's source of equal text on the page: strong if one, else the only one whose place is near."""
    met = runs.join(candidates, ["doc", "page", "text"], "left").withColumn("_near", F.abs(F.col("x") - F.col("cx")) <= near)
    out = met.groupBy("doc", "page", "seq").agg(F.count("cseq").alias("n"), F.count_if("_near").alias("close"), F.min("cseq").alias("only"), F.min(F.when(F.col("_near"), F.col("cseq"))).alias("at"))
    how = F.when(F.col("n") == 1, "strong").when((F.col("n") > 1) & (F.col("close") == 1), "placed").otherwise("none")
    return out.select("doc", "page", "seq", how.alias("binding"), F.when(F.col("n") == 1, F.col("only")).when(how == "placed", F.col("at")).alias("source"))


def split_paragraph(rows: DataFrame, text: str = "text", lines: str = "lines") -> DataFrame:
    """Text in so many lines: its own newlines if they are enough, else equal shares of its words; n counts a text's lines from 0, of `parts`.

    A blank at the end of a text makes an empty word there, and a text of no words has one line.
    """
    own, words = F.split(text, "\n"), F.split(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), " ")
    split = rows.withColumn("_words", F.when(F.size(own) < F.col(lines), words))  # split once
    size = F.ceil(F.size("_words") / F.col(lines)).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.col(lines) - 1), lambda i: i * size < F.size("_words"))
    parts = F.transform(places, lambda i: F.array_join(F.slice("_words", (i * size + 1).cast("int"), size), " "))
    split = split.withColumn("_parts", F.when(F.col("_words").isNull(), own).otherwise(parts)).withColumn("parts", F.size("_parts").cast("long")).drop("_words")
    return split.select("*", F.posexplode("_parts").alias("n", "part")).drop("_parts")
