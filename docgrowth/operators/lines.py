"""Line-level layout: clusters of glyphs, stability, text of blocks, cells of a row, fused layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.numbers import half_up


def y_cluster(items: DataFrame, share: float = 0.5) -> DataFrame:
    """Items of a page by line: centre within `share` of the page's mean height from the line's first item."""
    mean = items.groupBy("page").agg((share * F.avg("h")).alias("near"), F.array_sort(F.collect_list(F.struct((F.col("y") + F.col("h") / 2).alias("c"), "x", "block"))).alias("items"))
    start = F.struct(F.lit(float("-inf")).alias("first"), F.lit(-1).alias("line"), F.array().cast("array<struct<line:int,block:bigint>>").alias("out"))

    def fold(s: Column, i: Column) -> Column:
        fresh = i["c"] - s["first"] > F.col("near")
        line = s["line"] + fresh.cast("int")
        return F.struct(F.when(fresh, i["c"]).otherwise(s["first"]).alias("first"), line.alias("line"), F.concat(s["out"], F.array(F.struct(line.alias("line"), i["block"].cast("long").alias("block")))).alias("out"))

    return mean.select("page", F.explode(F.aggregate("items", start, fold)["out"]).alias("o")).select("page", "o.line", "o.block")


def line_stability(lines: DataFrame) -> DataFrame:
    """Score of a page's line breaks, 0 to 100: width fit (gaussian around 0.9), phrase ends, balance of words, and a constant."""
    widest = F.max("w").over(W.partitionBy("page"))
    fit = F.exp(-F.pow((F.col("w") / widest - 0.9) / 0.1, 2) / 2)
    words = F.size(F.split("text", " "))
    marked = lines.withColumn("fit", fit).withColumn("words", words).withColumn("phrase", F.col("text").rlike("[.,;:!?]$").cast("double"))
    balance = F.greatest(F.lit(0.0), 1 - F.coalesce(F.var_pop("words") / F.pow(F.avg("words"), 2), F.lit(0.0)))
    score = 0.35 * F.avg("fit") + 0.35 * F.avg("phrase") + 0.2 * balance + 0.1
    return marked.groupBy("page").agg(half_up(F.round(score * 100, 6)).alias("score"))


def block_text(items: DataFrame, least: float = 2.0, share: float = 0.3) -> DataFrame:
    """Text of a page's items by line (new line where y leaves the line's first by more than max(least, share of its height)), and the box around them."""
    page = items.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "text", "h"))).alias("items"), F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("near"), F.lit("").alias("text"), F.lit(0).alias("lines"))

    def fold(s: Column, i: Column) -> Column:
        fresh = s["y"].isNull() | (F.abs(i["y"] - s["y"]) > s["near"])
        text = F.when(s["y"].isNull(), i["text"]).when(fresh, F.concat(s["text"], F.lit("\n"), i["text"])).otherwise(F.concat(s["text"], i["text"]))
        return F.struct(F.when(fresh, i["y"]).otherwise(s["y"]).alias("y"), F.when(fresh, F.greatest(F.lit(least), share * i["h"])).otherwise(s["near"]).alias("near"), text.alias("text"), (s["lines"] + fresh.cast("int")).alias("lines"))

    return page.withColumn("t", F.aggregate("items", start, fold)).select("page", "left", "right", F.col("t.text").alias("text"), F.col("t.lines").alias("lines"))


def table_row_cells(words: DataFrame, font: float, share: float = 0.02, least: int = 3, narrow: float = 0.6, wide: float = 3.0) -> DataFrame:
    """(page, row, how, cells): the cells of rows that are rows of a table; other rows have none.

    `words` has page, row, x, w and text. Between two words lies a blank; where the left edges after blanks are nearly
    equally far apart `least` times in a run (within `share` of the run's mean), and the blanks of the run are at least
    `narrow` font sizes, the row is cut at all blanks of at least half the median one ("even"). Else, where exactly
    one blank is at least `wide` font sizes, it is cut there ("gap"). Words of a cell are joined by a blank.
    """
    page = words.groupBy("page", "row").agg(F.array_sort(F.collect_list(F.struct("x", "w", "text"))).alias("words"))
    after = F.slice("words", 2, F.size("words"))
    page = page.withColumn("lefts", F.transform(after, lambda i: i["x"])).withColumn("blanks", F.transform(after, lambda i, k: i["x"] - F.get("words", k)["x"] - F.get("words", k)["w"]))
    page = page.filter(F.size("lefts") > 0).withColumn("gaps", F.transform(F.slice("lefts", 2, F.size("lefts")), lambda v, k: v - F.get("lefts", k)))
    start = F.struct(*(F.lit(v).alias(k) for k, v in (("at", 0), ("first", 0), ("n", 0), ("sum", 0.0), ("most", 0), ("begin", -1))))

    def run(s: Column, g: Column) -> Column:
        mean = (s["sum"] + g) / (s["n"] + 1)
        goes = (s["n"] > 0) & (mean > 0) & (F.abs(g - mean) / mean <= share)
        first, n = F.when(goes, s["first"]).otherwise(s["at"]), F.when(goes, s["n"] + 1).otherwise(1)
        return F.struct((s["at"] + 1).alias("at"), first.alias("first"), n.alias("n"), F.when(goes, s["sum"] + g).otherwise(g).alias("sum"), F.greatest(n, s["most"]).alias("most"), F.when(n > s["most"], first).otherwise(s["begin"]).alias("begin"))

    page = page.withColumn("run", F.aggregate("gaps", start, run))
    inside = F.slice("blanks", F.col("run.begin") + 2, F.col("run.most"))
    even = (F.col("run.most") >= least) & F.forall(inside, lambda v: v >= narrow * font)
    one = F.size(F.filter("blanks", lambda v: v >= wide * font)) == 1
    ordered, n = F.array_sort("blanks"), F.size("blanks")
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    page = page.withColumn("how", F.when(even, "even").when(one, "gap")).filter("how is not null")
    page = page.withColumn("cut", F.when(F.col("how") == "even", median / 2).otherwise(wide * font))
    parts = F.transform("words", lambda i, k: F.concat(F.when(k == 0, "").when(F.get("blanks", k - 1) >= F.col("cut"), "\n").otherwise(" "), i["text"]))
    return page.select("page", "row", "how", F.split(F.array_join(parts, ""), "\n").alias("cells"))


def fuse_text_layers(blocks: DataFrame, lines: DataFrame, height: float = 12.0) -> DataFrame:
    """(page, block, line, y, text, how): the lines of each block.

    Text lines within a line height of the block's band, by y ("layer"; met on whole buckets of y). A block that has none
    is split evenly ("split"): into as many lines as fit its height, by its own line ends if it has that many, else by
    equal numbers of words. Blocks without text or width stay one line ("whole").
    """
    size = 2 * height
    b = blocks.select("page", "block", F.explode(F.sequence(F.floor((F.col("y") - height) / size), F.floor((F.col("y") + F.col("h") + height) / size))).alias("bucket"), "y", "h")
    ln = lines.select("page", F.col("y").alias("ly"), F.col("text").alias("ltext"), F.floor(F.col("y") / size).alias("bucket"))
    met = b.join(ln, ["page", "bucket"]).filter((F.col("ly") >= F.col("y") - height) & (F.col("ly") <= F.col("y") + F.col("h") + height))
    found = met.groupBy("page", "block").agg(F.array_sort(F.collect_list(F.struct("ly", "ltext"))).alias("found"))
    n = F.greatest(half_up(F.col("h") / height), F.lit(1)).cast("int") if height > 0 else F.lit(1)
    own = F.filter(F.split("text", "\n"), lambda t: t != "")
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    each = F.ceil(F.size(words) / F.col("n")).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.array_join(F.slice(words, k * each + 1, each), " "))
    even = F.when(F.size(own) >= F.col("n"), F.slice(own, 1, F.col("n"))).when((F.col("n") == 1) | (F.size(words) == 0), F.array("text")).otherwise(F.filter(dealt, lambda t: t != ""))
    line = lambda y, text: F.struct(y.alias("y"), text.alias("text"))
    whole = (F.coalesce(F.length("text"), F.lit(0)) == 0) | (F.coalesce(F.col("w"), F.lit(0)) == 0)
    out = blocks.select("page", "block", F.col("y").cast("double").alias("y"), "w", "h", "text").join(found, ["page", "block"], "left").withColumn("n", n)
    how = F.when(F.col("found").isNotNull(), "layer").when(whole, "whole").otherwise("split")
    made = F.when(how == "layer", F.transform("found", lambda i: line(i["ly"] - 0.8 * height, i["ltext"]))).when(how == "whole", F.array(line(F.col("y"), F.col("text")))).otherwise(F.transform(even, lambda t, k: line(F.col("y") + k * height, t)))
    return out.select("page", "block", how.alias("how"), F.posexplode(made).alias("line", "l")).select("page", "block", "line", "l.y", "l.text", "how")
