"""Keyword and page catalogue operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.numbers import at_least

# Words that expand a keyword, before it and after it.
ACTIONS = (
    "edit", "merge", "split", "compress", "convert", "rotate", "sign", "unlock", "resize", "delete pages from", "extract pages from", "reorder pages in", "add text to", "add image to",
    "remove text from", "remove image from", "watermark", "stamp", "number pages in", "flatten", "optimize", "reduce size of", "change format of",
)
QUALIFIERS = (
    "online free", "free online", "in browser", "without signup", "without watermark", "without installing software", "quickly", "in seconds",
    "on mac", "on windows", "on linux", "on mobile", "high quality", "for free", "no limits",
)
MODIFIERS = ("free", "online", "without signup", "no watermark", "best", "alternative", "tool", "editor", "in browser", "for free", "no limits")
INTENTS = ("how to {keyword}", "{keyword} on mac", "{keyword} on mobile", "{keyword} for free", "{keyword} without installing")
COMMERCIAL = ("best {keyword}", "{keyword} alternative", "{keyword} vs", "top {keyword}", "{keyword} review")
# Templates of pages, with places for the keyword and the product's name.
TITLES = (
    "Free online {keyword} tool — No signup needed", "Best way to {keyword} in seconds", "{keyword} — fast & secure PDF tool", "How to {keyword} online for free",
    "{keyword} instantly in your browser", "The easiest way to {keyword}", "Free {keyword} — no limits, no watermark", "{keyword} online — try it now",
)
HEADINGS = ("Free Online Tool to {keyword}", "How to {keyword} — Fast & Free", "{keyword} Online", "Best {keyword} Tool")
DESCRIPTIONS = (
    "Use {product} to {keyword} instantly in your browser. No signup, no watermark, 100% free.",
    "Free online tool to {keyword}. Fast, secure, and works on any device. Try it now!",
    "Looking to {keyword}? {product} makes it easy. Free, browser-based, no installation needed.",
)
BUTTON = '<div class="cta-box">\n  <a href="/editor" class="cta-button">Start {keyword} Now — Free →</a>\n</div>'
SECTIONS = (
    "<h2>How to {keyword}</h2>\n<p>Upload your PDF file, make your changes, and download the result. It's that simple with {product}.</p>\n"
    "<p>No software to install, no account to create. Everything runs securely in your browser.</p>",
    "<h2>Why Choose {product} for {keyword}?</h2>\n<ul>\n  <li>✅ 100% free — no hidden fees or credit card required</li>\n  <li>✅ No signup or registration needed</li>\n"
    "  <li>✅ Works in your browser — nothing to download</li>\n  <li>✅ No file size limits</li>\n  <li>✅ No watermarks on your documents</li>\n  <li>✅ Fast processing — results in seconds</li>\n</ul>",
    '<h2>What Users Say</h2>\n<p>"{product} is the best tool for {keyword}. I use it every day and it never disappoints."</p>\n'
    '<p>"Finally a free tool that works! No limits, no tricks, just {keyword} done right."</p>',
    "<h2>Frequently Asked Questions</h2>\n<h3>Is it really free to {keyword}?</h3>\n<p>Yes! {product} is completely free. There are no hidden charges, no premium tiers, and no credit card required.</p>\n"
    "<h3>Do I need to create an account?</h3>\n<p>No account needed. Just upload your file and start editing immediately.</p>\n<h3>Is my data secure?</h3>\n"
    "<p>Yes. All processing happens in your browser. Your files are never uploaded to our servers unless you choose to export.</p>",
)
FAQ = (
    ("How to {keyword}?", 'Upload your PDF file to {product}, select "{keyword}" option, and download the result. No signup required, works in your browser instantly.'),
    ("Is {keyword} free?", "Yes! {product} offers {keyword} completely free. No hidden charges, no watermark, and no credit card required."),
    ("Can I {keyword} online without installing software?", "Absolutely. Everything runs directly in your browser. No downloads, no installations, no plugins needed."),
    ("Is it safe to {keyword}?", "Yes. All PDF processing happens in your browser. Your files are never uploaded to our servers during processing."),
    ("What is the best tool to {keyword}?", "{product} is the top-rated free tool for {keyword}. It's fast, secure, and works on any device with zero limits."),
    ("Can I {keyword} on mobile?", "Yes, {product} works on any device with a modern browser, including phones and tablets."),
)
COMPETITOR_FAQ = (
    ("Is {keyword} free?", "{keyword} offers limited free features with watermarks. {product} is completely free with no restrictions."),
    ("Why choose {product} over {keyword}?", "{product} requires no signup, has no watermarks, processes files in your browser, and offers unlimited free usage."),
    ("Does {keyword} have file size limits?", "{keyword} restricts file sizes on its free tier. {product} has no file size limits."),
)
COMPETITOR = "Looking for a free alternative to {keyword}? {product} offers everything {keyword} does — no signup, no watermark, 100% browser-based."
#: The product's name where none is given.
PRODUCT = "our tool"


def filled(template: Column | str, keyword: Column, product: str = PRODUCT) -> Column:
    """A template with the keyword and the product's name in their places."""
    t = F.lit(template) if isinstance(template, str) else template
    return F.replace(F.replace(t, F.lit("{product}"), F.lit(product)), F.lit("{keyword}"), keyword)


def keyword_search(k: DataFrame, q: str, first: int | None = None) -> DataFrame:
    """Keywords that hold q in keyword or category, in any case; with `first` so many of them in table order, each with the `total`."""
    low = q.lower()
    found = k.filter(F.lower("keyword").contains(low) | F.lower("category").contains(low))
    return found.orderBy("seq").limit(first).join(F.broadcast(found.agg(F.count("*").alias("total")))) if first else found


def keywords_by_category(k: DataFrame, category: str) -> DataFrame:
    return k.filter(F.col("category") == category)


def low_difficulty(k: DataFrame, most: int = 30) -> DataFrame:
    return k.filter(F.col("difficulty") <= most).orderBy(F.desc("volume"), "seq")


def high_volume(k: DataFrame, least: int = 1000) -> DataFrame:
    return k.filter(F.col("volume") >= least).orderBy("difficulty", "seq")


def best_opportunities(k: DataFrame, most: int = 40, least: int = 500, top: int | None = None) -> DataFrame:
    """Keywords of low difficulty and enough volume, by volume over difficulty."""
    out = k.filter((F.col("difficulty") <= most) & (F.col("volume") >= least)).withColumn("chance", F.col("volume") / F.col("difficulty")).orderBy(F.desc("chance"), "seq")
    return out.limit(top) if top else out


def high_cpc(k: DataFrame, least: float = 2.0) -> DataFrame:
    return k.filter(F.col("cpc") >= least).orderBy(F.desc("cpc"), "seq")


def total_volume(k: DataFrame) -> DataFrame:
    return k.agg(F.sum("volume").alias("volume"))


def category_list(k: DataFrame) -> DataFrame:
    """Distinct categories with the place where each is first seen."""
    return k.groupBy("category").agg(F.min("seq").alias("first_seq"))


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def expand_keywords(k: DataFrame, limit: int | None = 1500) -> DataFrame:
    """Base, "action base", "base qualifier" and "action base qualifier" of each keyword, distinct in order, the first `limit`.

    Each distinct keyword is a phrase of its own, so the first `limit` keywords make enough.
    """
    k = k.groupBy("keyword").agg(F.min("seq").alias("seq"))
    k = k.orderBy("seq").limit(limit) if limit else k
    base = F.col("keyword")
    before = F.transform(_words(ACTIONS), lambda a: F.concat_ws(" ", a, base))
    after = F.transform(_words(QUALIFIERS), lambda q: F.concat_ws(" ", base, q))
    both = F.flatten(F.transform(_words(ACTIONS), lambda a: F.transform(_words(QUALIFIERS), lambda q: F.concat_ws(" ", a, base, q))))
    rows = k.select("seq", F.posexplode(F.concat(F.array(base), before, after, both)).alias("at", "phrase"))
    first = rows.groupBy("phrase").agg(F.min(F.struct("seq", "at")).alias("first")).select("phrase", "first.seq", "first.at")
    return first.orderBy("seq", "at").limit(limit) if limit else first


def keyword_discovery(k: DataFrame, n: int | None = None) -> DataFrame:
    """A seed's phrases with modifiers, intents and commercial words: (seed, place, phrase, related), distinct in order.

    The first n are the seed's cluster; `related` marks the five after the seed itself.
    """
    s = F.col("keyword")
    forms = [F.concat_ws(" ", s, F.lit(m)) for m in MODIFIERS] + [filled(t, s) for t in INTENTS + COMMERCIAL]
    phrases = F.array_distinct(F.array(s, *forms))
    rows = k.select(s.alias("seed"), F.posexplode(F.slice(phrases, 1, n) if n else phrases).alias("place", "phrase"))
    return rows.withColumn("related", F.col("place").between(1, 5))


def slugify_keyword(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "-")


def slugify_brand(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def _picked(templates: tuple[str, ...], slug: Column, what: str) -> Column:
    """One of the templates, by a hash of the slug."""
    return F.element_at(_words(templates), (F.crc32(F.concat(slug, F.lit(what))) % len(templates)).cast("int") + 1)


def page_factory(k: DataFrame, product: str = PRODUCT) -> DataFrame:
    """A page per keyword from templates, which a hash of the slug picks; missing, zero and empty fields get defaults.

    The body is two or three sections between two buttons.
    """
    word = F.col("keyword")
    slug = slugify_keyword(word)
    first = (F.crc32(F.concat(slug, F.lit("sections"))) % len(SECTIONS)).cast("int") + 1
    some = F.slice(F.concat(_words(SECTIONS), _words(SECTIONS)), first, (F.crc32(F.concat(slug, F.lit("how many"))) % 2).cast("int") + 2)
    body = F.array_join(F.concat(F.array(F.lit(BUTTON)), some, F.array(F.lit(BUTTON))), "\n")
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000))
    return k.select(
        "seq", slug.alias("slug"), filled(_picked(TITLES, slug, "title"), word, product).alias("title"), filled(_picked(HEADINGS, slug, "h1"), capital, product).alias("h1"),
        filled(_picked(DESCRIPTIONS, slug, "description"), word, product).alias("description"), filled(body, word, product).alias("content"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("general")).alias("category"), F.coalesce(F.nullif("volume", F.lit(0)), F.lit(1000)).alias("volume"),
        F.coalesce(F.nullif("difficulty", F.lit(0)), F.lit(30)).alias("difficulty"),
    )


def competitor_pages(brands: DataFrame, brand: str = "brand", product: str = PRODUCT) -> DataFrame:
    """A comparison page per brand."""
    b = F.col(brand)
    title, h1 = F.concat(F.lit("Best "), b, F.lit(" Alternative — Free & Better")), F.concat(b, F.lit(" Alternative"))
    return brands.select(brand, F.concat(slugify_brand(b), F.lit("-alternative")).alias("slug"), title.alias("title"), h1.alias("h1"), filled(COMPETITOR, b, product).alias("description"))


def faq_rows(k: DataFrame, faq: tuple[tuple[str, str], ...] = FAQ, product: str = PRODUCT) -> DataFrame:
    """Questions and answers per keyword, from templates."""
    rows = F.array(*(F.struct(filled(q, F.col("keyword"), product).alias("question"), filled(a, F.col("keyword"), product).alias("answer")) for q, a in faq))
    return k.select("seq", F.posexplode(rows).alias("place", "qa")).select("seq", "place", "qa.question", "qa.answer")


def internal_links(pages: DataFrame, most: int = 5) -> DataFrame:
    """Per page up to `most` others: those of its category first (missing equals missing), then the rest, in table order.

    Only the first most + 1 pages of each category can be chosen, so these are the
    candidates; no page is compared with all others. Categories are few.
    """
    p = pages.select("seq", "category")
    rank = lambda w: F.row_number().over(w)
    own = p.withColumn("n", rank(W.partitionBy("category").orderBy("seq"))).filter(F.col("n") <= most + 1).select(F.col("category").alias("c"), F.col("seq").alias("link"))
    same = p.join(own, F.col("category").eqNullSafe(F.col("c"))).filter("seq <> link").select("seq", "link", F.lit(0).alias("other"))
    # Of what is in other categories only the first `most` can be chosen: one short list per category.
    kinds = own.select(F.col("c").alias("category")).distinct()
    others = kinds.join(own, ~F.col("category").eqNullSafe(F.col("c"))).withColumn("n", rank(W.partitionBy("category").orderBy("link"))).filter(F.col("n") <= most)
    others = others.select(F.col("category").alias("k"), F.col("link"))
    rest = p.join(others, F.col("category").eqNullSafe(F.col("k"))).select("seq", "link", F.lit(1).alias("other"))
    return same.union(rest).withColumn("place", rank(W.partitionBy("seq").orderBy("other", "link"))).filter(F.col("place") <= most).select("seq", "place", "link")


def sitemap(k: DataFrame, day: str | None = None, root: str = "/") -> DataFrame:
    """An entry per page, as of `day` (today where none is given); easier keywords come first."""
    d = F.coalesce("difficulty", F.lit(100))
    when = F.current_date() if day is None else F.lit(day).cast("date")
    priority = F.when(d < 30, 1.0).when(d < 50, 0.8).otherwise(0.6)
    return k.select(F.concat(F.lit(root), slugify_keyword(F.col("keyword"))).alias("loc"), "seq", F.date_format(when, "yyyy-MM-dd").alias("lastmod"), priority.alias("priority"))


def page_lookup(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Each wanted slug's page, matched in any case with "-" as " "; a made-up page where there is none."""
    asked = wanted.withColumn("_key", F.lower(F.replace("slug", F.lit("-"), F.lit(" "))))
    had = pages.groupBy(F.lower("keyword").alias("_key")).agg(F.min_by("category", "seq").alias("category"))
    met = asked.join(had, "_key", "left")
    return met.select("slug", F.coalesce("category", F.lit("general")).alias("category"), F.col("category").isNotNull().alias("known"))


def pipeline_report(seed: DataFrame, page_perf: DataFrame) -> DataFrame:
    """What a seed makes, in one row: phrases, competitor pages, dead pages, pages to scale."""
    from docgrowth.operators.growth import dead_pages, roi_decision

    phrases = keyword_discovery(seed).agg(F.count("*").alias("phrases"))
    dead = dead_pages(page_perf).agg(F.count_if("dead").alias("dead"))
    scaled = roi_decision(page_perf).agg(F.count_if(F.col("decision") == "SCALE").alias("scaled"))
    return phrases.crossJoin(dead).crossJoin(scaled)


def missing_keys(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return used.select(key).distinct().join(known.select(key), key, "left_anti")


def merge_dictionaries(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Both dictionaries in one; the first wins."""
    two = second.select(key, F.col(value).alias("_value"))
    return first.join(two, key, "full").select(key, F.coalesce(value, "_value").alias(value))
