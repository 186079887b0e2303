"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of element paths (tag and class, repeated
siblings as one). A branch's importance joins two entropies, both 0 for what is the same
on every page and 1 for what is new on each. Presentation: of the sequences of children
that its element has. Content: of what is below it, path by path, each path weighted by
how much its occurrences could tell; over c occurrences of each of a path's texts it is
1 - sum(c log c) / (m log m), m = sum(c). Of blocks whose text is mostly links (menus,
lists of other pages) the features are the links, the images and the words instead of the
whole text, over c of the path's M pages each: 1 - sum(c log c) / (m log M); so a menu of
which one entry changes is still the same menu. An element with l sequences of children has
(1 - .9^l) of its importance from presentation, the rest from content; the texts directly
in an element are a branch of their own, by content only. Branches of low importance are
cut from every page, elements only if nothing below them is important.

Marks are a prior: elements that by their tag, class, id or role hold no article text
(menus, forms, scripts, adverts, comments ...) have no importance, unless the mark is on a
wrapper of the article or of most of the page's text. An article or main element is a
prior too: where too few pages tell a text's importance, what is outside the page's articles goes.

Blocks are joined in page order by one space. Defined results: null html is empty; a
page without text gives an empty text; broken markup is read as far as it goes (an
unclosed comment, script or style hides the rest); pages of equal texts count once, and
so does a text or a sequence of children that a page repeats at a path; repeated rows get
their text each; an empty table gives no rows; columns `main_text` or beginning with `_site_` are refused. Whole pages
are read; elements nested deeper than `DEPTH` blocks count as their ancestor of that
depth, so memory and time grow with the page's length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrowth.functions.shared import written

# Elements by what they hold.
RAW = {"script", "style", "textarea", "xmp", "noscript", "template", "iframe", "noembed", "noframes"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NO_TEXT = {"head", "title", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "audio", "video", "datalist"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
BESIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "disqus", "replies", "sidebar", "side", "related",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup", "social", "share", "sharing", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "pagination", "pager", "widget", "toolbar", "login", "search", "tags", "toc",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
MAIN = {"article", "main"}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_EACH = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_REF = re.compile(r"\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z]+")
_LOW = 0.3
#: To the power of an element's number of sequences of children: the share of content in its importance; the rest is presentation's.
_CONTENT = 0.9
#: Levels of block elements that have a path of their own; of marks around an element as many count.
DEPTH = 32
#: Name of the branch of texts that stand directly in an element.
_TEXT = "#"

PATH_LIMIT_ROWS = 200_000


def _hidden(attributes: str) -> bool:
    """Whether an attribute, by its name, hides the element."""
    for name, *values in _EACH.findall(attributes):
        key, value = name.lower(), next(filter(None, values), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _NONE.search(value)):
            return True
    return False


def _style(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name in the style tree, whether it holds no article text, and whether it is only marked as such."""
    name, beside, marked = tag, tag in NO_TEXT and tag != "form", tag == "form"
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "")
            if key.lower() == "role":
                marked |= value.lower() in ROLES
            else:
                marked |= not BESIDE.isdisjoint(value.lower().split())
                if key.lower() == "class" and value:
                    name += "." + ".".join(sorted({w.lower() for w in _NAME.findall(value)}))
                    name = name if len(name) <= 60 else f"{tag}.{xxhash.xxh3_64_hexdigest(name)}"
        beside |= _hidden(attributes)
    return name, beside, marked and tag not in MAIN and tag not in ("html", "body")


Block = tuple[str, bool, str]


def blocks(page: str | None) -> Iterator[Block]:
    """(path, inside an article, text) of every block that the marks keep, in page order."""
    return ((path, inside, text) for path, inside, text, _ in featured(page))


def featured(page: str | None, styles: set[tuple[str, str]] | None = None) -> Iterator[tuple[str, bool, str, frozenset[str] | None]]:
    """As blocks(), with the links, images and words of blocks that are mostly links (else None); `styles` gets (path, children) of the elements.

    A mark (class, id, role, form) doesn't count on an element that holds all articles of
    the page, or most of the text of a page without articles.
    """
    articles: list[tuple[int, ...]] = []
    found = [*_parsed(page, articles, styles)]
    whole = sum(len(text) for *_, text, _ in found)
    held: dict[int, int] = {}
    for marks, text in ((m, " ") for m in articles) if articles else ((f[0], f[3]) for f in found):
        for k in marks:
            held[k] = held.get(k, 0) + len(text)
    free = {k for k, n in held.items() if (n == len(articles) if articles else 2 * n > whole)}
    yield from (rest for marks, *rest in found if free.issuperset(marks))


class _Open:
    """An open element: its tag, whether it holds no article text, whether it is in an article, the marked elements around it, its path and its children."""

    __slots__ = ("beside", "children", "depth", "inside", "marks", "path", "tag")

    def __init__(self, tag: str, beside: bool, inside: bool, marks: tuple[int, ...], path: str, depth: int) -> None:
        self.tag, self.beside, self.inside, self.marks, self.path, self.depth = tag, beside, inside, marks, path, depth
        self.children: list[str] = []


def _parsed(page: str | None, articles: list[tuple[int, ...]], styles: set[tuple[str, str]] | None) -> Iterator[tuple[tuple[int, ...], str, bool, str, frozenset[str] | None]]:
    """(marked elements around it, path, inside an article, text, features of links) of blocks; the marked elements around each article go to `articles`."""
    if not page:
        return
    root = _Open("", False, False, (), "", 0)
    stack: list[_Open] = []
    open_tags: dict[str, int] = {}
    text: list[str] = []
    refs: list[str] = []
    linked = 0  # characters of the open block that are in links
    at, size, last = 0, len(page), page.rfind(">")

    def child(of: _Open, name: str) -> None:
        if styles is not None and of.depth < DEPTH and (not of.children or of.children[-1] != name):
            of.children.append(name)

    def flush() -> Iterator[tuple[tuple[int, ...], str, bool, str, frozenset[str] | None]]:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                top = stack[-1] if stack else root
                child(top, _TEXT)
                yield top.marks, top.path, top.inside, joined, frozenset([*(f">{x}" for x in refs), *joined.lower().split()]) if 2 * linked > len(joined) else None
        refs.clear()
        linked = 0

    def pop(to: int) -> None:
        for e in stack[to:]:
            open_tags[e.tag] -= 1
            if styles is not None and e.tag not in INLINE and e.children and not e.beside:
                styles.add((e.path, " ".join(e.children)))
        del stack[to:]

    while at < size:
        m = _MARKUP.search(page, at) if at <= last or page.find("<", at) >= 0 else None
        end = m.start() if m else size
        if end > at and not (stack and stack[-1].beside):
            text.append(html.unescape(page[at:end]))
            linked += len(text[-1].strip()) if open_tags.get("a") else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if m[1] or m[4]:
            if tag == "br" or not inline:
                yield from flush()
            for k in range(len(stack) - 1, -1, -1) if open_tags.get(tag) else ():
                if stack[k].tag == tag:
                    pop(k)
                    break
                if inline and stack[k].tag not in INLINE:
                    break
            continue
        if not inline:
            yield from flush()
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else size
            continue
        if (tag == "a" or tag == "img") and (ref := _REF.search(m[3] or m[6] or "")):
            refs.append(next(filter(None, ref.groups()), ""))
        if tag in EMPTY:
            continue
        if not inline:  # an open paragraph, list item or cell ends where the next begins
            closes = "p" if tag in CLOSES_P else tag if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else None
            for k in range(len(stack) - 1, -1, -1) if closes and open_tags.get(closes) else ():
                if stack[k].tag == closes:
                    pop(k)
                    break
                if stack[k].tag not in INLINE and stack[k].tag != "p":
                    break
        name, beside, marked = _style(tag, m[3] or m[6] or "")
        above = stack[-1] if stack else root
        if tag == "header" and not above.inside:
            beside = True
        beside |= above.beside or (marked and inline)
        marks = (*above.marks, at) if marked and len(above.marks) < DEPTH else above.marks
        if tag in MAIN and not beside:
            articles.append(marks)
        path, depth = (above.path, above.depth) if inline or above.depth >= DEPTH else (f"{above.path}>{name}" if above.path else name, above.depth + 1)
        if not inline and not beside:
            child(above, name)
        stack.append(_Open(tag, beside, above.inside or tag in MAIN, marks, path, depth))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    yield from flush()
    pop(0)


def branches(path: str) -> list[str]:
    """The branches that a block of the path is in: each element from the root, and the texts directly in the last."""
    names = path.split(">") if path else []
    return [*(">".join(names[: k + 1]) for k in range(len(names))), f"{path}>{_TEXT}" if path else _TEXT]


def main_text(page: str | None, low: frozenset[str] | set[str] = frozenset(), high: frozenset[str] | set[str] = frozenset()) -> str:
    """The page's blocks without branches of low importance; where the host's pages tell nothing of a text, an article excludes what is outside."""
    found = [*blocks(page)]
    article = any(inside for _, inside, _ in found)
    cut = {path: not low.isdisjoint(branches(path)) for path in {path for path, *_ in found}} if low else {}
    keep = lambda path, inside: inside or not article or branches(path)[-1] in high
    return " ".join(text for path, inside, text in found if not cut.get(path) and keep(path, inside))


_WHOLE, _STYLE, _LINKS, _PAGES = range(4)


def judged_branches(pages: DataFrame, host: Column, page: str = "html", least: float = _LOW, pages_needed: int = 5) -> DataFrame:
    """(host, low, high): per host the branches to cut, and the texts of high importance, as far as at least `pages_needed` occurrences tell."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda text: xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)
        for b in batches:
            rows = []
            for h, p in zip(b["host"], b["page"], strict=True):
                styles: set[tuple[str, str]] = set()
                found = [*featured(p, styles)]
                own = digest("\n".join(text for _, _, text, _ in found))
                rows += {(h, path, _WHOLE, digest(text), own) for path, _, text, links in found if links is None}
                rows += {(h, path, _LINKS, digest(x), own) for path, _, _, links in found if links is not None for x in links}
                rows += {(h, path, _PAGES, 0, own) for path, _, _, links in found if links is not None}
                rows += {(h, path, _STYLE, digest(s), own) for path, s in styles}
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows)
                    rows = []
            if rows:
                yield pd.DataFrame(rows)

    found = pages.select(host.alias("host"), F.col(page).alias("page")).mapInPandas(parse, "host string, path string, kind int, content long, own long")
    each = found.distinct().groupBy("host", "path", "kind", "content").agg(F.count("*").alias("c"))
    told = written(each.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count("*").alias("each")), "entropies")
    of = lambda kind: told.filter(F.col("kind") == kind)
    linked = of(_LINKS).join(of(_PAGES).select("host", "path", F.col("m").alias("seen")), ["host", "path"]).select("host", "path", "s", (F.col("m") * F.log("seen")).alias("most"), "seen")
    texts = of(_WHOLE).select("host", "path", "s", (F.col("m") * F.log("m")).alias("most"), F.col("m").alias("seen")).union(linked)
    names = F.split("path", ">")
    above = F.when(F.col("path") == "", F.array(F.lit(_TEXT))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), ">")), F.array(F.concat("path", F.lit(f">{_TEXT}")))))
    below = texts.select("host", F.explode(above).alias("branch"), "seen", "s", "most")  # as branches() has them
    content = below.groupBy("host", "branch").agg(F.max("seen").alias("seen"), (1 - F.sum("s") / F.nullif(F.sum("most"), F.lit(0.0))).alias("content"))
    shown = of(_STYLE).select("host", F.col("path").alias("branch"), (1 - F.col("s") / F.nullif(F.col("m") * F.log("m"), F.lit(0.0))).alias("shown"), "each")
    joined = content.join(shown, ["host", "branch"], "left").filter(F.col("seen") >= pages_needed)
    share = F.pow(F.lit(_CONTENT), F.col("each"))
    judged = joined.select("host", "branch", F.when(F.col("shown").isNull(), F.col("content")).otherwise((1 - share) * F.col("shown") + share * F.col("content")).alias("importance"), F.col("branch").endswith(_TEXT).alias("of_text"))
    judged = written(judged.withColumn("slight", F.col("importance") < least), "importance")
    parts = F.split("branch", ">")
    around = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), ">"))
    holding = judged.filter("NOT slight AND instr(branch, '>') > 0").select("host", F.explode(around).alias("branch")).distinct()
    cut = judged.filter("slight AND of_text").select("host", "branch").union(judged.filter("slight AND NOT of_text").select("host", "branch").join(holding, ["host", "branch"], "left_anti"))
    marked = cut.withColumn("slight", F.lit(True)).union(judged.filter("of_text AND NOT slight").select("host", "branch", "slight"))
    named = lambda wanted: F.sort_array(F.collect_list(F.when(wanted, F.col("branch"))))
    return marked.groupBy("host").agg(named(F.col("slight")).alias("low"), named(~F.col("slight")).alias("high"))


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """pages with a column `main_text`; hosts are those of `url`."""
    from docgrowth.llm.urls import host_and_path

    if taken := [c for c in pages.columns if c == "main_text" or c.startswith("_site_")]:
        raise ValueError(f"pages already have {taken}")
    host = host_and_path(F.col(url))[0]
    judged = written(judged_branches(pages, host, page), "judged")
    small = judged.agg(F.coalesce(F.sum(F.size("low") + F.size("high")), F.lit(0))).first()[0] <= PATH_LIMIT_ROWS
    judged = judged.select(F.col("host").alias("_site_host"), F.col("low").alias("_site_low"), F.col("high").alias("_site_high"))

    @F.pandas_udf("string")
    def text(p: pd.Series, host: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        known: dict[str | None, tuple[set[str], set[str]]] = {}  # of the batch's hosts
        for h, *sets in zip(host, low, high, strict=True):
            if h not in known:
                known[h] = tuple(set(u) if u is not None else set() for u in sets)
        return pd.Series([main_text(x, *known[h]) for x, h in zip(p, host, strict=True)], dtype=object)

    met = pages.withColumn("_site_host", host).join(F.broadcast(judged) if small else judged, "_site_host", "left")
    return met.withColumn("main_text", text(page, "_site_host", "_site_low", "_site_high")).drop("_site_host", "_site_low", "_site_high")
