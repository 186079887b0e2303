"""Rule scoring, classification, entity extraction, search and rewrite over document texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrowth.functions.numbers import half_up

# Words that signal a kind of document.
TABLE = ("|", "table", "column", "row")
FINANCE = ("invoice", "amount", "total", "tax", "payment", "balance", "usd", "amount due", "subtotal", "receipt", "transaction", "refund")
CONTRACT = ("agreement", "contract", "party", "terms", "liability", "termination", "hereby", "indemnify", "confidential", "clause")
HINT_FINANCE = ("invoice", "amount", "total", "tax", "payment", "balance", "usd")
HINT_CONTRACT = ("agreement", "contract", "party", "terms", "liability")
INVOICE = ("invoice", "total", "tax", "amount due", "bill to", "payment", "subtotal", "qty", "quantity", "unit price")
BANK = ("account", "balance", "deposit", "withdrawal", "statement", "transaction", "beginning balance", "ending balance", "interest", "fee")
REPORT = ("report", "summary", "table of contents", "introduction", "conclusion", "appendix", "figure", "chart")
RESUME5 = ("experience", "education", "skills", "employment", "curriculum", "vitae", "resume")
INVOICE5 = ("invoice", "total", "tax", "amount", "bill", "payment", "subtotal")
REPORT5 = ("report", "summary", "introduction", "conclusion", "methodology", "findings")
LETTER5 = ("dear", "sincerely", "regards", "enclosed", "attached")
VALUES = {"invoice": 0.95, "bank_statement": 0.9, "report": 0.5, "unknown": 0.3}
# Layout labels and words of page regions, in Chinese and English.
REGIONS = {
    "paragraph": ("text", "paragraph", "body", "body_text", "title", "header", "heading", "caption"),
    "signature": ("signature", "sign", "signed_name", "autograph"),
    "table": ("table", "table_cell"),
    "stamp": ("stamp", "seal", "red_seal", "redstamp"),
    "footer": ("footer", "page_footer", "page_number", "footnote"),
}
STAMP = ("公章", "专用章", "医疗专用章", "诊断专用章", "证明专用章", "seal", "stamp", "official seal")
SIGNED = ("签名", "签字", "签署", "医师签名", "盖章", "手写", "signature", "signed", "sign here", "authorized signature", "physician signature", "attending physician")
FOOTER = ("第", "页", "共", "页码", "page ", "of ", "copyright", "all rights reserved")
DOCTOR = ("dr.", "dra.", "doutor", "doutora", "crm", "médico", "medico", "médica", "medica", "physician")
WATERMARKS = (
    "confidential", "draft", "sample", "trial", "evaluation", "do not copy", "not for distribution", "internal use",
    "watermark", "preview", "demo", "test only", "草稿", "样本", "机密", "内部", "测试",
)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def document_signals(docs: DataFrame, text: str = "text", pages: str = "pages", images: Column | None = None) -> DataFrame:
    """score, signals and flag (YES from 5, NO up to 2) of every text; a null text has no signal of words or length."""
    image, size = F.lit(False) if images is None else images, F.length(text)
    rules = {
        "multi_page": (F.col(pages) >= 5, 2),
        "table_like_structure": (has_any(F.col("_low"), TABLE) | F.col("_low").rlike("[0-9]{2,}%"), 2),
        "financial_document": (has_any(F.col("_low"), FINANCE), 3),
        "contract_document": (has_any(F.col("_low"), CONTRACT), 3),
        "likely_scanned": ((size < 200) & image, 2),
        "rich_text": (size > 2000, 2),
    }
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))) for n, (c, w) in rules.items())))
    # exploded, so that a filter on what is derived from it does not search the texts again
    out = docs.withColumn("_low", F.lower(text)).select("*", F.explode(F.array(found)).alias("_found"))
    out = out.withColumn("score", F.aggregate("_found", F.lit(0), lambda s, x: s + x["weight"])).withColumn("signals", F.col("_found.name"))
    return out.withColumn("flag", F.when(F.col("score") >= 5, "YES").when(F.col("score") <= 2, "NO").otherwise("UNCERTAIN")).drop("_low", "_found")


def recommend_action(scored: DataFrame) -> DataFrame:
    """What to do with documents that are worth it (NO is skipped)."""
    has = lambda n: F.array_contains("signals", n)
    act = F.when(has("financial_document") | has("table_like_structure"), "extract_tables").when(has("likely_scanned"), "ocr_text")
    return scored.filter(F.col("flag") != "NO").withColumn("action", act.when(has("contract_document") | has("rich_text"), "convert_word").otherwise("extract_tables"))


def signal_prevalence(scored: DataFrame, by: str) -> DataFrame:
    """Documents per signal and group, per signal, and per group, in one pass."""
    return scored.select(by, F.explode("signals").alias("signal")).cube("signal", by).agg(F.count("*").alias("n"))


def workspace_hints(docs: DataFrame, text: str = "text", pages: str = "pages", images: Column | None = None, most: int = 2) -> DataFrame:
    """The first `most` hints as (kind, action), in the order of the rules."""
    low, image = F.col("_low"), F.lit(False) if images is None else images
    rules = [
        (has_any(low, TABLE) | low.rlike("[0-9]{2,}%"), "STRUCTURED_DATA", "extract_tables"),
        (has_any(low, HINT_FINANCE), "FINANCIAL", "extract_tables"),
        (has_any(low, HINT_CONTRACT), "CONTRACT", "convert_word"),
        (image | (F.length(text) < 200), "SCANNED", "ocr_text"),
        (F.col(pages) > 5, "MULTI_PAGE", "compress"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(act).alias("action"))) for c, kind, act in rules)))
    return docs.withColumn("_low", F.lower(text)).withColumn("hints", F.slice(found, 1, most)).drop("_low")


def primary_action(hinted: DataFrame, intent: str = "intent") -> DataFrame:
    """The action by intent, else that of the first hint, else extract_tables; and what is suggested after it (null: nothing)."""
    i = F.col(intent)
    act = F.when(i.isin("compress", "edit"), i).when(i == "convert", "convert_word").otherwise(F.coalesce(F.try_element_at("hints", F.lit(1))["action"], F.lit("extract_tables")))
    after = F.when(F.col("action") == "extract_tables", "convert_word").when(F.col("action") == "ocr_text", "extract_tables").when(F.col("action") == "convert_word", "compress")
    return hinted.withColumn("action", act).withColumn("next_action", after)


def table_lines_csv(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with over one separator or over two numbers, as CSV."""
    sep = r"\t|\s{2,}|\|"
    many = (F.size(F.regexp_extract_all(line, F.lit(sep), F.lit(0))) > 1) | (F.size(F.regexp_extract_all(line, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))) > 2)
    quoted = F.transform(F.split(line, sep), lambda c: F.concat(F.lit('"'), F.replace(F.trim(c), F.lit('"'), F.lit('""')), F.lit('"')))
    return lines.filter((F.trim(line) != "") & many).withColumn("csv", F.array_join(quoted, ","))


def document_domain(docs: DataFrame, text: str = "text") -> DataFrame:
    """invoice, bank_statement or report by most hits (in this order on ties), unknown below two."""
    i, b, r = (hits(F.col("_low"), w) for w in (INVOICE, BANK, REPORT))
    scored = docs.withColumn("_low", F.coalesce(F.lower(text), F.lit(""))).withColumns({"_i": i, "_b": b, "_r": r}).withColumn("_top", F.greatest("_i", "_b", "_r"))
    domain = F.when(F.col("_top") < 2, "unknown").when(F.col("_i") == F.col("_top"), "invoice").when(F.col("_b") == F.col("_top"), "bank_statement").otherwise("report")
    return scored.withColumn("domain", domain).drop("_low", "_i", "_b", "_r", "_top")


def document_domain5(docs: DataFrame, text: str = "text") -> DataFrame:
    """resume, invoice, report or letter by most hits, in this order on ties; without any hit resume."""
    lists = {"resume": RESUME5, "invoice": INVOICE5, "report": REPORT5, "letter": LETTER5}
    scored = docs.withColumn("_low", F.coalesce(F.lower(text), F.lit(""))).withColumns({f"_{n}": hits(F.col("_low"), w) for n, w in lists.items()})
    scored = scored.withColumn("_top", F.greatest(*(f"_{n}" for n in lists)))
    domain = F.coalesce(*(F.when(F.col(f"_{n}") == F.col("_top"), n) for n in lists))
    return scored.withColumn("domain", domain).drop("_low", "_top", *(f"_{n}" for n in lists))


def business_value(docs: DataFrame, quality: str = "quality", scanned: str = "scanned") -> DataFrame:
    """Value in 0 to 1 by domain and quality, and the price it leads to."""
    weight = F.lit(VALUES["unknown"])
    for domain, w in VALUES.items():
        weight = F.when(F.col("domain") == domain, w).otherwise(weight)
    q = F.when(F.col(quality) > 0.7, 1.0).when(F.col(quality) > 0.4, 0.7).otherwise(0.4)
    value = half_up(F.least(F.lit(1.0), weight * q * F.when(F.col(scanned), 0.8).otherwise(1.0)), 2)
    return docs.withColumn("value", value).withColumn("price", F.when(F.col("value") > 0.8, 1.99).when(F.col("value") > 0.5, 0.99).otherwise(0.0))


def _of_label(label: str, kinds: dict[str, tuple[str, ...]]) -> Column:
    """The kind that lists the label, in any case; null for others."""
    named = F.lower(F.trim(label))
    return F.coalesce(*(F.when(named.isin(*labels), kind) for kind, labels in kinds.items()))


def region_class(blocks: DataFrame, page_height: float) -> DataFrame:
    """A known label's region; else by words of stamps and signatures, cell gaps, footer words at the bottom sixth; else paragraph."""
    low = F.lower("text")
    rules = F.when(_of_label("label", REGIONS).isNotNull(), _of_label("label", REGIONS)).when(has_any(low, STAMP), "stamp").when(has_any(low, SIGNED), "signature")
    rules = rules.when(F.col("text").rlike(r"\t| {3,}"), "table").when((F.col("y") >= page_height * 5 / 6) & has_any(low, FOOTER), "footer")
    return blocks.withColumn("region", rules.otherwise("paragraph"))


def visual_object_type(blocks: DataFrame) -> DataFrame:
    """Stamp or signature by words, else by label, else text."""
    low, of = F.lower("text"), _of_label("label", {"Stamp": REGIONS["stamp"], "Signature": REGIONS["signature"]})
    return blocks.withColumn("kind", F.when(has_any(low, STAMP), "Stamp").when(has_any(low, SIGNED), "Signature").when(of.isNotNull(), of).otherwise("Text"))


# The classes of placed objects.
OBJECT_CLASSES = ("glyph", "vector", "pdf-fallback", "signature", "decoration", "image", "annotation")


def image_class(images: DataFrame) -> DataFrame:
    """Images with class and confidence: fills the page, is a signature (by label or rotation), a small image in the band of header or footer, else an image.

    Needs y, w, h, page_w, page_h, label and rotation; a page without a size makes an image that is hardly sure.
    """
    share = F.col("w") * F.col("h") / (F.col("page_w") * F.col("page_h"))
    band = (F.col("y") < F.col("page_h") * 0.1) | (F.col("y") + F.col("h") > F.col("page_h") * 0.9)
    signed = (F.col("label") == "signature") | (F.abs("rotation") > 0.001)
    rules = [
        (~F.coalesce((F.col("page_w") > 0) & (F.col("page_h") > 0), F.lit(False)), "image", 0.3), (share >= 0.9, "pdf-fallback", 0.95), (signed, "signature", 0.85),
        (band & (F.col("h") < F.col("page_h") * 0.2) & (share < 0.2), "decoration", 0.6), (F.lit(True), "image", 0.5),
    ]
    how = F.coalesce(*(F.when(rule, F.struct(F.lit(name).alias("class"), F.lit(sure).alias("confidence"))) for rule, name, sure in rules))
    return images.withColumns({"class": how["class"], "confidence": how["confidence"]})


def object_counts(classed: DataFrame, by: str) -> DataFrame:
    """(by, class, n): objects of each class of each group, zeros too."""
    n = F.array(*(F.struct(F.lit(c).alias("class"), F.count_if(F.col("class") == c).alias("n")) for c in OBJECT_CLASSES))
    return classed.groupBy(by).agg(n.alias("counts")).select(by, F.inline("counts"))


def geometry_strategy(blocks: DataFrame, page_height: float) -> DataFrame:
    """How a block's angle is measured (SignatureImage, StampImage or Skip), by which rule, and why not at all."""
    low = F.lower("text")
    known = _of_label("label", {"SignatureImage": REGIONS["signature"], "StampImage": REGIONS["stamp"]})
    doctor, bottom = has_any(low, DOCTOR), F.col("y") + F.col("h") > page_height * 0.7
    tilted = F.coalesce((F.abs("angle") > 0.1) & ~F.isnan("angle"), F.lit(False))
    via = F.when(known.isNotNull(), "label").when(has_any(low, STAMP), "stamp words").when(doctor & bottom, "doctor words").when(tilted, "angle")
    out = blocks.withColumn("via", via)
    strategy = F.when(F.col("via") == "label", known).when(F.col("via") == "stamp words", "StampImage").when(F.col("via").isNotNull(), "SignatureImage").otherwise("Skip")
    reason = F.when(F.col("via").isNull(), F.when(doctor, "doctor words above the bottom").when(F.col("angle").isNull(), "no angle").otherwise("level"))
    return out.withColumn("strategy", strategy).withColumn("skip_reason", reason)


def scanned_documents(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, scanned): whether over half of a document's pages have no text and a single image."""
    alone = (F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0) & (F.col("images") == 1)
    return pages.groupBy(key).agg((F.avg(alone.cast("double")) > 0.5).alias("scanned"))


def watermark_candidates(lines: DataFrame, words: tuple[str, ...] = WATERMARKS, objects: DataFrame | None = None, scanned: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, content, pages, confidence): keywords by the pages that hold them, and object names on three pages or more.

    `objects` has a row (doc_id, page, name) per placed object; documents that `scanned` marks are left out.
    """
    named = F.filter(F.array(*(F.when(F.lower("line").contains(w), w) for w in words)), lambda x: x.isNotNull())
    n = F.col("pages")
    found = lines.select("doc_id", "page", F.explode(named).alias("content")).groupBy("doc_id", "content").agg(F.count_distinct("page").alias("pages"))
    found = found.select("doc_id", F.lit("text").alias("kind"), "content", "pages", F.when(n >= 3, 0.95).when(n == 2, 0.8).otherwise(0.6).alias("confidence"))
    if objects is not None:
        often = objects.groupBy("doc_id", F.col("name").alias("content")).agg(F.count_distinct("page").alias("pages")).filter(n >= 3)
        found = found.union(often.select("doc_id", F.lit("image").alias("kind"), "content", "pages", F.when(n >= 5, 0.91).otherwise(0.75).alias("confidence")))
    return found if scanned is None else found.join(scanned.filter("scanned"), "doc_id", "left_anti")


def scan_detection(pages: DataFrame, first: int = 3) -> DataFrame:
    """Mean characters of a document's first pages, and whether none of them has text."""
    top = pages.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("page"))).filter(F.col("n") <= first)
    return top.groupBy("doc_id").agg(F.avg(F.length("text")).alias("chars"), (~F.max(F.trim("text") != "")).alias("scanned"))


def corpus_class(docs: DataFrame, glyphs: str = "n_chars") -> DataFrame:
    g = F.col(glyphs)
    return docs.withColumn("class", F.when(g.isNull(), "error").when(g > 0, "text-corpus").otherwise("scan-corpus"))


def top_samples(docs: DataFrame, n: int, glyphs: str = "n_chars") -> DataFrame:
    return docs.orderBy(F.desc(glyphs), "doc_id").limit(n)


def markdown_clean(c: Column) -> Column:
    """Text of marked-up cells: breaks and row ends as lines, other tags, entities and marks gone."""
    c = F.regexp_replace(c, "(?i)<br[^>]*>|</tr>", "\n")
    c = F.regexp_replace(c, "(?i)</t[dh]>", "\t")
    for pattern, by in ((r"<[^>]*>", ""), (r"&nbsp;", " "), (r"&[a-z]+;", ""), (r"[*_#`]+", ""), (r"[ \t]+\n", "\n")):
        c = F.regexp_replace(c, pattern, by)
    return F.rtrim(c)


def rule_decisions(rows: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """A row per rule that holds: rules are columns, so users add their own."""
    made = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(name).alias("rule"), F.lit(d).alias("decision"))) for name, (c, d) in rules.items())))
    return rows.select("*", F.explode(made).alias("d")).select(*rows.columns, "d.rule", "d.decision")


def size_outcome(rows: DataFrame, most: float = 1.1) -> DataFrame:
    return rows.withColumn("outcome", F.when(F.col("original") <= 0, "publish").when(F.col("rewritten") / F.col("original") > most, "fallback").otherwise("publish"))


def font_confidence_gate(rows: DataFrame) -> DataFrame:
    c, w = F.col("confidence"), F.col("weight")
    return rows.withColumn("gate", F.when((w >= 700) | (c >= 0.6), "accept").when((w == 400) & (c < 0.35) & ~F.col("safe"), "fallback").otherwise("accept"))


# Patterns of dates, names, codes and postcodes, each with its kind, role or form.
DATES = {
    "DD/MM/YYYY": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b", "YYYY-MM-DD": r"\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b",
    "DD-MM-YYYY": r"\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\b", "DD.MM.YYYY": r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b",
}
NAMES = {
    "patient": r"(?i)(?:patient|paciente|nome|name)\s*:?\s*([A-Z][A-Z\s]+)",
    "doctor": r"(?i)(?:doctor|dr|médico|medico)\s*:?\s*([A-Z][A-Z\s]+)",
    "signer": r"(?i)(?:assinado|signed|signature)\s*:?\s*([A-Z][A-Z\s]+)",
}
CAPITALS = r"\b[A-Z]{3,}(?:\s+[A-Z]{3,})+\b"
CID = r"(?i)\b(?:CID|CID-10|CID10)\s*:?\s*([A-Z][0-9]{2}(?:\.[0-9]{1,2})?)"
NUMBER = r"(?i)\b(?:ID|RG|CPF|CNPJ)\s*:?\s*([A-Za-z0-9_.-]+)"
POSTCODE = r"\b[0-9]{5}-[0-9]{3}\b"
SIGNATURE = r"(?i)assinatura|signature|signed by|ass\."
KINDS = ("dateField", "nameField", "addressField", "signatureField", "textField", "tableField")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _located(text: Column, pattern: str, group: int = 0, trimmed: bool = False) -> Column:
    """Every match as (start, end, value), offsets in characters; a group has to end where its match does."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    parts = F.struct(_all(text, pattern).alias("whole"), _all(text, pattern, group).alias("raw"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))

    def found(m: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), none.alias("out"))

        def step(s: Column, w: Column) -> Column:
            raw, end = F.get(m["raw"], s["k"]), s["at"] + F.get(m["gaps"], s["k"]) + F.length(w)
            value = F.regexp_replace(raw, r"\s+$", "") if trimmed else raw
            one = F.struct((end - F.length(raw)).alias("start"), (end - F.length(raw) + F.length(value)).alias("end"), value.alias("value"))
            return F.struct((s["k"] + 1).alias("k"), end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(m["whole"], start, step)["out"]

    # most texts have no match of most patterns
    return F.when(text.rlike(pattern), _let(parts, found)).when(text.isNotNull(), none)


def extract_dates(docs: DataFrame, key: str = "doc_id", text: str = "head") -> DataFrame:
    """Every date by form, with the ISO value (zero-padded, not checked against the calendar)."""
    of = lambda form: lambda v: F.struct(F.lit(form).alias("form"), v.alias("value"))
    found = F.flatten(F.array(*(F.transform(_all(F.col(text), p), of(n)) for n, p in DATES.items())))
    rows = docs.select(key, F.explode(found).alias("d")).select(key, "d.form", "d.value")
    p = F.split("value", "[-/.]")
    y, m, d = (F.when(F.col("form") == "YYYY-MM-DD", p[i]).otherwise(p[2 - i]) for i in (0, 1, 2))
    return rows.withColumn("iso", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).withColumn("confidence", F.lit(0.9))


def _names(text: Column) -> Column:
    """Names of a text, as an array of (role, value, confidence, start, end): after role words, then runs of capitals not among them, each once."""
    one = lambda role, c: lambda v: F.struct(F.lit(role).alias("role"), v["value"].alias("value"), F.lit(c).alias("confidence"), v["start"].alias("start"), v["end"].alias("end"))
    keyed = [F.transform(F.filter(_located(text, p, 1, trimmed=True), lambda n: F.length(n["value"]) >= 3), one(r, 0.8)) for r, p in NAMES.items()]

    def with_runs(v: Column) -> Column:
        other = F.filter(v["runs"], lambda n, i: ~F.array_contains(v["found"]["value"], n["value"]) & (F.array_position(v["runs"]["value"], n["value"]) == i + 1))
        return F.concat(v["found"], F.transform(other, one("unknown", 0.6)))

    return _let(F.struct(F.flatten(F.array(*keyed)).alias("found"), _located(text, CAPITALS).alias("runs")), with_runs)


def extract_names(docs: DataFrame, key: str = "doc_id", text: str = "head") -> DataFrame:
    """(key, role, name, confidence): names after a role word (.8), then runs of capitals that are not among them (.6)."""
    return docs.select(key, F.explode(_names(F.col(text))).alias("p")).select(key, "p.role", F.col("p.value").alias("name"), "p.confidence")


def extract_pattern(docs: DataFrame, kinds: dict[str, tuple[str, int, float]], key: str = "doc_id", text: str = "head") -> DataFrame:
    """(key, kind, value, confidence) of every match of each kind's pattern and group."""
    of = lambda kind, c: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(c).alias("confidence"))
    found = F.flatten(F.array(*(F.transform(_all(F.col(text), p, g), of(n, c)) for n, (p, g, c) in kinds.items())))
    return docs.select(key, F.explode(found).alias("f")).select(key, "f.*")


def extract_codes(docs: DataFrame, **names) -> DataFrame:
    return extract_pattern(docs, {"cid": (CID, 1, 0.9), "id": (NUMBER, 1, 0.85)}, **names)


def extract_postcodes(docs: DataFrame, **names) -> DataFrame:
    return extract_pattern(docs, {"postcode": (POSTCODE, 0, 0.85)}, **names)


def signature_areas(docs: DataFrame, key: str = "doc_id", text: str = "head") -> DataFrame:
    return docs.filter(F.col(text).rlike(SIGNATURE)).select(key, F.lit(0.7).alias("confidence"))


def entities(docs: DataFrame, key: str = "doc_id", text: str = "head", only: str | None = None) -> DataFrame:
    """(key, place, kind, role, label, value, confidence, start, end): what a text names, in the order in which it is looked for, and where it stands.

    `place` is the entity's id within its document; offsets are in characters of the text, the end exclusive.
    With `only` those of one kind, with the places that they have among all.
    """
    t, none = F.col(text), F.lit(None).cast("string")

    def one(kind: str, label: Column | str, c: Column | float, role=lambda v: none):
        label, c = (x if callable(x) else (lambda v, x=x: F.lit(x)) for x in (label, c))
        return lambda v: F.struct(F.lit(kind).alias("kind"), role(v).alias("role"), label(v).alias("label"), v["value"].alias("value"), c(v).alias("confidence"), v["start"].alias("start"), v["end"].alias("end"))

    name = lambda v: F.when(v["role"] == "patient", "Patient Name").when(v["role"] == "doctor", "Doctor Name").otherwise("Name")
    whole = F.when(t.rlike(SIGNATURE), F.array(F.struct(F.lit(0).alias("start"), F.length(t).alias("end"), t.alias("value")))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    parts = [
        *(("dateField", F.transform(_located(t, p), one("dateField", "Date", 0.9))) for p in DATES.values()),
        ("nameField", F.transform(_names(t), one("nameField", name, lambda v: v["confidence"], lambda v: v["role"]))),
        ("textField", F.transform(_located(t, CID, 1), one("textField", "CID", 0.9))),
        ("textField", F.transform(_located(t, NUMBER, 1), one("textField", "ID", 0.85))),
        ("addressField", F.transform(_located(t, POSTCODE), one("addressField", "Postal Code", 0.85))),
        ("signatureField", F.transform(whole, one("signatureField", "Signature Area", 0.7))),
    ]
    if only is None:
        return docs.select(key, F.posexplode(F.concat(*(x for _, x in parts))).alias("place", "e")).select(key, "place", "e.*")
    kinds = [k for k, _ in parts]
    if only not in kinds:
        raise ValueError(f"only one of {sorted(set(kinds))}")
    first, last = (0, len(DATES)) if only == "dateField" else (len(DATES), len(kinds) - kinds[::-1].index(only))  # dates are counted, others built up to the kind
    before = sum((F.regexp_count(t, F.lit(p)) for p in DATES.values()), F.lit(0)) if first else F.lit(0)
    rows = docs.select(key, before.alias("_before"), F.posexplode(F.concat(*(x for _, x in parts[first:last]))).alias("_at", "e"))
    return rows.filter(F.col("e.kind") == only).select(key, (F.col("_before") + F.col("_at")).alias("place"), "e.*")


def entity_counts(entities: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows per kind, zero for absent ones; kinds are a short list."""
    every = entities.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return F.broadcast(every).join(entities.groupBy("kind").count(), "kind", "left").select("kind", F.coalesce("count", F.lit(0)).alias("n"))


def semantic_query(
    entities: DataFrame, kind: str | None = None, role: str | None = None, label_words: tuple[str, ...] = (), value: str | None = None, first: bool = False, key: str = "doc_id", order: str = "place"
) -> DataFrame:
    """Entities that meet all conditions given: kind, role (a name's, or within the label), any label word, value pattern.

    With `first` only the first of each document, in document order.
    """
    label = F.coalesce(F.lower("label"), F.lit(""))
    if kind is not None:
        entities = entities.filter(F.col("kind") == kind)
    if role is not None:
        named = F.coalesce((F.col("kind") == "nameField") & (F.lower("role") == role.lower()), F.lit(False))
        entities = entities.filter(named | label.contains(role.lower()))
    if label_words:
        entities = entities.filter(has_any(label, tuple(w.lower() for w in label_words)))
    if value is not None:
        entities = entities.filter(F.col("value").rlike(value))
    return entities.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n") if first else entities


def apply_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "head") -> DataFrame:
    """docs with all their edits (key, start, end, by) applied at once, and how many (`edits`).

    Offsets are those of the text before any edit. From left to right, an edit that begins before the end of one already
    taken is left out, as are those that begin before the text, end before they begin or reach beyond it; of edits with one
    start the shorter comes first. Documents without edits stay as they are, with 0. One document's edits are gathered.
    """
    n = F.length(text)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "by")))
    met = docs.join(edits.dropna(subset=["start", "end", "by"]).groupBy(key).agg(ordered.alias("_edits")), key, "left")
    fits = F.filter("_edits", lambda e: (e["start"] >= 0) & (e["end"] >= e["start"]) & (e["end"] <= n))
    done = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0))
    kept = F.aggregate(fits, F.array().cast("array<struct<start:int,end:int,by:string>>"), lambda k, e: F.when(e["start"] >= done(k), F.concat(k, F.array(e))).otherwise(k))
    met = met.withColumn("_kept", F.coalesce(kept, F.array().cast("array<struct<start:int,end:int,by:string>>")))
    before = lambda k: F.when(k > 0, F.get("_kept", k - 1)["end"]).otherwise(0)
    pieces = F.transform("_kept", lambda e, k: F.concat(F.substring(F.col(text), before(k) + 1, e["start"] - before(k)), e["by"]))
    rest = F.substring(F.col(text), done(F.col("_kept")) + 1, n)
    return met.withColumn("edits", F.size("_kept")).withColumn(text, F.concat(F.array_join(pieces, ""), rest)).drop("_edits", "_kept")


def entity_edits(docs: DataFrame, found: DataFrame, replacements: DataFrame, key: str = "doc_id", text: str = "head") -> DataFrame:
    """docs with entities replaced by id, several a document: replacements are (key, place, by), found the rows of entities().

    Each value is written where its entity stands, not where its text stands first. Entities of the result are derived anew
    by entities(), with the offsets that they have then.
    """
    return apply_edits(docs, found.join(replacements.select(key, "place", "by"), [key, "place"]).select(key, "start", "end", "by"), key, text)


def entity_replace(docs: DataFrame, chosen: DataFrame, by: str, key: str = "doc_id", text: str = "head") -> DataFrame:
    """docs with each document's first chosen entity written anew where it stands, and whether that was done.

    `chosen` are rows of entities(), picked by place, label or kind with semantic_query.
    """
    first = chosen.groupBy(key).agg(F.min_by(F.struct("start", "end"), "place").alias("e")).select(key, "e.*", F.lit(by).alias("by"))
    return apply_edits(docs, first, key, text).withColumn("replaced", F.col("edits") > 0).drop("edits")


def find_occurrences(docs: DataFrame, target: str, key: str = "doc_id", text: str = "text", case_sensitive: bool = True) -> DataFrame:
    """(key, n, start, end) of every match, left to right without overlap; an empty target has none."""
    if not target:
        return docs.select(key, F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    where = F.col(text) if case_sensitive else F.lower(text)
    target = target if case_sensitive else target.lower()
    parts = F.split(where, r"\Q" + target + r"\E", -1)
    rows = docs.select(key, F.posexplode(F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length)).alias("n", "gap"))
    start = F.sum("gap").over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)) + F.col("n") * len(target)
    return rows.withColumn("start", start).withColumn("end", F.col("start") + len(target)).drop("gap")


def replace_all(docs: DataFrame, target: str, by: str, text: str = "text") -> DataFrame:
    """Text with each match replaced, and the number of matches."""
    n = (F.length(text) - F.length(F.replace(text, F.lit(target), F.lit("")))) / len(target)
    return docs.withColumn("n", n.cast("long")).withColumn(text, F.replace(text, F.lit(target), F.lit(by)))


def replace_check(pairs: DataFrame, target: Column | str, least: float = 0.98) -> DataFrame:
    """Whether a replacement came out.

    accuracy: share of equal characters by place, 1 if the expected text is contained; gone: no word of the target is
    left that is not expected; doubled: a word occurs twice, in any case; leaked: a word that is not expected.
    """
    e, a, t = F.col("expected"), F.col("actual"), F.lit(target) if isinstance(target, str) else target
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    same = F.aggregate(F.zip_with(F.split(e, ""), F.split(a, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    share = F.when(a.contains(e), 1.0).when(F.greatest(F.length(e), F.length(a)) == 0, 0.0).otherwise(same / F.greatest(F.length(e), F.length(a)))
    low = words(F.lower(a))
    out = pairs.withColumns(
        {
            "accuracy": share,
            "gone": F.size(F.array_intersect(F.array_except(words(t), words(e)), words(a))) == 0,
            "doubled": F.size(F.array_distinct(low)) < F.size(low),
            "leaked": F.size(F.array_except(low, words(F.lower(e)))) > 0,
        }
    )
    return out.withColumn("met", (F.col("accuracy") >= least) & F.col("gone") & ~F.col("doubled") & ~F.col("leaked"))


def document_summary(lines: DataFrame) -> DataFrame:
    """Pages, paragraphs (runs of lines that are not blank), lines, words, runs (of one kind of character) and characters, per document and in all."""
    before = F.lag("line").over(W.partitionBy("doc_id").orderBy("n"))
    begins = (F.trim("line") != "") & (before.isNull() | (F.trim(before) == ""))
    runs = F.size(_all(F.col("line"), "[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]+"))
    marked = lines.select("doc_id", "page", "line", begins.alias("begins"), F.size(_all(F.col("line"), "[A-Za-z0-9]+")).alias("words"), runs.alias("runs"))
    return marked.rollup("doc_id").agg(
        F.count_distinct("doc_id", "page").alias("pages"), F.count_if("begins").alias("paragraphs"), F.count("*").alias("lines"),
        F.sum("words").alias("words"), F.sum("runs").alias("runs"), F.sum(F.length("line")).alias("chars"),
    )


def word_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    words = _all(F.col(text), "[A-Za-z0-9]+")
    return docs.withColumn("first_word", F.try_element_at(words, F.lit(1))).withColumn("words", F.size(words))


def document_lines(docs: DataFrame, per_page: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, page, line, start, end) of each line; offsets within the text."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    end = F.sum(F.length("line") + 1).over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)) - 1
    return rows.withColumn("page", F.floor(F.col("n") / per_page)).withColumn("end", end).withColumn("start", end - F.length("line"))
