"""Queries of the document operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrowth.functions.shared import written
from docgrowth.operators import documents as d
from docgrowth.plans.base import query

#: Documents with a length-based page count, and statements, whose words reach every rule.
_TEXTS = """SELECT doc_id, text, lang, cast(ceil(length(text) / 1500e0) AS BIGINT) AS pages FROM {doc_texts} a
    UNION ALL SELECT 1000000000 + doc_id AS doc_id, head AS text, 'st' AS lang, cast(pages AS BIGINT) AS pages FROM {statements} b"""


def _any(text: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words.split(";")) + ")"


def _hits(text: str, words: str) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words.split(";")) + ")"


#: The lists again, typed apart from the operators', so that a wrong word there shows.
_TABLE = "|;table;column;row"
_FINANCE = "invoice;amount;total;tax;payment;balance;usd;amount due;subtotal;receipt;transaction;refund"
_CONTRACT = "agreement;contract;party;terms;liability;termination;hereby;indemnify;confidential;clause"
_RULES = [
    ("multi_page", "pages >= 5", 2), ("table_like_structure", f"({_any('low', _TABLE)} OR regexp_matches(low, '[0-9]{{2,}}%'))", 2), ("financial_document", _any("low", _FINANCE), 3),
    ("contract_document", _any("low", _CONTRACT), 3), ("likely_scanned", "length(text) < 200 AND pages = 1", 2), ("rich_text", "length(text) > 2000", 2),
]
_SCORED = f"""(SELECT *, CASE WHEN score >= 5 THEN 'YES' WHEN score <= 2 THEN 'NO' ELSE 'UNCERTAIN' END AS flag FROM (SELECT doc_id, lang, {" + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for _, c, w in _RULES)} AS score,
    list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _RULES)}], lambda x: x IS NOT NULL) AS signals FROM (SELECT *, lower(text) AS low FROM ({_TEXTS}) t) l) s)"""
_scored = lambda v: d.document_signals(v.sql(_TEXTS), images=F.col("pages") == 1)
query("document_signals", lambda v: _scored(v).select("doc_id", "score", F.array_join("signals", ",").alias("signals")), f"SELECT doc_id, score, array_to_string(signals, ',') AS signals FROM {_SCORED} s")
query("value_flag", lambda v: _scored(v).select("doc_id", "flag"), f"SELECT doc_id, flag FROM {_SCORED} s")
query("recommend_action", lambda v: d.recommend_action(_scored(v)).select("doc_id", "action"), f"""SELECT doc_id, CASE WHEN list_contains(signals, 'financial_document') OR list_contains(signals, 'table_like_structure') THEN 'extract_tables'
    WHEN list_contains(signals, 'likely_scanned') THEN 'ocr_text' WHEN list_contains(signals, 'contract_document') OR list_contains(signals, 'rich_text') THEN 'convert_word' ELSE 'extract_tables' END AS action FROM {_SCORED} s WHERE flag <> 'NO'""")
query("signal_prevalence", lambda v: d.signal_prevalence(_scored(v), "lang"), f"SELECT signal, lang, count(*) AS n FROM (SELECT lang, unnest(signals) AS signal FROM {_SCORED} s) u GROUP BY CUBE (signal, lang)")
_HINTS = [
    (f"({_any('low', _TABLE)} OR regexp_matches(low, '[0-9]{{2,}}%'))", "STRUCTURED_DATA"), (_any("low", "invoice;amount;total;tax;payment;balance;usd"), "FINANCIAL"), (_any("low", "agreement;contract;party;terms;liability"), "CONTRACT"),
    ("(pages = 1 OR length(text) < 200)", "SCANNED"), ("pages > 5", "MULTI_PAGE"),
]
_HINTED = f"(SELECT doc_id, list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for c, n in _HINTS)}], lambda x: x IS NOT NULL)[1:2] AS hints FROM (SELECT *, lower(text) AS low FROM ({_TEXTS}) t) l)"
_hinted = lambda v: d.workspace_hints(v.sql(_TEXTS), images=F.col("pages") == 1)
query("workspace_hints", lambda v: _hinted(v).select("doc_id", F.array_join("hints.kind", ",").alias("hints")), f"SELECT doc_id, array_to_string(hints, ',') AS hints FROM {_HINTED} h")
_INTENT = "CASE doc_id % 4 WHEN 0 THEN 'compress' WHEN 1 THEN 'convert' WHEN 2 THEN 'edit' ELSE 'other' END"
query("primary_action", lambda v: d.primary_action(_hinted(v).withColumn("intent", F.expr(_INTENT))).select("doc_id", "action", "next_action"), f"""SELECT doc_id, action, CASE action WHEN 'extract_tables' THEN 'convert_word' WHEN 'convert_word' THEN 'compress' WHEN 'ocr_text' THEN 'extract_tables' END AS next_action
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'compress' WHEN 2 THEN 'edit' WHEN 1 THEN 'convert_word' ELSE CASE hints[1] WHEN 'CONTRACT' THEN 'convert_word' WHEN 'SCANNED' THEN 'ocr_text' WHEN 'MULTI_PAGE' THEN 'compress' ELSE 'extract_tables' END END AS action FROM {_HINTED} h) a""")
query("table_lines_csv", lambda v: d.table_lines_csv(v.statement_lines).select("l_orderkey", "row", "csv"), r"""SELECT l_orderkey, row, array_to_string(list_transform(regexp_split_to_array(line, '\t|\s{2,}|\|'), lambda c: '"' || replace(trim(c), '"', '""') || '"'), ',') AS csv
    FROM {statement_lines} l WHERE trim(line) <> '' AND (len(regexp_extract_all(line, '\t|\s{2,}|\|')) > 1 OR len(regexp_extract_all(line, '[0-9]+(?:[.,][0-9]+)*')) > 2)""")
_DOMAIN = f"""SELECT doc_id, CASE WHEN greatest(i, b, r) < 2 THEN 'unknown' WHEN i = greatest(i, b, r) THEN 'invoice' WHEN b = greatest(i, b, r) THEN 'bank_statement' ELSE 'report' END AS domain
    FROM (SELECT doc_id, {_hits('low', 'invoice;total;tax;amount due;bill to;payment;subtotal;qty;quantity;unit price')} AS i, {_hits('low', 'account;balance;deposit;withdrawal;statement;transaction;beginning balance;ending balance;interest;fee')} AS b,
        {_hits('low', 'report;summary;table of contents;introduction;conclusion;appendix;figure;chart')} AS r FROM (SELECT doc_id, lower(text) AS low FROM ({_TEXTS}) t) l) h"""
query("document_domain", lambda v: d.document_domain(v.sql(_TEXTS)).select("doc_id", "domain"), _DOMAIN)
query("document_domain5", lambda v: d.document_domain5(v.sql(_TEXTS)).select("doc_id", "domain"), f"""SELECT doc_id, CASE WHEN m = cv THEN 'resume' WHEN m = i THEN 'invoice' WHEN m = r THEN 'report' ELSE 'letter' END AS domain FROM (SELECT *, greatest(cv, i, r, l) AS m FROM (
    SELECT doc_id, {_hits('low', 'experience;education;skills;employment;curriculum;vitae;resume')} AS cv, {_hits('low', 'invoice;total;tax;amount;bill;payment;subtotal')} AS i,
    {_hits('low', 'report;summary;introduction;conclusion;methodology;findings')} AS r, {_hits('low', 'dear;sincerely;regards;enclosed;attached')} AS l FROM (SELECT doc_id, lower(text) AS low FROM ({_TEXTS}) t) l) h) g""")
query("business_value", lambda v: d.business_value(d.document_domain(v.sql(_TEXTS)).withColumn("quality", F.expr("doc_id % 10 / 10e0")).withColumn("scanned", F.expr("doc_id % 3 = 0"))).groupBy("domain", "price").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value")), f"""
    SELECT domain, CASE WHEN value > 0.8 THEN 1.99e0 WHEN value > 0.5 THEN 0.99e0 ELSE 0e0 END AS price, count(*) AS n, round(avg(value), 6) AS value FROM (SELECT domain, floor(least(1e0, CASE domain WHEN 'invoice' THEN 0.95e0 WHEN 'bank_statement' THEN 0.9e0 WHEN 'report' THEN 0.5e0 ELSE 0.3e0 END
    * CASE WHEN doc_id % 10 / 10e0 > 0.7 THEN 1e0 WHEN doc_id % 10 / 10e0 > 0.4 THEN 0.7e0 ELSE 0.4e0 END * CASE WHEN doc_id % 3 = 0 THEN 0.8e0 ELSE 1e0 END) * 100 + 0.5e0) / 100 AS value FROM ({_DOMAIN}) t) v GROUP BY ALL""")
_BLOCKS = """SELECT page, block, x, y, w, h, CASE block % 11 WHEN 3 THEN 'Signature' WHEN 5 THEN ' table_cell ' WHEN 7 THEN 'footnote' WHEN 9 THEN 'red_seal' ELSE CASE WHEN page % 4 = 0 THEN label END END AS label,
    CASE (page + block) % 9 WHEN 0 THEN 'Signed by Dr. A' WHEN 1 THEN 'Official Seal' WHEN 2 THEN 'page 2 of 3' WHEN 3 THEN concat('a   ', text) WHEN 4 THEN concat('a', chr(9), text) WHEN 5 THEN 'atendido por médico' ELSE text END AS text FROM {text_blocks} b"""
_blocks = lambda v: v.sql(_BLOCKS)
_ST, _SG = _any("lower(text)", "公章;专用章;医疗专用章;诊断专用章;证明专用章;seal;stamp;official seal"), _any("lower(text)", "签名;签字;签署;医师签名;盖章;手写;signature;signed;sign here;authorized signature;physician signature;attending physician")
_FT, _DR = _any("lower(text)", "第;页;共;页码;page ;of ;copyright;all rights reserved"), _any("lower(text)", "dr.;dra.;doutor;doutora;crm;médico;medico;médica;medica;physician")
_OF = """CASE WHEN lower(trim(label)) IN ('text', 'paragraph', 'body', 'body_text', 'title', 'header', 'heading', 'caption') THEN 'paragraph' WHEN lower(trim(label)) IN ('signature', 'sign', 'signed_name', 'autograph') THEN 'signature'
    WHEN lower(trim(label)) IN ('table', 'table_cell') THEN 'table' WHEN lower(trim(label)) IN ('stamp', 'seal', 'red_seal', 'redstamp') THEN 'stamp' WHEN lower(trim(label)) IN ('footer', 'page_footer', 'page_number', 'footnote') THEN 'footer' END"""
query("region_class", lambda v: d.region_class(_blocks(v), 240).select("page", "block", "region"), f"""SELECT page, block, CASE WHEN m IS NOT NULL THEN m WHEN {_ST} THEN 'stamp' WHEN {_SG} THEN 'signature'
    WHEN regexp_matches(text, '\\t| {{3,}}') THEN 'table' WHEN y >= 200 AND {_FT} THEN 'footer' ELSE 'paragraph' END AS region FROM (SELECT *, {_OF} AS m FROM ({_BLOCKS}) b) t""")
query("visual_object_type", lambda v: d.visual_object_type(_blocks(v)).groupBy("kind").count().withColumnRenamed("count", "n"), f"""SELECT CASE WHEN {_ST} THEN 'Stamp' WHEN {_SG} THEN 'Signature' WHEN m = 'stamp' THEN 'Stamp' WHEN m = 'signature' THEN 'Signature' ELSE 'Text' END AS kind, count(*) AS n
    FROM (SELECT *, {_OF} AS m FROM ({_BLOCKS}) b) t GROUP BY 1""")
# Images of all sizes and places: some fill the page, some are rotated or marked, some lie in the bands, some reach into them, some pages have no size.
_IMAGES = """SELECT page, block, CASE block % 6 WHEN 0 THEN 5e0 WHEN 1 THEN 100e0 WHEN 2 THEN 262e0 WHEN 3 THEN 20e0 ELSE y END AS y, CASE WHEN block % 7 = 5 THEN 98e0 ELSE w / 2 END AS w, CASE WHEN block % 7 = 5 THEN 290e0 WHEN block % 6 = 3 THEN 65e0 ELSE h END AS h, CASE WHEN page % 9 = 4 THEN 0e0 ELSE 100e0 END AS page_w, 300e0 AS page_h,
    CASE WHEN (page + block) % 8 = 0 THEN 'signature' ELSE label END AS label, CASE (page + block) % 5 WHEN 0 THEN NULL WHEN 1 THEN -0.002e0 WHEN 2 THEN 0.001e0 ELSE 0e0 END AS rotation FROM {text_blocks} b"""
_CLASS = "CASE WHEN page_w <= 0 THEN 'image' WHEN w * h / (page_w * page_h) >= 0.9 THEN 'pdf-fallback' WHEN label = 'signature' OR abs(rotation) > 0.001 THEN 'signature' WHEN (y < 30 OR y + h > 270) AND h < 60 AND w * h / (page_w * page_h) < 0.2 THEN 'decoration' ELSE 'image' END"
query("image_class", lambda v: d.image_class(v.sql(_IMAGES)).select("page", "block", "class", "confidence"), f"""SELECT page, block, class, CASE WHEN page_w <= 0 THEN 0.3e0 ELSE CASE class WHEN 'pdf-fallback' THEN 0.95e0 WHEN 'signature' THEN 0.85e0 WHEN 'decoration' THEN 0.6e0 ELSE 0.5e0 END END AS confidence FROM (SELECT *, {_CLASS} AS class FROM ({_IMAGES}) i) c""")
query("object_counts", lambda v: d.object_counts(d.image_class(v.sql(_IMAGES)), "page"), f"""SELECT p.page, k.class, count(c.class) AS n FROM (SELECT DISTINCT page FROM ({_IMAGES}) i) p CROSS JOIN (SELECT unnest(['glyph', 'vector', 'pdf-fallback', 'signature', 'decoration', 'image', 'annotation']) AS class) k
    LEFT JOIN (SELECT page, {_CLASS} AS class FROM ({_IMAGES}) i) c ON c.page = p.page AND c.class = k.class GROUP BY p.page, k.class""")
_ANGLE = "CASE WHEN block % 5 = 1 THEN NULL ELSE (block % 4 - 2) / 10e0 END"
query("geometry_strategy", lambda v: d.geometry_strategy(_blocks(v).withColumn("angle", F.expr(_ANGLE)), 240).groupBy("strategy", "skip_reason").count().withColumnRenamed("count", "n"), f"""
    SELECT CASE WHEN m = 'signature' THEN 'SignatureImage' WHEN m = 'stamp' THEN 'StampImage' WHEN {_ST} THEN 'StampImage' WHEN {_DR} AND y + h > 168 THEN 'SignatureImage' WHEN abs(angle) > 0.1 THEN 'SignatureImage' ELSE 'Skip' END AS strategy,
    CASE WHEN m IN ('signature', 'stamp') OR {_ST} OR ({_DR} AND y + h > 168) OR coalesce(abs(angle) > 0.1, false) THEN NULL WHEN {_DR} THEN 'doctor words above the bottom' WHEN angle IS NULL THEN 'no angle' ELSE 'level' END AS skip_reason, count(*) AS n
    FROM (SELECT *, {_OF} AS m, {_ANGLE} AS angle FROM ({_BLOCKS}) b) t GROUP BY ALL""")
_LINES = r"(SELECT doc_id, u.i - 1 AS n, l[u.i] AS line, floor((u.i - 1) / 20)::BIGINT AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {doc_texts} d) t, unnest(range(1, len(l) + 1)) u(i))"
_lines = lambda v: d.document_lines(v.doc_texts)
_MARKED = """SELECT doc_id, n, page, CASE WHEN n % 7 = 0 THEN concat('Draft ', line) WHEN n % 11 = 0 AND doc_id % 2 = 0 THEN concat(line, ' 内部 Do Not Copy') ELSE line END AS line FROM {lines} l"""
_OBJECTS = "SELECT l_orderkey % 50 AS doc_id, row AS page, concat('Im', cast(l_linenumber % 2 AS VARCHAR(5))) AS name FROM {order_lines} l"
_IMAGED = "SELECT l_orderkey % 50 AS doc_id, row AS page, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'x' END AS text, 1 + l_linenumber % 2 AS images FROM {order_lines} l WHERE l_orderkey % 50 < 10"


def _watermarks(v):
    lines = _lines(v).selectExpr("doc_id", "n", "page", _MARKED[_MARKED.index("CASE") : _MARKED.index(" FROM")])
    return d.watermark_candidates(lines, objects=v.sql(_OBJECTS), scanned=d.scanned_documents(v.sql(_IMAGED)))


query("watermark_candidates", _watermarks, f"""WITH scanned AS (SELECT doc_id FROM ({_IMAGED}) i GROUP BY doc_id HAVING avg(CASE WHEN length(trim(text)) = 0 AND images = 1 THEN 1e0 ELSE 0e0 END) > 0.5),
    words AS (SELECT unnest(['confidential', 'draft', 'sample', 'trial', 'evaluation', 'do not copy', 'not for distribution', 'internal use', 'watermark', 'preview', 'demo', 'test only', '草稿', '样本', '机密', '内部', '测试']) AS word),
    found AS (SELECT doc_id, 'text' AS kind, word AS content, count(DISTINCT page) AS pages FROM ({_MARKED.replace("{lines}", _LINES)}) l, words WHERE contains(lower(line), word) GROUP BY doc_id, word
    UNION ALL SELECT doc_id, 'image', name, count(DISTINCT page) FROM ({_OBJECTS}) o GROUP BY doc_id, name HAVING count(DISTINCT page) >= 3)
    SELECT doc_id, kind, content, pages, CASE WHEN kind = 'image' THEN CASE WHEN pages >= 5 THEN 0.91e0 ELSE 0.75e0 END WHEN pages >= 3 THEN 0.95e0 WHEN pages = 2 THEN 0.8e0 ELSE 0.6e0 END AS confidence
    FROM found WHERE doc_id NOT IN (SELECT doc_id FROM scanned)""")
_PAGES = f"(SELECT doc_id, page, string_agg(line, chr(10) ORDER BY n) AS text FROM {_LINES} l GROUP BY doc_id, page)"
query("scan_detection", lambda v: d.scan_detection(_lines(v).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))),
      f"SELECT doc_id, avg(length(text)) AS chars, NOT max(trim(text) <> '') AS scanned FROM {_PAGES} p WHERE page < 3 GROUP BY doc_id")
query("corpus_class", lambda v: d.corpus_class(v.documents).groupBy("class").count().withColumnRenamed("count", "n"), "SELECT CASE WHEN n_chars IS NULL THEN 'error' WHEN n_chars > 0 THEN 'text-corpus' ELSE 'scan-corpus' END AS class, count(*) AS n FROM {documents} d GROUP BY 1")
query("top_samples", lambda v: d.top_samples(v.documents, 20).select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM {documents} d ORDER BY n_chars DESC, doc_id LIMIT 20")
query("markdown_clean", lambda v: v.pages.select("page_id", F.md5(d.markdown_clean(F.col("html"))).alias("digest")), r"""SELECT page_id, md5(rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br[^>]*>|</tr>', chr(10), 'g'),
    '(?i)</t[dh]>', chr(9), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' ', 'g'), '&[a-z]+;', '', 'g'), '[*_#`]+', '', 'g'), '[ \t]+\n', chr(10), 'g'))) AS digest FROM {pages} p""")
_DECIDE = {"stamp": ("label = 'stamp'", "keep"), "wide": ("w > 80", "wrap"), "low": ("y > 180", "footer")}
query("rule_decisions", lambda v: d.rule_decisions(v.text_blocks.select("page", "block", "label", "w", "y"), {n: (F.expr(c), d_) for n, (c, d_) in _DECIDE.items()}).select("page", "block", "rule", "decision"), """SELECT page, block, 'stamp' AS rule, 'keep' AS decision FROM {text_blocks} a WHERE label = 'stamp'
    UNION ALL SELECT page, block, 'wide', 'wrap' FROM {text_blocks} b WHERE w > 80 UNION ALL SELECT page, block, 'low', 'footer' FROM {text_blocks} c WHERE y > 180""")
query("size_outcome", lambda v: d.size_outcome(v.size_rows).select("id", "outcome"), "SELECT id, CASE WHEN original <= 0 THEN 'publish' WHEN rewritten / original > 1.1e0 THEN 'fallback' ELSE 'publish' END AS outcome FROM {size_rows} s")
_FONTS = "SELECT page, block, 400 + 100 * (block % 4) AS weight, (page + block) % 10 / 10e0 AS confidence, page % 2 = 0 AS safe FROM {text_blocks} b"
query("font_confidence_gate", lambda v: d.font_confidence_gate(v.sql(_FONTS)).select("page", "block", "gate"), f"SELECT page, block, CASE WHEN weight >= 700 OR confidence >= 0.6 THEN 'accept' WHEN weight = 400 AND confidence < 0.35 AND NOT safe THEN 'fallback' ELSE 'accept' END AS gate FROM ({_FONTS}) f")

_DATES = {
    "DD/MM/YYYY": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b", "YYYY-MM-DD": r"\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b", "DD-MM-YYYY": r"\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\b", "DD.MM.YYYY": r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b",
}
_ISO = """concat_ws('-', CASE WHEN form = 'YYYY-MM-DD' THEN p[1] ELSE p[3] END, lpad(p[2], 2, '0'), lpad(CASE WHEN form = 'YYYY-MM-DD' THEN p[3] ELSE p[1] END, 2, '0'))"""
query("extract_dates", lambda v: d.extract_dates(v.statements), f"SELECT doc_id, form, value, {_ISO} AS iso, 0.9e0 AS confidence FROM (SELECT *, regexp_split_to_array(value, '[-/.]') AS p FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS form, unnest(regexp_extract_all(head, '{p}')) AS value FROM {{statements}} s" for n, p in _DATES.items()) + ") u) t")
_ROLES = {"patient": "patient|paciente|nome|name", "doctor": "doctor|dr|médico|medico", "signer": "assinado|signed|signature"}
_NAMED = "(SELECT doc_id, k, role, trim(name) AS name FROM (" + " UNION ALL ".join(rf"SELECT doc_id, {k} AS k, '{r}' AS role, unnest(regexp_extract_all(head, '(?i)(?:{w})\s*:?\s*([A-Z][A-Z\s]+)', 1)) AS name FROM {{statements}} s" for k, (r, w) in enumerate(_ROLES.items())) + ") u WHERE length(trim(name)) >= 3)"
_NAMES = rf"""(SELECT doc_id, k, role, name, 0.8e0 AS confidence FROM {_NAMED} r UNION ALL SELECT doc_id, 9, 'unknown', name, 0.6e0 FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(head, '\b[A-Z]{{3,}}(?:\s+[A-Z]{{3,}})+\b')) AS name FROM {{statements}} s) o
    WHERE NOT EXISTS (SELECT 1 FROM {_NAMED} r WHERE r.doc_id = o.doc_id AND r.name = o.name))"""
query("extract_names", lambda v: d.extract_names(v.statements), f"SELECT doc_id, role, name, confidence FROM {_NAMES} n")
_CODES = r"""SELECT doc_id, 'cid' AS kind, unnest(regexp_extract_all(head, '(?i)\b(?:CID|CID-10|CID10)\s*:?\s*([A-Z][0-9]{2}(?:\.[0-9]{1,2})?)', 1)) AS value, 0.9e0 AS confidence FROM {statements} a
    UNION ALL SELECT doc_id, 'id', unnest(regexp_extract_all(head, '(?i)\b(?:ID|RG|CPF|CNPJ)\s*:?\s*([A-Za-z0-9_.-]+)', 1)), 0.85e0 FROM {statements} b"""
query("extract_codes", lambda v: d.extract_codes(v.statements), _CODES)
_POSTCODES = r"SELECT doc_id, 'postcode' AS kind, unnest(regexp_extract_all(head, '\b[0-9]{5}-[0-9]{3}\b')) AS value, 0.85e0 AS confidence FROM {statements} s"
query("extract_postcodes", lambda v: d.extract_postcodes(v.statements), _POSTCODES)
query("signature_areas", lambda v: d.signature_areas(v.statements), r"SELECT doc_id, 0.7e0 AS confidence FROM {statements} s WHERE regexp_matches(lower(head), 'assinatura|signature|signed by|ass\.')")
query("entity_counts", lambda v: d.entity_counts(d.entities(v.statements), d.KINDS), rf"""SELECT k.kind, count(e.kind) AS n FROM (SELECT unnest(['dateField', 'nameField', 'addressField', 'signatureField', 'textField', 'tableField']) AS kind) k LEFT JOIN (
    {" UNION ALL ".join(f"SELECT 'dateField' AS kind, unnest(regexp_extract_all(head, '{p}')) AS v FROM {{statements}} s" for p in _DATES.values())} UNION ALL SELECT 'nameField', name FROM {_NAMES} n UNION ALL SELECT 'textField', value FROM ({_CODES}) c
    UNION ALL SELECT 'addressField', value FROM ({_POSTCODES}) p UNION ALL SELECT 'signatureField', head FROM {{statements}} g WHERE regexp_matches(lower(head), 'assinatura|signature|signed by|ass\.')) e ON k.kind = e.kind GROUP BY k.kind""")
# The first patient or other name, by role and label words, in the order of the roles and then of the text.
query("semantic_query", lambda v: d.semantic_query(d.entities(v.statements.repartition(v.tasks, "doc_id"), only="nameField"), "nameField", label_words=("doctor", "patient"), value="^[A-Z]", first=True).select("doc_id", "role", "value"), f"""
    SELECT doc_id, min_by(role, k) AS role, min_by(name, k) AS value FROM {_NAMES} n WHERE k < 2 AND regexp_matches(name, '^[A-Z]') GROUP BY doc_id""")
query("entity_replace", lambda v: d.entity_replace(v.statements, d.semantic_query(d.entities(v.statements), role="postal"), "00000-000").select("doc_id", "replaced", "head"), rf"""
    SELECT doc_id, regexp_matches(head, '\b[0-9]{{5}}-[0-9]{{3}}\b') AS replaced, regexp_replace(head, '\b[0-9]{{5}}-[0-9]{{3}}\b', '00000-000') AS head FROM {{statements}} s""")

# All dates, codes, numbers and postcodes of a document at once, by id; the twin rewrites the patterns themselves.
_EDITED = lambda v: d.entity_edits(v.statements, f := written(d.entities(v.statements), "entities"), f.filter("kind IN ('dateField', 'textField', 'addressField')").select("doc_id", "place", F.format_string("<%s %d>", "label", F.length("value")).alias("by")))
_MARKED_UP = "head"
for _p, _by in ((r"\b([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}([/.-])[0-9]{1,2}[/.-][0-9]{4})\b", "<Date 10>"), (r"\b[0-9]{5}-[0-9]{3}\b", "<Postal Code 9>"), (r"(CID: )B20\.1", r"\1<CID 5>"), (r"(CPF )123\.456-7", r"\1<ID 9>")):
    _MARKED_UP = f"regexp_replace({_MARKED_UP}, '{_p}', '{_by}', 'g')"
query("entity_edits", lambda v: _EDITED(v).select("doc_id", "edits", "head"), rf"""SELECT doc_id, len(regexp_extract_all(head, '[0-9]+([/.-])[0-9]+[/.-][0-9]+')) + len(regexp_extract_all(head, '[0-9]{{5}}-[0-9]{{3}}')) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS edits, {_MARKED_UP} AS head FROM {{statements}} s""")
# Where patterned values stand; in these texts each stands once, so that a search for the value finds it.
query("entity_positions", lambda v: d.entities(v.statements).filter("kind IN ('dateField', 'textField', 'addressField')").select("doc_id", "kind", "value", "start", "end"), f"""SELECT doc_id, kind, value, (strpos(head, value) - 1)::INT AS start, (strpos(head, value) - 1 + length(value))::INT AS "end" FROM (
    {" UNION ALL ".join(f"SELECT doc_id, 'dateField' AS kind, head, unnest(regexp_extract_all(head, '{p}')) AS value FROM {{statements}} s" for p in _DATES.values())} UNION ALL SELECT doc_id, 'textField', head, value FROM ({_CODES}) c JOIN {{statements}} t USING (doc_id)
    UNION ALL SELECT doc_id, 'addressField', head, value FROM ({_POSTCODES}) p JOIN {{statements}} u USING (doc_id)) v""")


def _found(text: str, target: str) -> str:
    return f"""SELECT doc_id, (u.i - 1)::INT AS n, (list_sum(list_transform(p[1:u.i], lambda x: length(x))) + (u.i - 1) * {len(target)})::BIGINT AS start, (list_sum(list_transform(p[1:u.i], lambda x: length(x))) + u.i * {len(target)})::BIGINT AS "end"
        FROM (SELECT doc_id, string_split({text}, '{target}') AS p FROM {{doc_texts}} d) t, unnest(range(1, len(p))) u(i)"""


query("find_occurrences", lambda v: d.find_occurrences(v.doc_texts, "tion "), _found("text", "tion "))
query("find_matches", lambda v: d.find_occurrences(v.doc_texts, "The", case_sensitive=False), _found("lower(text)", "the"))
query("replace_all", lambda v: d.replace_all(v.doc_texts, "the", "THE").select("doc_id", "n", F.md5("text").alias("digest")), "SELECT doc_id, len(string_split(text, 'the')) - 1 AS n, md5(replace(text, 'the', 'THE')) AS digest FROM {doc_texts} d")
_W = lambda c: rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"
query("replace_check", lambda v: d.replace_check(v.edited_pairs, F.col("target")).select("conv_id", "turn", F.round("accuracy", 9).alias("accuracy"), "gone", "doubled", "leaked", "met"), f"""SELECT conv_id, turn, round(accuracy, 9) AS accuracy, gone, doubled, leaked, accuracy >= 0.98e0 AND gone AND NOT doubled AND NOT leaked AS met FROM (SELECT conv_id, turn,
    CASE WHEN contains(actual, expected) THEN 1e0 WHEN greatest(length(actual), length(expected)) = 0 THEN 0e0 ELSE len(list_filter(range(1, least(length(actual), length(expected)) + 1), lambda i: actual[i] = expected[i])) / greatest(length(actual), length(expected))::DOUBLE END AS accuracy,
    len(list_filter({_W("target")}, lambda w: NOT list_contains({_W("expected")}, w) AND list_contains({_W("actual")}, w))) = 0 AS gone, len(list_distinct({_W("lower(actual)")})) < len({_W("lower(actual)")}) AS doubled,
    len(list_filter({_W("lower(actual)")}, lambda w: NOT list_contains({_W("lower(expected)")}, w))) > 0 AS leaked FROM {{edited_pairs}} p) t""")
query("document_summary", lambda v: d.document_summary(_lines(v)), f"""SELECT doc_id, count(DISTINCT (doc_id, page)) AS pages, count(*) FILTER (WHERE trim(line) <> '' AND (before IS NULL OR trim(before) = '')) AS paragraphs, count(*) AS lines, sum(len(regexp_extract_all(line, '[A-Za-z0-9]+')))::BIGINT AS words,
    sum(len(regexp_extract_all(line, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]+')))::BIGINT AS runs, sum(length(line))::BIGINT AS chars FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM {_LINES} l) l GROUP BY ROLLUP (doc_id)""".replace("\\\\s", "\\s"))
query("word_tokens", lambda v: d.word_tokens(v.doc_texts).select("doc_id", "first_word", "words"), "SELECT doc_id, w[1] AS first_word, len(w)::INT AS words FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM {doc_texts} d) t")
