"""Queries of the catalogue operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrowth.operators import catalog as c
from docgrowth.plans.base import query

_COLS = "seq, keyword, category, volume, difficulty, cpc"
query("keyword_search", lambda v: c.keyword_search(v.keywords, "WIDGET", first=50), f"SELECT {_COLS}, (SELECT count(*) FROM {{keywords}} k WHERE contains(lower(keyword), 'widget') OR contains(lower(category), 'widget')) AS total FROM {{keywords}} k WHERE contains(lower(keyword), 'widget') OR contains(lower(category), 'widget') ORDER BY seq LIMIT 50")
query("keywords_by_category", lambda v: c.keywords_by_category(v.keywords, "PROMO"), f"SELECT {_COLS} FROM {{keywords}} k WHERE category = 'PROMO'")
query("low_difficulty", lambda v: c.low_difficulty(v.keywords), f"SELECT {_COLS} FROM {{keywords}} k WHERE difficulty <= 30 ORDER BY volume DESC, seq")
query("high_volume", lambda v: c.high_volume(v.keywords), f"SELECT {_COLS} FROM {{keywords}} k WHERE volume >= 1000 ORDER BY difficulty, seq")
query("best_opportunities", lambda v: c.best_opportunities(v.keywords), f"SELECT {_COLS}, volume / difficulty::DOUBLE AS chance FROM {{keywords}} k WHERE difficulty <= 40 AND volume >= 500")
query("high_cpc", lambda v: c.high_cpc(v.keywords), f"SELECT {_COLS} FROM {{keywords}} k WHERE cpc >= 2")
query("total_volume", lambda v: c.total_volume(v.keywords), "SELECT sum(volume)::BIGINT AS volume FROM {keywords} k")
query("category_list", lambda v: c.category_list(v.keywords), "SELECT category, min(seq) AS first_seq FROM {keywords} k GROUP BY category")


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.replace("'", "''").split(";")) + "]"


_A = _list("edit;merge;split;compress;convert;rotate;sign;unlock;resize;delete pages from;extract pages from;reorder pages in;add text to;add image to;remove text from;remove image from;watermark;stamp;number pages in;flatten;optimize;reduce size of;change format of")
_Q = _list("online free;free online;in browser;without signup;without watermark;without installing software;quickly;in seconds;on mac;on windows;on linux;on mobile;high quality;for free;no limits")
query("expand_keywords", lambda v: c.expand_keywords(v.keywords), f"""SELECT phrase, seq, (key % 1000000)::INT AS at FROM (
    SELECT phrase, min(seq * 1000000 + i) AS key, min_by(seq, seq * 1000000 + i) AS seq FROM (
      SELECT seq, 0 AS i, keyword AS phrase FROM {{keywords}} k
      UNION ALL SELECT seq, i + 1, {_A}[i + 1] || ' ' || keyword FROM {{keywords}} k, range(23) r(i)
      UNION ALL SELECT seq, i + 1 + 23, keyword || ' ' || {_Q}[i + 1] FROM {{keywords}} k, range(15) r(i)
      UNION ALL SELECT seq, i + 1 + 38, {_A}[i // 15 + 1] || ' ' || keyword || ' ' || {_Q}[i % 15 + 1]
        FROM {{keywords}} k, range(345) r(i)) t GROUP BY phrase) t ORDER BY key LIMIT 1500""")
_FORMS = """list_concat([keyword], list_transform(['free', 'online', 'without signup', 'no watermark', 'best', 'alternative', 'tool', 'editor', 'in browser', 'for free', 'no limits'], lambda m: keyword || ' ' || m),
    ['how to ' || keyword, keyword || ' on mac', keyword || ' on mobile', keyword || ' without installing', 'best ' || keyword, keyword || ' vs', 'top ' || keyword, keyword || ' review'])"""  # without those that are there already
query("keyword_discovery", lambda v: c.keyword_discovery(v.keywords), f"""SELECT keyword AS seed, (i - 1)::INT AS place, f[i] AS phrase, i BETWEEN 2 AND 6 AS related
    FROM (SELECT keyword, {_FORMS} AS f FROM {{keywords}} k) t, (SELECT unnest(range(1, 21)) AS i) r WHERE i <= len(f)""")
query("slugify_keyword", lambda v: v.keywords.select("seq", c.slugify_keyword(F.col("keyword")).alias("slug")), r"SELECT seq, regexp_replace(lower(keyword), '\s+', '-', 'g') AS slug FROM {keywords} k")
query("slugify_brand", lambda v: v.customer.select("c_custkey", c.slugify_brand(F.col("c_name")).alias("slug")), "SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM {customer} c")
_TITLES = "Free online {keyword} tool — No signup needed;Best way to {keyword} in seconds;{keyword} — fast & secure PDF tool;How to {keyword} online for free;{keyword} instantly in your browser;The easiest way to {keyword};Free {keyword} — no limits, no watermark;{keyword} online — try it now"
_H1 = "Free Online Tool to {keyword};How to {keyword} — Fast & Free;{keyword} Online;Best {keyword} Tool"
_ABOUT = "Use our tool to {keyword} instantly in your browser. No signup, no watermark, 100% free.;Free online tool to {keyword}. Fast, secure, and works on any device. Try it now!;Looking to {keyword}? our tool makes it easy. Free, browser-based, no installation needed."


def _one_of(templates: str, word: str, field: str):
    """Whether the field is one of the templates, filled."""
    return F.exists(F.split(F.lit(templates), ";"), lambda t: F.replace(t, F.lit("{keyword}"), F.expr(word)) == F.col(field)).alias(field)


#: Which templates a page has: any of each kind, and sections that follow each other, two or three between two buttons.
query("page_factory", lambda v: c.page_factory(v.keywords).join(v.keywords.select("seq", "keyword"), "seq").select(
        "seq", "slug", "category", "volume", "difficulty", *(_one_of(t, w, f) for t, w, f in ((_TITLES, "keyword", "title"), (_H1, "concat(upper(substr(keyword, 1, 1)), substr(keyword, 2))", "h1"), (_ABOUT, "keyword", "description"))),
        F.regexp_count("content", F.lit("<h2>")).between(2, 3).alias("sections"), F.regexp_count("content", F.lit("cta-button")).alias("buttons"), F.col("content").contains("{").alias("holes")),
      r"""SELECT seq, regexp_replace(lower(keyword), '\s+', '-', 'g') AS slug, coalesce(nullif(category, ''), 'general') AS category, coalesce(nullif(volume, 0), 1000) AS volume, coalesce(nullif(difficulty, 0), 30) AS difficulty,
    true AS title, true AS h1, true AS description, true AS sections, 2 AS buttons, false AS holes FROM {keywords} k""")
query("competitor_pages", lambda v: c.competitor_pages(v.customer.select(F.col("c_name").alias("brand"))), """SELECT c_name AS brand, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-alternative' AS slug,
    'Best ' || c_name || ' Alternative — Free & Better' AS title, c_name || ' Alternative' AS h1, 'Looking for a free alternative to ' || c_name || '? our tool offers everything ' || c_name || ' does — no signup, no watermark, 100% browser-based.' AS description FROM {customer} c""")
_QA = """SELECT unnest([0, 1, 2, 3, 4, 5]) AS place, unnest(['How to {K}?', 'Is {K} free?', 'Can I {K} online without installing software?', 'Is it safe to {K}?', 'What is the best tool to {K}?', 'Can I {K} on mobile?']) AS q,
    unnest(['Upload your PDF file to our tool, select "{K}" option, and download the result. No signup required, works in your browser instantly.', 'Yes! our tool offers {K} completely free. No hidden charges, no watermark, and no credit card required.',
    'Absolutely. Everything runs directly in your browser. No downloads, no installations, no plugins needed.', 'Yes. All PDF processing happens in your browser. Your files are never uploaded to our servers during processing.',
    'our tool is the top-rated free tool for {K}. It''s fast, secure, and works on any device with zero limits.', 'Yes, our tool works on any device with a modern browser, including phones and tablets.']) AS a"""
query("faq_rows", lambda v: c.faq_rows(v.keywords), f"SELECT seq, place::INT AS place, replace(q, '{{K}}', keyword) AS question, replace(a, '{{K}}', keyword) AS answer FROM {{keywords}} k, ({_QA}) f")
query("internal_links", lambda v: c.internal_links(v.keywords), """SELECT seq, place::INT AS place, link FROM (SELECT a.seq, b.seq AS link, row_number() OVER (PARTITION BY a.seq ORDER BY a.category IS DISTINCT FROM b.category, b.seq) AS place
    FROM {keywords} a JOIN {keywords} b ON a.seq <> b.seq) t WHERE place <= 5""")
query("sitemap", lambda v: c.sitemap(v.keywords, "2024-03-01"), r"""SELECT '/' || regexp_replace(lower(keyword), '\s+', '-', 'g') AS loc, seq, '2024-03-01' AS lastmod, CASE WHEN difficulty < 30 THEN 1e0 WHEN difficulty < 50 THEN 0.8e0 ELSE 0.6e0 END AS priority FROM {keywords} k""")
_WANTED = "SELECT DISTINCT replace(CASE WHEN seq % 2 = 0 THEN upper(keyword) ELSE concat(keyword, ' x') END, ' ', '-') AS slug FROM {keywords} k"
query("page_lookup", lambda v: c.page_lookup(v.sql(_WANTED), v.keywords), f"""SELECT slug, coalesce(category, 'general') AS category, category IS NOT NULL AS known FROM ({_WANTED}) w
    LEFT JOIN (SELECT lower(keyword) AS key, min_by(category, seq) AS category FROM {{keywords}} k GROUP BY lower(keyword)) k ON lower(replace(slug, '-', ' ')) = key""")
query("pipeline_report", lambda v: c.pipeline_report(v.keywords, v.page_perf))
_USED = r"SELECT DISTINCT regexp_extract(html, 'href=./([A-Za-z]+)', 1) AS word FROM {pages} p"
_KNOWN = "SELECT DISTINCT regexp_extract(text, '^[A-Za-z]+', 0) AS word FROM {documents} d"
query("missing_keys", lambda v: c.missing_keys(v.sql(_USED), v.sql(_KNOWN), "word"), f"SELECT word FROM ({_USED}) u WHERE word NOT IN (SELECT word FROM ({_KNOWN}) k)")
_D1 = "SELECT n_nationkey AS id, n_name AS name FROM {nation} n WHERE n_nationkey < 15"
_D2 = "SELECT n_nationkey AS id, 'other' AS name FROM {nation} n WHERE n_nationkey > 8"
query("merge_dictionaries", lambda v: c.merge_dictionaries(v.sql(_D1), v.sql(_D2), "id", "name"), f"SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name FROM ({_D1}) a FULL JOIN ({_D2}) b ON a.id = b.id")
