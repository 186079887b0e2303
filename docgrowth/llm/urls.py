"""URL filters: rules by host and path, and templates of paths learned per host.

Every path becomes a template: a segment with a digit is variable (`*`), and so is every
child of a node with more than `children` different ones; segments beyond the `depth`th
count as one (`**`). Branches of a host that differ in their last fixed segment only are
alike in structure; they are merged (`+`) where the counts allow it: a branch stays apart
if its blocked urls differ from the siblings' common share by more than `z` standard
deviations (and half a url). Unlabelled branches merge too, so evidence reaches urls that
no rule fits.

The labels are the verdicts of the rules; urls without a rule get their template's. A
template is rejected if its smoothed purity, blocked / (labelled + weight + doubt *
unlabelled), is at least `purity`: labels of a small part say little about the rest, so
each unlabelled url counts as `doubt` of an allowed one.

Only built-in functions: templates are few per host, so the tree is built on the grouped
(host, template) table and joined back. Defined results: a null url, or one without
"://", has an empty host and path, fits no rule, and belongs to the template of the
empty host; a template without labels is allowed; repeated rows are judged each; other
columns, of any name, are left out; an empty table gives no rows. Whole urls are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct<name, verdict>; null if none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # a longer one replaces a shorter
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _tree(paths: DataFrame, children: int, z: float) -> DataFrame:
    """(host, shape, template, blocked, labelled, urls): the final template of each path shape of a host."""
    step = paths.select("host", "shape", "blocked", "labelled", "urls", F.posexplode(F.split("shape", "/")).alias("at", "part")).withColumn(
        "parent", F.array_join(F.slice(F.split("shape", "/"), 1, F.col("at")), "/")
    )
    wide = step.groupBy("host", "at", "parent").agg(F.count_distinct("part").alias("n")).filter((F.col("n") > children) & (F.col("at") > 0)).select("host", "at", "parent", F.lit("*").alias("any"))
    named = step.join(wide, ["host", "at", "parent"], "left").groupBy("host", "shape").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("any", "part").alias("part")))).alias("parts"), *(F.first(c).alias(c) for c in ("blocked", "labelled", "urls"))
    )
    named = named.withColumn("template", F.array_join(F.transform("parts", lambda p: p["part"]), "/"))
    named = named.withColumn("context", F.regexp_replace("template", r"^(.*/)[^/*]+((?:/\*+)*)$", "$1+$2"))
    leaf = named.groupBy("host", "context", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"))
    pooled = leaf.groupBy("host", "context").agg((F.sum("b") / F.nullif(F.sum("n"), F.lit(0))).alias("share"), F.count("*").alias("siblings")).filter("siblings > 1 AND share IS NOT NULL")
    near = F.abs(F.col("b") - F.col("n") * F.col("share")) <= z * F.sqrt(F.col("n") * F.col("share") * (1 - F.col("share"))) + 0.5
    alike = leaf.join(pooled, ["host", "context"]).filter(near).select("host", "template", F.col("context").alias("merged"))
    final = named.join(alike, ["host", "template"], "left").withColumn("template", F.coalesce("merged", "template"))
    total = final.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("blocked", "labelled", "urls")))
    return final.select("host", "shape", "template").join(total, ["host", "template"])


def judge(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, children: int = 16, depth: int = 32, z: float = 2.0, weight: float = 1.0, doubt: float = 0.25, purity: float = 0.8
) -> DataFrame:
    """(key, host, path, rule, verdict, template, blocked, labelled, urls) of every row."""
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    parts = F.transform(F.split(F.rtrim("path", F.lit("/")), "/"), lambda p: F.when(p.rlike("[0-9]"), "*").otherwise(p))
    urls = urls.withColumn("shape", F.when(F.size(parts) > depth, F.concat(F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/**"))).otherwise(F.array_join(parts, "/")))
    counted = urls.groupBy("host", "shape").agg(F.count_if(F.col("r.verdict") == "block").alias("blocked"), F.count("r").alias("labelled"), F.count("*").alias("urls"))
    tree = _tree(counted, children, z)
    seen = F.col("labelled") + weight + doubt * (F.col("urls") - F.col("labelled"))
    learned = F.when((F.col("labelled") > 0) & (F.col("blocked") >= purity * seen), "block").otherwise("allow")
    met = urls.join(tree, ["host", "shape"])
    return met.select(key, "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", learned).alias("verdict"), "template", "blocked", "labelled", F.col("urls"))


#: DuckDB twin of judge() with its defaults, over the view `pages`.
SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
    string_split(regexp_replace(regexp_replace(path, '[^/]*[0-9][^/]*', '*', 'g'), '/+$', ''), '/') AS bits FROM urls),
labelled AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label,
  CASE WHEN len(bits) > 32 THEN array_to_string(bits[1:32], '/') || '/**' ELSE array_to_string(bits, '/') END AS shape FROM ruled),
counted AS (SELECT host, shape, count(*) FILTER (label = 'block') AS blocked, count(label) AS labelled, count(*) AS urls FROM labelled GROUP BY ALL),
numbered AS (SELECT *, unnest(range(len(string_split(shape, '/')))) AS pos FROM counted),
step AS (SELECT *, string_split(shape, '/')[pos + 1] AS part, array_to_string(string_split(shape, '/')[1:pos], '/') AS parent FROM numbered),
wide AS (SELECT host, pos, parent FROM step WHERE pos > 0 GROUP BY ALL HAVING count(DISTINCT part) > 16),
named AS (
  SELECT s.host, s.shape, any_value(blocked) AS blocked, any_value(labelled) AS labelled, any_value(urls) AS urls,
         string_agg(CASE WHEN w.host IS NULL THEN part ELSE '*' END, '/' ORDER BY s.pos) AS template
  FROM step s LEFT JOIN wide w ON s.host = w.host AND s.pos = w.pos AND s.parent = w.parent GROUP BY s.host, s.shape),
placed AS (SELECT *, regexp_replace(template, '^(.*/)[^/*]+((?:/\*+)*)$', '\1+\2') AS context FROM named),
leaf AS (SELECT host, context, template, sum(blocked) AS b, sum(labelled) AS n FROM placed GROUP BY ALL),
pooled AS (SELECT host, context, sum(b) / nullif(sum(n), 0)::DOUBLE AS share FROM leaf GROUP BY ALL HAVING count(*) > 1 AND sum(n) > 0),
alike AS (SELECT l.host, l.template, l.context FROM leaf l JOIN pooled p ON l.host = p.host AND l.context = p.context WHERE abs(b - n * share) <= 2e0 * sqrt(n * share * (1 - share)) + 0.5e0),
final AS (
  SELECT p.host, p.shape, p.blocked, p.labelled, p.urls, coalesce(a.context, p.template) AS template
  FROM placed p LEFT JOIN alike a ON p.host = a.host AND p.template = a.template),
total AS (SELECT host, template, sum(blocked) AS blocked, sum(labelled) AS labelled, sum(urls) AS urls FROM final GROUP BY ALL)
SELECT l.page_id, l.host, l.path, l.rule,
       coalesce(l.label, CASE WHEN t.labelled > 0 AND t.blocked >= 0.8e0 * (t.labelled + 1e0 + 0.25e0 * (t.urls - t.labelled)) THEN 'block' ELSE 'allow' END) AS verdict,
       f.template, t.blocked::BIGINT AS blocked, t.labelled::BIGINT AS labelled, t.urls::BIGINT AS urls
FROM labelled l JOIN final f ON l.host = f.host AND l.shape = f.shape JOIN total t ON f.host = t.host AND f.template = t.template
"""
