"""URL filters with redirect equivalence.

Rules give explicit decisions. Redirects, meta refreshes and canonical links join urls into groups of
aliases by distributed connected components; a block decision reaches every alias that no rule decides,
and an explicit allow of a url always takes precedence over a block that reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkfield.operators.components import connected_components
from larkfield.runtime import Scratch, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url that aliases are compared by: host in lower case, scheme and fragment left out."""
    rest = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def decide(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits; nulls where none does. The rules are a short list."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ordered):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        chain = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    pieces = F.slice(F.split(path, "/"), 2, 1 << 20)
    last = F.element_at(pieces, -1)

    def step(held, s):
        up = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when(s == ".", held).when(s == "..", up).otherwise(F.concat(held, F.array(s)))

    kept = F.aggregate(pieces, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve(base: Column, target: Column) -> Column:
    """The url that a link of a page at ``base`` leads to; ``&amp;`` counts as ``&``.

    Absolute ones stay; those that begin with ``//`` keep the page's scheme, those with ``/`` its host, those with ``?`` its path,
    those with ``#`` lead to the page, and others replace what follows the last ``/`` of its path. ``.`` and ``..`` are resolved.
    """
    t = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    site = F.concat(F.regexp_extract(base, "^[^:]*://", 0), host_of(base))
    query = lambda x: F.regexp_extract(x, "[?].*$", 0)
    bare = F.regexp_extract(t, "^[^?#]*", 0)
    folder = F.regexp_extract(F.concat(F.when(F.startswith(path_of(base), F.lit("/")), "").otherwise("/"), path_of(base)), "^.*/", 0)
    return (
        F.when(F.rlike(t, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), t)
        .when(F.startswith(t, F.lit("//")), F.concat(F.regexp_extract(base, "^[^:]*:", 0), t))
        .when(F.startswith(t, F.lit("/")), F.concat(site, _without_dots(bare), query(t)))
        .when(F.startswith(t, F.lit("?")), F.concat(site, path_of(base), t))
        .when((t == "") | F.startswith(t, F.lit("#")), base)
        .otherwise(F.concat(site, _without_dots(F.concat(folder, bare)), query(t)))
    )


def html_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target) urls of canonical links and meta refreshes, resolved against the page's url."""
    html = F.col(html_col)
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    meta = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"'][^\"'>]*?url\s*=\s*([^\"'\s>]+)"
    few = pages.where(html.contains("canonical") | html.contains("refresh") | F.rlike(html, F.lit("(?i)canonical|refresh")))
    target = F.explode(F.array_distinct(F.concat(F.regexp_extract_all(html, F.lit(tag), F.lit(1)), F.regexp_extract_all(html, F.lit(meta), F.lit(1)))))
    found = few.select(F.col(url_col).cast("string").alias("source"), target.alias("target")).where("instr(source, '://') > 0")
    return found.select("source", resolve(F.col("source"), F.col("target")).alias("target"))


def judge_urls(
    pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """``pages`` with a struct ``url_verdict`` (``url_verdict_1``, ... if pages has that name): host, path, rule, verdict.

    ``redirects`` may add (source, target) urls to the links found in html. A null url, or one without
    ``://``, has an empty host and path, fits no rule, has no alias and is allowed. Equal urls are one
    node; self links and repeated links count once; an empty table stays empty. A target that is no page
    is judged by the rules as well, so a page that redirects to a blocked url is blocked.
    """
    spark = pages.sparkSession
    k, name = 0, "url_verdict"
    while name.lower() in {c.lower() for c in pages.columns}:
        k, name = k + 1, f"url_verdict_{k + 1}"
    names = [f"c{i}" for i in range(len(pages.columns))]
    named = pages.toDF(*names)
    url = F.col(names[pages.columns.index(url_col)]).cast("string")
    links = redirects.select("source", "target") if redirects is not None else None
    if html_col:
        found = html_links(pages, url_col, html_col)
        links = found if links is None else links.unionByName(found)
    judged = named.withColumn("lf_host", host_of(url)).withColumn("lf_path", path_of(url))
    judged = judged.withColumn("lf_rule", decide(F.col("lf_host"), F.col("lf_path"), rules)).withColumn("lf_node", F.md5(node_of(url)))
    blocked = F.lit(False)
    if links is not None:
        scratch = Scratch(spark, "urls")
        ends = scratch.save(links.where("source is not null and target is not null").distinct(), "links")
        node = lambda c: F.when(F.instr(c, "://") > 0, F.md5(node_of(F.col(c))))
        groups = connected_components(ends.select(node("source").alias("a"), node("target").alias("b")), scratch)
        urls = ends.select(F.explode(F.array("source", "target")).alias("u")).where(F.instr("u", "://") > 0).distinct()
        explicit = urls.select(F.md5(node_of(F.col("u"))).alias("node"), decide(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("v"))
        bad = groups.join(explicit.where("v = 'block'"), "node").select("root").distinct()
        bad = groups.join(bad, "root").select(F.col("node").alias("lf_node"), F.lit(True).alias("lf_bad")).distinct()
        judged = judged.join(bad, "lf_node", "left")
        blocked = F.coalesce("lf_bad", F.lit(False))
    verdict = F.coalesce(F.col("lf_rule.verdict"), F.when(blocked, "block").otherwise("allow"))
    answer = F.struct(F.col("lf_host").alias("host"), F.col("lf_path").alias("path"), F.col("lf_rule.rule").alias("rule"), verdict.alias("verdict"))
    return judged.select(*[F.col(n).alias(c) for n, c in zip(names, pages.columns, strict=True)], answer.alias(name))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", *[F.col(f"url_verdict.{f}").alias(f) for f in ("host", "path", "rule", "verdict")])


#: the links of a page reach its direct neighbours and on by recursion
OP10_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html FROM pages),
x AS (
  SELECT url AS source, unnest(list_concat(
    regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract_all(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*([^"''\s>]+)', 1))) AS t
  FROM p WHERE contains(url, '://')),
z AS (SELECT source, trim(replace(t, '&amp;', '&')) AS t, regexp_extract(source, '^[^:]*://') || translate(regexp_extract(substr(source, instr(source, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS site,
  regexp_extract(substr(source, instr(source, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM x),
f AS (SELECT *, CASE WHEN starts_with(t, '/') THEN regexp_extract(t, '^[^?#]*') ELSE regexp_extract(CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END, '^.*/') || regexp_extract(t, '^[^?#]*') END AS full_path FROM z),
w AS (SELECT *, list_reduce(list_transform(string_split(full_path, '/')[2:], lambda s: [s]), lambda a, s: CASE s[1] WHEN '.' THEN a WHEN '..' THEN a[1:len(a) - 1] ELSE list_concat(a, s) END, CAST([] AS VARCHAR[])) AS kept FROM f),
v AS (SELECT *, '/' || array_to_string(kept, '/') || CASE WHEN regexp_matches(full_path, '/[.]{1,2}$') AND len(kept) > 0 THEN '/' ELSE '' END || regexp_extract(t, '[?].*$') AS rest FROM w),
y AS (SELECT source, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN regexp_extract(source, '^[^:]*:') || t
  WHEN starts_with(t, '/') THEN site || rest WHEN starts_with(t, '?') THEN site || path || t WHEN t = '' OR starts_with(t, '#') THEN source ELSE site || rest END AS t FROM v),
u AS (SELECT url FROM p WHERE url IS NOT NULL UNION SELECT source FROM y UNION SELECT t FROM y),
h AS (
  SELECT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
n AS (
  SELECT url, rest <> '' OR contains(url, '://') AS is_url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM h),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, q, verdict)),
d AS (
  SELECT n.url, arg_max(r.h || r.q, length(r.h || r.q)) AS rule, arg_max(r.verdict, length(r.h || r.q)) AS verdict
  FROM n JOIN r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.q) GROUP BY 1),
k AS (SELECT n.url, CASE WHEN is_url THEN host || tail END AS node, d.rule, d.verdict FROM n LEFT JOIN d ON d.url = n.url),
e AS (SELECT a.node AS a, b.node AS b FROM y JOIN k a ON a.url = y.source JOIN k b ON b.url = y.t WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT DISTINCT node FROM k WHERE verdict = 'block' AND node IN (SELECT a FROM s) UNION SELECT s.b FROM c JOIN s ON s.a = c.node)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, k.rule,
  coalesce(k.verdict, CASE WHEN k.node IN (SELECT node FROM c) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN n ON n.url = p.url LEFT JOIN k ON k.url = p.url
"""
