"""Queries whose inputs are made from the tables by SQL functions, so that a method decides rows that the tables leave to rules.

They are fixtures: of the tables only the ids are read, and the texts are made up from them.

The tables hold no tool calls, no links between pages, and few secrets that no pattern finds. Here conversations turn
into calls with results and constraints, and pages into redirects or sites with notices, by rules that SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkfield.llm import html_text, secrets, tool_chat, url_filter
from larkfield.runtime import read_table


def derived_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a token behind it: for even ids a hash of the id in base 64, else an identifier. (doc_id, found)"""
    docs = read_table(spark, sf, "documents")
    token = F.base64(F.unhex(F.substring(F.sha2(F.concat(F.lit("k"), F.col("doc_id").cast("string")), 256), 1, 36)))
    name = F.concat(F.lit("report_of_section_"), F.col("doc_id").cast("string"))
    text = F.concat(F.lit("note "), F.when(F.col("doc_id") % 2 == 0, token).otherwise(name), F.lit(" end"))
    return secrets.scan_secrets(docs.select("doc_id", text.alias("text"))).select("doc_id", (F.size("secrets") > 0).alias("found"))


def derived_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as calls: each needs the turn before, even ones have results. (conv_id, turn, level, status) of the calls."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn")
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    call = F.struct(F.struct(name(F.col("turn")).alias("id"), F.when(F.col("turn") % 5 == 3, "fetch").otherwise("search").alias("name"), F.lit('{"query":"q"}').alias("arguments"), F.array(name(F.col("turn") - 1)).alias("after")).alias("c"))
    made = turns.select("conv_id", "turn", F.lit("assistant").alias("role"), F.concat(F.lit('{"tool_calls":['), F.to_json(call["c"]), F.lit("]}")).alias("text"))
    result = F.to_json(F.struct(name(F.col("turn")).alias("tool_call_id"), F.lit("done").alias("content")))
    given = turns.where("turn % 2 = 0").select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text"))
    out = tool_chat.format_chat(made.unionByName(given)).where("kind = 'call'")
    return out.select("conv_id", "turn", F.col("level").cast("long").alias("level"), "status")


def derived_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as urls of one host; page n redirects to n + 1 unless n + 1 divides by 7; numbers that divide by 21 are blocked. (page_id, verdict)"""
    pages = read_table(spark, sf, "pages").select("page_id")
    url = lambda n: F.concat(F.lit("http://a.com/"), F.when(n % 21 == 0, "bad/").otherwise("p/"), n.cast("string"))
    rows = pages.select("page_id", url(F.col("page_id")).alias("url"))
    links = pages.where("(page_id + 1) % 7 <> 0").select(url(F.col("page_id")).alias("source"), url(F.col("page_id") + 1).alias("target"))
    rules = (("a.com", "/bad/", "block"),)
    return url_filter.judge_urls(rows, rules, html_col=None, redirects=links).select("page_id", F.col("url_verdict.verdict").alias("verdict"))


def derived_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as articles of seven hosts that end with a notice: on nine pages of ten of hosts 0 to 4, on each second page of the others. (page_id, text)"""
    pages = read_table(spark, sf, "pages").select("page_id").distinct()
    own = F.concat(F.lit("<p>page number "), F.col("page_id").cast("string"), F.lit(" has a text of its own about "), F.array_join(F.array_repeat(F.col("page_id").cast("string"), 9), " and "), F.lit("</p>"))
    notice = F.concat(F.lit("<p>all that host "), (F.col("page_id") % 7).cast("string"), F.lit(" shows may be read by anyone who cares to</p>"))
    shown = F.when(F.col("page_id") % 7 < 5, F.col("page_id") % 10 > 0).otherwise(F.col("page_id") % 2 == 0)
    html = F.concat(F.lit("<article>"), own, F.when(shown, notice).otherwise(""), F.lit("</article>"))
    made = pages.select("page_id", F.concat(F.lit("http://h"), (F.col("page_id") % 7).cast("string"), F.lit(".com/")).alias("url"), html.alias("html"))
    return html_text.main_text(made).select("page_id", "text")


QUERIES = {"derived_secrets": derived_secrets, "derived_tool_calls": derived_tool_calls, "derived_redirects": derived_redirects, "derived_boilerplate": derived_boilerplate}
SQL = {
    "derived_secrets": "SELECT doc_id, doc_id % 2 = 0 AS found FROM documents",
    # a run of consecutive turns is a chain: a call's level is its place in the run
    "derived_tool_calls": """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations),
r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS level,
  CASE WHEN turn % 5 = 3 THEN 'invalid: missing url' WHEN turn % 2 = 0 THEN 'ok' ELSE 'pending' END AS status FROM r""",
    # groups are runs between numbers that divide by 7, broken where a page is missing
    "derived_redirects": """WITH p AS (SELECT DISTINCT page_id AS n FROM pages),
u AS (SELECT n FROM p UNION SELECT n + 1 FROM p WHERE (n + 1) % 7 <> 0),
s AS (SELECT n, CASE WHEN n % 7 <> 0 AND (n - 1) IN (SELECT n FROM p) THEN 0 ELSE 1 END AS new FROM u),
g AS (SELECT n, sum(new) OVER (ORDER BY n) AS g FROM s),
b AS (SELECT g, count(*) AS size, bool_or(n % 21 = 0) AS bad FROM g GROUP BY g)
SELECT page_id, CASE WHEN b.bad THEN 'block' ELSE 'allow' END AS verdict FROM pages JOIN g ON g.n = page_id JOIN b ON b.g = g.g""",
    "derived_boilerplate": """SELECT page_id, 'page number ' || page_id || ' has a text of its own about ' || array_to_string(list_transform(range(9), lambda i: page_id), ' and ') ||
  CASE WHEN page_id % 7 > 4 AND page_id % 2 = 0 THEN chr(10) || chr(10) || 'all that host ' || page_id % 7 || ' shows may be read by anyone who cares to' ELSE '' END AS text
FROM (SELECT DISTINCT page_id FROM pages)""",
}
