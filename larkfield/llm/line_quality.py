"""Quality rules: counts of each text, and cross-document line frequency.

Normalised lines are hashed; for every host the distinct documents that hold a line are counted over all
rows. Lines in more than a share of the host's documents are removed, and a document that keeps too little of
itself is rejected. The counts of a text need no shuffle. Lines move as 64-bit hashes (of host and line, and of the
document), dealt by both before they are counted by line, so a line that a third of the documents share is
spread by document first. The lines above the limit are written and joined back: broadcast where the
planner finds them short, else by a join that is salted for the same reason. Texts move only if what is left of
them is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkfield.runtime import Scratch, read_table

#: fixed definitions of words and symbols
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: a line is cut that over LINE_PERCENT of a host's documents hold, and LINE_DOCS at least
LINE_PERCENT, LINE_DOCS = 5, 5
#: share of its words that a document has to keep
LEAST_LEFT = 0.3
SALTS = 16


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the same text."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def covered(ordered):
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(places, zero, step, lambda acc: acc["n"])

    def counted(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(ordered, covered))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_let(hashes, counted))


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def text_counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text that is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counts = lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        repeated_words(ws).alias("n_repeat_words"),
    )
    return F.struct(
        _let(words, counts).alias("w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def line_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    line_percent: int = LINE_PERCENT, line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT, with_left: bool = False,
) -> DataFrame:
    """``docs`` with a struct ``quality`` (``quality_1``, ... if docs has that name) at the end.

    quality holds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_cut (words in lines that over
    ``line_percent`` of the host's documents hold, and ``line_docs`` at least), base_failed, kept and, with
    ``with_left``, left (the text without those lines). A null text counts as empty, a null host as a host of its own, and rows that repeat id,
    text and host as one document. kept is false if base_failed (fewer than 10 words, or over 20 percent of them
    repeat), or if less than ``least_left`` of the words is left. No row is dropped.
    """
    k, name = 0, "quality"
    while name.lower() in {c.lower() for c in docs.columns}:
        k, name = k + 1, f"quality_{k + 1}"
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = lambda c: F.col(names[docs.columns.index(c)])
    text = F.coalesce(of(text_col).cast("string"), F.lit(""))
    host = F.coalesce(of(host_col).cast("string"), F.lit("\0"))
    keyed = docs.toDF(*names).select("*", F.xxhash64(of(id_col).cast("string"), text, host).alias("lf_row"), F.xxhash64(host).alias("lf_host"))
    lines = F.transform(
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
        lambda x: _let(normal_line(x), lambda y: F.struct(F.xxhash64(host, y).alias("h"), F.size(F.split(y, " ")).alias("n"))),
    )
    long = keyed.select("lf_row", "lf_host", F.explode(lines).alias("l")).select("lf_row", "lf_host", "l.h", "l.n")
    hosts = keyed.groupBy("lf_host").agg(F.count_distinct("lf_row").alias("all"))
    shared = long.groupBy("h").agg(F.count_distinct("lf_row").alias("docs"), F.min("lf_host").alias("lf_host")).where(F.col("docs") >= line_docs)
    frequent = shared.join(hosts, "lf_host").where(100 * F.col("docs") > line_percent * F.col("all"))
    # written first, so that the planner knows its size: a short list is broadcast and the lines stay where they are
    frequent = Scratch(docs.sparkSession, "lines").save(frequent.select("h"), "frequent")
    frequent = frequent.select("h", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    gone = [F.collect_set("h").alias("lf_lines")] if with_left else []
    cut = (
        long.withColumn("salt", F.pmod("lf_row", F.lit(SALTS)).cast("int"))
        .join(frequent, ["h", "salt"])
        .groupBy("lf_row").agg(F.sum("n").alias("lf_cut"), *gone)
    )
    # rows that repeat were summed together: their number divides the sum again
    times = keyed.groupBy("lf_row").agg(F.count("*").alias("lf_times")).where("lf_times > 1")
    out = keyed.withColumn("lf_q", text_counts(text)).join(cut, "lf_row", "left").join(times, "lf_row", "left")
    n_words, repeat = F.col("lf_q.w.n_words"), F.col("lf_q.w.n_repeat_words")
    n_cut = F.coalesce(F.col("lf_cut") / F.coalesce("lf_times", F.lit(1)), F.lit(0)).cast("long")
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    fields = [
        n_words.alias("n_words"), F.col("lf_q.w.word_chars").alias("word_chars"), F.col("lf_q.n_symbols").alias("n_symbols"),
        F.col("lf_q.n_dup_lines").alias("n_dup_lines"), repeat.alias("n_repeat_words"), n_cut.alias("n_cut"),
        failed.alias("base_failed"), (~failed & (n_words - n_cut >= least_left * n_words)).alias("kept"),
    ]
    if with_left:
        cut_lines = F.coalesce(F.col("lf_lines"), F.array().cast("array<bigint>"))
        left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(cut_lines, F.xxhash64(host, normal_line(x))))
        fields.append(F.array_join(left, "\n").alias("left"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], F.struct(*fields).alias(name))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = line_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) - 3 AS BIGINT))) AS i FROM d WHERE len(ws) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, source, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM (SELECT doc_id, source, unnest(ls) AS line FROM d)),
h AS (SELECT source, count(DISTINCT doc_id) AS n FROM d GROUP BY 1),
f AS (SELECT l.source, line FROM l JOIN h ON h.source IS NOT DISTINCT FROM l.source GROUP BY l.source, line, h.n
  HAVING count(DISTINCT doc_id) >= 5 AND 100 * count(DISTINCT doc_id) > 5 * h.n),
c AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS n FROM l JOIN f ON f.source IS NOT DISTINCT FROM l.source AND f.line = l.line GROUP BY 1),
q AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(c.n, 0) AS n_cut
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_cut >= 0.3 * n_words AS kept
FROM q
"""
