"""Queries over time series, ledgers, cases and message traces, with SQL that gives the same rows.

``events`` stands in for sensor readings, ledgers and case states, ``conversations`` for message traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkfield.functions import parse
from larkfield.operators import evaluation, ledger, routing, series
from larkfield.runtime import read_table

START, END, AS_OF, NOW = "2024-01-05", "2024-01-20", "2024-01-12", "2024-01-31 00:00:00"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def asof_window(spark, sf):
    """Readings of the window as it was known on the as-of date, by type."""
    w = series.as_of_window(F.lit(START), F.lit(END), F.lit(AS_OF))
    rows = _events(spark, sf).where(series.in_window(F.col("ts"), w["start"], w["end"], F.to_timestamp(F.lit(NOW))))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def coverage_gap(spark, sf):
    return series.coverage_gap(_events(spark, sf), "user_id", "ts", F.lit(START)).select("user_id", "gap")


def window_stats(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = _events(spark, sf).withColumn("day", day).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = series.window_stats(rows, ["event_type", "day"], "cents", F.struct("ts", "event_id"))
    return out.select("event_type", "day", "latest", "least", "greatest", F.col("total").cast("long").alias("total"), "n")


def latest_per_key(spark, sf):
    return ledger.latest(_events(spark, sf), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def _log(spark, sf):
    """Events as decision-log entries: some pending, some undated."""
    e = _events(spark, sf)
    return e.select(
        "event_id", (F.col("user_id") % 20).cast("string").alias("site"), F.when(F.col("event_id") % 5 == 0, "pending").otherwise("settled").alias("status"),
        F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("resolved_date"), F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("outcome"),
    )


def last_n_context(spark, sf):
    return ledger.past_context(_log(spark, sf), "3", AS_OF, "event_id").select("event_id", "site", "same_site")


def idempotent_append(spark, sf):
    """The first entry of each site and day that isn't stored yet; stored are the purchases'."""
    e = _events(spark, sf).select("event_id", (F.col("user_id") % 20).alias("site"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return ledger.to_append(e, e.where("event_type = 'purchase' AND event_id % 4 = 0"), ["site", "day"], [F.col("event_id")]).select("event_id", "site", "day")


def settlement(spark, sf):
    """Pending entries meet the outcomes of odd sites; blank ones settle nothing."""
    log = _log(spark, sf).withColumn("outcome", F.when(F.col("status") == "pending", F.lit("")).otherwise(F.col("outcome")))
    outcomes = _log(spark, sf).where("site % 2 = 1").select("event_id", "outcome")
    return ledger.settle(log, outcomes, ["event_id"]).select("event_id", "status", "outcome")


def task_receipts(spark, sf):
    rows = _events(spark, sf)
    led = rows.select((F.col("user_id") % 10).alias("site_id"), F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 500).cast("string")).alias("task_id"), F.when(F.col("event_id") % 4 == 0, "dry-run").otherwise("live").alias("mode"), F.col("event_id").alias("seq"))
    tasks = rows.select((F.col("user_id") % 10).alias("site_id"), (F.col("event_id") % 700).cast("string").alias("task_id")).distinct()
    return ledger.receipts(led, tasks)


def case_list(spark, sf):
    """Cases as of their last event, newest first, a hundred of them."""
    e = _events(spark, sf).select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 2 == 0, F.lit("r")).alias("report"))
    cases = ledger.case_list(ledger.case_view(e), "updated_seq")
    state = routing.lifecycle(F.coalesce(F.col("status") == "click", F.lit(False)), F.when(F.col("report").isNull(), 1).otherwise(0))
    return cases.select("case_id", "updated_seq", F.coalesce("status", F.lit("")).alias("status"), state.alias("lifecycle"))


RULES = (("X-1", True, "materials", ("purchase",), ()), ("X-2", False, "action", ("1", "7"), ()), ("X-3", False, "action", ("2",), ("view",)))


def rule_check(spark, sf):
    orders = _events(spark, sf).select("event_id", F.col("props").alias("action"), F.col("event_type").alias("materials"))
    out = routing.check_rules(orders, RULES)
    return out.select("event_id", F.array_join("hits", ",").alias("hits"), F.col("n_blocked").cast("long").alias("n_blocked"), "conclusion")


def router_branches(spark, sf):
    """Every branch of the routers over states that are derived from the events."""
    i, u = F.col("event_id"), F.col("user_id")
    action = F.element_at(F.array(*map(F.lit, ("perceive_more", "diagnose_more", "close", "plan_work_order", " "))), (i % 5 + 1).cast("int"))
    verdict = F.element_at(F.array(*map(F.lit, ("pass", "revise", "block"))), (i % 3 + 1).cast("int"))
    status = F.when(i % 4 == 0, "failed").when(i % 4 == 1, "unknown").otherwise("done")
    return _events(spark, sf).select(
        routing.after_screen(F.when(i % 3 != 2, i % 3 == 0)).alias("screen"), routing.coordinator_next(u % 6, action, u % 2, (u + 1) % 3).alias("coordinator"),
        routing.after_safety(verdict, u % 4).alias("safety"), routing.after_approval(F.when(i % 3 != 2, i % 3 == 0)).alias("approval"),
        routing.after_execution(status, u % 2).alias("execution"), routing.final_status(status, F.when(u % 2 == 0, "plan")).alias("final"),
    ).groupBy("screen", "coordinator", "safety", "approval", "execution", "final").agg(F.count("*").alias("n"))


def level_parse(spark, sf):
    """Dispositions, levels and verdicts from messages with written marks."""
    m = read_table(spark, sf, "conversations")
    mark = F.element_at(F.array(*map(F.lit, ("Disposition: **Soon**", "rating - monitor", "处置等级：立即处置", "Disposition options: urgent", "review", "no action", "紧急", "plain"))), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    text = F.concat(F.lit("ok\n"), mark, F.lit("\n"), F.lit("severity: "), F.element_at(F.array(*map(F.lit, ("high", "low", "?"))), (F.col("turn") % 3 + 1).cast("int")))
    rows = m.select("conv_id", "turn", parse.parse_disposition(text).alias("disposition"), parse.first_level(text, ("low", "medium", "high"), "severity").alias("level"), parse.first_level(text, parse.VERDICTS, None, "revise").alias("verdict"))
    return rows.groupBy("disposition", "level", "verdict").agg(F.count("*").alias("n"))


def tool_budget(spark, sf):
    """Roles as tools: two calls of a user, one of any other, three in all."""
    return routing.within_budget(read_table(spark, sf, "conversations"), "conv_id", "turn", "role", {"user": 2}, total=3).select("conv_id", "turn", "role")


def tool_usage(spark, sf):
    return read_table(spark, sf, "conversations").where("length(text) >= 40").groupBy("role").agg(F.count("*").alias("n"))


def citation_check(spark, sf):
    """Conversations cite numbers of documents; those that no document has are unsupported."""
    text = F.concat(F.lit("doc_id="), (F.col("conv_id") * 13).cast("string"), F.lit(" and doc_id="), (F.col("turn") * 7).cast("string"))
    cited = read_table(spark, sf, "conversations").select("conv_id", F.explode(evaluation.cited_ids(text)).alias("doc_id"))
    have = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string"))
    return evaluation.unsupported(cited, cited.join(have, "doc_id", "left_semi"), ["conv_id", "doc_id"])


def evidence_check(spark, sf):
    calls = read_table(spark, sf, "conversations").withColumn("has_evidence", F.length("text") >= 100)
    return evaluation.evidence_complete(calls, "conv_id", {"asked": F.col("role") == "user", "answered": (F.col("role") == "assistant") & (F.col("turn") >= 1)})


def synth_readings(spark, sf):
    """Seeded noise of a Mersenne twister, so there is no SQL."""
    asked = spark.createDataFrame([(s, c) for s in series.SITES for c in (*series.CHANNELS, "other")], "site_id string, channel string")
    return series.sensor_readings(asked, "2026-09-19", "2026-09-26")


_LOG = """log AS (SELECT event_id, CAST(user_id % 20 AS VARCHAR) AS site, CASE WHEN event_id % 5 = 0 THEN 'pending' ELSE 'settled' END AS status,
  CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS resolved_date, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END AS outcome FROM events)"""
_MARKS = "['Disposition: **Soon**', 'rating - monitor', '处置等级：立即处置', 'Disposition options: urgent', 'review', 'no action', '紧急', 'plain']"
#: what the eight marks mean, worked out by hand from the rules
_MEANING = "['Soon', 'Monitor', 'Immediate', 'Immediate', 'REVIEW', 'NoAction', 'Immediate', 'REVIEW']"

SQL = {
    "asof_window": f"SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY GROUP BY 1",
    "coverage_gap": f"SELECT user_id, min(ts) > TIMESTAMP '{START}' AS gap FROM events GROUP BY 1",
    "window_stats": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, arg_max(c, struct_pack(ts := ts, e := event_id)) AS latest, min(c) AS least, max(c) AS greatest, CAST(sum(c) AS BIGINT) AS total, count(*) AS n FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY 1, 2",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "last_n_context": f"WITH {_LOG} SELECT event_id, site, site = '3' AS same_site FROM log WHERE status <> 'pending' AND resolved_date <= '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY site = '3' ORDER BY event_id DESC) <= CASE WHEN site = '3' THEN 5 ELSE 3 END",
    "idempotent_append": """WITH e AS (SELECT event_id, user_id % 20 AS site, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events)
SELECT min(event_id) AS event_id, site, day FROM e WHERE (site, day) NOT IN (SELECT (site, day) FROM e WHERE event_type = 'purchase' AND event_id % 4 = 0) GROUP BY site, day""",
    "settlement": f"""WITH {_LOG} SELECT event_id, CASE WHEN status = 'pending' AND CAST(site AS INTEGER) % 2 = 1 AND trim(outcome) <> '' THEN 'settled' ELSE status END AS status,
  CASE WHEN status = 'pending' THEN CASE WHEN CAST(site AS INTEGER) % 2 = 1 AND trim(outcome) <> '' THEN outcome ELSE '' END ELSE outcome END AS outcome FROM log""",
    "task_receipts": """WITH l AS (SELECT user_id % 10 AS site_id, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 500 AS VARCHAR) END AS task_id, CASE WHEN event_id % 4 = 0 THEN 'dry-run' ELSE 'live' END AS mode, event_id AS seq FROM events),
n AS (SELECT site_id, task_id, arg_max(mode, seq) AS mode FROM l WHERE task_id IS NOT NULL GROUP BY 1, 2),
t AS (SELECT DISTINCT user_id % 10 AS site_id, CAST(event_id % 700 AS VARCHAR) AS task_id FROM events)
SELECT t.site_id, t.task_id, CASE WHEN mode IS NULL THEN 'missing' WHEN mode = 'dry-run' THEN 'dry-run' ELSE 'done' END AS state FROM t LEFT JOIN n ON n.site_id = t.site_id AND n.task_id = t.task_id""",
    "case_list": """WITH c AS (SELECT user_id AS case_id, max(event_id) AS updated_seq, arg_max(event_type, event_id) FILTER (event_id % 3 <> 0) AS status, max(CASE WHEN event_id % 2 = 0 THEN 'r' END) AS report FROM events GROUP BY 1)
SELECT case_id, updated_seq, coalesce(status, '') AS status, CASE WHEN status = 'click' THEN 'awaiting_approval' WHEN report IS NULL THEN 'paused' ELSE 'completed' END AS lifecycle FROM c ORDER BY updated_seq DESC, case_id LIMIT 100""",
    "rule_check": """WITH r AS (SELECT event_id, contains(event_type, 'purchase') AS a, contains(props, '1') OR contains(props, '7') AS b, contains(props, '2') AND contains(event_type, 'view') AS c FROM events)
SELECT event_id, concat_ws(',', CASE WHEN a THEN 'X-1' END, CASE WHEN b THEN 'X-2' END, CASE WHEN c THEN 'X-3' END) AS hits, CAST(a AS BIGINT) AS n_blocked, CASE WHEN a THEN 'blocked' WHEN b OR c THEN 'conditions' ELSE 'clear' END AS conclusion FROM r""",
    "router_branches": """WITH s AS (SELECT event_id AS i, user_id AS u, ['perceive_more', 'diagnose_more', 'close', 'plan_work_order', ' '][event_id % 5 + 1] AS action, ['pass', 'revise', 'block'][event_id % 3 + 1] AS verdict, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'unknown' ELSE 'done' END AS status FROM events)
SELECT CASE WHEN i % 3 = 1 THEN 'close_case' ELSE 'diagnosis' END AS screen,
  CASE WHEN u % 6 > 3 THEN 'close_case' WHEN action = 'perceive_more' AND u % 2 < 1 THEN 'perception' WHEN action = 'diagnose_more' AND (u + 1) % 3 < 1 THEN 'diagnosis' WHEN action = 'close' THEN 'close_case' ELSE 'work_order' END AS coordinator,
  CASE WHEN verdict = 'pass' THEN 'approval' WHEN verdict = 'revise' AND u % 4 < 2 THEN 'work_order' ELSE 'coordinator' END AS safety,
  CASE WHEN i % 3 = 0 THEN 'executor' ELSE 'coordinator' END AS approval, CASE WHEN status = 'failed' AND u % 2 < 1 THEN 'rollback' ELSE 'finalize' END AS execution,
  CASE WHEN status = 'failed' OR u % 2 = 0 THEN 'rolled_back' ELSE 'executed' END AS final, count(*) AS n FROM s GROUP BY ALL""",
    "level_parse": f"""SELECT {_MEANING}[(conv_id + turn) % 8 + 1] AS disposition, ['high', 'low', 'unknown'][turn % 3 + 1] AS level, 'revise' AS verdict, count(*) AS n FROM conversations GROUP BY ALL""",
    "tool_budget": """WITH k AS (SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) <= CASE WHEN role = 'user' THEN 2 ELSE 1 END)
SELECT conv_id, turn, role FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""",
    "tool_usage": "SELECT role, count(*) AS n FROM conversations WHERE length(text) >= 40 GROUP BY 1",
    "citation_check": """WITH c AS (SELECT DISTINCT conv_id, CAST(d AS VARCHAR) AS doc_id FROM (SELECT conv_id, unnest([conv_id * 13, turn * 7]) AS d FROM conversations))
SELECT conv_id, doc_id FROM c WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)""",
    "evidence_check": "SELECT conv_id, bool_or(length(text) >= 100 AND role = 'user') AND bool_or(length(text) >= 100 AND role = 'assistant' AND turn >= 1) AS complete FROM conversations GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in [*SQL, "synth_readings"]}
