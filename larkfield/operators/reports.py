"""Reports of cases as rows: sections in markdown, the whole report of a case, and a tree of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkfield.operators.digest import set_digest

# Folders, files, headings and fields of a report's parts, and the labels of its head.
PARTS = (
    ("1_perception", "一、感知", "perception_state", ("perception_report", "anomaly_screen"),
     (("report.md", "感知报告", "perception_report"), ("anomaly_screen.md", "异常初筛", "anomaly_screen"))),
    ("2_diagnosis", "二、诊断", "diagnosis_state", ("diagnosis_report", "rationale"),
     (("report.md", "诊断报告", "diagnosis_report"), ("severity.md", "严重度与依据", None))),
    ("3_coordination", "三、协调决策", "coordination_state", ("coordination_notes", "work_order"),
     (("decisions.md", "中枢决策记录", "coordination_history"), ("work_order.md", "维护工单", "work_order"), ("safety_review.md", "安全检查", "safety_review"), (None, "审批", "approval"), ("rollback_plan.md", "回滚预案", "rollback_plan"))),
    ("4_execution", "四、执行", "execution_state", ("dispatch_log", "execution_report"),
     (("dispatch_log.md", "下发记录", "dispatch_log"), ("feedback.md", "执行反馈", "execution_report"))),
)
TITLE, DECISION, DAY, STATUS, SEVERITY, CONFIDENCE, NONE = "维护决策报告", "维护决策单", "基准日期", "案件状态", "严重度", "置信度", "（无）"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _severity(between: str) -> Column:
    d = "diagnosis_state."
    return F.concat(F.lit(f"{SEVERITY}："), _text(d + "severity"), F.lit(f"{between}{CONFIDENCE}："), _text(d + "confidence"), F.lit("\n\n"), _text(d + "rationale"))


def _field(state: str, field: str | None, between: str) -> Column:
    """A field's text; the severity, which has no field of its own, names two and the rationale."""
    return _severity(between) if field is None else _text(f"{state}.{field}")


def _held(state: str, main: tuple[str, str]) -> Column:
    return (_text(f"{state}.{main[0]}") != "") | (_text(f"{state}.{main[1]}") != "")


def files(states: DataFrame, case: str = "site_of_interest") -> DataFrame:
    """(case, path, text) of every file of the cases' reports.

    A part has files only if one of its two main texts isn't empty, and of these only files with a text. The approval
    has no file, only a section in the whole report, which every case has.
    """
    kind = "array<struct<path:string,text:string>>"
    out = []
    for folder, _, state, main, fields in PARTS:
        every = F.array(*[F.struct(F.lit(f"{folder}/{file}").alias("path"), _field(state, field, "\n").alias("text")) for file, _, field in fields if file])
        out.append(F.when(_held(state, main), F.filter(every, lambda f: f["text"] != "")).otherwise(F.array().cast(kind)))
    whole = F.array(F.struct(F.lit("complete_report.md").alias("path"), complete().alias("text")))
    return states.select(F.col(case).alias("case"), F.explode(F.concat(*out, whole)).alias("f")).select("case", "f.path", "f.text")


def complete() -> Column:
    """The whole report of a state: head, decision, then the parts that have something to say."""
    head = F.concat(F.lit(f"# {TITLE}："), _text("site_of_interest"), F.lit(f"\n\n{DAY}："), _text("as_of"), F.lit(f"\n{STATUS}："), _text("case_status"), F.lit("\n"))
    sections = [F.when(_text("final_decision") != "", F.concat(F.lit(f"## {DECISION}\n\n"), F.col("final_decision")))]
    for _, title, state, main, fields in PARTS:
        body = [F.when(_field(state, field, "；") != "", F.concat(F.lit(f"### {label}\n"), _field(state, field, "；"))) for _, label, field in fields]
        sections.append(F.when(_held(state, main), F.concat(F.lit(f"## {title}\n\n"), F.concat_ws("\n\n", *body))))
    return F.concat(head, F.concat_ws("\n\n", *sections), F.lit("\n"))


def write_tree(states: DataFrame, root: str, case: str = "site_of_interest") -> None:
    """One folder for each case and file, written by the tasks as Spark writes partitions: ``case=.../file=.../part-*.txt``."""
    rows = files(states, case).select(F.regexp_replace("case", r"[^\w-]", "_").alias("case"), F.regexp_replace("path", "/", "__").alias("file"), F.col("text").alias("value"))
    rows.write.mode("overwrite").partitionBy("case", "file").text(root, lineSep="\n")


def resources_text(resources: Column) -> Column:
    """A list of resources as text: nothing known (null) and known to be none (empty) are told apart."""
    return F.when(resources.isNull(), "资源未登记").when(F.size(resources) == 0, "无可用资源").otherwise(F.array_join(resources, "、"))


def report_or_marker(report: Column) -> Column:
    """A report, or a marker that says there is none."""
    return F.coalesce(F.nullif(F.trim(report), F.lit("")), F.lit(NONE))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a digest over (path, length, modificationTime) of files, whatever their order; tasks send sums, no listing."""
    return set_digest(files, ["path", "length", "modificationTime"]).select("digest", F.col("n").alias("n_files"))
