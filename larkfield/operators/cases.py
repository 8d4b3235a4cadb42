"""Case states: their schema, projections, closing rules and the transitions that a case may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkfield.functions.parse import REVIEW, parse_disposition

STATE = (
    "site_of_interest string, site_type string, as_of string, site_context string, resource_context string, "
    "perception_state struct<perception_report:string,anomaly_screen:string,anomaly_level:string,has_anomaly:boolean,perception_rounds:int>, "
    "diagnosis_state struct<diagnosis_report:string,severity:string,confidence:string,rationale:string,recommended_checks:string,diagnosis_rounds:int>, "
    "coordination_state struct<coordination_notes:string,coordination_history:string,next_action:string,decision_reason:string,work_order:string,safety_review:string,safety_verdict:string,approval:string,approved:boolean,rollback_plan:string,"
    "coordinator_rounds:int,safety_rounds:int,rollback_rounds:int>, "
    "execution_state struct<dispatch_log:string,execution_status:string,execution_report:string,needs_followup:boolean>, final_decision string, case_status string"
)


def project_state(states: DataFrame) -> DataFrame:
    """What a case shows: four parts under short names, nulls as empty or false, no messages and no counters."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    part = lambda *cs: F.struct(*[(flag if f else text)(c).alias(n) for n, c, f in cs])
    p, d, c, e = "perception_state.", "diagnosis_state.", "coordination_state.", "execution_state."
    keep = [x for x in states.columns if x not in ("perception_state", "diagnosis_state", "coordination_state", "execution_state", "messages")]
    return states.select(
        *keep,
        part(("report", p + "perception_report", 0), ("anomaly_screen", p + "anomaly_screen", 0), ("anomaly_level", p + "anomaly_level", 0), ("has_anomaly", p + "has_anomaly", 1)).alias("perception"),
        part(("report", d + "diagnosis_report", 0), *[(k, d + k, 0) for k in ("severity", "confidence", "rationale", "recommended_checks")]).alias("diagnosis"),
        part(*[(k, c + k, 0) for k in ("work_order", "safety_review", "safety_verdict", "approval", "rollback_plan")], ("approved", c + "approved", 1)).alias("coordination"),
        part(("dispatch_log", e + "dispatch_log", 0), ("status", e + "execution_status", 0), ("report", e + "execution_report", 0), ("needs_followup", e + "needs_followup", 1)).alias("execution"),
    )


def respond(projected: DataFrame) -> DataFrame:
    """Adds severity and a description of at most 500 characters, each the first that isn't blank."""
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    severity = F.coalesce(first("diagnosis.severity", "perception.anomaly_level"), F.lit("unknown"))
    description = F.coalesce(first("diagnosis.rationale", "diagnosis.report", "perception.anomaly_screen"), F.lit("流程尚未产出诊断结论"))
    return projected.withColumn("severity", severity).withColumn("description", F.substring(description, 1, 500))


def close(next_action: Column, notes: Column) -> Column:
    """struct(disposition, forced): a case that is closed without having chosen so always goes to review."""
    forced = ~F.coalesce(next_action, F.lit("")).isin("", "close")
    found = parse_disposition(F.coalesce(notes, F.lit("")))
    return F.struct(F.when(forced, REVIEW).when(found == REVIEW, "Monitor").otherwise(found).alias("disposition"), forced.alias("forced"))


#: case status -> what may follow
TRANSITIONS = {
    "queued": ("running",), "running": ("awaiting_approval", "paused", "completed", "failed"), "awaiting_approval": ("resuming",),
    "resuming": ("awaiting_approval", "paused", "completed", "failed", "resuming"), "paused": ("running",), "completed": (), "failed": ("running",),
}


def bad_transitions(events: DataFrame, case: str = "case_id", order: str = "seq", status: str = "status") -> DataFrame:
    """Events that no rule lets follow the one before."""
    from pyspark.sql import Window

    before = F.lag(status).over(Window.partitionBy(case).orderBy(order))
    rows = events.where(F.col(status).isNotNull()).withColumn("before", before)
    fine = F.col("before").isNull() & (F.col(status) == "queued")
    for state, after in TRANSITIONS.items():
        fine = fine | ((F.col("before") == state) & F.col(status).isin(*after)) if after else fine
    return rows.where(~F.coalesce(fine, F.lit(False)))


def valid_request(site: Column, day: Column, note: Column, dry_run: Column) -> Column:
    """What a case may be opened with; cases from outside are always dry runs."""
    return F.rlike(site, F.lit(r"^[A-Za-z0-9_-]{1,64}$")) & F.rlike(day, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & (F.length(F.coalesce(note, F.lit(""))) <= 2000) & F.coalesce(dry_run, F.lit(True))
