"""Append-only logs: idempotent append, latest views, settlement, lessons, receipts and cases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key; ``order`` is from new to old and should decide every tie."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def to_append(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """What an idempotent append adds: the first incoming row of each key that isn't stored."""
    first = incoming.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    return first.join(stored.select(*keys).distinct(), keys, "left_anti")


def settle(log: DataFrame, outcomes: DataFrame, keys: list[str], status: str = "status", outcome: str = "outcome") -> DataFrame:
    """Pending rows that have an outcome which isn't blank become ``settled``; all others stay as they are."""
    known = outcomes.where(F.trim(F.coalesce(F.col(outcome), F.lit(""))) != "").groupBy(*keys).agg(F.min(outcome).alias("_o"))
    joined = log.join(known, keys, "left")
    hit = (F.col(status) == "pending") & F.col("_o").isNotNull()
    return joined.withColumn(outcome, F.when(hit, F.col("_o")).otherwise(F.col(outcome))).withColumn(status, F.when(hit, "settled").otherwise(F.col(status))).drop("_o")


def past_context(log: DataFrame, site: str, as_of: str | None, order: str, same: int = 5, other: int = 3) -> DataFrame:
    """The last lessons of the same site and of others, in log order: never pending, and with ``as_of`` never undated or later."""
    rows = log.where("status <> 'pending'")
    if as_of is not None:
        rows = rows.where(F.col("resolved_date").isNotNull() & (F.col("resolved_date") <= as_of))
    own = F.coalesce(F.col("site") == site, F.lit(False))
    last = lambda which, most: rows.where(which).withColumn("same_site", own).orderBy(F.desc(order)).limit(most)
    return last(own, same).unionByName(last(~own, other))  # each task sends its newest few, not its log


def receipts(ledger: DataFrame, tasks: DataFrame, order: str = "seq") -> DataFrame:
    """(site_id, task_id, state): of each asked task the newest record: missing, dry-run or done. Records without a task id never match."""
    newest = latest(ledger.where("task_id is not null"), ["site_id", "task_id"], [F.desc(order)])
    state = F.when(F.col("mode").isNull(), "missing").when(F.col("mode") == "dry-run", "dry-run").otherwise("done")
    return tasks.join(newest, ["site_id", "task_id"], "left").select("site_id", "task_id", state.alias("state"))


def dispatch(commands: DataFrame, dry_run: bool) -> DataFrame:
    """Ledger records of commands (site_id, actuator, command, params, work_order_id); a task id only where it is sent."""
    key = F.concat_ws("|", "site_id", "work_order_id", "actuator", "command", "params")
    task = F.lit(None).cast("string") if dry_run else F.concat(F.lit("SYN-"), F.upper(F.substring(F.sha2(key, 256), 1, 8)))
    return commands.withColumn("mode", F.lit("dry-run" if dry_run else "live")).withColumn("dispatched", F.lit(not dry_run)).withColumn("task_id", task)


CASE_COLUMNS = ("status", "lifecycle", "report", "approval", "error")


def case_view(events: DataFrame, keys: str = "case_id", order: str = "seq") -> DataFrame:
    """Cases as of their last event: each column's last value that isn't null, and when it was updated."""
    columns = [c for c in events.columns if c not in (keys, order)]
    return events.groupBy(keys).agg(F.max(order).alias("updated_seq"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def case_list(cases: DataFrame, by: str, most: int = 100) -> DataFrame:
    return cases.orderBy(F.desc(by), "case_id").limit(most)


def case_update(case: Mapping[str, object], change: Mapping[str, object]) -> dict:
    """One event row: only known columns may change."""
    unknown = set(change) - set(CASE_COLUMNS)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return {**case, **change}
