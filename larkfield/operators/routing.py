"""Routers of the case graph as column expressions, vendor chains, and rule evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkfield.sources.errors import NoDataError, NotConfiguredError, RateLimitError

# How many rounds each part of a case may take.
PERCEPTION, DIAGNOSIS, COORDINATION, SAFETY, ROLLBACK = 1, 1, 3, 2, 1


def after_screen(has_anomaly: Column, auto_close: bool = True) -> Column:
    """Closes only what was said to be no anomaly; unknown goes on."""
    return F.when(F.lit(auto_close) & ~F.coalesce(has_anomaly, F.lit(True)), "close_case").otherwise("diagnosis")


def coordinator_next(rounds: Column, action: Column, perception: Column, diagnosis: Column) -> Column:
    """Over the cap closes; more evidence only while its budget lasts; anything else is planned."""
    a = F.trim(F.coalesce(action, F.lit("")))
    return (
        F.when(rounds > COORDINATION, "close_case").when((a == "perceive_more") & (perception < PERCEPTION), "perception")
        .when((a == "diagnose_more") & (diagnosis < DIAGNOSIS), "diagnosis").when(a == "close", "close_case").otherwise("work_order")
    )


def after_safety(verdict: Column, rounds: Column) -> Column:
    v = F.trim(F.coalesce(verdict, F.lit("")))
    return F.when(v == "pass", "approval").when((v == "revise") & (rounds < SAFETY), "work_order").otherwise("coordinator")


def after_approval(approved: Column) -> Column:
    return F.when(F.coalesce(approved, F.lit(False)), "executor").otherwise("coordinator")


def after_execution(status: Column, rollbacks: Column) -> Column:
    return F.when((F.trim(F.coalesce(status, F.lit(""))) == "failed") & (rollbacks < ROLLBACK), "rollback").otherwise("finalize")


def approval_gate(require_human: Column, dry_run: Column, human: Column) -> Column:
    """struct(approved, waits, basis): a person where one is required, else a dry run's or the caller's own risk."""
    by = lambda approved, waits, basis: F.struct(approved.alias("approved"), waits.alias("waits"), F.lit(basis).alias("basis"))
    yes, no = F.lit(True), F.lit(False)
    return F.when(require_human, by(F.coalesce(human, no), human.isNull(), "human")).when(dry_run, by(yes, no, "dry run")).otherwise(by(yes, no, "automatic"))


def final_status(execution: Column, rollback_plan: Column) -> Column:
    """Failed, or with a rollback plan: rolled back; anything else counts as executed."""
    return F.when((F.coalesce(execution, F.lit("")) == "failed") | (F.coalesce(rollback_plan, F.lit("")) != ""), "rolled_back").otherwise("executed")


def lifecycle(interrupted: Column, pending: Column) -> Column:
    return F.when(interrupted, "awaiting_approval").when(pending > 0, "paused").otherwise("completed")


def chain(tool: str, category: str, tools: Mapping[str, str], categories: Mapping[str, str]) -> list[str]:
    """The vendors of a tool, in order: its own setting, else its category's."""
    return [v.strip() for v in (tools.get(tool) or categories.get(category, "")).split(",") if v.strip()]


def route(vendors: Sequence[str], registry: Mapping[str, Callable], *args, optional: bool = False, **kwargs):
    """The first vendor's answer that has one. Only typed errors move on; an exhausted chain raises, or is None if optional."""
    last: Exception | None = None
    for name in vendors:
        try:
            if name not in registry:
                raise NotConfiguredError(name)
            return registry[name](*args, **kwargs)
        except (NoDataError, RateLimitError, NotConfiguredError) as why:
            last = why
    if optional:
        return None
    raise NoDataError(f"no vendor of {list(vendors)} had data") from last


# Fixed values of the demonstration rules: id, blocks, field, words, words that the materials need as well.
RULES = (
    ("R-101", True, "materials", ("毒死蜱", "百草枯", "甲胺磷", "克百威"), ()),
    ("R-201", False, "materials", ("生物农药 X",), ()),
    ("R-301", False, "action", ("喷", "施药", "喷雾"), ()),
    ("R-401", False, "action", ("喷", "施药", "喷雾"), ()),
    ("R-202", False, "action", ("灌溉", "滴灌", "浇水"), ("药",)),
    ("R-501", False, "action", ("检修", "带电", "电气", "拆"), ()),
    ("R-601", False, "action", ("清园", "整枝", "摘除", "拔除"), ()),
)


def check_rules(orders: DataFrame, rules: Sequence[tuple] = RULES, action: str = "action", materials: str = "materials") -> DataFrame:
    """Adds ``hits`` (rule ids, blocking ones first, one hit for each forbidden material), ``n_blocked`` and ``conclusion``."""
    field = {"action": F.coalesce(F.col(action), F.lit("")), "materials": F.coalesce(F.col(materials), F.lit(""))}
    hits = []
    for rule, blocks, where, words, also in sorted(rules, key=lambda r: not r[1]):
        needs = F.lit(True)
        for word in also:
            needs = needs & F.contains(field["materials"], F.lit(word))
        found = [F.contains(field[where], F.lit(word)) for word in words]
        if blocks:
            hits += [F.when(f & needs, rule) for f in found]
        else:
            any_found = F.lit(False)
            for f in found:
                any_found = any_found | f
            hits.append(F.when(any_found & needs, rule))
    blocking = [r[0] for r in rules if r[1]]
    out = orders.withColumn("hits", F.array_compact(F.array(*hits)))
    n = F.size(F.filter("hits", lambda x: x.isin(blocking)))
    return out.withColumn("n_blocked", n).withColumn("conclusion", F.when(n > 0, "blocked").when(F.size("hits") > 0, "conditions").otherwise("clear"))




def within_budget(calls: DataFrame, by: str, order: str, tool: str, caps: Mapping[str, int], total: int = 8, default: int = 1) -> DataFrame:
    """Calls that a run may make: at most so many of each tool, and of those the first ``total`` in order."""
    from pyspark.sql import Window

    cap = F.lit(default)
    for name, most in caps.items():
        cap = F.when(F.col(tool) == name, most).otherwise(cap)
    kept = calls.withColumn("_k", F.row_number().over(Window.partitionBy(by, tool).orderBy(order))).where(F.col("_k") <= cap).drop("_k")
    return kept.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= total).drop("_k")
