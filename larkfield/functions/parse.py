"""Deterministic parsers of model text: dispositions, levels, verdicts, actions and work orders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Canonical dispositions, their labels and the aliases in the order in which they are tried.
DISPOSITIONS = ("Immediate", "Soon", "Scheduled", "Monitor", "NoAction")
LABELS = {"Immediate": "立即处置", "Soon": "尽快处置", "Scheduled": "计划处置", "Monitor": "观察", "NoAction": "无需处置"}
REVIEW = "REVIEW"
REVIEW_ALIASES = ("待人工复核", "需人工复核", "review")
ALIASES = (
    ("immediate", "Immediate"), ("urgent", "Immediate"), ("立即处置", "Immediate"), ("紧急", "Immediate"),
    ("soon", "Soon"), ("尽快处置", "Soon"), ("尽快", "Soon"),
    ("scheduled", "Scheduled"), ("计划处置", "Scheduled"), ("计划", "Scheduled"),
    ("monitor", "Monitor"), ("observe", "Monitor"), ("观察", "Monitor"),
    ("noaction", "NoAction"), ("no action", "NoAction"), ("无需处置", "NoAction"), ("无需", "NoAction"), ("none", "NoAction"),
)
# How a scale of dispositions, and a disposition's label, are written.
_SCALE = r"(?i)(处置等级|disposition)\s*(说明|对照|表|scale|options|legend)"
_LABEL = r"(?i)(处置等级|处置预判|处置建议|disposition|rating)\s*[*\s]*[:\-\x{2010}-\x{2015}\x{ff1a}][\s*]*([^\s*|，,。;；]+)"
VERDICTS = ("pass", "revise", "block")
ACTIONS = ("perceive_more", "diagnose_more", "plan_work_order", "close")


def normalize_disposition(word: Column) -> Column:
    """Canonical value of one written form; review first, then exact aliases, then contained ones; else null."""
    key = F.lower(F.regexp_replace(word, r"^[\s*_`\"'。，,.；;：:]+|[\s*_`\"'。，,.；;：:]+$", ""))
    review = F.lit(False)
    for alias in REVIEW_ALIASES:
        review = review | F.contains(key, F.lit(alias))
    out = F.when(review, REVIEW)
    for alias, value in ALIASES:
        out = out.when(key == alias, value)
    for alias, value in ALIASES:
        out = out.when(F.contains(key, F.lit(alias)), value)
    return F.when(F.coalesce(key, F.lit("")) != "", out)


def extract_disposition(text: Column) -> Column:
    """From label lines in order (legend lines are skipped), else explicit review marks, else any alias in table order."""
    lines = F.filter(F.split(text, "\r\n|\n|\r"), lambda x: ~F.rlike(x, F.lit(_SCALE)) & F.rlike(x, F.lit(_LABEL)))
    found = F.filter(F.transform(lines, lambda x: normalize_disposition(F.regexp_extract(x, _LABEL, 2))), lambda x: x.isNotNull())
    fallback = F.when(F.contains(text, F.lit(REVIEW_ALIASES[0])) | F.contains(text, F.lit(REVIEW_ALIASES[1])), REVIEW)
    lower = F.lower(text)
    for alias, value in ALIASES:
        fallback = fallback.when(F.contains(lower, F.lit(alias)), value)
    return F.coalesce(F.get(found, F.lit(0)), fallback)


def parse_disposition(text: Column) -> Column:
    return F.coalesce(extract_disposition(text), F.lit(REVIEW))


def disposition_label(value: Column) -> Column:
    out = value
    for key, label in LABELS.items():
        out = F.when(value == key, label).otherwise(out)
    return out


def first_level(text: Column, levels: tuple[str, ...], marker: str | None = None, default: str = "unknown") -> Column:
    """The first level of the list that a line with the marker names, else that the text names, else the default."""

    def named(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for level in reversed(levels):
            out = F.when(F.contains(s, F.lit(level)), level).otherwise(out)
        return out

    by_line = F.lit(None).cast("string")
    if marker:
        lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(marker)))
        by_line = F.get(F.filter(F.transform(lines, named), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(by_line, named(text), F.lit(default))


def work_order_id(text: Column, marker: str = "工单编号") -> Column:
    """What follows the colon on the marker's line; empty where there is none."""
    return F.trim(F.regexp_extract(text, r"(?m)" + marker + r"[^:：\n]*[:：]\s*([^\n]*)$", 1))
