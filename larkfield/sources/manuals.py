"""Skill manuals: text files with a head of ``key: value`` lines between ``---`` lines, and a body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parse(text: Column) -> Column:
    """struct(meta map, body). Without a closed head, all of the text is body; comments and lines without a colon are no fields."""
    text = F.regexp_replace(text, "^﻿", "")
    headed = F.rlike(text, F.lit(r"(?s)^---.*?\n---"))
    head = F.regexp_extract(text, r"(?s)^---(.*?)\n---", 1)
    body = F.when(headed, F.regexp_replace(text, r"(?s)^---.*?\n---", "")).otherwise(text)
    lines = F.filter(F.transform(F.split(head, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit(":")))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    value = lambda x: F.trim(F.substr(x, F.instr(x, ":") + 1))
    entries = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.when(headed, F.map_from_entries(last)).otherwise(empty).alias("meta"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def read_manuals(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, meta, body) of the files ``<name>/SKILL.md`` under a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="SKILL.md")
    rows = files.select(F.input_file_name().alias("path"), parse(F.col("value")).alias("m"))
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("name"), "path", "m.meta", "m.body")


def load_skill(manuals: DataFrame, name: str) -> str:
    """The body of one manual; KeyError where there is none."""
    row = manuals.where(F.col("name") == name.strip().lower()).select("body").first()
    if row is None:
        raise KeyError(f"no manual {name!r}")
    return row.body
