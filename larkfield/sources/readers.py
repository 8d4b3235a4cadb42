"""Readers: JSON lines, delimited text, mixed encodings, parquet shards, paged rows, ledgers and logs."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from larkfield.runtime import ship_package

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Strict: a line that is no JSON fails; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def decode_any(raw: bytes) -> str:
    """The first encoding that fits; never a guess that garbles."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise UnicodeDecodeError("gb18030", raw, 0, 1, "no known encoding fits")


def read_text_any(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole small files of any known encoding, each tried in order."""
    ship_package(spark)

    @F.pandas_udf(T.StringType())
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: decode_any(bytes(b)))

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("text"))


def clean_rows(df: DataFrame) -> DataFrame:
    """Trimmed names and values; rows of blanks only vanish."""
    out = df.toDF(*[c.strip() for c in df.columns])
    out = out.select(*[F.trim(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in out.dtypes])
    filled = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in out.columns]
    return out.where(F.coalesce(*filled).isNotNull())


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    return clean_rows(spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).csv(path))


def parquet_complete(path: str) -> bool:
    """A local file that begins and ends as parquet does and whose footer can be read."""
    import pyarrow.parquet as pq

    try:
        with open(path, "rb") as f:
            if f.read(4) != b"PAR1":
                return False
            f.seek(-4, os.SEEK_END)
            if f.read(4) != b"PAR1":
                return False
        pq.ParquetFile(path).metadata
        return True
    except (OSError, ValueError):
        return False
    except Exception as bad:  # pyarrow's own errors derive from these two in most versions
        if type(bad).__module__.startswith("pyarrow"):
            return False
        raise


def read_shards(spark: SparkSession, paths: Iterable[str], columns: Iterable[str] | None = None) -> DataFrame:
    """All shards as one table; columns are pruned at the scan."""
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def paged_rows(fetch: Callable[[int, int], list[dict]], limit: int | None = None, page: int = 100) -> Iterator[dict]:
    """Rows of an offset-paged source; the limit also bounds the last page."""
    at = 0
    while limit is None or at < limit:
        rows = fetch(at, page if limit is None else min(page, limit - at))
        yield from rows
        at += len(rows)
        if not rows:
            return


def with_fallback(first: Callable[[], DataFrame], second: Callable[[], DataFrame], limit: int | None = None, order: str | None = None) -> tuple[DataFrame, str]:
    """(rows, mode): the first reader if it yields at all, else the second. A limit needs an order to be the same every time."""
    try:
        df, mode = first(), "parquet"
        df.take(1)
    except Exception:
        df, mode = second(), "paged"
    if limit is not None:
        df = (df.orderBy(order) if order else df).limit(limit)
    return df, mode


LEDGER = "site_id string, actuator string, command string, params string, work_order_id string, mode string, dispatched boolean, task_id string, seq long"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger records; corrupt lines are skipped. Lines are parsed as text, so that any column may be counted alone."""
    rows = spark.read.text(path).select(F.from_json("value", LEDGER, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.where("site_id is not null")


SEPARATOR = "\n\n<!-- ENTRY_END -->\n\n"
_TAG = r"^\[(\d{4}-\d{2}-\d{2}) \| ([^|\]]*) \| ([^|\]]*) \| ([^|\]]*)\]"


def read_decision_log(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """(as_of, site, disposition, status, decision, outcome, reflection) of a log of tagged text blocks."""
    block = F.col("value")
    section = lambda name: F.trim(F.regexp_extract(block, rf"(?s){name}:\n(.*?)(?=\n(?:DECISION|OUTCOME|REFLECTION):|$)", 1))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", separator.strip())).alias("value")).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value"))
    rows = rows.where(F.rlike("value", F.lit(_TAG)))
    return rows.select(*[F.trim(F.regexp_extract(block, _TAG, k)).alias(c) for k, c in enumerate(("as_of", "site", "disposition", "status"), 1)],
                       section("DECISION").alias("decision"), section("OUTCOME").alias("outcome"), section("REFLECTION").alias("reflection"))
