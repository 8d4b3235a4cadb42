"""Ledgers as streams: first records of keys, and a sink to a ledger table that a replayed batch doesn't change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from larkfield.sources.ledger_table import LedgerTable


def ledger_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def first_of_each(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Idempotent append on a stream: the first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(rows: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def to_ledger(rows: DataFrame, table: LedgerTable, order: Sequence[Column], name: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each batch once: the batch's number is committed with its rows, under the stream's name.

    A batch that Spark runs again, as it failed after the commit, adds nothing. ``checkpoint`` belongs to the name: with a
    new checkpoint numbers begin anew, so that a stream needs a new name as well; stored keys are still not repeated.
    """
    return rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: table.append(batch, order, stream=name, batch=number) and None)
