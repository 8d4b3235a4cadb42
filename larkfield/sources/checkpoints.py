"""Checkpoints of case runs: one row for each step of a thread, in a table that any Hadoop file system holds.

A step is a row (thread, seq, signature, node, state as JSON). The newest row of a thread is where it goes on. Rows
are only ever added; clearing a thread adds a row that says so, so a reader never sees half of a deletion.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "thread string, seq long, signature string, node string, state string, cleared boolean"


class Checkpoints:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self._path, self._fs = path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        if not self._fs.exists(self._path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.root)

    def latest(self) -> DataFrame:
        """The newest row of every thread that wasn't cleared since; ``max_by`` keeps one row a key on each task."""
        row = F.struct("signature", "node", "state", "cleared")
        newest = self.rows().groupBy("thread").agg(F.max("seq").alias("seq"), F.max_by(row, "seq").alias("r"))
        return newest.where(~F.col("r.cleared")).select("thread", "seq", "r.signature", "r.node", "r.state")

    def save(self, thread: str, node: str, state: dict, signature: str) -> int:
        return self._add(thread, node, json.dumps(state, ensure_ascii=False, sort_keys=True), signature, False)

    def exists(self, thread: str) -> bool:
        return not self.latest().where(F.col("thread") == thread).isEmpty()

    def load(self, thread: str, signature: str) -> tuple[str, dict] | None:
        """(node that comes next, state); None where there is none. A checkpoint of another signature isn't resumed: ValueError."""
        row = self.latest().where(F.col("thread") == thread).first()
        if row is None:
            return None
        if row.signature != signature:
            raise ValueError(f"{thread} was saved by another graph or with other settings")
        return row.node, json.loads(row.state)

    def clear(self, thread: str) -> None:
        if self.exists(thread):
            self._add(thread, "", "{}", "", True)

    def clear_all(self) -> None:
        self._fs.delete(self._path, True)

    def _add(self, thread: str, node: str, state: str, signature: str, cleared: bool) -> int:
        last = self.rows().where(F.col("thread") == thread).agg(F.max("seq")).first()[0]
        seq = 0 if last is None else last + 1
        self.spark.createDataFrame([(thread, seq, signature, node, state, cleared)], SCHEMA).coalesce(1).write.mode("append").json(self.root)
        return seq
