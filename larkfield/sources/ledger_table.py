"""A ledger as a table: idempotent appends, settlement that rewrites only what it touches, replayed batches that add nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from larkfield.operators import ledger

BUCKET = "lf_bucket"


class Conflict(RuntimeError):
    """Another writer made the same version first."""


class LedgerTable:
    """Parquet under a root of any Hadoop file system, in buckets of the keys' hash, with one small JSON file a version.

    A version names the folders of each bucket, the schema and the last batch of each stream. It comes into being by
    one rename that fails where the name is taken, so of two writers one succeeds, and the other starts again from what
    the first wrote. Readers see whole versions. Null keys equal each other. A failed writer removes its own
    folder; one that is lost leaves a folder that no version names.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64, attempts: int = 5):
        self.spark, self.root, self.keys, self.buckets, self.attempts = spark, root.rstrip("/"), list(keys), buckets, attempts
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def version(self) -> int:
        """The newest version, 0 for a table that nothing was written to."""
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "buckets": self.buckets, "schema": None, "folders": {}, "streams": {}}
        stream = self._fs.open(self._path(f"{self.root}/_log/{version:012d}.json"))
        try:
            state = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if state["buckets"] != self.buckets or state["keys"] != self.keys:
            raise ValueError(f"{self.root} has {state['buckets']} buckets of {state['keys']}")
        return {"version": version, **state}

    def _commit(self, before: dict, folders: dict, schema: str, streams: dict) -> int:
        version = before["version"] + 1
        text = json.dumps({"buckets": self.buckets, "keys": self.keys, "schema": schema, "folders": folders, "streams": streams}, sort_keys=True)
        new = self._path(f"{self.root}/_log/{uuid.uuid4().hex}.new")
        out = self._fs.create(new, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        sc = self.spark.sparkContext
        how = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        source, target = (self._fs.makeQualified(p) for p in (new, self._path(f"{self.root}/_log/{version:012d}.json")))
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), sc._jsc.hadoopConfiguration()).rename(source, target, how)
        except Exception as failed:
            self._fs.delete(new, False)
            if self._fs.exists(target):
                raise Conflict(f"version {version} of {self.root} is taken") from failed
            raise
        return version

    def _again(self, work: Callable[[dict], int]) -> int:
        for left in range(self.attempts - 1, -1, -1):
            try:
                return work(self.state())
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    # rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, only: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        chosen = sorted(state["folders"], key=int) if only is None else [str(b) for b in only if str(b) in state["folders"]]
        paths = [f"{self.root}/{folder}/{BUCKET}={b}" for b in chosen for folder in state["folders"][b]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        if state["schema"] is None:
            raise FileNotFoundError(f"nothing was written to {self.root}")
        return self._rows(state)

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of rows: as many numbers as there are buckets, at most."""
        return sorted(r[0] for r in rows.select(self._bucket().alias(BUCKET)).distinct().collect())

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Writes rows by bucket to a new folder; its name and the buckets that it holds."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket()).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        return folder, [n.split("=")[1] for n in names if n.startswith(f"{BUCKET}=")]

    def _swap(self, state: dict, rows: DataFrame, schema: str, streams: dict, replaced: Sequence[int] = ()) -> int:
        folder, held = self._write(rows)
        kept = {b: list(f) for b, f in state["folders"].items() if int(b) not in set(replaced)}
        for b in held:
            kept.setdefault(b, []).append(folder)
        try:
            return self._commit(state, kept, schema, streams)
        except BaseException:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise

    # writers

    def append(self, rows: DataFrame, order: Sequence[Column], stream: str | None = None, batch: int | None = None) -> int:
        """Adds the first row, by ``order``, of each key that isn't stored; the version that holds them.

        With ``stream`` and ``batch`` (numbers that ascend) a batch that was committed already changes nothing. Only the
        buckets of incoming keys are read, and of these the keys alone. Columns are taken by name, others are refused.
        """
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} is the table's own column")

        def work(state: dict) -> int:
            if stream is not None and batch is not None and batch <= state["streams"].get(stream, -1):
                return state["version"]
            schema = state["schema"] or rows.schema.json()
            names = StructType.fromJson(json.loads(schema)).fieldNames()
            if sorted(names) != sorted(rows.columns):
                raise ValueError(f"the table has the columns {names}")
            new = ledger.latest(rows, self.keys, list(order))  # the first by this order
            if state["folders"]:
                old = self._rows(state, self._touched(rows)).select(*[F.col(k).alias(f"lf_{k}") for k in self.keys])
                same = F.lit(True)
                for k in self.keys:
                    same = same & F.col(k).eqNullSafe(F.col(f"lf_{k}"))
                new = new.join(old, same, "left_anti")
            streams = {**state["streams"], **({stream: batch} if stream is not None and batch is not None else {})}
            return self._swap(state, new.select(*names), schema, streams)

        return self._again(work)

    def rewrite(self, keys_hit: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], among: DataFrame) -> int:
        """Replaces the buckets where ``keys_hit`` leaves rows; all other files stay as they are.

        ``among`` holds the keys that can be hit at all, so that only their buckets are looked at.
        """
        def work(state: dict) -> int:
            if not state["folders"]:
                return state["version"]
            near = self._rows(state, self._touched(among))
            hit = self._touched(keys_hit(near))
            if not hit:
                return state["version"]
            names = StructType.fromJson(json.loads(state["schema"])).fieldNames()
            return self._swap(state, change(self._rows(state, hit)).select(*names), state["schema"], state["streams"], hit)

        return self._again(work)

    def settle(self, outcomes: DataFrame, status: str = "status", outcome: str = "outcome") -> int:
        """Pending rows that have an outcome which isn't blank become settled, as by ``ledger.settle``."""
        known = outcomes.where(F.trim(F.coalesce(F.col(outcome), F.lit(""))) != "").select(*self.keys, outcome)
        return self.rewrite(
            lambda rows: rows.where(F.col(status) == "pending").join(known.select(*self.keys), self.keys, "left_semi"),
            lambda rows: ledger.settle(rows, known, self.keys, status, outcome), known,
        )

    def compact(self, least: int = 8) -> int:
        """Writes buckets anew that lie in ``least`` folders or more, as many small appends leave them."""
        def work(state: dict) -> int:
            many = [int(b) for b, folders in state["folders"].items() if len(folders) >= least]
            if not many:
                return state["version"]
            return self._swap(state, self._rows(state, many).repartition(self._bucket()), state["schema"], state["streams"], many)

        return self._again(work)
