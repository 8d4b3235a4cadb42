"""Sinks: staged versions with checks and an atomic pointer, manifests, ledgers and JSON lines."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkfield.operators.dense import validity
from larkfield.operators.corpus import gate


#: seconds without a sign of its owner after which a lock counts as left by a crash
STALE = 6 * 3600


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_ledger(records: DataFrame, path: str) -> None:
    """One folder for each site, so that a site's receipts read only its own."""
    records.write.mode("append").partitionBy("site_id").json(path)


class Store:
    """Versions under a root of any Hadoop file system; ``CURRENT`` names the one that readers use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @contextmanager
    def lock(self) -> Iterator[Callable[[], None]]:
        """One build at a time: creating the lock file fails where it exists. Gives a function that renews the lock.

        The file names its owner. A lock that was not renewed for STALE seconds is one that a crash left, and may be
        taken over; the earlier owner then finds another name in it, and raises instead of going on.
        """
        path, owner = f"{self.root}/LOCK", uuid.uuid4().hex
        self._fs.mkdirs(self._path(self.root))
        if self._fs.exists(self._path(path)) and time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000 > STALE:
            self._fs.delete(self._path(path), False)
        if not self._fs.createNewFile(self._path(path)):
            raise RuntimeError(f"{self.root} is being built")
        self._put(path, owner)

        def renew() -> None:
            if self._get(path) != owner:
                raise RuntimeError(f"the lock of {self.root} was taken over")
            self._put(path, owner)

        try:
            yield renew
            renew()
        finally:
            if self._get(path) == owner:
                self._fs.delete(self._path(path), False)

    def current(self) -> str | None:
        text = self._get(f"{self.root}/CURRENT")
        return text.strip() if text else None

    def _get(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(
        self, tables: dict[str, DataFrame], manifest: dict, checks: Callable[["Store", str], list[str]] | None = None,
        keep: Iterable[str] = (), writers: dict[str, Callable[[str], object]] | None = None,
    ) -> str:
        """Writes a version, checks it as read back, then moves the pointer; readers keep the old version on any failure.

        Tables named in ``keep`` are unchanged: the new version refers to the files of the current one, and nothing of
        them is read or written. ``writers`` write what is no single table, such as an index, under the path they get.
        """
        with self.lock() as lease:
            version = f"v{time.time_ns()}"
            base = f"{self.root}/{version}"
            try:
                places = {name: f"{version}/{name}" for name in [*tables, *(writers or {})]}
                held = self.places()
                if missing := [name for name in keep if name not in held]:
                    raise FileNotFoundError(f"the current version has no {missing}")
                places |= {name: held[name] for name in keep}
                for name, df in tables.items():
                    df.write.parquet(f"{base}/{name}")
                    lease()
                for name, write in (writers or {}).items():
                    write(f"{base}/{name}")
                    lease()
                self._put(f"{base}/tables.json", json.dumps(places, sort_keys=True))
                failed = (checks or standard_checks)(self, version)
                if failed:
                    raise ValueError(f"the staged version failed: {failed}")
                self._put(f"{base}/manifest.json", json.dumps({"version": 1, **manifest}, ensure_ascii=False, sort_keys=True))
                lease()
                self._point(version)
            except BaseException:
                self._fs.delete(self._path(base), True)
                raise
            return version

    def _point(self, version: str) -> None:
        """Replaces the pointer by one rename, which raises if it fails: there is no moment without a pointer."""
        self._put(f"{self.root}/CURRENT.new", version)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        renames = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(renames, 1)
        how[0] = renames.OVERWRITE
        path = self._fs.makeQualified(self._path(f"{self.root}/CURRENT.new"))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(path, self._fs.makeQualified(self._path(f"{self.root}/CURRENT")), how)

    def places(self, version: str | None = None) -> dict[str, str]:
        """Where the tables of a version are, by name: its own, and those it shares with earlier versions."""
        version = version or self.current()
        text = self._get(f"{self.root}/{version}/tables.json") if version else None
        return json.loads(text) if text else {}

    def place(self, table: str, version: str | None = None) -> str:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"nothing is published under {self.root}")
        return f"{self.root}/{self.places(version).get(table, f'{version}/{table}')}"

    def has(self, table: str, version: str | None = None) -> bool:
        return self._fs.exists(self._path(self.place(table, version)))

    def read(self, table: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.place(table, version))

    def unused(self, keep: int = 2) -> list[str]:
        """Folders of tables and versions that none of the ``keep`` newest versions, nor the current one, refers to."""
        versions = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())
        kept = {*versions[-keep:], self.current()}
        used = {place for v in kept for place in self.places(v).values()}
        out = []
        for v in versions:
            tables = [f"{v}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(f"{self.root}/{v}")) if s.isDirectory()]
            if v not in kept:
                out += [t for t in tables if t not in used] if any(t in used for t in tables) else [v]
        return out

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def standard_checks(store: Store, version: str) -> list[str]:
    """What a staged version must hold: documents with unique ids, texts and sources, and vectors that are usable if there are any."""
    out = []
    row = gate(store.read("documents", version)).first().asDict()
    out += [f"{k}={v}" for k, v in row.items() if (k == "n_docs" and not v) or (k != "n_docs" and v)]
    if store.has("vectors", version) and not validity(store.read("vectors", version)).first()["usable"]:
        out.append("vectors")
    return out


def manifest(docs: DataFrame, embedder: str | None = None, dim: int | None = None) -> dict:
    """Counts by source and kind, and what vectors were made with."""
    rows = docs.groupBy("source", "kind").agg(F.count("*").alias("n")).collect()  # sources times kinds
    by = {"by_source": {}, "by_kind": {}}
    for r in rows:
        for key, name in (("by_source", r.source), ("by_kind", r.kind)):
            by[key][name] = by[key].get(name, 0) + r.n
    return {"documents": sum(r.n for r in rows), **by, "embedder": embedder, "dim": dim}


def write_json(path: str, value: object) -> None:
    """A local JSON file, replaced as a whole."""
    with open(path + ".part", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(path + ".part", path)
