"""A Spark data source over services that give rows by offset and length."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from larkfield.runtime import ship_package


class Span(InputPartition):
    """Rows from ``start`` up to ``end``."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end
        super().__init__((start, end))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        self.url = options["url"]
        self.page, self.pages = int(options.get("page", "100")), int(options.get("pages_per_task", "50"))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.retries, self.wait = int(options.get("retries", "3")), float(options.get("wait", "1"))
        self.timeout = float(options.get("timeout", "60"))
        if "{offset}" not in self.url or "{length}" not in self.url:
            raise ValueError("the url needs {offset} and {length}")

    def _get(self, offset: int, length: int) -> dict:
        """One page; what may pass (no connection, 429, 5xx) is tried again after a wait that doubles."""
        url = self.url.replace("{offset}", str(offset)).replace("{length}", str(length))
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return json.loads(answer.read().decode("utf-8"))
            except urllib.error.HTTPError as bad:
                if not left or (bad.code != 429 and bad.code < 500):
                    raise
            except OSError:
                if not left:
                    raise
            time.sleep(self.wait * 2 ** (self.retries - left))
        raise AssertionError

    def partitions(self) -> list[Span]:
        """Runs of pages, over as many rows as the service says it has, or as the limit allows."""
        total = int(self._get(0, 1)["num_rows_total"])
        total = total if self.limit is None else min(total, max(self.limit, 0))
        step = self.page * self.pages
        return [Span(at, min(at + step, total)) for at in range(0, total, step)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        """Its rows, page by page. A page that ends early is asked for on; one without rows fails the task, which Spark runs again."""
        at = partition.start
        while at < partition.end:
            rows = self._get(at, min(self.page, partition.end - at)).get("rows") or []
            if not rows:
                raise OSError(f"no rows at {at}, where there should be some up to {partition.end}")
            for item in rows[: partition.end - at]:
                row = item.get("row") or {}
                yield tuple(row.get(name) for name in self.names)
            at += len(rows)


class PagedSource(DataSource):
    """``spark.read.format("lf_paged")`` with a schema and the options url, page, pages_per_task, limit, retries, wait and timeout.

    Answers are JSON: ``{"rows": [{"row": {...}}], "num_rows_total": n}``. Names that a row lacks are null, others are left out.
    ``limit`` bounds the pages that are asked for; the driver asks for one row, to learn how many there are.
    """

    @classmethod
    def name(cls) -> str:
        return "lf_paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def read_paged(spark: SparkSession, url: str, schema: StructType | str, limit: int | None = None, **options: object) -> DataFrame:
    """Rows of a paged service as a table; pages are fetched by the tasks."""
    ship_package(spark)
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("lf_paged").schema(schema).option("url", url)
    for key, value in {**options, **({} if limit is None else {"limit": limit})}.items():
        reader = reader.option(key, str(value))
    return reader.load()
