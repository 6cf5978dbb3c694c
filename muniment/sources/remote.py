"""Paged remote results as a data source, with retries, and over recorded pages where there is no network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def with_retry(call: Callable, attempts: int = 3, base: float = 1.0, sleep: Callable = time.sleep) -> Callable:
    """call, tried again after base, 2 base, 4 base seconds; the last error is raised."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception:
                if n == attempts - 1:
                    raise
                sleep(base * 2**n)
        return None

    return run


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedReader(DataSourceReader):
    """One partition a page. `fetch` is a function of page number and options; recorded pages are the default."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        return [Page(n) for n in range(int(self.options.get("pages", "1")))]

    def read(self, partition):
        import os

        n = partition.value
        path = os.path.join(self.options["path"], f"page-{n:05d}.json")
        load = with_retry(lambda: json.load(open(path, encoding="utf-8")), int(self.options.get("attempts", "3")), float(self.options.get("base", "0.01")))
        for row in load():
            yield n, str(row.get("item", "")), json.dumps(row, sort_keys=True, ensure_ascii=False)


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("muniment_pages").option("path", ...).option("pages", n)."""

    @classmethod
    def name(cls):
        return "muniment_pages"

    def schema(self):
        return "page int, item string, json string"

    def reader(self, schema):
        return PagedReader(self.options)


class Disabled:
    """A live service that policy switches off."""

    def fetch(self, *_):
        raise PermissionError("live access is disabled; use a recorded snapshot")
