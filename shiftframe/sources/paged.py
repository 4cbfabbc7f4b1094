"""A paged JSON service as a data source: one partition a page, read by the executors.

``spark.dataSource.register(PagedJson)``, then
``spark.read.format("paged_json").option("url", "http://host/rows?start={start}&length={length}").load()``
gives (start, payload); ``rows_of`` makes columns of the payloads' array.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedJson(DataSource):
    """Options: url with {start} and {length}, total (rows in all; without it the first page's ``total_field``, recordsTotal, tells), length (rows a page, 100), tries (3)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "start long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.total, self.field = options["url"], options.get("total"), options.get("total_field", "recordsTotal")
        self.length, self.tries = int(options.get("length", 100)), int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        total = int(self.total) if self.total is not None else int(json.loads(self._page(0))[self.field])
        return [InputPartition(start) for start in range(0, total, self.length)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        yield partition.value, self._page(partition.value)

    def _page(self, start: int) -> str:
        from time import sleep
        from urllib.request import urlopen

        url = self.url.format(start=start, length=self.length)
        for k in range(1, self.tries + 1):
            try:
                with urlopen(url, timeout=60) as answer:
                    return answer.read().decode("utf-8")
            except OSError:
                if k == self.tries:
                    raise
                sleep(0.2 * k)
        raise OSError(f"no try for {url}")


def rows_of(pages: DataFrame, field: str, row_schema: str) -> DataFrame:
    """The rows of the array ``field`` of all payloads; ``row_schema`` is a row's columns as DDL."""
    parsed = F.from_json("payload", f"`{field}` array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in row_schema.split(','))}>>")
    return pages.select(F.explode(parsed[field]).alias("row")).select("row.*")
