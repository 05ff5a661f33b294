"""A Python data source for landed pages of a REST listing.

``spark.read.format("landed_listing").option("path", folder).option("per_page", 100).load()``
reads ``*.json`` pages in the order of their names and stops at the first that is short, no list
or does not parse, as paging at the source would.  A page follows from the one before, so one
folder is one partition; several folders (comma-separated) are read side by side.  The files are
opened by the executors, so the folder must be mounted on them; payloads in other stores go
through ``spark.read`` and ``sources.landed``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folder(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folders = [p for p in options.get("path", "").split(",") if p]
        self.per_page = min(100, max(1, int(options.get("per_page", 100))))

    def partitions(self) -> list[Folder]:
        return [Folder(p) for p in self.folders]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for page in sorted(Path(partition.path).glob("*.json")):
            try:
                items = json.loads(page.read_text(encoding="utf-8"))
            except (OSError, ValueError):
                return
            if not isinstance(items, list):
                return
            for item in items:
                yield (str(page), json.dumps([item], ensure_ascii=False))
            if len(items) < self.per_page:
                return


class LandedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_listing"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LandedListing)
