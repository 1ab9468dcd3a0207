"""A versioned reference library as a data source: pages are partitions of a read, versions are offsets of a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Most items that a service gives for a request (fixed value).
PAGE = 100
ITEMS = "key string, version long, kind string, title string, parent string, deleted boolean, data string"


class LibraryClient(Protocol):
    """What a connector needs of a service; HTTP, keys and retries are its own."""

    def state(self, since: int) -> tuple[int, int]:
        """The library's version now, and how many items have changed after ``since``."""

    def items(self, since: int, start: int, limit: int) -> list[dict]:
        """Items changed after ``since``, a page of them in order of version and key: key, version, data, deleted."""


@dataclass
class Pages(InputPartition):
    """Items from ``start`` on that changed after ``since``, up to a version."""

    since: int
    until: int
    start: int
    size: int


def row(item: dict) -> tuple:
    """An item of a service as a row of ``ITEMS``; fields that it lacks are null."""
    data = item.get("data") or {}
    return item.get("key"), item.get("version"), data.get("itemType"), data.get("title"), data.get("parentItem"), bool(item.get("deleted") or data.get("deleted")), json.dumps(data, sort_keys=True)


def _read(client: LibraryClient, part: Pages | None) -> Iterator[tuple]:
    """Items of a part (of none where nothing has changed). What changed after the read began has a later version: it is left to the next one."""
    if part is None:
        return
    for start in range(part.start, part.start + part.size, PAGE):
        for item in client.items(part.since, start, min(PAGE, part.start + part.size - start)):
            if item.get("version") is None or item["version"] <= part.until:
                yield row(item)


def _parts(client: LibraryClient, since: int, until: int, pages: int) -> list[Pages]:
    """The changes after a version, so many pages a partition."""
    _, count = client.state(since)
    return [Pages(since, until, start, pages * PAGE) for start in range(0, count, pages * PAGE)]


class Reader(DataSourceReader):
    def __init__(self, client: LibraryClient, since: int, pages: int) -> None:
        self.client, self.since, self.pages = client, since, pages

    def partitions(self) -> list[Pages]:
        return _parts(self.client, self.since, self.client.state(self.since)[0], self.pages)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _read(self.client, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are library versions, so a stream that starts again asks for what changed after the last one it committed."""

    def __init__(self, client: LibraryClient, since: int, pages: int) -> None:
        self.client, self.since, self.pages = client, since, pages

    def initialOffset(self) -> dict:
        return {"version": self.since}

    def latestOffset(self) -> dict:
        return {"version": self.client.state(self.since)[0]}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return _parts(self.client, start["version"], end["version"], self.pages)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _read(self.client, partition)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the version; the service has nothing to be told."""


def source(spark: SparkSession, name: str, make: Callable[[dict], LibraryClient]) -> None:
    """Registers a library under ``name``, for ``spark.read`` and ``spark.readStream``.

    ``make`` gives a client for the options. Options ``since`` (a version, 0 unless given) and ``pages`` (pages of a partition, 1 unless given).
    """

    class Library(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ITEMS

        def _with(self, kind):
            return kind(make(dict(self.options)), int(self.options.get("since", 0)), int(self.options.get("pages", 1)))

        def reader(self, schema) -> DataSourceReader:
            return self._with(Reader)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return self._with(StreamReader)

    spark.dataSource.register(Library)


def current(items: DataFrame) -> DataFrame:
    """The last version of every item (``ITEMS``); items without key go, and with them those deleted at last."""
    from pyspark.sql import functions as F

    last = items.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*(c for c in items.columns if c != "key")), F.struct("version", "data")).alias("x"))
    return last.select("key", "x.*").where("NOT deleted").select(*items.columns)
