"""A Python data source for paged JSON interfaces: one input partition for each page, read on the executors.

The transport is a picklable function page -> text, so that it can be an HTTP client on a cluster and a local
function where there is no network. A page without records, or shorter than a full one, ends its reader early.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRANSPORTS: dict[str, Callable[[int], str]] = {}


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int], str], pages: int, path: list[str], fields: list[str]):
        self.fetch, self.pages, self.path, self.fields = fetch, pages, path, fields

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(1, self.pages + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        at = json.loads(self.fetch(partition.number) or "null")
        for key in self.path:
            at = at[int(key)] if isinstance(at, list) else (at or {}).get(key)
        for record in at or []:
            yield tuple(None if record.get(f) is None else str(record[f]) for f in self.fields)


def paged_source(name: str, fetch: Callable[[int], str], pages: int, path: list[str], fields: list[str]) -> type[DataSource]:
    """A data source class to register with spark.dataSource.register and to read with spark.read.format(name)."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ", ".join(f"`{f}` string" for f in fields)

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(fetch, pages, path, fields)

    return Paged


class Run(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class OpenReader(DataSourceReader):
    """Pages first, first + lanes, first + 2 * lanes .. in each of ``lanes`` partitions, until one is short or empty."""

    def __init__(self, fetch: Callable[..., str], lanes: int, size: int, path: list[str], fields: list[str], headers: dict[str, str] | None):
        self.fetch, self.lanes, self.size, self.path, self.fields, self.headers = fetch, lanes, size, path, fields, headers

    def partitions(self) -> list[Run]:
        return [Run(k, self.lanes) for k in range(1, self.lanes + 1)]

    def read(self, partition: Run) -> Iterator[tuple]:
        page = partition.first
        while True:
            at = json.loads((self.fetch(page, self.headers) if self.headers else self.fetch(page)) or "null")
            for key in self.path:
                at = at[int(key)] if isinstance(at, list) else (at or {}).get(key)
            for record in at or []:
                yield tuple(None if record.get(f) is None else str(record[f]) for f in self.fields)
            if len(at or []) < self.size:  # every later page is empty
                return
            page += partition.step


def bearer(token: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {token}"}


def open_source(name: str, fetch: Callable[..., str], size: int, path: list[str], fields: list[str], lanes: int = 4, headers: dict[str, str] | None = None) -> type[DataSource]:
    """As paged_source, for an unknown number of pages of ``size`` records: reading stops at a short page. headers (say,
    of authorisation) are handed to fetch as its second argument."""

    class Open(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ", ".join(f"`{f}` string" for f in fields)

        def reader(self, schema) -> DataSourceReader:
            return OpenReader(fetch, lanes, size, path, fields, headers)

    return Open
