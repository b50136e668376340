"""A mailbox as a streaming source: one page of threads a micro-batch, offsets (month, offset) kept by the query's checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Client(Protocol):
    """What the source asks of a mailbox; it is sent to the tasks, so it has to be picklable."""

    def threads(self, month: str) -> int:
        """How many threads a search of the month finds."""

    def fetch(self, month: str, offset: int, size: int) -> Iterator[tuple]:
        """Messages of the threads at [offset, offset + size), as rows of the schema; also such of other months."""


def following(month: str) -> str:
    year, m = divmod(int(month[:4]) * 12 + int(month[5:]), 12)
    return f"{year:04d}-{m + 1:02d}"


class Page(InputPartition):
    def __init__(self, month: str, offset: int):
        super().__init__((month, offset))
        self.month, self.offset = month, offset


class Pages(DataSourceStreamReader):
    """An offset is where the next page begins. It moves by one page a trigger, over months without threads at once, and ends at the
    month after `last`. Spark logs it before the page is read and takes it as done after the sink, so a crash repeats one page."""

    def __init__(self, client: Client, month_of: Callable[[tuple], str], first: str, last: str, size: int):
        self.client, self.month_of, self.first, self.last, self.size = client, month_of, first, last, size
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"month": self.first, "offset": 0}

    def step(self, at: dict) -> dict:
        month, offset = at["month"], at["offset"]
        if month > self.last:
            return at
        n = self.client.threads(month)
        if offset < 0 or offset > n:
            raise ValueError(f"offset {offset} is not within the {n} threads of {month}")
        if offset + self.size < n:
            return {"month": month, "offset": offset + self.size}
        month = following(month)
        while month <= self.last and not self.client.threads(month):
            month = following(month)
        return {"month": month, "offset": 0}

    def latestOffset(self) -> dict:
        self.at = self.step(self.at or self.initialOffset())
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if self.at is None:  # a query that goes on plans its last logged batch first
            self.at = end
        pages = []
        while start != end:
            pages.append(Page(start["month"], start["offset"]))
            start = self.step(start)
        return pages

    def read(self, partition: Page) -> Iterator[tuple]:
        """Only messages of the page's own month: those of threads that reach into another come with that one."""
        return (m for m in self.client.fetch(partition.month, partition.offset, self.size) if self.month_of(m) == partition.month)


def mailbox(client: Client, schema: str, month_of: Callable[[tuple], str], first: str, last: str, size: int = 25, name: str = "mailbox") -> type[DataSource]:
    """A data source to register with `spark.dataSource.register` and to read by `spark.readStream.format(name)`: the months `first`
    to `last`, `size` threads a page. Its own state is none but the checkpoint's."""
    called, columns = name, schema

    class Mailbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> str:
            return columns

        def streamReader(self, schema) -> Pages:
            return Pages(client, month_of, first, last, size)

    return Mailbox
