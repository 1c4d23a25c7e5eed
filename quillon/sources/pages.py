"""Pages of paper sources as a Spark data source: a batch and a streaming reader over a client.

The client is any callable (source, query, cursor) -> (body, next cursor or None). The one
here replays saved pages from a folder; a client with network access is passed as the
dotted name of a function that every worker can import.
"""

from __future__ import annotations

import glob
import importlib
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Client = Callable[[str, str, int], tuple[str | None, int | None]]
TRIES, FIRST_WAIT = 5, 3.0


def waits(tries: int = TRIES, first: float = FIRST_WAIT) -> list[float]:
    """Seconds to wait after each failed try but the last: doubled each time."""
    return [first * 2**k for k in range(tries - 1)]


def patient(client: Client, source: str, query: str, cursor: int, pauses: list[float] | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int | None]:
    """What ``client`` returns, tried again after each of ``pauses``; nothing, and no further cursor, if every try fails."""
    for pause in [*(waits() if pauses is None else pauses), None]:
        try:
            return client(source, query, cursor)
        except OSError:
            if pause is not None:
                sleep(pause)
    return None, None


def arxiv_query(categories: list[str], keywords: list[str]) -> str:
    """Categories or key words, each quoted."""
    parts = [f"cat:{c}" for c in categories] + [f'all:"{k}"' for k in keywords]
    return " OR ".join(parts)


def rotating_query(seeds: list[str], call: int, modifiers: tuple[str, ...] = ("mechanism", "experiment", "review"), most: int = 400) -> str:
    """Two or three seeds in turn by the number of the call, every third call with a modifier, at most ``most`` characters."""
    if not seeds:
        return ""
    n = min(len(seeds), 2 + call % 2)
    words = [seeds[(call * 2 + i) % len(seeds)] for i in range(n)]
    if call % 3 == 2:
        words.append(modifiers[(call // 3) % len(modifiers)])
    return " ".join(words)[:most]


def replay(source: str, query: str, cursor: int) -> tuple[str | None, int | None]:
    """Page ``cursor`` of the folder ``query``, files in the order of their names."""
    files = sorted(glob.glob(os.path.join(query, "*")))
    if cursor >= len(files):
        return None, None
    with open(files[cursor], encoding="utf-8") as f:
        return f.read(), cursor + 1 if cursor + 1 < len(files) else None


def _client(options: dict) -> Client:
    name = options.get("client")
    if not name:
        return replay
    module, _, function = name.rpartition(".")
    return getattr(importlib.import_module(module), function)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        first, pages = int(self.options.get("cursor", 0)), int(self.options.get("pages", 1))
        return [InputPartition(first + i) for i in range(pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        body, _ = patient(_client(self.options), self.options.get("source", ""), self.options.get("query", ""), partition.value)
        if body is not None:
            yield self.options.get("source", ""), partition.value, body


class PagesStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"cursor": int(self.options.get("cursor", 0))}

    def _page(self, cursor: int) -> list[tuple]:
        body, _ = patient(_client(self.options), self.options.get("source", ""), self.options.get("query", ""), cursor)
        return [] if body is None else [(self.options.get("source", ""), cursor, body)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._page(start["cursor"])
        return iter(rows), {"cursor": start["cursor"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for cursor in range(start["cursor"], end["cursor"]):
            yield from self._page(cursor)


class PaperPages(DataSource):
    """Format ``paper_pages``: options source, query, cursor, pages, client. Columns source, cursor, body."""

    @classmethod
    def name(cls) -> str:
        return "paper_pages"

    def schema(self) -> str:
        return "source string, cursor int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagesStream(dict(self.options))
