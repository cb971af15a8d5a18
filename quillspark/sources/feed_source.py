"""Stored feed documents as a Spark data source: ``spark.read.format("feeds")`` and ``spark.readStream``.

Documents lie at ``<path>/poll=<n>/feed_id=<m>/<file>``, one feed as it was at
one poll.  Few documents are a partition each; of many, as many are one as
make a share of their bytes.  A filter on ``feed_id`` or
``poll`` is applied to the names before anything is opened.  A stream's offset is
the last poll that it has read: polls are numbered upwards, and one is read
when the next number's folder, or the poll's own ``_SUCCESS``, is there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from quillspark.sources.feeds import feed_error, read_feed

SCHEMA = "poll int, feed_id long, position int, guid string, title string, url string, summary string, published string, content_type string, extensions array<string>, inline_html string, error string"
_NAME = re.compile(r"poll=(\d+)/feed_id=(\d+)/[^/_.][^/]*$")


#: Documents up to which each is a partition, and bytes of one; opening a document counts as so many.
SINGLE, SHARE, OPENING = 96, 16 << 20, 16 << 10


@dataclass
class Document:
    path: str
    poll: int
    feed_id: int
    size: int


@dataclass
class Documents(InputPartition):
    held: list[Document]


def shares(documents: list[Document]) -> list[Documents]:
    """Documents in order, dealt into partitions: one each, or ``SINGLE`` and more of up to ``SHARE`` bytes."""
    if len(documents) <= SINGLE:
        return [Documents([d]) for d in documents]
    costs = [d.size + OPENING for d in documents]
    most = min(SHARE, sum(costs) // SINGLE)
    out, held, cost = [], [], 0
    for d, c in zip(documents, costs, strict=True):
        if held and cost + c > most:
            out.append(Documents(held))
            held, cost = [], 0
        held.append(d)
        cost += c
    return [*out, Documents(held)]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class _Documents:
    def __init__(self, options: dict[str, str]):
        self.path, self.base = options["path"].rstrip("/"), options.get("base", "")
        self.wanted: dict[str, set[int]] = {}

    def listed(self) -> list[Document]:
        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out = [Document(f.path, int(m[1]), int(m[2]), f.size or 0) for f in found if f.is_file and (m := _NAME.search(f.path))]
        fine = lambda d: all(getattr(d, name) in values for name, values in self.wanted.items())
        return sorted(filter(fine, out), key=lambda d: (d.poll, d.feed_id, d.path))

    def read(self, partition: Documents | None) -> Iterator[tuple]:
        for document in partition.held if partition is not None else []:
            yield from self.rows(document)

    def rows(self, document: Document) -> Iterator[tuple]:
        """Entries by position; a document that can't be read is one row with its error."""
        system, _ = _opened(self.path)
        with system.open_input_stream(document.path) as file:
            data = file.read()
        error = feed_error(data)
        if error is not None:
            yield (document.poll, document.feed_id, None, *[None] * 8, error)
        for position, e in enumerate(read_feed(data, self.base)):
            yield (document.poll, document.feed_id, position, *[e[c] for c in ("guid", "title", "url", "summary", "published", "content_type", "extensions", "inline_html")], None)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.documents = _Documents(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on feed_id and poll choose documents; all others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("feed_id",), ("poll",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                wanted = self.documents.wanted
                wanted[f.attribute[0]] = values & wanted.get(f.attribute[0], values)
            else:
                yield f

    def partitions(self) -> list[Documents]:
        return shares(self.documents.listed())

    def read(self, partition: Documents | None) -> Iterator[tuple]:
        return self.documents.read(partition)


class FeedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.documents = _Documents(options)

    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        system, root = _opened(self.documents.path)
        names = {f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))}
        polls = sorted({int(m[1]) for n in names if (m := re.search(r"/poll=(\d+)(?:/|$)", n))})
        if polls and not any(n.endswith(f"/poll={polls[-1]}/_SUCCESS") for n in names):
            polls.pop()
        return {"poll": polls[-1] if polls else -1}

    def partitions(self, start: dict, end: dict) -> list[Documents]:
        return shares([d for d in self.documents.listed() if start["poll"] < d.poll <= end["poll"]])

    def read(self, partition: Documents | None) -> Iterator[tuple]:
        return self.documents.read(partition)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Options: path, and base, the address that relative links belong to."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make ``feeds`` known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
    return spark
