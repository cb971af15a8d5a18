"""Exact deduplication over a bucketed cuckoo-filter index of live digests.

Digests are combined in each map task before they move, so that a text with
very many copies reaches its partition as one row per task.  A partition keeps
its live digests in buckets that go to disk, and a cuckoo filter in memory: a
digest that the filter denies is new and appended to its bucket unread; hits
wait and are verified against the content of their bucket, one bucket at a
time; a filter that overflows is rebuilt at twice the size from the stored keys.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_rows, id_text, partitions, row_key, session, stage
from quillspark.llm.suffixsort import Scratch

_INDEX = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class CuckooFilter:
    """Approximate set of 64-bit keys with deletion: 4 slots a bucket, 16-bit tags."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 1024):
        self.buckets = 1 << max(4, (max(1, capacity) * 4 // 3 // self.SLOTS).bit_length())
        self.slots = array("H", bytes(2 * self.SLOTS * self.buckets))
        self.size = 0

    def _places(self, key: int) -> tuple[int, int, int]:
        tag = (key >> 48) or 1
        first = key & (self.buckets - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & (self.buckets - 1)

    def _put(self, bucket: int, tag: int) -> bool:
        at = bucket * self.SLOTS
        for i in range(at, at + self.SLOTS):
            if not self.slots[i]:
                self.slots[i] = tag
                return True
        return False

    def __contains__(self, key: int) -> bool:
        tag, first, second = self._places(key)
        at, to = first * self.SLOTS, second * self.SLOTS
        return tag in self.slots[at : at + self.SLOTS] or tag in self.slots[to : to + self.SLOTS]

    def insert(self, key: int) -> bool:
        """False if there was no room: the filter must then be rebuilt, as a tag may be out."""
        tag, first, second = self._places(key)
        if self._put(first, tag) or self._put(second, tag):
            self.size += 1
            return True
        bucket = second
        for kick in range(self.KICKS):
            i = bucket * self.SLOTS + kick % self.SLOTS
            self.slots[i], tag = tag, self.slots[i]
            bucket = self._other(bucket, tag)
            if self._put(bucket, tag):
                self.size += 1
                return True
        return False

    def delete(self, key: int) -> bool:
        """Take out one tag of a key that was inserted."""
        tag, first, second = self._places(key)
        for bucket in (first, second):
            at = bucket * self.SLOTS
            for i in range(at, at + self.SLOTS):
                if self.slots[i] == tag:
                    self.slots[i] = 0
                    self.size -= 1
                    return True
        return False


class Buckets:
    """Rows (digest, owner, count) by bucket of their digest; beyond ``held`` rows they go to one file a bucket."""

    COUNT, ROW = 64, struct.Struct("<32s?qq")

    def __init__(self, scratch: Scratch, held: int):
        self.scratch, self.held, self.size = scratch, held, 0
        self.rows: list[list[tuple[bytes, int | None, int]]] = [[] for _ in range(self.COUNT)]
        self.files: dict[int, str] = {}

    @classmethod
    def of(cls, digest: bytes) -> int:
        return digest[-1] % cls.COUNT

    def add(self, digest: bytes, owner: int | None, count: int) -> None:
        self.rows[self.of(digest)].append((digest, owner, count))
        self.size += 1
        if self.size > self.held:
            for b, rows in enumerate(self.rows):
                with open(self.files.setdefault(b, self.scratch.path()), "ab") as f:
                    f.write(b"".join(self.ROW.pack(d, o is None, o or 0, n) for d, o, n in rows))
            self.rows, self.size = [[] for _ in range(self.COUNT)], 0

    def read(self, b: int) -> Iterator[tuple[bytes, int | None, int]]:
        if b in self.files:
            with open(self.files[b], "rb") as f:
                while part := f.read(self.ROW.size * 4096):
                    for digest, none, owner, count in self.ROW.iter_unpack(part):
                        yield digest, None if none else owner, count
        yield from self.rows[b]

    def take(self, b: int) -> Iterator[tuple[bytes, int | None, int]]:
        """The rows of a bucket, which is empty afterwards."""
        yield from self.read(b)
        self.size -= len(self.rows[b])
        self.rows[b] = []
        if b in self.files:
            os.unlink(self.files.pop(b))


class LiveIndex:
    """Digests of 32 bytes with their owner and count; ``offer`` keeps the largest owner of each."""

    def __init__(self, scratch: Scratch, capacity: int = 1024, held: int = 1 << 18):
        self.filter = CuckooFilter(capacity)
        self.store, self.hits = Buckets(scratch, held), Buckets(scratch, held)
        self.held, self.waiting, self.resizes = held, 0, 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "big")

    def _insert(self, digest: bytes) -> None:
        """The digest is in the store, or about to be; every other one of the filter's is in it."""
        if not self.filter.insert(self.key(digest)):
            room = self.filter.buckets * CuckooFilter.SLOTS
            while True:
                room *= 2
                self.resizes += 1
                self.filter = CuckooFilter(room)
                keys = (self.key(d) for b in range(Buckets.COUNT) for d, _, _ in self.store.read(b))
                if self.filter.insert(self.key(digest)) and all(self.filter.insert(k) for k in keys):
                    return

    def offer(self, digest: bytes, owner: int | None, count: int) -> None:
        if self.key(digest) in self.filter:
            self.hits.add(digest, owner, count)
            self.waiting += 1
            if self.waiting > self.held:
                self.settle()
        else:
            self._insert(digest)
            self.store.add(digest, owner, count)

    def settle(self) -> None:
        """Verify the waiting hits against the content of their buckets."""
        for b in range(Buckets.COUNT):
            self._settle(b)
        self.waiting = 0

    def _settle(self, b: int, without: bytes | None = None) -> None:
        hits = list(self.hits.take(b))
        if not hits and without is None:
            return
        live = {}
        for digest, owner, count in self.store.take(b):
            live[digest] = owner, count
        fresh = []
        for digest, owner, count in hits:
            known = live.get(digest)
            if known is None:
                fresh.append(digest)
                live[digest] = owner, count
            else:
                live[digest] = max((x for x in (known[0], owner) if x is not None), default=None), known[1] + count
        if without is not None and live.pop(without, None) is not None and without not in fresh:
            self.filter.delete(self.key(without))
        new = set(fresh)
        for digest, (owner, count) in live.items():
            if digest not in new:
                self.store.add(digest, owner, count)
        for digest in fresh:
            if digest in live:
                self._insert(digest)
                self.store.add(digest, *live[digest])

    def remove(self, digest: bytes) -> None:
        """Take a live digest out of its bucket and the filter."""
        b = Buckets.of(digest)
        # a hit that still waits is not in the filter itself
        if self.key(digest) in self.filter or b in self.hits.files or self.hits.rows[b]:
            self._settle(b, without=digest)

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        self.settle()
        for b in range(Buckets.COUNT):
            yield from self.store.read(b)


def _combine(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held).group_by("digest").aggregate([("doc_id", "max"), ([], "count_all")])
        return table.select(["digest", "doc_id_max", "count_all"]).rename_columns(_INDEX.names).cast(_INDEX).combine_chunks().to_batches()

    for batch in rows:
        held.append(batch)
        size += batch.num_rows
        if size >= 200_000:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _index(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with Scratch() as scratch:
        index = LiveIndex(scratch)
        for batch in rows:
            for digest, owner, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index.offer(digest, owner, count)
        items = index.items()
        while part := list(islice(items, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _INDEX, strict=True)], schema=_INDEX)


def live_index(docs: DataFrame) -> DataFrame:
    """One row per distinct text: digest, keep_id (largest doc_id), group_size."""
    return live_index_of(id_text(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")))


def live_index_of(digests: DataFrame) -> DataFrame:
    """digests: doc_id and digest of each row."""
    schema = "digest binary, keep_id long, group_size long"
    return digests.mapInArrow(_combine, schema).repartition(partitions(digests.sparkSession), "digest").mapInArrow(_index, schema)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every row with the id that stays of its group of equal texts.

    Null text counts as empty.  Of equal texts the row with the largest doc_id
    stays; rows that repeat a doc_id and its text share its fate.  A null
    doc_id stays only if its group has no other.  An empty table gives no rows.
    """
    session(docs)
    rows = id_text(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256")).withColumn("digest", F.unhex("text_sha256"))
    return rows.join(live_index(docs), "digest", "left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: of largest doc_id, without one only where none has any.

    Of rows that repeat that doc_id and the text, one stays.
    """
    session(docs)
    rows = stage(docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest")), "digests")
    keep = live_index_of(rows.select("doc_id", "digest")).filter("group_size > 1").select("digest", "keep_id")
    groups = rows.join(keep, "digest").groupBy("__none", "__id", "__text").agg(F.count("*").alias("n"), F.first(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("one"))
    return drop_rows(docs, groups.filter("not one or n > 1").select("__none", "__id", "__text", "one"))
