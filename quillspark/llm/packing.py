"""Packing token pieces into sequences of fixed length.

Pieces are dealt by number (of their task and row, so that equal rows part) to shards of about ``SHARD_BYTES`` of text, so that a
shard's packing fits in one task at any corpus size and the loss to packing
shards apart is at most a few sequences a shard.  Full pieces are sequences of
their own.

``best_fit_decreasing`` searches capacities with a segment tree.  ``improve``
is the local search: it exchanges one piece for one, two for one, or moves a
piece between underfull bins whenever that raises the sum of squared fills,
and so drains the emptiest bins until they are gone.  It ends where no such
step is left between any two underfull bins of the shard, whichever of them is
the fuller, or where the shard has as few sequences as its lengths allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import id_text, partitions, session, stage
from quillspark.llm.tokens import PIECES_DDL, SEQUENCE, pieces

#: Bytes of text whose pieces make a shard: with token ids, and with lengths only.
SHARD_BYTES, LIGHT_SHARD_BYTES = 8 << 20, 96 << 20


class CapacityTree:
    """Segment tree over capacities 0..capacity: which have open bins; finds the least that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        at = self.size + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of least room that is at least ``need``."""
        at = self.size + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        bin_id = self.bins[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, bin_id


def best_fit_decreasing(lengths: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where least room is left."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            bins.append([i])
            tree.add(capacity - lengths[i], len(bins) - 1)
        else:
            room, b = found
            bins[b].append(i)
            tree.add(room - lengths[i], b)
    return bins


class RoomIndex:
    """Which open bins hold items of a length, or two items of a sum, and the most room among them.

    ``reach[k]`` is that room plus k: a bin can give k and take s for it if
    ``k < s <= reach[k]``.  Entries of bins that have changed since are dropped
    when they come to the top.
    """

    def __init__(self, capacity: int):
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.reach = np.zeros(capacity + 1, np.int64)
        self.version: dict[int, int] = {}

    def add(self, b: int, room: int, keys: set[int]) -> None:
        for k in keys:
            heappush(self.heaps[k], (-room, b, self.version.setdefault(b, 0)))
            self._settle(k)

    def remove(self, b: int, keys: set[int]) -> None:
        self.version[b] = self.version.get(b, 0) + 1
        for k in keys:
            self._settle(k)

    def _settle(self, k: int) -> None:
        heap = self.heaps[k]
        while heap and heap[0][2] != self.version[heap[0][1]]:
            heappop(heap)
        self.reach[k] = k - heap[0][0] if heap else 0

    def least(self, s: int, low: int, high: int) -> int | None:
        """The least k in low..high-1 that some bin can give for s."""
        if low >= high:
            return None
        k = int((self.reach[low:high] >= s).argmax()) + low
        return k if self.reach[k] >= s else None

    def bin(self, k: int) -> int:
        return self.heaps[k][0][1]


class RoomTable:
    """How many open bins hold items of a length (or two of a sum) with less than a given room.

    A bin that gives ``s`` gains by getting ``k`` from any bin, fuller or
    emptier, whose room is at least ``s - k`` and less than that and its own.
    """

    def __init__(self, capacity: int):
        self.below = np.zeros((capacity + 1, capacity + 2), np.int32)
        self.bins: dict[tuple[int, int], set[int]] = {}

    def add(self, b: int, room: int, keys: set[int]) -> None:
        for k in keys:
            self.below[k, room + 1 :] += 1
            self.bins.setdefault((k, room), set()).add(b)

    def remove(self, b: int, room: int, keys: set[int]) -> None:
        for k in keys:
            self.below[k, room + 1 :] -= 1
            self.bins[k, room].discard(b)

    def find(self, s: int, least: int, most: int, room: int) -> tuple[int, int] | None:
        """The least k of least..s-1 for which some bin's room fits, of a shift above ``most``; and such a bin."""
        top = self.below.shape[1] - 1
        ks = np.arange(max(least, s - top + 1), s - most)
        if not len(ks):
            return None
        shift = s - ks
        fits = self.below[ks, np.minimum(shift + room, top)] > self.below[ks, shift]
        if not fits.any():
            return None
        k = int(ks[fits.argmax()])
        row = self.below[k, s - k : min(s - k + room, top) + 1]
        at = s - k + int((row > row[0]).argmax()) - 1
        return k, min(self.bins[k, at])


def improve(bins: list[list[int]], lengths: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Local search by moves and exchanges between underfull bins; never more bins than before.

    A pass goes through all underfull bins, the emptiest of those left first,
    and shifts length from each to fuller bins until no move or exchange does
    so.  When such a pass gains nothing, the bins are tried in pairs of either
    order, as a fuller bin may give to an emptier one.  The search ends where
    no pair gains, or with as few bins as the lengths allow.
    """
    full, held = [], []  # item numbers of each underfull bin by length
    for b in bins:
        if sum(lengths[i] for i in b) == capacity:
            full.append(b)
            continue
        held.append({})
        for i in b:
            held[-1].setdefault(lengths[i], []).append(i)
    fill = [sum(n * len(of) for n, of in b.items()) for b in held]
    fewest = -(-sum(fill) // capacity)
    live = sum(f > 0 for f in fill)

    def sums(b: int) -> set[int]:
        sizes = sorted(held[b])
        return {x + y for k, x in enumerate(sizes) for y in sizes[:k]} | {2 * x for x in sizes if len(held[b][x]) > 1}

    def halves(b: int, total: int) -> tuple[int, int]:
        return next((x, total - x) for x in sorted(held[b]) if total - x in held[b] and (2 * x != total or len(held[b][x]) > 1))

    def shift(a: int, b: int, sizes: tuple[int, ...]) -> None:
        for n in sizes:
            held[b].setdefault(n, []).append(held[a][n].pop())
            if not held[a][n]:
                del held[a][n]
        fill[a], fill[b] = fill[a] - sum(sizes), fill[b] + sum(sizes)

    def anywhere() -> bool:
        """Exchanges between any two bins until none gains; whether one did."""
        nonlocal live
        ones, twos = RoomTable(capacity), RoomTable(capacity)

        def enter(b: int) -> None:
            if 0 < fill[b] < capacity:
                ones.add(b, capacity - fill[b], {0, *held[b]})
                twos.add(b, capacity - fill[b], sums(b))

        def leave(b: int) -> None:
            if 0 < fill[b] < capacity:
                ones.remove(b, capacity - fill[b], {0, *held[b]})
                twos.remove(b, capacity - fill[b], sums(b))

        def step(b: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
            most, found, room = 0, None, capacity - fill[b]
            for s in sorted(held[b], reverse=True):
                for index in (ones, twos):  # move, one for one, one for two
                    if (hit := index.find(s, 0, most, room)) is not None:
                        most, found = s - hit[0], ((s,), hit[1], halves(hit[1], hit[0]) if index is twos else (hit[0],) if hit[0] else ())
            for s in sums(b):  # two for one
                if s <= capacity and (hit := ones.find(s, 1, most, room)) is not None:
                    most, found = s - hit[0], (halves(b, s), hit[1], (hit[0],))
            return None if found is None else (found[1], found[0], found[2])

        for b in range(len(held)):
            enter(b)
        any_gain, again = False, True
        while again:
            again = False
            for b in range(len(held)):
                while 0 < fill[b] < capacity:
                    leave(b)
                    found = step(b)
                    if found is None:
                        enter(b)
                        break
                    t, mine, theirs = found
                    leave(t)
                    shift(b, t, mine)
                    shift(t, b, theirs)
                    enter(b)
                    enter(t)
                    any_gain = again = True
                    live -= not fill[b]
                    if live == fewest:
                        return True
        return any_gain

    gained = True
    while gained and live > fewest:
        gained = False
        # key 0 of ``ones``: a bin that gives nothing
        ones, twos = RoomIndex(capacity), RoomIndex(capacity)
        waiting = {b for b in range(len(held)) if 0 < fill[b] < capacity}
        queue = sorted((fill[b], b) for b in waiting)

        def enter(b: int) -> None:
            ones.add(b, capacity - fill[b], {0, *held[b]})
            twos.add(b, capacity - fill[b], sums(b))

        def leave(b: int) -> None:
            ones.remove(b, {0, *held[b]})
            twos.remove(b, sums(b))

        def step(b: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
            """The fuller bin, what it gets and what it gives where most length is shifted."""
            most, found, room = 0, None, int(ones.reach[0])
            for s in sorted(held[b], reverse=True):
                for index in (ones, twos):  # move, one for one, one for two
                    if (k := index.least(s, max(0, s - room), s - most)) is not None:
                        most, found = s - k, (index, (s,), k)
            for s in sums(b):  # two for one
                if (k := ones.least(s, max(1, s - room), min(s - most, capacity))) is not None:
                    most, found = s - k, (ones, halves(b, s), k)
            if found is None:
                return None
            index, mine, k = found
            t = index.bin(k)
            return t, mine, halves(t, k) if index is twos else (k,) if k else ()

        for b in waiting:
            enter(b)
        while queue:
            f, b = heappop(queue)
            if b not in waiting or f != fill[b]:
                continue
            waiting.remove(b)
            leave(b)
            while (found := step(b)) is not None:
                t, mine, theirs = found
                leave(t)
                shift(b, t, mine)
                shift(t, b, theirs)
                gained = True
                if fill[t] < capacity:
                    enter(t)
                    heappush(queue, (fill[t], t))
                else:
                    waiting.remove(t)
            if not fill[b]:
                live -= 1
                if live == fewest:
                    break
        if not gained and live > fewest:
            gained = anywhere()
    return full + [[i for of in b.values() for i in of] for b in held if b]


def _dealt(n: int) -> Column:
    """Shard of a piece: by its task and its place there, whatever its id and text.

    The same task gives the same numbers when it runs again.
    """
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))


def shards(docs: DataFrame, shard_bytes: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return max(1, -(-size // shard_bytes))


def _places(lengths: list[int], bins: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for s, members in enumerate(bins):
        at = 0
        for i in members:
            sequence[i], offset[i] = s, at
            at += lengths[i]
    return sequence, offset


def _pack_shard(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = part["length"].tolist()
    sequence, offset = _places(lengths, improve(best_fit_decreasing(lengths), lengths))
    return part.assign(sequence_id=sequence * (1 << 24) + part["shard"].to_numpy(), offset=offset).drop(columns="shard")


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, shard_bytes: int = LIGHT_SHARD_BYTES) -> DataFrame:
    """Place of each piece of each document in sequences of 2048 tokens.

    Null text counts as empty: its document is the end id alone.  Repeated rows
    are packed each by itself.  Full pieces get sequences of their own.  An
    empty table gives no rows.
    """
    session(docs)
    rows = id_text(docs)
    n = shards(rows, shard_bytes)
    cut = stage(rows.mapInArrow(lambda it: pieces(it, tokenizer, False), PIECES_DDL).drop("ids"), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.filter(F.col("length") == SEQUENCE).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.filter(F.col("length") < SEQUENCE).select(*columns, _dealt(n).alias("shard"))
    packed = part.groupBy("shard").applyInPandas(_pack_shard, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(packed)


_MATRIX = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])
MATRIX_DDL = "sequence_id long, n_tokens long, doc_ids array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def _matrix(table: pa.Table, sequence: int = SEQUENCE) -> Iterator[pa.RecordBatch]:
    """Rows of the packed matrix of one shard: ids padded with the end id, segment ends, positions from 0 in each segment."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
    if not table.num_rows:
        return
    shard = table.column("shard")[0].as_py()
    lengths, ids, docs = table.column("length").to_pylist(), table.column("ids"), table.column("doc_id").to_pylist()
    rows = []
    for s, members in enumerate(best_fit_decreasing(lengths, sequence)):
        tokens = b"".join(ids[i].as_py() for i in members)
        ends = np.cumsum([lengths[i] for i in members])
        positions = np.concatenate([np.arange(lengths[i], dtype="<u4") for i in members])
        rows.append((s * (1 << 24) + shard, int(ends[-1]), [docs[i] for i in members], [0, *ends.tolist()], tokens.ljust(4 * sequence, b"\0"), positions.tobytes().ljust(4 * sequence, b"\0")))
        if len(rows) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MATRIX, strict=True)], schema=_MATRIX)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MATRIX, strict=True)], schema=_MATRIX)


def pack_matrix(docs: DataFrame, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed id matrix: per sequence its 2048 ids, cumulative segment lengths and position resets.

    Each segment is one piece of a document, named in ``doc_ids``; the segments
    of all sequences together hold every token once.  Null text counts as
    empty, repeated rows are packed each by itself, an empty table gives none.
    """
    session(docs)
    rows = id_text(docs)
    n = shards(rows, shard_bytes)
    cut = rows.mapInArrow(lambda it: pieces(it, tokenizer, True), PIECES_DDL)
    dealt = cut.select(_dealt(n).alias("shard"), "doc_id", "piece", "length", "ids").repartition(max(n, partitions(docs.sparkSession)), "shard")
    return dealt.groupBy("shard").applyInArrow(lambda t: pa.Table.from_batches(list(_matrix(t)), schema=_MATRIX), MATRIX_DDL)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Write the packed sequences as Parquet: binary ids and positions, segment ends."""
    matrix.write.mode("overwrite").parquet(path)


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids = [zlib.crc32(x.as_py()) for x in batch.column("input_ids")]
        places = [zlib.crc32(x.as_py()) for x in batch.column("position_ids")]
        kept = [batch.column(c) for c in ("sequence_id", "n_tokens", "doc_ids", "cu_seqlens")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.int64()), pa.array(places, pa.int64())], names=["sequence_id", "n_tokens", "doc_ids", "cu_seqlens", "ids_crc32", "positions_crc32"])


def matrix_digests(matrix: DataFrame) -> DataFrame:
    """The matrix with checksums in place of its binary columns."""
    return matrix.mapInArrow(_digests, "sequence_id long, n_tokens long, doc_ids array<long>, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long")
