"""Super-k-mer partitioning, shared by the two substring deduplicators.

A window is ``width`` consecutive units (words or bytes) of one text.  Its
minimiser is the least hash among its m-grams, the leftmost of equal ones;
equal windows have equal minimisers at equal places.  Consecutive windows with
the same minimiser place travel as one packed string, a super-k-mer.

Three passes.  (1) Minimisers are counted over the corpus; those that occur
once can't be in a repeated window and set no bit in a bitmap of bounded size
(a collision there only lets more through).  (2) Super-k-mers whose minimiser
passes are emitted: once per task and string as packed strings, and per text
and string as the places where they stand.  (3) Packed strings meet in the
bucket of their minimiser, which tells for each string which of its windows
repeat; a minimiser with very many strings (the edge of a passage that stands
in very many texts) has no bucket of its own, its windows are dealt out one by
one by a 128-bit digest and counted there.  What comes back is joined to the places, gathered by text, and applied
to the whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.common import id_text, partitions, session, stage, unstage

#: The bitmap of repeated minimisers has at most this many bits (32 MB), and 16 a minimiser below that.
MAX_BITMAP_BITS = 28
_BLOCK_BITS = 20
#: Packed strings that a task holds before it passes them on.
HELD_BYTES = 48 << 20
#: A minimiser with more strings than this is split by window, at any corpus size.
HOT_STRINGS = 500
#: Split minimisers that are broadcast (1 MB), at most; more are joined by key.
MAX_HOT_BROADCAST = 1 << 17
#: Places of one string that are joined in one task, and strings at most that have more and are dealt out.
HOT_PLACES, MAX_SALTED = 100_000, 1 << 17


@dataclass(frozen=True)
class Shape:
    width: int
    gram: int
    words: bool  # units are white-space words, else bytes

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bk.Units | None]:
        """Hash of each unit's value, first unit of each text, and the words."""
        if not self.words:
            return data, offsets, None
        units = bk.Units(data, offsets, bk.SPACE)
        return units.hashes(), units.bounds, units


@dataclass
class SuperKmers:
    text: np.ndarray  # index of the text in the slice
    start: np.ndarray  # first window, as a unit of the slice
    count: np.ndarray  # windows
    key: np.ndarray  # hash of the minimiser
    spot: np.ndarray  # place of the minimiser, from the first window's start


def cut(values: np.ndarray, bounds: np.ndarray, shape: Shape) -> SuperKmers:
    none = np.empty(0, np.int64)
    if len(values) < shape.width:
        return SuperKmers(none, none, none, none.astype(np.uint64), none)
    hashes = bk.grams(bk.prefix(values), shape.gram)
    spots = bk.leftmost_minima(hashes, shape.width - shape.gram + 1)
    # windows inside one text
    sizes = np.diff(bounds)
    long = np.flatnonzero(sizes >= shape.width)
    if not len(long):
        return SuperKmers(none, none, none, none.astype(np.uint64), none)
    inside = np.zeros(len(spots) + 1, dtype=np.int8)
    np.add.at(inside, bounds[long], 1)
    np.add.at(inside, bounds[long] + sizes[long] - shape.width + 1, -1)
    live = np.flatnonzero(np.cumsum(inside[:-1]))
    place = spots[live]
    new = np.ones(len(live), dtype=bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(live) != 1)
    first = np.flatnonzero(new)
    start = live[first]
    count = np.diff(np.append(first, len(live)))
    # minima crowd near zero: mixed again, their first bits spread over the bitmap
    return SuperKmers(np.searchsorted(bounds, start, side="right") - 1, start, count, bk.mix(hashes[place[first]]), place[first] - start)


_KEYS_DDL = "key long, low long, high long, n long"


def _minimisers(rows: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Minimisers of each slice with their count and least and largest document."""
    for batch in rows:
        ids = np.array([-(1 << 63) if x is None else x for x in batch.column("doc_id").to_pylist()], dtype=np.int64)
        for first, _, data, offsets in bk.slices(batch, "text"):
            values, bounds, _ = shape.units(data, offsets)
            found = cut(values, bounds, shape)
            if not len(found.key):
                continue
            owner = ids[first + found.text]
            order = np.argsort(found.key, kind="stable")
            key, owner = found.key[order], owner[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(at, len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(np.minimum.reduceat(owner, at)), pa.array(np.maximum.reduceat(owner, at)), pa.array(n)], names=["key", "low", "high", "n"])


@dataclass
class Bitmap:
    """Which keys repeat, by their first bits."""

    bits: int
    data: np.ndarray  # uint8, packed

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _blocks(rows: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A partition's keys as blocks of the bitmap; a block is in one partition only."""
    blocks: dict[int, np.ndarray] = {}
    size = min(bits, _BLOCK_BITS)
    for batch in rows:
        at = (batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        for b in np.unique(at >> size).tolist():
            block = blocks.setdefault(b, np.zeros(1 << size, dtype=bool))
            block[at[at >> size == b] & ((1 << size) - 1)] = True
    for b, block in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())], names=["block", "data"])


def repeated_minimisers(rows: DataFrame, shape: Shape, across: bool) -> Bitmap:
    """across: only minimisers of more than one document count."""
    counts = rows.mapInArrow(lambda it: _minimisers(it, shape), _KEYS_DDL).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    return bitmap_of(counts.filter("low != high" if across else "n > 1").select("key"))


def bitmap_of(keys: DataFrame) -> Bitmap:
    """Bitmap of the distinct keys of a column ``key``, of bounded size."""
    repeated = stage(keys, "minimisers")
    bits = min(MAX_BITMAP_BITS, max(16, (16 * repeated.count()).bit_length()))
    size = min(bits, _BLOCK_BITS)
    unsigned = F.shiftrightunsigned("key", 64 - bits)
    n = min(partitions(keys.sparkSession), 1 << (bits - size))
    blocks = repeated.withColumn("block", F.shiftright(unsigned, size)).repartition(n, "block").select("key").mapInArrow(lambda it: _blocks(it, bits), "block long, data binary")
    data = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for block, part in blocks.toLocalIterator():  # the bitmap's own bounded size
        at = block << (size - 3)
        data[at : at + len(part)] = np.frombuffer(part, dtype=np.uint8)
    unstage(repeated)
    return Bitmap(bits, data)


_EMIT = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("owner", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("times", pa.int64()), ("starts", pa.list_(pa.int32())), ("packed", pa.binary()), ("spot", pa.int32())])
_EMIT_DDL = "key long, sid long, owner long, row long, n int, times long, starts array<int>, packed binary, spot int"


def _emit(rows: Iterator[pa.RecordBatch], shape: Shape, bitmap: Bitmap) -> Iterator[pa.RecordBatch]:
    """Places of the super-k-mers that pass (packed null), and each packed string once per hold."""
    strings: dict[tuple[int, int], list] = {}
    size = 0
    out: list[tuple] = []

    def flush_out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _EMIT, strict=True)], schema=_EMIT)
        out.clear()
        return batch

    def flush_strings():
        items = list(strings.items())
        strings.clear()
        for at in range(0, len(items), 4096):
            out.extend((key, sid, owner, None, n, times, None, packed, spot) for (key, sid), (owner, n, times, packed, spot) in items[at : at + 4096])
            yield flush_out()

    for batch in rows:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for first, _, data, offsets in bk.slices(batch, "text"):
            values, bounds, units = shape.units(data, offsets)
            found = cut(values, bounds, shape)
            pick = np.flatnonzero(bitmap.has(found.key))
            if not len(pick):
                continue
            start, count, text = found.start[pick], found.count[pick], found.text[pick]
            last = start + count + shape.width - 2
            low = units.starts[start] if units else start
            high = units.ends[last] if units else last + 1
            raw = data.tobytes()
            per_text: dict[tuple[int, int, int], list[int]] = {}
            for t, key, s, n, a, b, spot in zip(text.tolist(), found.key[pick].view(np.int64).tolist(), (start - bounds[text]).tolist(), count.tolist(), low.tolist(), high.tolist(), found.spot[pick].tolist(), strict=True):
                packed = raw[a:b]
                if units:
                    packed = b" ".join(packed.split())
                sid = xxhash.xxh3_64_intdigest(packed) - (1 << 63)
                owner = ids[first + t]
                known = strings.get((key, sid))
                if known is None:
                    strings[key, sid] = [owner, n, 1, packed, spot]
                    size += len(packed) + 100
                else:
                    known[2] += 1
                    if owner is not None and (known[0] is None or owner < known[0]):
                        known[0] = owner
                places = per_text.get((t, key, sid))
                if places is None:
                    per_text[t, key, sid] = places = [n]
                places.append(s)
            for (t, key, sid), places in per_text.items():
                out.append((key, sid, ids[first + t], keys[first + t], places[0], len(places) - 1, places[1:], None, None))
                if len(out) >= 4096:
                    yield flush_out()
            if out:
                yield flush_out()
            if size > HELD_BYTES:
                yield from flush_strings()
                size = 0
    yield from flush_strings()


_RUNS_DDL = "key long, sid long, offset int, length int, least long, times long"


def _windows(rows: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Digest of each window of each string."""
    for batch in rows:
        for key, sid, owner, n, times, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "sid", "owner", "n", "times", "packed")), strict=True):
            if shape.words:
                gaps = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20)
                begins, ends = np.append(0, gaps + 1).tolist(), np.append(gaps, len(packed)).tolist()
            else:
                begins, ends = range(len(packed)), range(1, len(packed) + 1)
            digests = b"".join(xxhash.xxh3_128_digest(packed[begins[i] : ends[i + shape.width - 1]]) for i in range(n))
            halves = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            same = lambda v, kind: pa.array([v] * n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), same(key, pa.int64()), same(sid, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), same(owner, pa.int64()), same(times, pa.int64())], names=["a", "b", "key", "sid", "offset", "owner", "times"])


def _as_runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def runs():
        for batch in rows:
            for key, sid, times, cells in zip(*(batch.column(c).to_pylist() for c in ("key", "sid", "times", "cells")), strict=True):
                start, length, least = None, 0, None
                for cell in cells:
                    if start is not None and cell["offset"] == start + length and cell["least"] == least:
                        length += 1
                        continue
                    if start is not None:
                        yield key, sid, start, length, least, times
                    start, length, least = cell["offset"], 1, cell["least"]
                yield key, sid, start, length, least, times

    return runs_batches(runs())


def _hot_runs(strings: DataFrame, shape: Shape) -> DataFrame:
    """Runs of repeated windows of the strings of hot minimisers: no task gets a minimiser's strings together."""
    windows = strings.repartition(partitions(strings.sparkSession)).mapInArrow(lambda it: _windows(it, shape), "a long, b long, key long, sid long, offset int, owner long, times long")
    repeated = windows.groupBy("a", "b").agg(F.min("owner").alias("least"), F.sum("times").alias("n")).filter("n > 1").drop("n")
    cells = windows.select("a", "b", "key", "sid", "offset", "times").join(repeated, ["a", "b"])
    lists = cells.groupBy("key", "sid").agg(F.greatest(F.lit(1), F.sum(F.when(F.col("offset") == 0, F.col("times")).otherwise(0))).alias("times"), F.array_sort(F.collect_set(F.struct("offset", "least"))).alias("cells"))
    return lists.mapInArrow(_as_runs, _RUNS_DDL)


def _salted(places: DataFrame, runs: DataFrame) -> DataFrame:
    """Places joined with the runs of their string; a string of very many places is dealt to several tasks by text."""
    total, most = runs.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
    limit = max(HOT_PLACES, total // MAX_SALTED)
    if most <= limit:
        return places.join(runs.drop("times"), ["key", "sid"])
    hot = runs.filter(F.col("times") > limit).groupBy("key", "sid").agg(F.ceil(F.max("times") / limit).cast("int").alias("salts"))
    # at most MAX_SALTED strings, by the limit
    salts = F.coalesce("salts", F.lit(1))
    dealt = places.join(F.broadcast(hot), ["key", "sid"], "left").withColumn("salt", F.pmod(F.col("row"), salts).cast("int")).drop("salts")
    copied = runs.drop("times").join(F.broadcast(hot), ["key", "sid"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copied, ["key", "sid", "salt"]).drop("salt")


def _who(column: str):
    """With ``row``, a 64-bit hash of id and text, the id itself tells texts apart; null as the least long."""
    return F.coalesce(F.col(column), F.lit(-(1 << 63)))


def gather(rows: DataFrame, shape: Shape, across: bool, bucket: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], hot_strings: int | None = None) -> DataFrame:
    """row, who and their list of (starts, offset, length): windows that ``bucket`` finds repeated.

    ``bucket`` turns a partition of packed strings, sorted by key and string,
    into runs of windows (``_RUNS_DDL``) with the least owner of each.
    """
    spark = rows.sparkSession
    bitmap = spark.sparkContext.broadcast(repeated_minimisers(rows, shape, across))
    emitted = stage(rows.mapInArrow(lambda it: _emit(it, shape, bitmap.value), _EMIT_DDL), "superkmers")
    strings = emitted.filter("packed is not null").select("key", "sid", "owner", "n", "times", "packed", "spot")
    limit = HOT_STRINGS if hot_strings is None else hot_strings
    hot = stage(strings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("key"), "hot")
    n_hot = hot.count()
    keys = F.broadcast(hot) if n_hot <= MAX_HOT_BROADCAST else hot
    cold = strings.join(keys, "key", "left_anti") if n_hot else strings
    dealt = cold.repartition(partitions(spark), "key").sortWithinPartitions("key", "sid")
    runs = dealt.mapInArrow(bucket, _RUNS_DDL)
    if n_hot:
        runs = runs.union(_hot_runs(strings.join(keys, "key", "left_semi"), shape))
    places = emitted.filter("packed is null").select("key", "sid", "owner", "row", "starts")
    hits = _salted(places, stage(runs, "runs"))
    if across:
        hits = hits.filter("owner > least")
    # rows that repeat id and text bring the same places: a set holds them once, and is combined before it moves
    return hits.withColumn("who", _who("owner")).groupBy("row", "who").agg(F.collect_set(F.struct("starts", "offset", "length")).alias("runs"))


def covered(runs: list[dict] | None, size: int, width: int) -> np.ndarray:
    """Which units of a text the windows of the runs cover."""
    if not runs:
        return np.zeros(size, dtype=bool)
    each = [np.asarray(r["starts"], dtype=np.int64) + r["offset"] for r in runs]
    start = np.concatenate(each)
    length = np.repeat([r["length"] for r in runs], [len(x) for x in each])
    return bk.ranges_to_mask(start, start + length + width - 1, size)


def apply(docs: DataFrame, shape: Shape, across: bool, bucket: Callable, finish: Callable, ddl: str, hot_strings: int | None = None) -> DataFrame:
    """Join each text with its runs and let ``finish`` write the result."""
    session(docs)
    rows = id_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    found = gather(rows, shape, across, bucket, hot_strings)
    # the runs are the smaller side: hashing them spares a sort of the texts
    joined = rows.withColumn("who", _who("doc_id")).join(found.hint("shuffle_hash"), ["row", "who"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(finish, ddl)


def groups(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list]]]:
    """Strings of each key of a partition sorted by key: sid to [least owner, windows, times, packed, minimiser's place]."""
    current, held = None, {}
    for batch in rows:
        for key, sid, owner, n, times, packed, spot in zip(*(batch.column(c).to_pylist() for c in ("key", "sid", "owner", "n", "times", "packed", "spot")), strict=True):
            if key != current:
                if held:
                    yield current, held
                current, held = key, {}
            known = held.get(sid)
            if known is None:
                held[sid] = [owner, n, times, packed, spot]
            else:
                known[2] += times
                if owner is not None and (known[0] is None or owner < known[0]):
                    known[0] = owner
    if held:
        yield current, held


def runs_batches(rows: Iterator[tuple[int, int, int, int, int | None, int]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("offset", pa.int32()), ("length", pa.int32()), ("least", pa.int64()), ("times", pa.int64())])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
