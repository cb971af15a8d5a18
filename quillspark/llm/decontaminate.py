"""Benchmark decontamination by winnowed fingerprints.

Of each six consecutive 5-grams (ten words) the least hash is a fingerprint,
the leftmost of equal ones.  Any span of ten words that a document and an item
share therefore has a fingerprint in common, at the same place within the span.
Fingerprints that meet are seeds: the words around them are compared one by
one, and every maximal run of ten or more equal words is hit.  Items of fewer
than ten words are looked up whole, by their own length.

A small benchmark goes to the executors as one index.  Beyond
``broadcast_bytes`` a bitmap of bounded size holds the items' fingerprints; the
windows of a document around a fingerprint that passes are joined, by hash and
words, with the windows of the items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.common import batches, drop_rows, id_text, row_key, session, stage
from quillspark.llm.superkmer import Bitmap, bitmap_of

WINDOW, GRAM = 10, 5
#: Largest benchmark text, in bytes, that is sent to every executor.
BROADCAST_BYTES = 16 << 20

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_spans", pa.list_(pa.int64()))])
_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<long>"


def _fingerprints(word_hashes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints among the 5-grams of one run of words; sorted, each once."""
    spots = bk.leftmost_minima(bk.grams(bk.prefix(word_hashes), GRAM), WINDOW - GRAM + 1)
    return spots[np.flatnonzero(np.diff(spots, prepend=-1))] if len(spots) else spots


def _cut(text: str) -> tuple[list[bytes], np.ndarray]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    units = bk.Units(data, np.array([0, len(data)]), bk.ALNUM_RAW, bk.LOWER)
    raw = units.data.tobytes()
    return [raw[s:e] for s, e in zip(units.starts.tolist(), units.ends.tolist(), strict=True)], units.hashes()


class ItemIndex:
    """Fingerprints of the items, and whole items of fewer than ten words by length."""

    def __init__(self, items: list[tuple[object, str | None]]):
        by_words: dict[tuple[bytes, ...], set] = {}
        hashes: dict[tuple[bytes, ...], np.ndarray] = {}
        for item_id, text in items:
            words, hashed = _cut(text or "")
            if words:
                by_words.setdefault(tuple(words), set()).add(item_id)
                hashes[tuple(words)] = hashed
        self.words, self.ids = list(by_words), [sorted(str(x) for x in ids if x is not None) for ids in by_words.values()]
        seeds, short = [], {}
        for k, words in enumerate(self.words):
            pre = bk.prefix(hashes[words])
            if len(words) < WINDOW:
                short.setdefault(len(words), []).append((int(bk.grams(pre, len(words))[0]), k))
            else:
                spots = _fingerprints(hashes[words])
                seeds += [(h, k, p) for h, p in zip(bk.grams(pre, GRAM)[spots].tolist(), spots.tolist(), strict=True)]
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        for h, k, p in seeds:
            self.seeds.setdefault(h, []).append((k, p))
        self.sorted = np.array(sorted(self.seeds), dtype=np.uint64)
        self.short: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for length, found in short.items():
            of: dict[int, list[int]] = {}
            for h, k in found:
                of.setdefault(h, []).append(k)
            self.short[length] = np.array(sorted(of), dtype=np.uint64), of


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Scan:
    """Hits of a slice of documents against an index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.units = bk.Units(data, offsets, bk.ALNUM_RAW, bk.LOWER)
        self.pre = bk.prefix(self.units.hashes())
        self.grams = bk.grams(self.pre, GRAM)
        self.doc_end = self.units.bounds[1:]
        spots = bk.leftmost_minima(self.grams, WINDOW - GRAM + 1)
        # a window that leaves its document counts for none
        whole = self._whole(len(spots), WINDOW)
        self.spots = np.unique(spots[whole])
        self.raw = self.units.data.tobytes()

    def _whole(self, n: int, width: int) -> np.ndarray:
        starts = np.arange(n)
        return starts + width <= self.doc_end[np.searchsorted(self.doc_end, starts, side="right")] if n else np.zeros(0, bool)

    def word(self, i: int) -> bytes:
        return self.raw[self.units.starts[i] : self.units.ends[i]]

    def hits(self, index: ItemIndex) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """For each document with a hit: spans of words (from the slice's first), and the items."""
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        bounds = self.units.bounds
        spots = self.spots
        reached: dict[tuple[int, int], int] = {}
        for p in spots[_member(self.grams[spots], index.sorted)].tolist():
            d = int(np.searchsorted(bounds, p, side="right")) - 1
            first, end = int(bounds[d]), int(bounds[d + 1])
            for k, q in index.seeds[int(self.grams[p])]:
                if reached.get((k, p - q), -1) > p:
                    continue
                words = index.words[k]
                left, right = 0, 0
                while p - left > first and q - left > 0 and self.word(p - left - 1) == words[q - left - 1]:
                    left += 1
                while p + right < end and q + right < len(words) and self.word(p + right) == words[q + right]:
                    right += 1
                if right >= GRAM:
                    reached[k, p - q] = p + right
                    if left + right >= WINDOW:
                        spans, items = found.setdefault(d, ([], set()))
                        spans.append((p - left, p + right))
                        items.add(k)
        for length, (table, of) in index.short.items():
            hashes = bk.grams(self.pre, length)
            for p in np.flatnonzero(_member(hashes, table) & self._whole(len(hashes), length)).tolist():
                for k in of[int(hashes[p])]:
                    if all(self.word(p + j) == w for j, w in enumerate(index.words[k])):
                        spans, items = found.setdefault(int(np.searchsorted(bounds, p, side="right")) - 1, ([], set()))
                        spans.append((p, p + length))
                        items.add(k)
        return found


def _row(doc_id, n_words: int, base: int, hit, index: ItemIndex | None) -> tuple:
    if not hit:
        return doc_id, n_words, 0, 0, hashlib.sha256(b"").hexdigest(), False, []
    spans, items = hit
    starts, ends = bk.mask_to_runs(bk.ranges_to_mask(np.array([s - base for s, _ in spans]), np.array([e - base for _, e in spans]), n_words))
    ids = sorted({x for k in items for x in index.ids[k]})
    return doc_id, n_words, int((ends - starts).sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), True, np.stack([starts, ends], 1).reshape(-1).tolist()


def _scan_all(rows: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids, out = batch.column("doc_id").to_pylist(), []
        for first, end, data, offsets in bk.slices(batch, "text"):
            scan = Scan(data, offsets)
            found, counts = scan.hits(index), scan.units.counts().tolist()
            out += [_row(ids[first + i], counts[i], int(scan.units.bounds[i]), found.get(i), index) for i in range(end - first)]
        yield from batches(out, _SCHEMA)


_ITEM_DDL = "key long, finger long, packed binary, item_id string"
_DOC_DDL = "__none boolean, __id long, __text long, pos long, size int, key long, packed binary"


def _finger(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bitmap key of a fingerprint (size 0) or of a whole item of fewer than ten words."""
    return bk.mix(hashes + np.uint64(size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _packed(scan: Scan, start: int, size: int) -> bytes:
    return b" ".join(scan.word(i) for i in range(start, start + size))


def _emitted(columns: list[list], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _item_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of every item, and its fingerprint's bitmap key."""
    for batch in rows:
        ids = batch.column("item_id").to_pylist()
        for first, end, data, offsets in bk.slices(batch, "text"):
            scan, out = Scan(data, offsets), []
            least = bk.leftmost_minima(scan.grams, WINDOW - GRAM + 1)
            for i in range(end - first):
                lo, hi = int(scan.units.bounds[i]), int(scan.units.bounds[i + 1])
                size = min(WINDOW, hi - lo)
                if not size:
                    continue
                hashes = bk.span(scan.pre, np.arange(lo, hi - size + 1), np.arange(lo + size, hi + 1))
                fingers = _finger(scan.grams[least[lo : hi - size + 1]], 0) if size == WINDOW else _finger(hashes, size)
                out += [(k, f, _packed(scan, lo + j, size), ids[first + i]) for j, (k, f) in enumerate(zip(hashes.view(np.int64).tolist(), fingers.view(np.int64).tolist(), strict=True))]
            for at in range(0, len(out), 4096):
                yield _emitted(list(zip(*out[at : at + 4096], strict=True)), _ITEM_DDL)


def _doc_windows(rows: Iterator[pa.RecordBatch], bitmap: Bitmap, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Windows of the documents whose fingerprint is an item's, by the bitmap."""
    for batch in rows:
        keys = [batch.column(c).to_pylist() for c in ("__none", "__id", "__text")]
        for first, _, data, offsets in bk.slices(batch, "text"):
            scan, out = Scan(data, offsets), []
            least = bk.leftmost_minima(scan.grams, WINDOW - GRAM + 1)
            for size in [WINDOW, *sizes]:
                starts = np.arange(max(0, len(scan.pre) - size))
                hashes = bk.span(scan.pre, starts, starts + size)
                fine = scan._whole(len(hashes), size)
                fine &= bitmap.has(_finger(scan.grams[least[: len(hashes)]], 0) if size == WINDOW else _finger(hashes, size))
                at = np.flatnonzero(fine)
                of = first + np.searchsorted(scan.doc_end, at, side="right")
                base = scan.units.bounds[of - first]
                for d, p, b, k in zip(of.tolist(), at.tolist(), base.tolist(), hashes[at].view(np.int64).tolist(), strict=True):
                    out.append((keys[0][d], keys[1][d], keys[2][d], p - b, size, k, _packed(scan, p, size)))
                    if len(out) == 4096:
                        yield _emitted(list(zip(*out, strict=True)), _DOC_DDL)
                        out = []
            if out:
                yield _emitted(list(zip(*out, strict=True)), _DOC_DDL)


def _sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for _, _, data, offsets in bk.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(bk.Units(data, offsets, bk.ALNUM_RAW, bk.LOWER).counts().astype(np.int64))], names=["n_words"])


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [bk.Units(data, offsets, bk.ALNUM_RAW, bk.LOWER).counts() for _, _, data, offsets in bk.slices(batch, "text")]
        counts = pa.array(np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "__none", "__id", "__text")), counts], names=["doc_id", "__none", "__id", "__text", "n_words"])


def _written(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for doc_id, n_words, spans, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "spans", "ids")), strict=True):
            at = np.array([[s["pos"], s["pos"] + s["size"]] for s in spans or []], dtype=np.int64).reshape(-1, 2)
            starts, ends = bk.mask_to_runs(bk.ranges_to_mask(at[:, 0], at[:, 1], n_words))
            listed = sorted(ids or [])
            out.append((doc_id, n_words, int((ends - starts).sum()), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(len(starts)), np.stack([starts, ends], 1).reshape(-1).tolist()))
        yield from batches(out, _SCHEMA)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _index(items: DataFrame, broadcast_bytes: int):
    """The items as a broadcast index, or None if they are too large for one."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    return items.sparkSession.sparkContext.broadcast(ItemIndex([tuple(x) for x in items.collect()])) if size <= broadcast_bytes else None


def _joined_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hit windows of the documents: __none, __id, __text, pos, size, item_id."""
    spark = docs.sparkSession
    windows = stage(items.mapInArrow(_item_windows, _ITEM_DDL).distinct(), "windows")
    bitmap = spark.sparkContext.broadcast(bitmap_of(windows.select(F.col("finger").alias("key")).distinct()))
    # at most nine rows
    sizes = sorted(r[0] for r in items.mapInArrow(_sizes, "n_words long").filter(F.col("n_words").between(1, WINDOW - 1)).distinct().collect())
    keyed = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    mine = keyed.mapInArrow(lambda it: _doc_windows(it, bitmap.value, sizes), _DOC_DDL)
    return mine.join(windows.drop("finger"), ["key", "packed"]).drop("key", "packed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: words, hit words, items that occur, and the hit spans of words.

    Null texts have no words.  Items without words never occur.  Repeated items
    count once by item_id; an item whose id is null hits but is not listed.  An
    empty benchmark hits nothing; an empty table gives no rows.
    """
    session(docs)
    items = _items(benchmark)
    index = _index(items, broadcast_bytes)
    if index is not None:
        return id_text(docs).mapInArrow(lambda it: _scan_all(it, index.value), _DDL)
    key = ["__none", "__id", "__text"]
    hits = stage(_joined_hits(docs, items), "hits")
    spans = hits.select(*key, "pos", "size").distinct().groupBy(*key).agg(F.collect_list(F.struct("pos", "size")).alias("spans"))
    # as many ids as the result names
    listed = hits.select(*key, "item_id").distinct().groupBy(*key).agg(F.collect_list("item_id").alias("ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counted, "doc_id long, __none boolean, __id long, __text long, n_words long")
    return counted.join(spans, key, "left").join(listed, key, "left").mapInArrow(_written, _DDL)


def _keep_clean(rows: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        clean = np.ones(batch.num_rows, dtype=bool)
        for first, _, data, offsets in bk.slices(batch, "text"):
            for d in Scan(data, offsets).hits(index):
                clean[first + d] = False
        yield batch.filter(pa.array(clean))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without a hit, with all their columns; every row is decided by its own text."""
    session(docs)
    items = _items(benchmark)
    index = _index(items, broadcast_bytes)
    if index is not None:
        return docs.mapInArrow(lambda it: _keep_clean(it, index.value), docs.schema)
    return drop_rows(docs, _joined_hits(docs, items).select("__none", "__id", "__text").distinct().withColumn("one", F.lit(False)))
