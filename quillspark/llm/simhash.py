"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint maps to a point: the number of set bits in each of 32 segments of
two bits.  The Manhattan distance of two points is at most the Hamming distance
of their fingerprints.  The points are laid on a grid of four blocks of eight
segments; points within distance 2 agree in at least two whole blocks, so each
point visits the six cells that name two blocks, and no pair is missed.  In a
cell, points are compared by Manhattan distance first and survivors verified on
their bits.  A crowded cell is a smaller grid of the same kind: the segments in
which its points differ make four blocks again, and so on until few points are
left in a cell; where fewer than four segments differ, single bits are the
segments.  A cell returns a spanning forest, never all pairs, and cells whose
points are connected already are not opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.common import drop_rows, id_text, partitions, session, stage, unstage

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Cells with more distinct fingerprints than this are divided again.
CROWDED = 64

_BITS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])


def fingerprints_of(units: bk.Units, width: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text of the slice, as signed integers."""
    counts = units.counts()
    n = len(units)
    out = np.zeros(len(counts), dtype=np.int64)
    if not n:
        return out
    raw = units.data.tobytes()
    starts, ends = units.starts.tolist(), units.ends.tolist()
    joined = b" ".join([raw[s:e] for s, e in zip(starts, ends, strict=True)])
    sizes = units.ends - units.starts
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    bounds = units.bounds
    first, last, owner = [], [], []
    whole = np.arange(n)
    of = np.searchsorted(bounds, whole, side="right") - 1
    fits = whole + width <= bounds[1:][of]
    head = whole[fits]
    short = np.flatnonzero((counts > 0) & (counts < width))
    first = np.concatenate([begin[head], begin[bounds[short]]])
    tail = np.concatenate([head + width - 1, bounds[short + 1] - 1])
    last = begin[tail] + sizes[tail]
    owner = np.concatenate([of[head], short])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first.tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=len(first))
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], hashes[order]
    texts, at, each = np.unique(owner, return_index=True, return_counts=True)
    votes = np.zeros((len(texts), 64), dtype=np.int64)
    # bits in blocks of rows, so that memory stays small
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low : low + (1 << 16)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        inside = np.searchsorted(at, low, side="right") - 1
        cuts = np.concatenate([[0], at[(at > low) & (at < low + len(part))] - low])
        votes[inside : inside + len(cuts)] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    major = (2 * votes > each[:, None]).astype(np.uint8)
    out[texts] = np.packbits(major, axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)
    return out


def _fingerprints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = []
        for _, _, data, offsets in bk.slices(batch, "text"):
            found.append(fingerprints_of(bk.Units(data, offsets, bk.SPACE, bk.LOWER)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], schema=_BITS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and 64-bit fingerprint (signed) of every whole text; no words: 0."""
    session(docs)
    return id_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The embedding: set bits in each two-bit segment, as two-bit fields of one word."""
    v = fps.view(np.uint64)
    return v - ((v >> np.uint64(1)) & np.uint64(0x5555555555555555))


def popcount(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embedded points: fields differ by 0, 1 or 2."""
    low, high = np.uint64(0x5555555555555555), np.uint64(0xAAAAAAAAAAAAAAAA)
    # unary code of a field (0: 00, 1: 01, 2: 11): the bits that differ are the distance
    unary = lambda p: (p & low) | ((p & high) >> np.uint64(1)) | (p & high)
    return popcount(unary(a) ^ unary(b))


_BLOCKS = [np.uint64(0xFFFF << (16 * k)) for k in range(4)]
_CELLS = [(_BLOCKS[a] | _BLOCKS[b], k) for k, (a, b) in enumerate(combinations(range(4), 2))]


def _visit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each point once for each of its six cells."""
    for batch in rows:
        fps, rep = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
        points = segment_counts(fps)
        for mask, k in _CELLS:
            cell = bk.mix((points & mask) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fps), pa.array(rep)], names=["cell", "fp", "rep"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def link_cell(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the distinct fingerprints that differ in two bits or fewer."""
    points, bits = segment_counts(fps), fps.view(np.uint64)
    forest, edges = _Forest(len(fps)), []

    def compare(members: np.ndarray) -> None:
        a, b = np.triu_indices(len(members), 1)
        a, b = members[a], members[b]
        near = manhattan(points[a], points[b]) <= DISTANCE
        a, b = a[near], b[near]
        near = popcount(bits[a] ^ bits[b]) <= DISTANCE
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if forest.join(i, j):
                edges.append((i, j))

    def differing(values: np.ndarray, width: int) -> list[int]:
        """Masks of the segments of ``width`` bits that are not the same in all values."""
        mixed = int(np.bitwise_or.reduce(values ^ values[0]))
        every = [((1 << width) - 1) << at for at in range(0, 64, width)]
        return [mask for mask in every if mixed & mask]

    def divide(members: np.ndarray) -> None:
        if len(members) <= CROWDED:
            compare(members)
            return
        root = forest.find(int(members[0]))
        if all(forest.find(i) == root for i in members.tolist()):
            return
        values, segments = points[members], differing(points[members], 2)
        if len(segments) < 4:
            values, segments = bits[members], differing(bits[members], 1)
        blocks = [sum(segments[k::4]) for k in range(4)]
        for a, b in combinations(blocks, 2):
            cell = values & np.uint64(a | b)
            order = np.argsort(cell, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]]))
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                if e - s > 1:
                    divide(members[order[s:e]])

    divide(np.arange(len(fps)))
    return edges


def _link(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (larger id, smaller id) between representatives, from the cells of one partition."""
    held = [b for b in rows if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    cell, fps, rep = (table.column(c).to_numpy() for c in ("cell", "fp", "rep"))
    order = np.argsort(cell, kind="stable")
    cell, fps, rep = cell[order], fps[order], rep[order]
    edge = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1 if cell[0] > np.iinfo(np.int64).min else cell[0] + 1))
    ends = np.append(edge[1:], len(cell))
    pairs = []
    for s, e in zip(edge[ends - edge > 1].tolist(), ends[ends - edge > 1].tolist(), strict=True):
        if e - s == 2:
            if int(fps[s] ^ fps[s + 1]) & 0xFFFFFFFFFFFFFFFF and bin(int(fps[s] ^ fps[s + 1]) & 0xFFFFFFFFFFFFFFFF).count("1") <= DISTANCE:
                pairs.append((s, s + 1))
        else:
            pairs += [(s + i, s + j) for i, j in link_cell(fps[s:e])]
    if pairs:
        at = np.array(pairs)
        a, b = rep[at[:, 0]], rep[at[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def links(points: DataFrame) -> DataFrame:
    """points: distinct fp with rep.  Edges u > v that connect all fingerprints within two bits."""
    n = partitions(points.sparkSession)
    return points.mapInArrow(_visit, "cell long, fp long, rep long").repartition(n, "cell").mapInArrow(_link, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) of every node with an edge.

    Alternates large-star and small-star steps until the edges stay the same:
    each step hangs a node's larger, then its smaller neighbours on the least
    one.  Tables go to the shared folder; only counts and sums reach the driver.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    current = stage(edges, "links")
    before = mark(current)
    while before[0]:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(lower.select("u", F.col("m").alias("v"))).distinct()
        after = stage(small, "links")
        mark_after = mark(after)
        unstage(current)
        current = after
        if mark_after == before:
            break
        before = mark_after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, root (a fingerprint of its component, the same for all of it) and component_id of every row."""
    prints = stage(fingerprints(docs), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp", F.col("fp").alias("rep")))).withColumnRenamed("node", "fp")
    of = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every row.

    Null and wordless texts have fingerprint zero and are linked like any other.
    Rows with equal fingerprints are one class; a null doc_id belongs to its
    class but never names it (component_id is null if no other id does).  An
    empty table gives no rows.
    """
    return _with_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component with all its columns: of least doc_id, without one only where none has any.

    Of rows that repeat that doc_id and its text, one stays.
    """
    key = [F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_key").alias("__text")]
    rows = _with_components(docs).select("root", F.struct(*key).alias("k"))
    keep = rows.groupBy("root").agg(F.min("k").alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n")
    dropped = rows.join(keep, "root").groupBy("k").agg(F.count("*").alias("n"), F.first(F.col("k") == F.col("best")).alias("one"))
    return drop_rows(docs, dropped.filter("not one or n > 1").select("k.*", "one"))
