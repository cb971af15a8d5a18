"""Suffix-array deduplication of byte strings.

Every byte covered by a 200-byte string that also starts anywhere else goes.
Strings travel as super-k-mers to the bucket of their minimiser.  A string that
stands in two places or more is settled.  Strings that may share a window with
another one are laid end to end on disk, all buckets of a partition together,
and external induced suffix sorting with common-prefix values finds the windows
that two of them share.  A window reaches so far to the left of its minimiser
and so far to the right; what no other string of the bucket shares to that
extent is left out beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import bytekit as bk
from quillspark.llm import superkmer as sk
from quillspark.llm.common import batches
from quillspark.llm.suffixsort import BLOCK, HELD, Scratch, repeated_starts

WINDOW, GRAM = 200, 24
SHAPE = sk.Shape(WINDOW, GRAM, words=False)
#: A minimiser with more strings (of some 300 bytes, held by one task) is split by window.
HOT_STRINGS = 10_000
#: Steps in which a window's reach to the left of its minimiser is told.
_STEP = (WINDOW - GRAM) // 4
#: Texts are sorted with symbols 0 (the end), 1 (the end of a string) and bytes from 2 on.
_SYMBOLS = 258
_RECORD = 6

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int64()))])


def _doubtful(strings: dict[int, list]) -> list[tuple[int, int, int]]:
    """(string, first, last window) that another string of the bucket may share.

    A window that reaches from k to k + 1 steps to the left of the minimiser
    holds k steps on its left and the rest of its bytes, less one step, on its
    right: another string must have the same bytes there.
    """
    rest = WINDOW - GRAM
    around: dict[tuple[int, bytes], list[int]] = {}
    for sid, (_, _, _, packed, spot) in strings.items():
        for left in range(0, rest, _STEP):
            end = spot + GRAM + rest - left - _STEP
            if left <= spot and end <= len(packed):
                around.setdefault((left, packed[spot - left : end]), []).append(sid)
    reach: dict[int, list[int]] = {}
    for (left, _), sids in around.items():
        if len(sids) > 1:
            for sid in sids:
                reach.setdefault(sid, []).append(left)
    out = []
    for sid in sorted(reach):
        _, n, _, _, spot = strings[sid]
        out.append((sid, max(0, spot - max(reach[sid]) - _STEP), min(n - 1, spot - min(reach[sid]))))
    return out


def _bucket(rows: Iterator[pa.RecordBatch], block: int = BLOCK, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows; the partition's doubtful strings are one text on disk."""

    def runs():
        with Scratch() as scratch:
            path, records, size = scratch.path(), scratch.path(), 0
            with open(path, "wb") as text, open(records, "wb") as kept:
                for key, strings in sk.groups(rows):
                    for sid, (_, n, times, *_) in strings.items():
                        if times > 1:
                            yield key, sid, 0, n, None, times
                    if all(s[2] > 1 for s in strings.values()):
                        continue
                    for sid, first, last in _doubtful(strings):
                        _, _, times, packed, _ = strings[sid]
                        part = np.frombuffer(packed, np.uint8)[first : last + WINDOW]
                        text.write(np.append(part.astype(np.uint16) + 2, np.uint16(1)).tobytes())
                        kept.write(np.array([key, sid, first, last - first + 1, times, size], dtype=np.int64).tobytes())
                        size += len(part) + 1
                text.write(b"\0\0")
            if not size:
                return
            repeated = repeated_starts(scratch.array(size + 1, np.uint16, path), _SYMBOLS, WINDOW, scratch, block, held)
            with open(records, "rb") as kept:
                while part := kept.read(8 * _RECORD * 4096):
                    for key, sid, first, n, times, start in np.frombuffer(part, np.int64).reshape(-1, _RECORD).tolist():
                        if times > 1:
                            continue
                        for s, e in zip(*(x.tolist() for x in bk.mask_to_runs(repeated[start : start + n])), strict=True):
                            yield key, sid, first + s, e - s, None, times

    return sk.runs_batches(runs())


def _finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids, runs = batch.column("doc_id").to_pylist(), batch.column("runs")
        for first, end, data, offsets in bk.slices(batch, "text"):
            out = []
            for i in range(end - first):
                text = data[offsets[i] : offsets[i + 1]]
                removed = sk.covered(runs[first + i].as_py(), len(text), WINDOW)
                starts, ends = bk.mask_to_runs(removed)
                kept = text[~removed].tobytes() if len(starts) else text.tobytes()
                out.append((ids[first + i], len(text), int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), np.stack([starts, ends], 1).reshape(-1).tolist()))
            yield from batches(out, _SCHEMA)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every text.

    Null counts as empty.  Repeated rows repeat each other's strings, whatever
    their doc_ids, null ones too.  An empty table gives no rows.
    """
    return sk.apply(docs, SHAPE, False, _bucket, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>", HOT_STRINGS)
