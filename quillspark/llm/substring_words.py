"""Substring deduplication by super-k-mers of words.

A window of fifty words is removed where the same words also start in a
document with a smaller doc_id.  In a bucket, strings that are alone with their
minimiser are settled by their least document; otherwise the windows of the
bucket's strings are sorted and equal neighbours give each its least document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quillspark.llm import bytekit as bk
from quillspark.llm import superkmer as sk
from quillspark.llm.common import batches

WINDOW, GRAM = 50, 10
SHAPE = sk.Shape(WINDOW, GRAM, words=True)
#: Windows that are sorted at once; a larger group takes several turns, by hash of the window.
SORTED_AT_ONCE = 100_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def least_owners(strings: dict[int, list], width: int = WINDOW) -> dict[int, list[int | None]]:
    """Least owner of each window of each string, by sorting the windows."""
    out = {sid: [None] * n for sid, (_, n, *_) in strings.items()}
    turns = -(-sum(len(x) for x in out.values()) // SORTED_AT_ONCE)
    for turn in range(turns):
        windows = []
        for sid, (owner, n, _, packed, _) in strings.items():
            ends = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20).tolist()
            begins, ends = [0, *[e + 1 for e in ends]], [*ends, len(packed)]
            for i in range(n):
                window = packed[begins[i] : ends[i + width - 1]]
                if turns == 1 or xxhash.xxh3_64_intdigest(window) % turns == turn:
                    windows.append((window, float("inf") if owner is None else owner, sid, i))
        windows.sort(key=lambda w: (w[0], w[1]))
        least, last = None, None
        for window, owner, sid, i in windows:
            if window != last:
                last, least = window, owner
            out[sid][i] = None if least == float("inf") else least
    return out


def _bucket(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def runs():
        for key, strings in sk.groups(rows):
            if len(strings) == 1:
                ((sid, (owner, n, times, *_)),) = strings.items()
                if times > 1:
                    yield key, sid, 0, n, owner, times
                continue
            for sid, least in least_owners(strings).items():
                owner, n, times, *_ = strings[sid]
                at = 0
                for i in range(1, n + 1):
                    if i == n or least[i] != least[at]:
                        if least[at] is not None and (times > 1 or owner is None or least[at] < owner):
                            yield key, sid, at, i - at, least[at], times
                        at = i

    return sk.runs_batches(runs())


def _finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids, runs, out = batch.column("doc_id").to_pylist(), batch.column("runs"), []
        for first, end, data, offsets in bk.slices(batch, "text"):
            raw = data.tobytes()
            for i in range(end - first):
                words = raw[offsets[i] : offsets[i + 1]].split()
                removed = sk.covered(runs[first + i].as_py(), len(words), WINDOW)
                gone = int(removed.sum())
                kept = b" ".join([w for w, r in zip(words, removed.tolist(), strict=True) if not r] if gone else words)
                out.append((ids[first + i], len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield from batches(out, _SCHEMA)
            out = []


def remove_repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words of every text.

    Null has no words.  A row without a doc_id loses nothing and takes nothing
    from others.  Rows that share a doc_id are one document: neither loses to
    the other.  An empty table gives no rows.
    """
    return sk.apply(docs, SHAPE, True, _bucket, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
