"""Cross-tokenizer alignment by bitsets of token ends.

Bit i of a tokenizer's bitset is set where one of its tokens ends at byte i.
The AND of both bitsets has the shared cuts; the population count below a cut
(its rank) is the number of tokens that end there or before, which maps the
bytes between two cuts to a range of tokens of either side: a group.  Tokens of
a group are linked, each of one side with each of the other.

White space that follows something else starts a chunk.  Neither tokenizer has
a token over such a place, so it is a cut of both, and a chunk's groups don't
depend on its neighbours: each worker remembers short chunks that it has aligned.
Texts for which that isn't certain are aligned whole.

How many documents hold a pair of ids linked is counted over the corpus.  The
pairs in most documents, of bounded number, are broadcast to the documents'
links; the links of all others are joined by pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import id_text, session, stage, unstage
from quillspark.llm.tokens import _byte_letters, _Memory

#: Pairs that are broadcast (some 40 bytes each).
MAX_BROADCAST_PAIRS = 1 << 18
#: Bytes of a text whose bitsets are single integers.
SHORT = 64

_CHUNK = re.compile(r"[ \n]+[^ \n]*")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side up to each shared cut, by packed bitsets; ends are byte offsets, ascending."""
    size = (int(a_ends[-1]) >> 6) + 1
    sets = np.zeros((2, size * 64), dtype=bool)
    sets[0, a_ends], sets[1, b_ends] = True, True
    a, b = np.packbits(sets, axis=1, bitorder="little").view(np.uint64)
    shared = a & b
    cuts = np.flatnonzero(np.unpackbits(shared.view(np.uint8), bitorder="little"))  # select
    word, upto = cuts >> 6, ~np.uint64(0) >> (63 - (cuts & 63)).astype(np.uint64)

    def rank(bits: np.ndarray) -> np.ndarray:
        before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
        return before[word] + np.bitwise_count(bits[word] & upto)

    return rank(a), rank(b)


def integer_groups(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """The same for a chunk, whose bitset is one integer."""
    a = b = 0
    for end in a_ends:
        a |= 1 << end
    for end in b_ends:
        b |= 1 << end
    shared, a_ranks, b_ranks = a & b, [], []
    while shared:
        low = shared & -shared
        upto = (low << 1) - 1
        a_ranks.append((a & upto).bit_count())
        b_ranks.append((b & upto).bit_count())
        shared ^= low
    return a_ranks, b_ranks


class Aligner:
    """Both tokenizers, their tokens' bytes and what is known of chunks."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path or _vocabulary("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path or _vocabulary("piece_bpe_32k.model"))
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        self.a_bytes: list[bytes] = [b""] * (1 + max(self.a.get_vocab().values()))
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        is_byte = re.compile(r"<0x([0-9A-F]{2})>\Z")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := is_byte.match(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.blank = pieces.index("▁") if "▁" in pieces else None
        self.a_names, self.b_names = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        before = json.loads(self.a.to_str())
        plain = before["normalizer"] is None and before["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self.blank is not None
        self.chunked = plain and apart
        self.known = _Memory(self._chunk)

    def _aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple | None:
        """n_a, n_b, n_groups, n_links, groups, a ids and b ids of the links; None where a side's bytes differ."""
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw or not raw:
            return None
        if len(a) == 1 or len(b) == 1:  # no cut but the end
            a_ranks, b_ranks = [len(a)], [len(b)]
        elif len(raw) <= SHORT:
            a_ends, b_ends, at = [], [], 0
            for t in a_bytes:
                a_ends.append(at := at + len(t))
            at = 0
            for t in b_bytes:
                b_ends.append(at := at + len(t))
            a_ranks, b_ranks = integer_groups(a_ends, b_ends)
        else:
            a_ranks, b_ranks = (r.tolist() for r in packed_groups(np.cumsum([len(t) for t in a_bytes]), np.cumsum([len(t) for t in b_bytes])))
        groups, links, i, j = [], array("q"), 0, 0
        for a_to, b_to in zip(a_ranks, b_ranks, strict=True):
            ours, theirs = a[i:a_to], b[j:b_to]
            groups.append(f"{','.join([self.a_names[x] for x in ours])}|{','.join([self.b_names[x] for x in theirs])}")
            for x in ours:
                links.extend([x << 32 | y for y in theirs])
            i, j = a_to, b_to
        return len(a), len(b), len(groups), len(links), ";".join(groups), links.tobytes()

    def _chunk(self, chunk: str) -> tuple | None:
        a = self.a.encode(chunk, add_special_tokens=False).ids
        if chunk[0] == " ":  # which the tokenizer adds
            b = self.b.encode(chunk[1:]) or [self.blank]
        else:
            b = self.b.encode(chunk)
            if b[:1] != [self.blank]:
                return None
            b = b[1:]
        return self._aligned(chunk.encode(), a, b)

    def whole(self, text: str) -> tuple | None:
        spaced = " " + text
        return self._aligned(spaced.encode(), self.a.encode(spaced, add_special_tokens=False).ids, self.b.encode(text))

    def align(self, text: str) -> list[tuple]:
        """What ``_aligned`` returns of each part of the text; no part where the text has no tokens."""
        if not text:
            return []
        if self.chunked and not _OTHER_SPACE.search(text):
            parts = [self.known[chunk] if len(chunk) <= SHORT else self._chunk(chunk) for chunk in _CHUNK.findall(" " + text)]
            if None not in parts:
                return parts
        part = self.whole(text)
        return [part] if part else []


@lru_cache(maxsize=1)
def _aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """One a worker process: its next tasks go on with what it knows."""
    return Aligner(a_path, b_path)


_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("groups", pa.string()), *[(c, pa.list_(pa.int32())) for c in ("a", "b", "times")]])
_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, a array<int>, b array<int>, times array<int>"


def _align(rows: Iterator[pa.RecordBatch], a_path: str | None, b_path: str | None, with_groups: bool) -> Iterator[pa.RecordBatch]:
    aligner, out, size = _aligner(a_path, b_path), [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    for batch in rows:
        for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            parts = aligner.align(text.as_py() or "")
            if not parts:
                out.append((row, doc_id, 0, 0, 0, 0, "", "" if with_groups else None, [], [], []))
                continue
            n_a, n_b, n_groups, n_links, groups, links = zip(*parts, strict=True)
            groups = ";".join(groups)
            pairs, times = np.unique(np.frombuffer(b"".join(links), dtype=np.int64), return_counts=True)
            out.append((row, doc_id, sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(groups.encode()).hexdigest(), groups if with_groups else None, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)))
            size += 12 * len(pairs) + len(groups)
            if size > 4 << 20 or len(out) >= 1000:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked) and best: no pair of the same a has a larger n."""
    counts = linked.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    # a group is one id's partners: at most the other vocabulary
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def _link_sums(linked: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """row, n_best and count_sum over the links of each document."""
    links = linked.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    least = 1
    if counts.count() > limit:
        # the least power of two that at most ``limit`` pairs reach
        steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()  # 63 rows at most
        total, least = 0, 1 << (steps[0].step + 1)
        for step, n in steps:
            total += n
            if total > limit:
                break
            least = 1 << step
    heavy = F.broadcast(counts.filter(F.col("n") >= least))
    found = links.join(heavy, ["a", "b"])
    if least > 1:
        # a pair of these is in fewer than ``least`` documents
        found = found.unionByName(links.join(heavy, ["a", "b"], "left_anti").join(counts.filter(F.col("n") < least), ["a", "b"]))
    return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = True, max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups of every text.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by
    byte, have no tokens: zeros and ''.  Every row is a document of its own,
    repeated ones too.  An empty table gives no rows.
    """
    session(docs)
    # the numbers are fixed once the table is written
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    linked = stage(rows.mapInArrow(lambda it: _align(it, a_path, b_path, with_groups), _DDL), "linked")
    counts = stage(pair_counts(linked), "pairs")
    sums = stage(_link_sums(linked, counts, max_broadcast), "sums")
    unstage(counts)
    out = linked.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256", "groups")
    return out if with_groups else out.drop("groups")
