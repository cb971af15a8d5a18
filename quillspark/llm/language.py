"""Language identification with bit-sliced Bloom filters over language bitmasks.

One table of slots holds, in each slot, a bitmask with a bit per language.  An
n-gram sets its languages' bits in its ``HASHES`` slots; the AND of those slots
returns all languages that contain it, in one probe.  A document's evidence for
a language is the number of its n-grams with that bit, less what the filter
would say by chance at that language's measured load; the largest share decides.

N-grams are counted exactly, by 64-bit hashes, and the filter has eight slots
for each, as narrow as the number of languages allows.  The fit is bounded by
the number of labelled documents, of which each language gets an equal share
first; the filter learns every language and n-gram of these.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.common import batches, session, stage, unstage

#: Bytes of an n-gram, and hash functions of the filter.
GRAM, HASHES = 5, 3
#: Largest number of labelled documents that the filter is fitted on, whole texts.
MAX_TRAIN_DOCS = 20_000
#: N-grams that a training task holds before it passes their counts on.
_HELD = 1 << 21
#: An n-gram belongs to a language if its frequency there is at least this share of its largest.
SHARE = 0.25

#: White space and ASCII punctuation and digits become one mark; letters are lower-cased.
_FOLD = bk.LOWER.copy()
for _b in range(128):
    if not 0x61 <= bk.LOWER[_b] <= 0x7A:
        _FOLD[_b] = 0x20

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % 5 == 0


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each place, and whether it stays inside its text and has no run of marks."""
    folded = _FOLD[data]
    if len(data) < GRAM:
        return np.empty(0, np.uint64), np.empty(0, bool)
    hashes = bk.grams(bk.prefix(folded), GRAM)
    fine = np.ones(len(hashes), dtype=bool)
    for edge in range(1, GRAM):
        at = offsets[1:-1] - edge
        fine[at[(at >= 0) & (at < len(hashes))]] = False
    blank = folded == 0x20
    two = blank[:-1] & blank[1:]
    for j in range(GRAM - 1):
        fine &= ~two[j : j + len(hashes)]
    return hashes, fine


def _count(rows: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """Frequencies of n-grams by language (its place), combined before they move."""
    place = {x: i for i, x in enumerate(languages)}
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def flush():
        for at, parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            for k in range(0, len(gram), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram[part]), at, np.int32)), pa.array(gram[part].view(np.int64)), pa.array(n[part].astype(np.int64))], names=["at", "gram", "n"])
        held.clear()

    for batch in rows:
        langs = batch.column("lang").to_pylist()
        for first, end, data, offsets in bk.slices(batch, "text"):
            hashes, fine = _grams(data, offsets)
            for i in range(end - first):
                part = slice(int(offsets[i]), int(offsets[i + 1]))
                found = hashes[part][fine[part]]
                held.setdefault(place[langs[first + i]], []).append(found)
                size += len(found)
            if size > _HELD:
                yield from flush()
                size = 0
    yield from flush()


@dataclass
class LanguageFilter:
    languages: list[str]
    bits: int  # of a slot's number
    slots: np.ndarray  # words of a slot: (words, 1 << bits)
    false_positive: np.ndarray  # by language
    usual: int = 0  # place of the language of most labelled documents

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, members: np.ndarray, usual: int = 0) -> LanguageFilter:
        """grams: hash of each n-gram, members: place of a language that has it; an n-gram of several languages repeats."""
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * np.dtype(k).itemsize), np.uint64)
        width = 8 * np.dtype(kind).itemsize
        bits = max(10, (8 * len(np.unique(grams)) - 1).bit_length()) if len(grams) else 10
        slots = np.zeros((-(-len(languages) // width), 1 << bits), dtype=kind)
        load = np.zeros(len(languages))
        for i in range(len(languages)):
            for at in cls.places(grams[members == i], bits):
                slots[i // width, at] |= kind(1 << (i % width))
            load[i] = ((slots[i // width] >> kind(i % width)) & kind(1)).mean()
        return cls(list(languages), bits, slots, load**HASHES, usual)

    @staticmethod
    def places(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        """Slots of hashed n-grams, by each hash function."""
        h = bk.mix(grams + np.uint64(0x1234567))
        step = bk.mix(h) | np.uint64(1)
        for k in range(HASHES):
            yield ((h + np.uint64(k) * step) >> np.uint64(64 - bits)).astype(np.int64)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): corrected number of n-grams that each language contains, as a share of all."""
        hashes, fine = _grams(data, offsets)
        n_docs = len(offsets) - 1
        out = np.zeros((n_docs, len(self.languages)))
        if not len(hashes):
            return out
        at = list(self.places(hashes, self.bits))
        cuts = np.minimum(offsets, len(hashes))
        total = np.diff(np.concatenate([[0], np.cumsum(fine)])[cuts])
        width = 8 * self.slots.itemsize
        for word in range(len(self.slots)):
            masks = self.slots[word][at[0]]
            for p in at[1:]:
                masks &= self.slots[word][p]
            masks[~fine] = 0
            for i in range(width * word, min(width * (word + 1), len(self.languages))):
                bits = (masks >> masks.dtype.type(i % width)) & masks.dtype.type(1)
                hits = np.diff(np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])[cuts])
                out[:, i] = np.maximum(0, hits - total * self.false_positive[i]) / (1 - self.false_positive[i] + 1e-12)
        return out / np.maximum(total, 1)[:, None]


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Documents of each language: equal shares, what small ones leave goes to the larger ones; no more than ``most``."""
    out, left = {}, most
    for i, (n, lang) in enumerate(sorted((n, lang) for lang, n in counts.items())):
        out[lang] = min(n, left // (len(counts) - i))
        left -= out[lang]
    return out


def _sample(docs: DataFrame, max_docs: int) -> tuple[DataFrame, list[str]]:
    """At most ``max_docs`` labelled rows that are not held out, and their languages, that of most rows first.

    Of each language those of least hashed id and text.  Where more languages
    than ``max_docs`` are labelled, those of fewest rows have none.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # as many rows as languages
    counts = {r["lang"]: r["count"] for r in labelled.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    share = {lang: n for lang, n in quotas(counts, max_docs).items() if n}
    languages = sorted(share, key=lambda x: (-counts[x], x))
    key = [F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").cast("long").alias("doc_id")]
    # a text's first and last word have a mark beside them, like any other
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.concat(F.lit(" "), F.col("text").cast("string"), F.lit(" ")).alias("text"), *key)
    if not share:
        return rows.select("lang", "text").limit(0), []
    # hashes are even: a little more than the share of each language lies below its bound
    bound = {lang: 1.0 if n == counts[lang] else min(1.0, (1.2 * n + 50) / counts[lang]) for lang, n in share.items()}
    of = spark_map({lang: (float(n), bound[lang]) for lang, n in share.items()})
    near = rows.drop("text").withColumn("of", F.try_element_at(of, F.col("lang"))).filter((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.col("of")[1]).distinct()
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    chosen = ranked.filter(F.col("rank") <= F.col("of")[0]).select("lang", "h", "doc_id")
    # at most ``max_docs`` keys; of rows that repeat id, text and language one is taken
    return rows.join(F.broadcast(chosen), ["lang", "h", "doc_id"], "left_semi").dropDuplicates(["lang", "h", "doc_id"]).select("lang", "text"), languages


def spark_map(values: dict[str, tuple[float, ...]]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.array(*map(F.lit, v)) for v in values.values()]))


def fit(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> LanguageFilter:
    """Fit on at most ``max_docs`` labelled rows that are not held out, each language's equal share first.

    Without labelled documents the filter knows no language.
    """
    session(docs)
    sample, languages = _sample(docs, max_docs)
    if not languages:
        return LanguageFilter.build([], np.empty(0, np.uint64), np.empty(0, np.int64))
    order = sorted(languages)
    counted = sample.mapInArrow(lambda it: _count(it, order), "at int, gram long, n long")
    cells = stage(counted.groupBy("at", "gram").agg(F.sum("n").alias("n")), "grams")
    # as many rows as languages
    totals = {r["at"]: r["n"] for r in cells.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for at, n in totals.items() for x in (at, 1.0 / n)]), F.col("at")) if totals else F.lit(0.0)
    by_gram = cells.groupBy("gram").agg(F.collect_list(F.struct("at", (F.col("n") * share).alias("rate"))).alias("c"))
    # n-grams of the sample, whose size is bounded
    has = by_gram.select("gram", F.explode(F.filter("c", lambda x: x["rate"] >= SHARE * F.array_max("c.rate"))["at"]).alias("at")).toArrow()
    unstage(cells)
    return LanguageFilter.build(order, has.column("gram").to_numpy().view(np.uint64), has.column("at").to_numpy(), order.index(languages[0]))


def _predict(rows: Iterator[pa.RecordBatch], model: LanguageFilter) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    for batch in rows:
        preds, scores = [], []
        texts = batch.column("text")
        for first, end, data, offsets in bk.slices(batch, "text"):
            share = model.evidence(data, offsets)
            for i in range(end - first):
                lettered = any(c.isalpha() for c in texts[first + i].as_py() or "")
                if not lettered or not model.languages:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                found = share[i]
                if not found.any() and offsets[i + 1] - offsets[i] < 4 * GRAM:
                    # a short text may have no n-gram but with what is around a word
                    alone = np.concatenate([[0x20], data[offsets[i] : offsets[i + 1]], [0x20]]).astype(np.uint8)
                    found = model.evidence(alone, np.array([0, len(alone)]))[0]
                total = float(found.sum())
                best = int(found.argmax()) if total > 0 else model.usual
                preds.append(model.languages[best])
                scores.append(float(found[best]) / total if total > 0 else 0.0)
        yield batch, preds, scores


def _with_ids(rows: Iterator[pa.RecordBatch], model: LanguageFilter) -> Iterator[pa.RecordBatch]:
    for batch, preds, scores in _predict(rows, model):
        out = list(zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), preds, scores, strict=True))
        yield from batches(out, _SCHEMA)


def identify(docs: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from its text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learned.  Score 0 with a language: no evidence for any, and the language
    is that of most labelled documents.  Ties go to the language that sorts
    first.  held_out is false for a null doc_id.
    """
    spark = session(docs)
    held = spark.sparkContext.broadcast(pickle.dumps(model or fit(docs)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _with_ids(it, pickle.loads(held.value)), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(rows: Iterator[pa.RecordBatch], model: LanguageFilter, languages: list[str] | None, least: float) -> Iterator[pa.RecordBatch]:
    for batch, preds, scores in _predict(rows, model):
        yield batch.filter(pa.array([p != "und" and s >= least and (languages is None or p in languages) for p, s in zip(preds, scores, strict=True)], pa.bool_()))


def keep_identified(docs: DataFrame, languages: list[str] | None = None, least: float = 0.0, model: LanguageFilter | None = None) -> DataFrame:
    """The documents in a learned language (or one of ``languages``) with a score of at least ``least``, all columns.

    With the defaults only those go that ``identify`` calls ``und``.
    """
    spark = session(docs)
    held = spark.sparkContext.broadcast(pickle.dumps(model or fit(docs)))
    return docs.mapInArrow(lambda it: _keep(it, pickle.loads(held.value), languages, least), docs.schema)
