"""Quality selection by importance resampling.

Two generative models of hashed n-grams (single words and pairs in a fixed
number of buckets), one of target texts and one of the raw corpus, give each
document the logarithm of their likelihood ratio.  A Gumbel variable drawn from
the document's own key is added, and the k largest sums are the sample: that is
sampling without replacement in proportion to the ratio.

The target model is fitted on at most ``MAX_TARGET_DOCS`` documents labelled as
good; the raw model counts every document.  The k-th largest sum is found by
counting in ever finer ranges, so no sort or limit gathers rows anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.common import id_text, session, stage

BUCKETS, SMOOTHING = 10_000, 1.0
#: Largest number of labelled documents in the target model (those of least hashed id).
MAX_TARGET_DOCS = 20_000
SEED = 7


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bk.Units]:
    """Bucket of each single word and of each pair (-1 where the pair leaves its text)."""
    units = bk.Units(data, offsets, bk.ALNUM_RAW, bk.LOWER)
    words = units.hashes()
    single = (words % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.full(len(words), -1, dtype=np.int64)
    if len(words) > 1:
        pair[:-1] = (bk.mix(words[:-1] * np.uint64(31) + bk.mix(words[1:])) % np.uint64(BUCKETS)).astype(np.int64)
        last = units.bounds[1:] - 1
        pair[last[last >= 0]] = -1
    return single, pair, units


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in rows:
        chosen = batch.column("target").to_numpy(zero_copy_only=False)
        for first, end, data, offsets in bk.slices(batch, "text"):
            single, pair, units = _buckets(data, offsets)
            mine = np.repeat(chosen[first:end], units.counts())
            for values in (single, pair):
                fine = values >= 0
                raw += np.bincount(values[fine], minlength=BUCKETS)
                target += np.bincount(values[fine & mine], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET_DOCS) -> np.ndarray:
    """Logarithm of the ratio of the two models, by bucket; all zero without target documents."""
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_target)
    marked = id_text(docs).join(F.broadcast(good), F.col("doc_id") == F.col("id"), "left").select("text", F.col("id").isNotNull().alias("target"))
    counts = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts.collect():  # as many rows as buckets
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    model = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))
    return model(target) - model(raw)


def _score(rows: Iterator[pa.RecordBatch], ratio: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        weights, n_grams = [], []
        for _, _, data, offsets in bk.slices(batch, "text"):
            single, pair, units = _buckets(data, offsets)
            each = ratio[single] + np.where(pair >= 0, ratio[pair], 0.0)
            counts = units.counts()
            # summed text by text, so that a weight depends on its own text alone
            weights.append(np.bincount(np.repeat(np.arange(len(counts)), counts), weights=each, minlength=len(counts)))
            n_grams.append(counts + np.maximum(counts - 1, 0))
        weight, grams = np.concatenate(weights or [np.empty(0)]), np.concatenate(n_grams or [np.empty(0, np.int64)])
        key = batch.column("key").to_numpy().view(np.uint64)
        uniform = ((bk.mix(key + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        gumbel = -np.log(-np.log(uniform))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(grams.astype(np.int64)), pa.array(weight), pa.array(weight + gumbel)], names=["doc_id", "key", "n_grams", "log_weight", "gumbel_key"])


def kth_largest(scored: DataFrame, column: str, k: int) -> float:
    """Value of the k-th largest of a double column, by counts in finer and finer ranges."""
    n, low, high = scored.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    while low < high:
        step = (high - low) / 4096
        if low + step <= low:
            break
        inside = scored.filter(F.col(column).between(low, high))
        slot = F.least(F.floor((F.col(column) - low) / step), F.lit(4095))
        counts = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()  # 4096 rows at most
        for row in sorted(counts, key=lambda r: -r["slot"]):
            if k <= row["n"]:
                if row["n"] == k:
                    return row["lo"]
                if k == 1:
                    return row["hi"]
                if (low, high) == (row["lo"], row["hi"]):
                    return low
                low, high = row["lo"], row["hi"]
                break
            k -= row["n"]
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and selected for every document.

    ``share`` of the rows is selected; by default the share of good ones among
    the labels (all rows if there are no labels).  Null text counts as empty:
    weight 0.  The draw depends on doc_id and text alone, so repeated rows tie
    and are selected together, as are all rows that tie with the last selected.
    """
    session(docs)
    if share is None:
        share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = id_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    scored = stage(rows.mapInArrow(lambda it: _score(it, ratio.value, seed), "doc_id long, key long, n_grams long, log_weight double, gumbel_key double"), "scores")
    least = kth_largest(scored, "gumbel_key", round(share * scored.count()))
    return scored.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(least)).alias("selected"))
