"""Counts for the desk: imports, feeds, retention, key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.catalog import zero_filled

IMPORT_OUTCOMES = ["imported", "duplicate", "skipped", "error"]


def import_outcomes(files: DataFrame, catalog: DataFrame, supported: Column, broken: Column) -> DataFrame:
    """Outcome of each file (file_id, content_hash): unsupported ones are skipped, then broken ones fail, then known or repeated contents are duplicates.

    The first of equal contents is found by an aggregate, so that a content with
    very many copies needs no window in one task.
    """
    judged = files.withColumn("__bad", F.when(~F.coalesce(supported, F.lit(False)), "skipped").when(F.coalesce(broken, F.lit(True)), "error"))
    first = judged.filter("__bad IS NULL").groupBy("content_hash").agg(F.min("file_id").alias("__first"))
    known = catalog.select("content_hash", F.lit(True).alias("__known")).distinct()
    rows = judged.join(first, "content_hash", "left").join(known, "content_hash", "left")
    fresh = F.col("__known").isNull() & (F.col("file_id") == F.col("__first"))
    return rows.withColumn("outcome", F.coalesce("__bad", F.when(fresh, "imported").otherwise("duplicate"))).drop("__bad", "__first", "__known")


def import_counts(outcomes: DataFrame) -> DataFrame:
    return zero_filled(outcomes, "outcome", IMPORT_OUTCOMES)


def kinds_of_feed(entries: DataFrame, order: str, kind: str = "kind", first: int = 200, sample: int = 10) -> DataFrame:
    """Kinds among the first entries with their counts and the titles of the sample."""
    read = entries.orderBy(order).limit(first)
    shown = read.orderBy(order).limit(sample).select(order, F.lit(True).alias("__shown"))
    rows = read.join(F.broadcast(shown), order, "left")
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.count("__shown").alias("sampled"))


def feed_counts(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """Items and linked books of every feed, zero included."""
    counts = items.groupBy(F.col("feed_id").alias("id")).agg(F.count("*").alias("items"), F.count("book_id").alias("books"))
    return feeds.select("id").join(counts, "id", "left").select("id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("books", F.lit(0)).alias("books"))


def retention_totals(feeds: DataFrame, removed: DataFrame) -> DataFrame:
    """Feeds that clean up, and what was removed, freed and skipped; ``removed`` has feed_id, done and freed."""
    enabled = feeds.filter("cleanup_enabled AND cleanup_days > 0").select(F.col("id").alias("feed_id"))
    done = F.col("done")
    sums = removed.join(enabled, "feed_id", "left_semi").agg(F.count_if(done).alias("removed"), F.coalesce(F.sum(F.when(done, F.col("freed"))), F.lit(0)).alias("freed"), F.count_if(~done).alias("skipped"))
    return enabled.agg(F.count("*").alias("feeds")).crossJoin(F.broadcast(sums))  # one row by one row


def key_figures(books: DataFrame, categories: DataFrame, listed: int = 500) -> DataFrame:
    """Books, and authors, series and categories; the lists of authors and series show at most ``listed``."""
    shown = lambda c: F.least(F.count_distinct(c), F.lit(listed)).alias(c)
    figures = books.agg(F.count(text.given("format")).alias("books"), shown("author"), shown("series"))
    return figures.crossJoin(F.broadcast(categories.agg(F.count("*").alias("categories"))))  # one row by one row
