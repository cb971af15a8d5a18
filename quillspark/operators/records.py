"""File records and catalog rows: lists, state changes, derived books, delivery, profiles, feeds."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.catalog import HIDDEN
from quillspark.operators.lifecycle import at

INHERITED = ["title", "author", "series", "series_index", "publisher", "language", "description", "reading_direction"]


def download_list(records: DataFrame, books: DataFrame, state: str | None = None, q: str = "", page: int = 1, per_page: int = 40) -> DataFrame:
    """A page of records, last download first, never downloaded last; the search reads file names and titles."""
    titles = books.select(F.col("id").alias("book_id"), F.col("title").alias("__title"))
    rows = records.join(titles, "book_id", "left")
    if state:
        rows = rows.filter(F.col("state") == state)
    if q.strip():
        rows = rows.filter(text.contains(["file_name", "__title"], q))
    shown = rows.withColumn("title", F.coalesce(text.given("__title"), "file_name")).drop("__title")
    return shown.orderBy(F.desc_nulls_last("last_download_at"), F.desc("created_at"), "file_id").offset((max(page, 1) - 1) * per_page).limit(per_page)


def least_recent(records: DataFrame, k: int) -> DataFrame:
    """The k records that were used longest ago."""
    return records.orderBy(F.coalesce("last_download_at", "updated_at").asc_nulls_first(), "file_id").limit(k)


def set_state(records: DataFrame, changes: DataFrame, key: str = "book_id") -> DataFrame:
    """Records with the states of ``changes`` (key, new_state); of several for one key the greatest holds, unknown keys change nothing."""
    new = changes.filter(F.col("new_state").isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max("new_state").alias("__state"))
    return records.join(new, records[key] == new["__key"], "left").withColumn("state", F.coalesce("__state", "state")).drop("__key", "__state")


def forget(records: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and events without those of the given file_ids."""
    gone = ids.select("file_id").distinct()
    return records.join(gone, "file_id", "left_anti"), events.join(gone, "file_id", "left_anti")


def derived(conversions: DataFrame, origins: DataFrame) -> DataFrame:
    """Catalog rows of converted files: what the file does not say comes from its origin.

    ``conversions``: origin_id, device_profile, format and any of ``INHERITED``;
    a blank or zero counts as unsaid.
    """
    said = [c for c in INHERITED if c in conversions.columns]
    kept = [c for c in INHERITED if c in origins.columns]
    new = conversions.select(F.col("origin_id").alias("__origin"), "device_profile", "format", *[F.col(c).alias(f"__{c}") for c in said])
    old = origins.select("id", *kept, *[c for c in ("category_id", "source_url", "source_id", "tags") if c in origins.columns])

    def value(c: str) -> Column:
        if c not in said:
            return F.col(c)
        blank = text.nonzero(f"__{c}") if c == "series_index" else text.given(f"__{c}")
        return F.coalesce(blank, F.col(c))

    rows = new.join(old, new["__origin"] == old["id"])
    carried = [c for c in old.columns if c not in kept and c != "id"]
    out = rows.select(F.col("id").alias("origin_book_id"), *[value(c).alias(c) for c in kept], *carried, "device_profile", "format", F.lit("import").alias("source"), F.lit(False).alias("is_original"))
    return out.withColumn("sort_title", F.lower("title")).withColumn("file_name", F.concat(F.col("title"), F.lit(" ["), F.col("device_profile"), F.lit("]."), F.col("format")))


def enqueue(requests: DataFrame, books: DataFrame, now: datetime) -> DataFrame:
    """Pending jobs for the requests whose book is known."""
    known = books.select(F.col("id").alias("book_id")).distinct()
    return requests.join(known, "book_id", "left_semi").select("*", F.lit("pending").alias("status"), F.lit(0).alias("progress"), F.lit(0).alias("attempts"), at(now).alias("created_at"))


def delivery(requests: DataFrame, books: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """Each request with the first reason against delivering its book, or ok.

    In order: unknown book, hidden state, a path that leaves the library, no such
    file.  Books need file_path, files have path.
    """
    own = books.select(F.col("id").alias("book_id"), "file_path", F.lit(True).alias("__known"))
    hidden = records.filter(F.col("state").isin(HIDDEN)).select("book_id", F.lit(True).alias("__hidden")).distinct()
    there = files.select(F.col("path").alias("file_path"), F.lit(True).alias("__there")).distinct()
    escapes = F.col("file_path").rlike(r"^/|(^|/)\.\.(/|$)")
    reason = F.when(F.col("__known").isNull(), "unknown").when(F.col("__hidden"), "hidden").when(escapes, "invalid path").when(F.col("__there").isNull(), "missing").otherwise("ok")
    return requests.join(own, "book_id", "left").join(hidden, "book_id", "left").join(there, "file_path", "left").withColumn("outcome", reason).drop("file_path", "__known", "__hidden", "__there")


def sync_profiles(stored: DataFrame, builtin: DataFrame) -> DataFrame:
    """Stored profiles (slug, name, spec, builtin) with the built-in ones renewed; profiles of users stay as they are."""
    code = builtin.select("slug", F.col("name").alias("__name"), F.col("spec").alias("__spec"))
    renew = F.col("__name").isNotNull() & F.coalesce("builtin", F.lit(True))
    rows = stored.join(code, "slug", "full")
    return rows.select("slug", F.when(renew, F.col("__name")).otherwise(F.col("name")).alias("name"), F.when(renew, F.col("__spec")).otherwise(F.col("spec")).alias("spec"), F.coalesce("builtin", F.lit(True)).alias("builtin"))


def delete_profiles(stored: DataFrame, slugs: DataFrame) -> DataFrame:
    """Without the named profiles of users; built-in ones stay."""
    gone = slugs.select("slug").distinct().withColumn("__gone", F.lit(True))
    return stored.join(gone, "slug", "left").filter(F.col("__gone").isNull() | F.col("builtin")).drop("__gone")


def create_feeds(feeds: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, url) with ``created``: false where the address exists or an earlier request has it."""
    taken = feeds.select("url", F.lit(True).alias("__taken")).distinct()
    first = F.row_number().over(Window.partitionBy("url").orderBy("request_id")) == 1
    return requests.withColumn("__first", first).join(taken, "url", "left").withColumn("created", F.col("__first") & F.col("__taken").isNull()).drop("__first", "__taken")


def latest_items(items: DataFrame, k: int, group: str = "feed_id", when: str = "added_at", key: str = "guid") -> DataFrame:
    """The k newest items of each feed."""
    newest = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(when), F.desc(key)))
    return items.withColumn("__n", newest).filter(F.col("__n") <= k).drop("__n")


def feed_defaults(posts: DataFrame, feeds: DataFrame, host: str = "host") -> DataFrame:
    """Posts with the settings of the first feed of the same host, null where there is none."""
    names = [c for c in feeds.columns if c not in (host, "id")]
    first = feeds.groupBy(host).agg(F.min_by(F.struct("id", *names), "id").alias("__f"))
    return posts.join(first, host, "left").select(*posts.columns, F.col("__f.id").alias("feed_id"), *[F.col(f"__f.{c}").alias(c) for c in names if c not in posts.columns])


def progress_writes(reports: DataFrame, delta: int = 5, seconds: float = 1.0) -> DataFrame:
    """Reports (job_id, at, seq, percent) that are written: 100 and more always, else a step of ``delta`` after ``seconds``.

    What is written depends on what was written before, so each job's reports are
    folded in order, a batch at a time.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, percent, when = None, -1, None
        for part in parts:
            keep = []
            for j, t, p in zip(part["job_id"], part["at"], part["percent"], strict=True):
                if j != job:
                    job, percent, when = j, -1, None
                due = p >= 100 or (abs(p - percent) >= delta and (when is None or (t - when).total_seconds() >= seconds))
                if due:
                    percent, when = p, t
                keep.append(due)
            yield part[keep]

    rows = reports.filter("job_id IS NOT NULL AND at IS NOT NULL AND percent IS NOT NULL").select("job_id", "at", "seq", "percent")
    return rows.repartition("job_id").sortWithinPartitions("job_id", "at", "seq").mapInPandas(fold, rows.schema)
