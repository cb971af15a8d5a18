"""Downloads, retention, queue and throttle: all against a given time, never the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.files import client, range_flags
from quillspark.functions.text import nonzero

STATES = ["available", "downloaded", "blocked", "deleted"]
JOB_STATES = ["pending", "running", "done", "failed", "cancelled"]


def at(now: datetime) -> Column:
    return F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def fold_events(events: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Downloads, first and last of them, open attempts and state of each file.

    A completed countable attempt counts; a file that was available becomes
    downloaded, blocked and deleted ones stay as they were.
    """
    counted = (F.col("status") == "completed") & F.coalesce(F.col("countable"), F.lit(True))
    folded = events.groupBy("file_id").agg(
        F.count_if(counted).alias("download_count"),
        F.min(F.when(counted, F.col("at"))).alias("first_download_at"),
        F.max(F.when(counted, F.col("at"))).alias("last_download_at"),
        F.greatest(F.lit(0), F.sum(F.when(F.col("status") == "started", 1).otherwise(-1))).alias("active_downloads"),
    )
    downloaded = F.col("download_count") > 0
    if records is None:
        return folded.withColumn("state", F.when(downloaded, "downloaded").otherwise("available"))
    out = folded.join(records.select("file_id", F.col("state").alias("before")), "file_id", "left")
    state = F.when(F.coalesce("before", F.lit("available")) == "available", F.when(downloaded, "downloaded").otherwise("available")).otherwise(F.col("before"))
    return out.withColumn("state", state).drop("before")


def overview(records: DataFrame, states: list[str] = STATES) -> DataFrame:
    """Files, bytes, downloads and open attempts by state, zero where there are none."""
    table = records.sparkSession.createDataFrame([(s,) for s in states], "state string")
    sums = records.groupBy("state").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("download_count").alias("downloads"), F.sum("active_downloads").alias("active"))
    return table.join(sums, "state", "left").select("state", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "bytes", "downloads", "active")])


def freed(record_size: Column, book_size: Column) -> Column:
    """Bytes that a removal frees: zero means not known."""
    return F.coalesce(nonzero(record_size), nonzero(book_size), F.lit(0))


def recover(events: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """Attempts that started so long ago are interrupted."""
    stuck = (F.col("status") == "started") & (F.col("at") <= at(now) - F.expr(f"INTERVAL {seconds} SECONDS"))
    return events.withColumn("status", F.when(stuck, "interrupted").otherwise(F.col("status")))


def cleanup_candidates(records: DataFrame, books: DataFrame, now: datetime, days: int, limit: int = 200, originals: bool = False) -> DataFrame:
    """Downloaded or blocked files idle for so long, least recently used first.

    The limit comes before originals are left out, on purpose: the plan looks
    at so many files and then drops those it may not touch.
    """
    used = F.coalesce("last_download_at", "updated_at", "created_at")
    old = records.filter(F.col("state").isin("downloaded", "blocked") & (F.col("active_downloads") == 0) & (used <= at(now) - F.expr(f"INTERVAL {days} DAYS")))
    top = old.withColumn("used_at", used).orderBy("used_at", "file_id").limit(limit)
    joined = top.join(books.select(F.col("id").alias("book_id"), "is_original", "file_size"), "book_id", "left")
    return joined if originals else joined.filter(~F.coalesce("is_original", F.lit(False)))


def feed_retention(feeds: DataFrame, items: DataFrame, books: DataFrame, records: DataFrame, jobs: DataFrame, now: datetime, limit: int = 200) -> DataFrame:
    """Books of feeds with clean-up whose age is over, at most so many a feed, then only the idle ones."""
    due = feeds.filter("cleanup_enabled AND cleanup_days > 0").select(F.col("id").alias("feed_id"), F.greatest(F.lit(1), F.col("cleanup_days")).alias("days"))
    old = items.join(due, "feed_id").join(books.select(F.col("id").alias("book_id"), "added_at", "file_size"), "book_id").filter(F.col("added_at") <= at(now) - F.make_dt_interval(F.col("days").cast("int")))
    w = Window.partitionBy("feed_id").orderBy("added_at", "book_id", "guid")
    top = old.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit).drop("__n", "days")
    busy = records.filter("active_downloads > 0").select("book_id").union(jobs.filter(F.col("status").isin("pending", "running")).select("book_id")).distinct()
    return top.join(busy, "book_id", "left_anti")


def prune_events(events: DataFrame, now: datetime, keep_days: int, limit: int = 500) -> DataFrame:
    """Closed events that are over the age, the oldest so many."""
    return events.filter(F.col("finished_at") <= at(now) - F.expr(f"INTERVAL {max(1, keep_days)} DAYS")).orderBy("finished_at", "event_id").limit(limit)


def claim(jobs: DataFrame, k: int, now: datetime) -> DataFrame:
    """The oldest k pending jobs become running, with one more attempt."""
    pending = jobs.filter("status = 'pending'").orderBy("created_at", "id").limit(k).select(F.col("id").alias("__claimed"))
    joined = jobs.join(pending, jobs["id"] == pending["__claimed"], "left")
    mine = F.col("__claimed").isNotNull()
    return joined.withColumn("status", F.when(mine, "running").otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + mine.cast("int")).withColumn("heartbeat_at", F.when(mine, at(now)).otherwise(F.col("heartbeat_at"))).drop("__claimed")


def requeue_stale(jobs: DataFrame, now: datetime, seconds: int = 120) -> DataFrame:
    """Running jobs whose heart stopped, or never beat, are pending again without progress."""
    stale = (F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < at(now) - F.expr(f"INTERVAL {seconds} SECONDS")))
    return jobs.withColumn("progress", F.when(stale, 0).otherwise(F.col("progress"))).withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def transition(jobs: DataFrame, actions: DataFrame, limit: int = 4000) -> DataFrame:
    """Apply finish, fail, cancel and retry by id; one that the state forbids changes nothing."""
    j = jobs.join(actions.select("id", "action", F.col("message").alias("__message")), "id", "left")
    s, a = F.col("status"), F.col("action")
    new = (
        F.when((a == "finish") & (s == "running"), "done")
        .when((a == "fail") & (s == "running"), "failed")
        .when((a == "cancel") & s.isin("pending", "running"), "cancelled")
        .when((a == "retry") & s.isin("failed", "cancelled"), "pending")
        .otherwise(s)
    )
    return j.withColumn("error", F.when((a == "fail") & (s == "running"), F.substring("__message", 1, limit)).otherwise(F.col("error"))).withColumn("status", new).drop("action", "__message")


def clear(jobs: DataFrame, statuses: tuple[str, ...] = ()) -> DataFrame:
    """Jobs without those that ended (done, failed, cancelled, or the given states)."""
    return jobs.filter(~F.col("status").isin(*(statuses or ("done", "failed", "cancelled"))))


def open_attempts(records: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their open attempts counted, and the started events of ``starts`` (event_id, file_id, user_agent, range, at)."""
    counts = starts.groupBy(F.col("file_id").alias("__file")).agg(F.count("*").alias("__n"))
    opened = records.join(counts, records["file_id"] == counts["__file"], "left").withColumn("active_downloads", F.coalesce("active_downloads", F.lit(0)) + F.coalesce("__n", F.lit(0))).drop("__file", "__n")
    who, part = client("user_agent"), range_flags("range")
    events = starts.select("event_id", "file_id", F.lit("started").alias("status"), who["client"].alias("client"), who["client_key"].alias("client_key"), part["range_request"].alias("range_request"), part["resume"].alias("resume"), part["countable"].alias("countable"), "at")
    return opened, events


def close_attempts(events: DataFrame, closes: DataFrame, limit: int = 300) -> DataFrame:
    """Events after ``closes`` (event_id, at, status, bytes_sent, error): only a started one closes, and once.

    Of several closes of one attempt the first holds; those of attempts that
    are closed or not there change nothing.
    """
    first = closes.groupBy(F.col("event_id").alias("__id")).agg(F.min(F.struct("at", "status", F.greatest(F.lit(0), F.col("bytes_sent")).alias("sent"), F.substring("error", 1, limit).alias("error"))).alias("__c"))
    joined = events.join(first, events["event_id"] == first["__id"], "left").withColumn("__hit", F.col("__id").isNotNull() & (F.col("status") == "started"))
    take = lambda new, old: F.when(F.col("__hit"), F.col(f"__c.{new}")).otherwise(old)
    had = lambda c, kind: F.col(c) if c in events.columns else F.lit(None).cast(kind)
    return joined.withColumn("bytes_sent", take("sent", had("bytes_sent", "long"))).withColumn("finished_at", take("at", had("finished_at", "timestamp"))).withColumn("error", take("error", had("error", "string"))).withColumn("status", take("status", F.col("status"))).drop("__id", "__c", "__hit")


def cleanup_report(records: DataFrame, books: DataFrame, now: datetime, days: int, limit: int = 200, originals: bool = False) -> DataFrame:
    """One row: removed, skipped, orphans and freed_bytes of a clean-up run."""
    found = cleanup_candidates(records, books.withColumn("__there", F.lit(True)), now, days, limit, True)
    there = found.join(books.select(F.col("id").alias("book_id"), F.lit(True).alias("there")), "book_id", "left")
    gone, kept = F.col("there").isNull(), F.coalesce("is_original", F.lit(False)) & F.lit(not originals)
    goes = ~gone & ~kept
    return there.agg(F.count_if(goes).alias("removed"), F.count_if(~gone & kept).alias("skipped"), F.count_if(gone).alias("orphans"), F.coalesce(F.sum(F.when(goes, freed(F.col("size_bytes"), F.col("file_size")))), F.lit(0)).alias("freed_bytes"))


def throttle(attempts: DataFrame, window_seconds: int = 900, failures: int = 5, lock_seconds: int = 300) -> DataFrame:
    """Failures of each key within the window up to each failure, and when a lock ends.

    A success empties the key's window.  A failure exactly as old as the window
    is out of it.
    """
    order = Window.partitionBy("key").orderBy("at", "attempt_id")
    runs = attempts.withColumn("run", F.sum(F.col("success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    failed = runs.filter("NOT success").withColumn("__us", F.unix_micros("at"))
    frame = Window.partitionBy("key", "run").orderBy("__us").rangeBetween(1 - window_seconds * 1_000_000, 0)
    counted = failed.withColumn("recent", F.count("*").over(frame))
    locked = F.col("recent") >= failures
    return counted.withColumn("locked_until", F.when(locked, F.timestamp_micros(F.col("__us") + lock_seconds * 1_000_000))).drop("__us", "run")


def throttle_key(user: Column, address: Column) -> Column:
    """user@address; the default stands in before trimming."""
    part = lambda c: F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("?")))
    return F.concat(F.lower(part(user)), F.lit("@"), part(address))


def due_feeds(feeds: DataFrame, now: datetime) -> DataFrame:
    """Active feeds that were never checked or not for their interval."""
    age = F.unix_timestamp(at(now)) - F.unix_timestamp("last_checked_at")
    return feeds.filter(F.col("active") & (F.col("last_checked_at").isNull() | (age >= F.col("interval_minutes") * 60)))


def backfill_days(days: Column, months: Column) -> Column:
    return F.when(F.coalesce(days, F.lit(0)) != 0, days).when(months < 0, -1).otherwise(F.coalesce(months, F.lit(0)) * 30)


def failure_streak(runs: DataFrame) -> DataFrame:
    """Failures in a row of each feed after its last success."""
    order = Window.partitionBy("feed_id").orderBy(F.col("at").desc(), F.col("run_id").desc())
    since = runs.withColumn("__ok", F.max(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return since.groupBy("feed_id").agg(F.count_if(F.col("__ok") == 0).alias("consecutive_failures"))


def completion(outcome: Column, sent: Column, total: Column) -> Column:
    """Status and bytes of a response that ended: nothing sent by a success means all was."""
    status = F.when(outcome == "finished", "completed").when(outcome == "cancelled", "interrupted").otherwise("error")
    return F.struct(status.alias("status"), F.when((status == "completed") & (sent == 0), total).otherwise(sent).alias("bytes_sent"))


def unblock(state: Column, count: Column) -> Column:
    return F.when(state != "blocked", state).when(count > 0, "downloaded").otherwise("available")


def ensure_records(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records of all files: new ones inserted, names and extensions refreshed, size and hash where the new one is truthy."""
    r, f = records.alias("r"), files.alias("f")
    both = r.join(f, F.col("r.file_id") == F.col("f.file_id"), "full")
    pick = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"r.{c}")).alias(c)
    return both.select(
        pick("file_id"), pick("file_name"), pick("file_ext"),
        F.coalesce(F.nullif(F.col("f.file_hash"), F.lit("")), F.col("r.file_hash")).alias("file_hash"),
        F.coalesce(F.nullif(F.col("f.size_bytes"), F.lit(0)), F.col("r.size_bytes"), F.lit(0)).alias("size_bytes"),
        F.coalesce(F.col("r.state"), F.lit("available")).alias("state"),
    )


def delete_books(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the books: their jobs and tags go, links to them become null."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()

    def without(df: DataFrame, key: str) -> DataFrame:
        return df.join(gone, df[key] == gone["__gone"], "left_anti")

    def unlinked(df: DataFrame, key: str) -> DataFrame:
        return df.join(gone, df[key] == gone["__gone"], "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")

    out = dict(tables)
    out["books"] = unlinked(without(tables["books"], "id"), "origin_book_id")
    for name in ("jobs", "book_tags"):
        if name in out:
            out[name] = without(out[name], "book_id")
    for name in ("feed_items", "records"):
        if name in out:
            out[name] = unlinked(out[name], "book_id")
    return out


def patch(table: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Rows with the allowed columns replaced where a change gives a value."""
    names = [c for c in allowed if c in changes.columns]
    p = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in names])
    out = table.join(p, table[key] == p["__key"], "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)))
    return out.drop("__key", *[f"__{c}" for c in names])


def fill_blanks(table: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with blank columns filled; what is there stays."""
    p = fresh.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = table.join(p, table[key] == p["__key"], "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")))
    return out.drop("__key", *[f"__{c}" for c in columns])


def mark_missing(books: DataFrame, files: DataFrame) -> DataFrame:
    """Books with missing set to whether their file is not listed; flipped tells a change."""
    there = files.select(F.col("path").alias("__path")).distinct()
    out = books.join(there, books["file_path"] == there["__path"], "left").withColumn("__missing", F.col("__path").isNull())
    return out.withColumn("flipped", ~F.col("missing").eqNullSafe(F.col("__missing"))).withColumn("missing", F.col("__missing")).drop("__path", "__missing")
