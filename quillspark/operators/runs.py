"""Feed runs: counters, resets, windows, archive posts and the queue's lists."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import col, given
from quillspark.operators.lifecycle import at

#: The folder of all feeds' categories, and the mark that tells a page's encoding.
FEED_ROOT, CHARSET = "rss", '<meta charset="utf-8">'


def feed_category(name: Column | str, folder: Column | str) -> Column:
    """rss/<folder or name>, without slashes at the leaf's ends."""
    trimmed = lambda c: given(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.concat(F.lit(f"{FEED_ROOT}/"), F.regexp_replace(F.coalesce(trimmed(folder), trimmed(name), F.lit("feed")), "^/+|/+$", ""))


def with_charset(html: Column | str) -> Column:
    """Inline HTML that says its encoding: in its head if it has one, else in front."""
    h = F.coalesce(col(html), F.lit(""))
    said = F.lower(F.substring(h, 1, 1024)).contains("charset")
    head = r"(?is)^(.*?<head[^>]*>)(.*)$"
    placed = F.concat(F.regexp_extract(h, head, 1), F.lit(CHARSET), F.regexp_extract(h, head, 2))
    return F.when(said, h).when(h.rlike(head), placed).when(F.lower(h).contains("<head"), h).otherwise(F.concat(F.lit(CHARSET), h))


def default_target(content_type: Column | str, path: Column | str) -> Column:
    """epub for articles, else nothing."""
    article = F.coalesce(col(content_type).rlike("^(text/html|application/xhtml)"), F.lit(False)) | F.coalesce(F.lower(col(path)).rlike(r"\.(html|htm|xhtml)$"), F.lit(False))
    return F.when(article, "epub").otherwise("")


def posts_of_year(posts: DataFrame, year: int | None) -> DataFrame:
    return posts if year is None else posts.filter(F.col("year") == year)


def preview(posts: DataFrame, sample: int = 30) -> DataFrame:
    """The first posts, newest first, each with the number of those that are not shown."""
    total = posts.agg(F.greatest(F.count("*") - sample, F.lit(0)).alias("more"))
    return posts.orderBy(F.desc("date"), "url").limit(sample).join(total, F.lit(True))


def fetch_once(wanted: DataFrame, fetched: DataFrame, url: str = "url") -> DataFrame:
    """Addresses to fetch: each once, without those that were fetched in this run."""
    return wanted.select(F.col(url).alias("url")).filter(given("url").isNotNull()).distinct().join(fetched.select("url"), "url", "left_anti")


#: The counters of a run's report.
COUNTERS = ["fetched", "downloaded", "imported", "queued", "skipped", "articles", "backfilled"]


def run_report(feeds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """feed_id, the counters, the errors and ok of each feed's run.

    outcomes: feed_id and, for each entry, status, is_article, queued, backfill
    and message; a feed without outcomes has zeros.
    """
    s = F.col("status")
    counted = outcomes.groupBy("feed_id").agg(
        F.count("*").alias("fetched"),
        F.count_if(s.isin("downloaded", "imported")).alias("downloaded"),
        F.count_if(s == "imported").alias("imported"),
        F.count_if((s == "imported") & F.col("queued")).alias("queued"),
        F.count_if(s == "skipped").alias("skipped"),
        F.count_if((s == "imported") & F.col("is_article")).alias("articles"),
        F.count_if((s == "imported") & F.col("backfill")).alias("backfilled"),
        F.count_if(s == "error").alias("errors"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in [*COUNTERS, "errors"]]
    return feeds.select(F.col("id").alias("feed_id")).join(counted, "feed_id", "left").select("feed_id", *zero).withColumn("ok", F.col("errors") == 0)


def reset(feed_items: DataFrame, feeds: DataFrame, books: DataFrame, feed_ids: DataFrame, with_books: bool = False) -> dict[str, DataFrame]:
    """Items, feeds and books after the feeds forget what they processed; their books and what was made of these go if asked."""
    chosen = feed_ids.select(F.col("feed_id").alias("__feed")).distinct()
    items = feed_items.join(chosen, feed_items["feed_id"] == chosen["__feed"], "left_anti")
    marked = feeds.join(chosen, feeds["id"] == chosen["__feed"], "left")
    unchecked = marked.withColumn("last_checked_at", F.when(F.col("__feed").isNull(), F.col("last_checked_at"))).drop("__feed")
    if with_books:
        gone = feed_items.join(chosen, feed_items["feed_id"] == chosen["__feed"]).filter("book_id IS NOT NULL").select(F.col("book_id").alias("__gone")).distinct()
        books = books.join(gone, books["id"] == gone["__gone"], "left_anti").join(gone, F.col("origin_book_id") == F.col("__gone"), "left_anti")
    return {"feed_items": items, "feeds": unchecked, "books": books}


def caught_up(feeds: DataFrame, left: DataFrame, now: datetime) -> DataFrame:
    """Feeds with the time at which their window had no post left; left: feed_id, n."""
    done = left.filter("n = 0").select(F.col("feed_id").alias("__done"))
    return feeds.join(done, feeds["id"] == done["__done"], "left").withColumn("backfill_done_at", F.when(F.col("__done").isNotNull(), at(now)).otherwise(F.col("backfill_done_at"))).drop("__done")


def archive_posts(posts: DataFrame, feed_id: int, enqueue: bool = True) -> DataFrame:
    """Catalog rows of archive posts: published is the post's day, the conversion to EPUB is asked for or not."""
    published = F.date_format("date", "yyyy-MM-dd")
    return posts.select(F.lit(feed_id).cast("long").alias("feed_id"), F.col("url").alias("guid"), F.col("url").alias("source_url"), F.coalesce(given("title"), F.col("url")).alias("title"), published.alias("published"), F.lit("epub" if enqueue else "").alias("target_format"))


def job_list(jobs: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """Jobs, newest first."""
    return (jobs if status is None else jobs.filter(F.col("status") == status)).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def progress(jobs: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """Jobs with the progress, message and heartbeat of ``changes`` (id, progress, message); a blank message is none."""
    c = changes.select(F.col("id").alias("__id"), F.col("progress").alias("__progress"), given("message").alias("__message"))
    hit = F.col("__id").isNotNull()
    out = jobs.join(c, jobs["id"] == c["__id"], "left")
    message = F.col("message") if "message" in jobs.columns else F.lit(None).cast("string")
    return out.withColumn("progress", F.when(hit, F.col("__progress")).otherwise(F.col("progress"))).withColumn("message", F.when(hit, F.col("__message")).otherwise(message)).withColumn("heartbeat_at", F.when(hit, at(now)).otherwise(F.col("heartbeat_at"))).drop("__id", "__progress", "__message")


def records_of(records: DataFrame, ids: DataFrame, key: str = "file_id") -> DataFrame:
    """The records of the given ids, each once."""
    return records.join(ids.select(key).distinct(), key, "left_semi").dropDuplicates([key])


def with_relations(books: DataFrame, categories: DataFrame, book_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Books with their category's name and their tags' names in order; no tags: an empty list."""
    names = book_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy(F.col("book_id").alias("__book")).agg(F.sort_array(F.collect_set("name")).alias("tags"))
    c = categories.select(F.col("id").alias("__category"), F.col("name").alias("category"))
    out = books.join(c, F.col("category_id") == F.col("__category"), "left").join(names, F.col("id") == F.col("__book"), "left")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).drop("__category", "__book")


def address(path: Column | str, query: dict[str, Column], base: str = "") -> Column:
    """An address with the parameters that are given, encoded."""
    quoted = lambda c: F.url_encode(c.cast("string"))
    parts = [F.when(given(c.cast("string")).isNotNull(), F.concat(F.lit(f"{re.sub('=', '%3D', name)}="), quoted(c))) for name, c in query.items()]
    rest = F.concat_ws("&", *parts) if parts else F.lit("")
    whole = F.concat(F.lit(base.rstrip("/")), col(path))
    return F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("?"), rest))
