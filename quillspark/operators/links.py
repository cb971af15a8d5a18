"""Deduplication, seen sets and repairs: what to join, and what to leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.files import metadata_name
from quillspark.functions.text import given, safe_filename, slugify_path
from quillspark.functions.urls import normal_form


def content_groups(books: DataFrame, content: str, key: str) -> DataFrame:
    """hash, first key and size of every group of equal contents; counted before rows move."""
    return books.groupBy(F.sha2(F.col(content), 256).alias("hash")).agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))


def origins(books: DataFrame, content: str, key: str) -> DataFrame:
    """Each row with the first key of its equal contents as origin, null for the first itself.

    Only digests are grouped; a group of one row joins nothing.
    """
    groups = content_groups(books, content, key).filter("copies > 1").select(F.col("hash").alias("__hash"), F.col("first_id").alias("__first"))
    joined = books.join(groups, F.sha2(F.col(content), 256) == F.col("__hash"), "left")
    return joined.withColumn("origin_book_id", F.when(F.col(key) != F.col("__first"), F.col("__first"))).drop("__hash", "__first")


def known_urls(books: DataFrame) -> DataFrame:
    """Normal forms of the books' two addresses, each once, without blank ones."""
    both = books.select(normal_form("source_url").alias("url")).union(books.select(normal_form("source_id").alias("url")))
    return both.filter("url != ''").distinct()


def unknown(posts: DataFrame, known: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Posts whose normal form is not known and whose address is no seen guid."""
    k = known.select(F.col("url").alias("__known"))
    out = posts.join(k, normal_form(posts["url"]) == k["__known"], "left_anti")
    if seen is not None:
        g = seen.select(F.col("guid").alias("__seen"))
        out = out.join(g, out["url"] == g["__seen"], "left_anti")
    return out


def new_items(entries: DataFrame, seen: DataFrame, cap: Column | int | None = None) -> DataFrame:
    """Entries whose (feed_id, guid) is not seen, the first of equal ones; the cap counts new items only."""
    once = Window.partitionBy("feed_id", "guid").orderBy("position")
    fresh = entries.withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n").join(seen.select("feed_id", "guid"), ["feed_id", "guid"], "left_anti")
    if cap is None:
        return fresh
    w = Window.partitionBy("feed_id").orderBy("position")
    return fresh.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= cap).drop("__n")


def unambiguous(items: DataFrame, books: DataFrame, title: str = "title") -> DataFrame:
    """Items linked to a book where exactly one book has the trimmed title."""
    only = books.groupBy(F.trim(title).alias("__title")).agg(F.count("*").alias("__n"), F.min("id").alias("linked_id")).filter("__n = 1")
    return items.join(only, F.trim(items[title]) == only["__title"], "inner").drop("__title", "__n")


def author_repair(books: DataFrame, slugs: list[str]) -> DataFrame:
    """Authors that are device slugs become the origin's author, or null."""
    o = books.select(F.col("id").alias("__o"), given("author").alias("__author"))
    fixed = books.join(o, books["origin_book_id"] == o["__o"], "left")
    return fixed.withColumn("author", F.when(F.col("author").isin(*slugs), F.col("__author")).otherwise(F.col("author"))).drop("__o", "__author")


def recategorise(feeds: DataFrame, items: DataFrame, books: DataFrame) -> DataFrame:
    """Books whose category is not their feed's, with the category that they should have."""
    joined = items.join(feeds.select(F.col("id").alias("feed_id"), F.col("category_id").alias("target")), "feed_id").join(books.select(F.col("id").alias("book_id"), "category_id"), "book_id")
    return joined.filter(~F.col("category_id").eqNullSafe(F.col("target"))).select("book_id", "category_id", "target").distinct()


def orphans(files: DataFrame, used: DataFrame, key: str = "name") -> DataFrame:
    return files.join(used.select(F.col(key)).distinct(), key, "left_anti")


def unused_tags(tags: DataFrame, book_tags: DataFrame) -> DataFrame:
    used = book_tags.select(F.col("tag_id").alias("__used")).distinct()
    return tags.join(used, tags["id"] == used["__used"], "left_anti")


def overridden(builtin: DataFrame, custom: DataFrame, key: str = "slug") -> DataFrame:
    """Rows by key, the custom one where there are both."""
    columns = [c for c in builtin.columns if c != key]
    b, c = builtin.alias("b"), custom.alias("c")
    return b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full").select(F.coalesce(F.col(f"c.{key}"), F.col(f"b.{key}")).alias(key), *[F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(f"b.{x}")).alias(x) for x in columns])


def unique_names(frame: DataFrame, path: str, order: str) -> DataFrame:
    """Paths made unique: the first of equal ones keeps its name, the others get the next free ' (n)' before the extension.

    Every path that the table names is taken; n begins at 2.
    """
    parts = r"^(.*?)(\.[^./]*)?$"
    stem, ext = F.regexp_extract(path, parts, 1), F.regexp_extract(path, parts, 2)
    numbered = r"^(.*) \((\d{1,9})\)$"
    names = frame.select(F.col(path).alias("__path")).distinct()
    bare, mark = F.regexp_extract(F.regexp_extract("__path", parts, 1), numbered, 1), F.regexp_extract(F.regexp_extract("__path", parts, 1), numbered, 2)
    owner = F.concat(bare, F.regexp_extract("__path", parts, 2))
    used = names.filter((mark != "") & ~mark.startswith("0")).groupBy(owner.alias("__owner")).agg(F.sort_array(F.collect_set(mark.cast("int"))).alias("__taken"))
    ranked = frame.withColumn("__n", F.row_number().over(Window.partitionBy(path).orderBy(order)))
    joined = ranked.join(used, F.col(path) == F.col("__owner"), "left")
    free = F.aggregate(F.filter(F.coalesce("__taken", F.array().cast("array<int>")), lambda t: t >= 2), F.col("__n"), lambda n, t: n + (t <= n).cast("int"))
    return joined.withColumn("unique_path", F.when(F.col("__n") == 1, F.col(path)).otherwise(F.concat(stem, F.lit(" ("), free.cast("string"), F.lit(")"), ext))).drop("__n", "__owner", "__taken")


def backfill_summary(posts: DataFrame, in_window: Column, known: DataFrame) -> DataFrame:
    """found, in_window, skipped and new of a dry run."""
    k = known.select(F.col("url").alias("__known")).distinct()
    flags = posts.join(k, normal_form(posts["url"]) == k["__known"], "left").select(in_window.alias("w"), F.col("__known").isNotNull().alias("k"))
    return flags.agg(F.count("*").alias("found"), F.count_if("w").alias("in_window"), F.count_if(F.expr("w AND k")).alias("skipped"), F.count_if(F.expr("w AND NOT k")).alias("new"))


def moved(books: DataFrame, category: Column, path: str = "file_path", order: str = "id") -> DataFrame:
    """Books with their file in the folder of another category; names that meet there are numbered.

    A null or blank category is the library's root; a book without a file stays.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    folder = slugify_path(F.coalesce(category, F.lit("")))
    target = F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))
    placed = books.withColumn("__target", F.when(F.col(path).isNotNull(), target))
    return unique_names(placed, "__target", order).withColumn(path, F.when(F.col(path).isNotNull(), F.col("unique_path"))).drop("__target", "unique_path")


def renamed(books: DataFrame, path: str = "file_path", order: str = "id") -> DataFrame:
    """Books with their file named after series, number, title and author, in the same folder; equal names are numbered."""
    folder, ext = F.regexp_extract(path, r"^(.*/)?", 0), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    named = books.withColumn("__target", F.concat(folder, safe_filename(metadata_name("title", "author", "series", "series_index")), F.lower(ext)))
    return unique_names(named, "__target", order).withColumn(path, F.coalesce("unique_path", path)).drop("__target", "unique_path")


def pasted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pasted texts (title, body) as files to import, and those that lack a title or a body."""
    fine = given(F.trim("title")).isNotNull() & given(F.trim("body")).isNotNull()
    whole = F.coalesce(fine, F.lit(False))
    files = texts.filter(whole).select(F.concat(safe_filename(F.trim("title"), 170), F.lit(".txt")).alias("file_name"), F.trim("title").alias("title"), F.encode("body", "UTF-8").alias("content"))
    return files, texts.filter(~whole)
