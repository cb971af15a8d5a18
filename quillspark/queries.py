"""Registered queries over the given tables, and the SQL that each must equal.

The tables stand in for a library: documents are books (text as description,
source as author), labels their file records, events the download log, orders
the job queue, pages web articles, parts tags and line items the bridge.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import chapters, files, html, lines, text, urls
from quillspark.functions.udf import dealt, spread
from quillspark.operators import catalog, lifecycle, links, reports
from quillspark.operators import records as desk
from quillspark.plans import planner
from quillspark.sources import books as containers
from quillspark.sources import catalogs, feeds
from quillspark.sources import files as file_sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 2, 15)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- the library

_BOOKS = """books AS (SELECT doc_id AS id, substr(text, 1, 40) AS title, source AS author,
  CASE WHEN doc_id % 3 > 0 THEN 'Series ' || (doc_id % 12) END AS series, (doc_id % 20)::DOUBLE AS series_index, lang AS language, text AS description,
  n_chars AS file_size, ['epub', 'pdf', 'mobi', 'cbz'][doc_id % 4 + 1] AS format, ['ebook', 'document', 'ebook', 'comic'][doc_id % 4 + 1] AS content_type,
  nullif(doc_id % 7, 0) AS category_id, make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS added_at, doc_id % 5 > 0 AS is_original,
  nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS origin_book_id, ['', 'kindle', 'kobo'][doc_id % 3 + 1] AS device_profile FROM documents)"""
_RECORDS = """records AS (SELECT l.doc_id AS file_id, l.doc_id AS book_id, CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 0 THEN 'deleted' WHEN l.doc_id % 3 = 0 THEN 'downloaded' ELSE 'available' END AS state,
  l.doc_id % 5 AS download_count, (l.doc_id % 11 = 0)::BIGINT AS active_downloads, CASE WHEN l.doc_id % 6 > 0 THEN l.doc_id * 10 ELSE 0 END AS size_bytes,
  CASE WHEN l.doc_id % 4 > 0 THEN make_timestamp((1704067200 + l.doc_id * 3600) * 1000000) END AS last_download_at, make_timestamp((1704067200 + l.doc_id * 60) * 1000000) AS updated_at FROM labels l)"""
_JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS book_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'running' END AS status, o_orderdate::TIMESTAMP AS created_at,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::TIMESTAMP + INTERVAL 1 HOUR END AS heartbeat_at, (o_orderkey % 100)::BIGINT AS progress, (o_orderkey % 4)::INT AS attempts FROM orders)"""
_EVENTS = """ev AS (SELECT event_id, user_id AS file_id, ts AS seen, CASE event_type WHEN 'view' THEN 'started' WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'interrupted' END AS status, event_id % 7 > 0 AS countable FROM events)"""
_ITEMS = """items AS (SELECT page_id % 5 AS feed_id, url AS guid, page_id AS book_id FROM pages)"""
_FEEDS = """feeds AS (SELECT i AS id, i <> 3 AS cleanup_enabled, i * 2 AS cleanup_days, i % 3 AS category_id, i <> 4 AS active, 30 * i AS interval_minutes,
  CASE WHEN i <> 2 THEN TIMESTAMP '2024-02-14 23:00:00' END AS last_checked_at FROM range(5) t(i))"""


def _pick(values: list[str], at) -> object:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    base = docs.select(
        i.alias("id"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("author"),
        F.when(i % 3 > 0, F.concat(F.lit("Series "), (i % 12).cast("string"))).alias("series"), (i % 20).cast("double").alias("series_index"), F.col("lang").alias("language"), F.col("text").alias("description"),
        F.col("n_chars").alias("file_size"), _pick(["epub", "pdf", "mobi", "cbz"], i % 4).alias("format"), _pick(["ebook", "document", "ebook", "comic"], i % 4).alias("content_type"),
        text.nonzero(i % 7).alias("category_id"), F.timestamp_seconds(F.lit(1704067200) + i * 3600).alias("added_at"), (i % 5 > 0).alias("is_original"), _pick(["", "kindle", "kobo"], i % 3).alias("device_profile"),
    )
    return base


def derived_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.origins(books(spark, sf_dir), "description", "id")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    state = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "deleted").when(i % 3 == 0, "downloaded").otherwise("available")
    return table(spark, sf_dir, "labels").select(
        i.alias("file_id"), i.alias("book_id"), state.alias("state"), (i % 5).alias("download_count"), (i % 11 == 0).cast("long").alias("active_downloads"), F.when(i % 6 > 0, i * 10).otherwise(0).alias("size_bytes"),
        F.when(i % 4 > 0, F.timestamp_seconds(F.lit(1704067200) + i * 3600)).alias("last_download_at"), F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("updated_at"), F.lit(None).cast("timestamp").alias("created_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    return table(spark, sf_dir, "orders").select(i.alias("id"), F.col("o_custkey").alias("book_id"), status.alias("status"), day.alias("created_at"), F.when(i % 3 > 0, day + F.expr("INTERVAL 1 HOUR")).alias("heartbeat_at"), (i % 100).alias("progress"), (i % 4).cast("int").alias("attempts"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "signup"), "started").when(kind == "purchase", "completed").when(kind == "error", "error").otherwise("interrupted")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), (F.col("event_id") % 7 > 0).alias("countable"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("feed_id"), F.col("url").alias("guid"), F.col("page_id").alias("book_id"))


def feed_table(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(5).select("id", (i != 3).alias("cleanup_enabled"), (i * 2).alias("cleanup_days"), (i % 3).alias("category_id"), (i != 4).alias("active"), (i * 30).alias("interval_minutes"), F.when(i != 2, F.lit("2024-02-14 23:00:00").cast("timestamp")).alias("last_checked_at"))


# ----------------------------------------------------------------- catalog


@query(f"""WITH {_BOOKS} SELECT id, title, author, file_size FROM books WHERE (lower(coalesce(title, '')) LIKE '%the%' OR lower(coalesce(author, '')) LIKE '%the%' OR lower(coalesce(series, '')) LIKE '%the%' OR lower(coalesce(description, '')) LIKE '%the%')
  AND content_type = 'ebook' ORDER BY lower(title) ASC NULLS FIRST, id LIMIT 25 OFFSET 25""")
def search_page(spark, sf_dir):
    q = catalog.BookQuery(q=" The ", content_type="ebook", sort="title", page=2, per_page=25)
    return catalog.page(catalog.search(books(spark, sf_dir), q), q)[0].select("id", "title", "author", "file_size")


@query(f"""WITH {_BOOKS}, n AS (SELECT count(*) AS total FROM books WHERE author = 'src0') SELECT total, greatest(1, ceil(total / 40.0))::BIGINT AS pages, true AS has_prev, 3 < greatest(1, ceil(total / 40.0)) AS has_next FROM n""")
def search_totals(spark, sf_dir):
    q = catalog.BookQuery(author="src0", category_id=0, sort="nonsense", page=3)
    return catalog.page(catalog.search(books(spark, sf_dir), q), q)[1]


@query(f"WITH {_BOOKS}, {_RECORDS} SELECT id FROM books b WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.book_id = b.id AND r.state IN ('blocked', 'deleted')) AND (origin_book_id IS NULL OR is_original OR NOT EXISTS (SELECT 1 FROM books o WHERE o.id = b.origin_book_id)) AND format = 'pdf'")
def search_visible(spark, sf_dir):
    q = catalog.BookQuery(format="pdf", exclude_states=tuple(catalog.HIDDEN), collapse_variants=True)
    return catalog.search(derived_books(spark, sf_dir), q, records=records(spark, sf_dir)).select("id")


@query("SELECT source AS value, count(*) AS books FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY lower(source), source LIMIT 500")
def facet_authors(spark, sf_dir):
    return catalog.facet(books(spark, sf_dir), "author")


@query(f"WITH {_BOOKS} SELECT coalesce(nullif(device_profile, ''), 'unknown') AS value, count(*) AS books FROM books GROUP BY 1")
def facet_histogram(spark, sf_dir):
    return catalog.histogram(books(spark, sf_dir), "device_profile")


_FACETS = ["author", "series", "language", "format", "content_type", "category_id", "device_profile"]


@query(f"WITH {_BOOKS} " + " UNION ALL ".join(f"SELECT '{n}' AS facet, {n}::VARCHAR AS value, count(*) AS books, coalesce(sum(file_size), 0)::BIGINT AS total_size FROM books GROUP BY {n}" for n in _FACETS))
def facet_document(spark, sf_dir):
    return catalog.facets(books(spark, sf_dir), _FACETS)


@query("SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('pending'), ('running'), ('done'), ('failed'), ('cancelled')) v(s) LEFT JOIN orders ON CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'running' END = s GROUP BY s")
def facet_zero_fill(spark, sf_dir):
    return catalog.zero_filled(jobs(spark, sf_dir), "status", lifecycle.JOB_STATES)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12')")
def tag_filter_semi(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    bridge = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_partkey").alias("tag_id"))
    return catalog.with_tag(jobs(spark, sf_dir), bridge, tags, "Brand#12").select("id")


@query("SELECT p_partkey, p_name, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_name")
def tag_facet_outer(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem")
    return catalog.outer_counts(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", facts, "l_partkey", "l_orderkey")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE (toxic = 1 OR quality = 0) AND doc_id IS NOT NULL)")
def hidden_anti(spark, sf_dir):
    return catalog.hide_states(books(spark, sf_dir), records(spark, sf_dir)).select("id")


@query(f"WITH {_BOOKS} SELECT id, origin_book_id FROM books b WHERE origin_book_id IS NULL OR is_original OR NOT EXISTS (SELECT 1 FROM books o WHERE o.id = b.origin_book_id)")
def collapse_variants(spark, sf_dir):
    return catalog.collapse_variants(derived_books(spark, sf_dir)).select("id", "origin_book_id")


_RANK = "coalesce(list_position(['epub', 'azw3', 'mobi', 'pdf', 'cbz', 'cbr', 'fb2', 'docx', 'txt'], format), 10)"
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY coalesce(origin_book_id, id) ORDER BY CASE WHEN device_profile = 'kindle' THEN 0 WHEN device_profile = '' THEN 1 ELSE 2 END, {_RANK}, CASE WHEN device_profile = '' THEN 0 ELSE 1 END, CASE WHEN is_original THEN 0 ELSE 1 END, id) AS rank FROM books)"


@query(f"WITH {_BOOKS}, {_RANKED} SELECT coalesce(origin_book_id, id) AS work_id, id, rank::INT AS rank FROM ranked")
def variants_ranked(spark, sf_dir):
    return catalog.ranked_variants(derived_books(spark, sf_dir), "kindle").select("work_id", "id", "rank")


_PLAIN_RANKED = _RANKED.replace("CASE WHEN device_profile = 'kindle' THEN 0 WHEN device_profile = '' THEN 1 ELSE 2 END, ", "")


@query(f"WITH {_BOOKS}, {_PLAIN_RANKED}, l AS (SELECT *, row_number() OVER (PARTITION BY coalesce(origin_book_id, id), format, device_profile ORDER BY rank) AS n FROM ranked) SELECT coalesce(origin_book_id, id) AS work_id, id, format FROM l WHERE n = 1")
def acquisition_links(spark, sf_dir):
    return catalog.acquisition_links(derived_books(spark, sf_dir)).select("work_id", "id", "format")


_LINKS = "l AS (SELECT *, coalesce(origin_book_id, id) AS work_id, row_number() OVER (PARTITION BY coalesce(origin_book_id, id), format, device_profile ORDER BY rank) AS n FROM ranked)"


@query(f"""WITH {_BOOKS}, {_PLAIN_RANKED}, {_LINKS} SELECT work_id, to_json({{'metadata': {{'title': arg_min(title, rank), 'author': arg_min(coalesce(nullif(author, ''), '?'), rank)}}, 'links': list({{'rank': rank, 'href': '/opds/file/' || id, 'format': format, 'file_size': file_size}} ORDER BY rank)}})::VARCHAR AS json FROM l WHERE n = 1 GROUP BY work_id""")
def opds_publications(spark, sf_dir):
    return catalogs.publications(catalog.acquisition_links(derived_books(spark, sf_dir)))


@query(f"""WITH {_BOOKS}, {_PLAIN_RANKED}, {_LINKS} SELECT work_id, '<entry><title>' || replace(replace(replace(coalesce(arg_min(title, rank), ''), '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '</title>' || string_agg('<link rel="http://opds-spec.org/acquisition" type="' || format || '" href="/opds/file/' || id || '"/>', '' ORDER BY rank) || '</entry>' AS xml FROM l WHERE n = 1 GROUP BY work_id""")
def opds_atom_entries(spark, sf_dir):
    return catalogs.atom_entries(catalog.acquisition_links(derived_books(spark, sf_dir)))


@query(f"""WITH {_BOOKS} SELECT id, to_json({{'added_at': strftime(added_at, '%Y-%m-%dT%H:%M:%S.000Z'), 'author': author, 'category_id': category_id, 'content_type': content_type, 'description': description, 'device_profile': device_profile, 'file_size': file_size, 'format': format, 'id': id, 'is_original': is_original, 'language': language, 'series': series, 'series_index': series_index, 'title': title}})::VARCHAR AS json FROM books""")
def book_json(spark, sf_dir):
    return catalogs.summary_json(books(spark, sf_dir))


@query(f"WITH {_BOOKS} SELECT (count(*) - 1) * 0 + count(*) AS total, 41::BIGINT AS start, '/opds/all?page=1' AS previous, CASE WHEN count(*) > 80 THEN '/opds/all?page=3' END AS next FROM books")
def opds_page_links(spark, sf_dir):
    q = catalog.BookQuery(page=2)
    return catalogs.page_links(catalog.page(books(spark, sf_dir), q)[1], "/opds/all", 2, 40)


@query("SELECT string_split(url, '/')[3] AS top, sum(length(html))::BIGINT AS bytes, count(*) AS files, round(100.0 * sum(length(html)) / 1000000, 1) AS percent FROM pages GROUP BY 1")
def disk_usage(spark, sf_dir):
    listing = table(spark, sf_dir, "pages").select(F.expr("split(url, '/')[2]").alias("path"), F.length("html").alias("length"))
    return catalog.usage(listing, 1_000_000)


# ------------------------------------------------- dedup, links and repairs

_NORMAL = "regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return links.content_groups(books(spark, sf_dir), "description", "id")


@query(f"SELECT page_id, {_NORMAL} AS url FROM pages")
def url_normal_form(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normal_form("url").alias("url"))


@query(f"WITH known AS (SELECT DISTINCT {_NORMAL} AS u FROM pages WHERE page_id % 3 = 0) SELECT page_id FROM pages WHERE {_NORMAL} NOT IN (SELECT u FROM known WHERE u <> '') AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")
def known_url_anti(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    known = links.known_urls(pages.filter("page_id % 3 = 0").select(F.col("url").alias("source_url"), F.lit("").alias("source_id")))
    return links.unknown(pages, known, pages.filter("page_id % 5 = 0").select(F.col("url").alias("guid"))).select("page_id")


@query("WITH e AS (SELECT page_id % 5 AS feed_id, url AS guid, min(page_id) AS position FROM pages GROUP BY 1, 2), f AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM pages s WHERE s.page_id % 4 = 0 AND s.page_id % 5 = e.feed_id AND s.url = e.guid)), n AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY position) AS n FROM f) SELECT feed_id, position FROM n WHERE n <= 12")
def feed_new_items(spark, sf_dir):
    entries = items(spark, sf_dir).withColumnRenamed("book_id", "position")
    return links.new_items(entries, entries.filter("position % 4 = 0"), 12).select("feed_id", "position")


@query("WITH u AS (SELECT trim(source || lang) AS t, min(doc_id) AS id FROM documents GROUP BY 1 HAVING count(*) = 1), i AS (SELECT doc_id AS item, source || lang AS title FROM documents) SELECT item, u.id AS linked_id FROM i JOIN u ON trim(i.title) = u.t")
def unambiguous_link(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", "lang").alias("title"))
    return links.unambiguous(docs.withColumnRenamed("id", "item"), docs).select("item", "linked_id")


@query(f"WITH {_BOOKS} SELECT b.id, CASE WHEN b.author IN ('src1', 'src2') THEN nullif(o.author, '') ELSE b.author END AS author FROM books b LEFT JOIN books o ON b.origin_book_id = o.id")
def author_repair(spark, sf_dir):
    return links.author_repair(derived_books(spark, sf_dir), ["src1", "src2"]).select("id", "author")


@query(f"WITH {_BOOKS}, {_ITEMS}, {_FEEDS} SELECT DISTINCT b.id AS book_id, b.category_id, f.category_id AS target FROM items i JOIN feeds f ON i.feed_id = f.id JOIN books b ON b.id = i.book_id WHERE b.category_id IS DISTINCT FROM f.category_id")
def recategorise(spark, sf_dir):
    return links.recategorise(feed_table(spark), items(spark, sf_dir), books(spark, sf_dir))


@query("SELECT p_partkey * 2 AS id FROM part WHERE p_partkey * 2 NOT IN (SELECT l_partkey FROM lineitem)")
def unused_tags(spark, sf_dir):
    return links.unused_tags(table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tag_id")))


@query("SELECT coalesce(c.slug, b.slug) AS slug, CASE WHEN c.slug IS NOT NULL THEN c.width ELSE b.width END AS width FROM (SELECT n_name AS slug, n_nationkey::INT AS width FROM nation) b FULL JOIN (SELECT n_name AS slug, 100 + n_nationkey::INT AS width FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'own', 7) c ON b.slug = c.slug")
def profile_override(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("slug"), F.col("n_nationkey").cast("int").alias("width"), "n_regionkey")
    custom = n.filter("n_regionkey = 1").select("slug", (F.col("width") + 100).alias("width")).union(spark.sql("SELECT 'own', 7"))
    return links.overridden(n.drop("n_regionkey"), custom)


@query("""WITH d AS (SELECT doc_id, source AS base, CASE WHEN doc_id % 9 = 0 THEN ' (' || doc_id % 5 || ')' ELSE '' END AS mark FROM documents),
  r AS (SELECT doc_id, base || mark AS stem, row_number() OVER (PARTITION BY base, mark ORDER BY doc_id) AS n FROM d), names AS (SELECT DISTINCT stem FROM r),
  slots AS (SELECT stem, unnest(range(2, 2 * count(*) + 12)) AS k FROM r GROUP BY stem), free AS (SELECT slots.stem, k, row_number() OVER (PARTITION BY slots.stem ORDER BY k) + 1 AS n FROM slots ANTI JOIN names ON names.stem = slots.stem || ' (' || k || ')')
  SELECT doc_id, r.stem || CASE WHEN r.n = 1 THEN '' ELSE ' (' || free.k || ')' END || '.epub' AS unique_path FROM r LEFT JOIN free ON free.stem = r.stem AND free.n = r.n""")
def unique_file_names(spark, sf_dir):
    i = F.col("doc_id")
    mark = F.when(i % 9 == 0, F.concat(F.lit(" ("), (i % 5).cast("string"), F.lit(")"))).otherwise("")
    return links.unique_names(table(spark, sf_dir, "documents").select("doc_id", F.concat("source", mark, F.lit(".epub")).alias("path")), "path", "doc_id").select("doc_id", "unique_path")


@query(f"SELECT count(*) AS found, count(*) FILTER (WHERE page_id < 200) AS in_window, count(*) FILTER (WHERE page_id < 200 AND {_NORMAL} IN (SELECT {_NORMAL} FROM pages WHERE page_id % 3 = 0)) AS skipped, count(*) FILTER (WHERE page_id < 200 AND {_NORMAL} NOT IN (SELECT {_NORMAL} FROM pages WHERE page_id % 3 = 0)) AS new FROM pages")
def backfill_discovery(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    known = pages.filter("page_id % 3 = 0").select(urls.normal_form("url").alias("url"))
    return links.backfill_summary(pages, F.col("page_id") < 200, known)


# ------------------------------------------------------ lifecycle and queue


@query(f"""WITH {_EVENTS}, f AS (SELECT file_id, count(*) FILTER (WHERE status = 'completed' AND countable) AS download_count, min(seen) FILTER (WHERE status = 'completed' AND countable) AS first_download_at, max(seen) FILTER (WHERE status = 'completed' AND countable) AS last_download_at,
  greatest(0, sum(CASE WHEN status = 'started' THEN 1 ELSE -1 END))::BIGINT AS active_downloads FROM ev GROUP BY file_id), {_RECORDS}
  SELECT f.*, CASE WHEN coalesce(r.state, 'available') = 'available' THEN CASE WHEN f.download_count > 0 THEN 'downloaded' ELSE 'available' END ELSE r.state END AS state FROM f LEFT JOIN records r ON r.file_id = f.file_id""")
def lifecycle_fold(spark, sf_dir):
    return lifecycle.fold_events(events(spark, sf_dir), records(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT s AS state, count(file_id) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, coalesce(sum(download_count), 0)::BIGINT AS downloads, coalesce(sum(active_downloads), 0)::BIGINT AS active FROM (VALUES ('available'), ('downloaded'), ('blocked'), ('deleted')) v(s) LEFT JOIN records ON state = s GROUP BY s")
def download_overview(spark, sf_dir):
    return lifecycle.overview(records(spark, sf_dir))


@query(f"WITH {_RECORDS}, {_BOOKS} SELECT sum(coalesce(nullif(r.size_bytes, 0), nullif(b.file_size, 0), 0))::BIGINT AS freed, count(*) AS removed FROM records r LEFT JOIN books b ON b.id = r.book_id WHERE state = 'deleted'")
def freed_bytes(spark, sf_dir):
    gone = records(spark, sf_dir).filter("state = 'deleted'").join(books(spark, sf_dir), F.col("book_id") == F.col("id"), "left")
    return gone.agg(F.sum(lifecycle.freed(F.col("size_bytes"), F.col("file_size"))).alias("freed"), F.count("*").alias("removed"))


@query(f"WITH {_EVENTS} SELECT event_id, CASE WHEN status = 'started' AND seen <= TIMESTAMP '2024-01-20' - INTERVAL 21600 SECOND THEN 'interrupted' ELSE status END AS status FROM ev")
def stuck_recovery(spark, sf_dir):
    return lifecycle.recover(events(spark, sf_dir), datetime(2024, 1, 20), 21600).select("event_id", "status")


@query(f"""WITH {_RECORDS}, {_BOOKS}, old AS (SELECT *, coalesce(last_download_at, updated_at) AS used_at FROM records WHERE state IN ('downloaded', 'blocked') AND active_downloads = 0 AND coalesce(last_download_at, updated_at) <= TIMESTAMP '2024-02-15' - INTERVAL 5 DAY ORDER BY used_at, file_id LIMIT 40)
  SELECT old.file_id, used_at FROM old LEFT JOIN books ON books.id = old.book_id WHERE NOT coalesce(is_original, false)""")
def cleanup_plan(spark, sf_dir):
    return lifecycle.cleanup_candidates(records(spark, sf_dir), books(spark, sf_dir), NOW, 5, 40).select("file_id", "used_at")


@query(f"""WITH {_FEEDS}, {_ITEMS}, {_BOOKS}, {_RECORDS}, {_JOBS}, old AS (SELECT i.feed_id, i.guid, b.id AS book_id, row_number() OVER (PARTITION BY i.feed_id ORDER BY b.added_at, b.id, i.guid) AS n FROM items i JOIN feeds f ON f.id = i.feed_id AND cleanup_enabled AND cleanup_days > 0 JOIN books b ON b.id = i.book_id WHERE b.added_at <= TIMESTAMP '2024-02-15' - to_days(greatest(1, cleanup_days)::INT))
  SELECT feed_id, book_id FROM old WHERE n <= 20 AND book_id NOT IN (SELECT book_id FROM records WHERE active_downloads > 0) AND book_id NOT IN (SELECT book_id * 3 FROM jobs WHERE status IN ('pending', 'running'))""")
def feed_retention(spark, sf_dir):
    waiting = jobs(spark, sf_dir).withColumn("book_id", F.col("book_id") * 3)
    return lifecycle.feed_retention(feed_table(spark), items(spark, sf_dir), books(spark, sf_dir), records(spark, sf_dir), waiting, NOW, 20).select("feed_id", "book_id")


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-02-15' - INTERVAL 20 DAY ORDER BY ts, event_id LIMIT 500")
def prune_events(spark, sf_dir):
    return lifecycle.prune_events(events(spark, sf_dir).withColumnRenamed("at", "finished_at"), NOW, 20).select("event_id")


@query(f"WITH {_JOBS}, c AS (SELECT id FROM jobs WHERE status = 'pending' ORDER BY created_at, id LIMIT 10) SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'running' ELSE status END AS status, attempts + CASE WHEN id IN (SELECT id FROM c) THEN 1 ELSE 0 END AS attempts FROM jobs")
def claim_topk(spark, sf_dir):
    return lifecycle.claim(jobs(spark, sf_dir), 10, NOW).select("id", "status", "attempts")


@query(f"WITH {_JOBS} SELECT id, CASE WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN stale THEN 0 ELSE progress END AS progress FROM (SELECT *, status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '1997-01-01' - INTERVAL 120 SECOND) AS stale FROM jobs)")
def stale_requeue(spark, sf_dir):
    return lifecycle.requeue_stale(jobs(spark, sf_dir), datetime(1997, 1, 1)).select("id", "status", "progress")


@query(f"""WITH {_JOBS}, a AS (SELECT id, ['finish', 'fail', 'cancel', 'retry'][id % 4 + 1] AS action FROM jobs WHERE id % 2 = 0 OR id % 7 = 0)
  SELECT jobs.id, CASE WHEN action = 'finish' AND status = 'running' THEN 'done' WHEN action = 'fail' AND status = 'running' THEN 'failed' WHEN action = 'cancel' AND status IN ('pending', 'running') THEN 'cancelled' WHEN action = 'retry' AND status IN ('failed', 'cancelled') THEN 'pending' ELSE status END AS status,
  CASE WHEN action = 'fail' AND status = 'running' THEN 'no room' END AS error FROM jobs LEFT JOIN a USING (id)""")
def job_transitions(spark, sf_dir):
    j = jobs(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    actions = j.filter("id % 2 = 0 OR id % 7 = 0").select("id", _pick(["finish", "fail", "cancel", "retry"], F.col("id") % 4).alias("action"), F.lit("no room").alias("message"))
    return lifecycle.transition(j, actions).select("id", "status", "error")


@query("""WITH a AS (SELECT event_id, user_id::VARCHAR AS key, ts, event_type = 'purchase' AS success FROM events WHERE event_type IN ('error', 'purchase')), r AS (SELECT *, sum(success::INT) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
  c AS (SELECT *, count(*) OVER (PARTITION BY key, run ORDER BY ts RANGE BETWEEN INTERVAL '604799.999999 seconds' PRECEDING AND CURRENT ROW) AS recent FROM r WHERE NOT success) SELECT event_id AS attempt_id, recent, CASE WHEN recent >= 3 THEN ts + INTERVAL 300 SECOND END AS locked_until FROM c""")
def throttle_window(spark, sf_dir):
    tries = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')").select(F.col("event_id").alias("attempt_id"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("success"))
    return lifecycle.throttle(tries, 604800, 3).select("attempt_id", "recent", "locked_until")


@query("""WITH c AS (SELECT user_id AS id, max(ts) FILTER (WHERE event_type = 'purchase') AS last_checked_at, count(*) FILTER (WHERE event_type = 'signup') > 0 AS active, 30 * count(*) AS interval_minutes FROM events GROUP BY user_id)
  SELECT id FROM c WHERE active AND (last_checked_at IS NULL OR floor(epoch(TIMESTAMP '2024-02-15')) - floor(epoch(last_checked_at)) >= interval_minutes * 60)""")
def due_feeds(spark, sf_dir):
    """Users are feeds, their purchases the checks."""
    kind = F.col("event_type")
    checks = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(kind == "purchase", F.col("ts").cast("timestamp"))).alias("last_checked_at"), (F.count_if(kind == "signup") > 0).alias("active"), (30 * F.count("*")).alias("interval_minutes"))
    return lifecycle.due_feeds(checks, NOW).select("id")


@query("WITH r AS (SELECT user_id AS feed_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS good, ts FROM events WHERE event_type IN ('purchase', 'error')) SELECT feed_id, count(*) FILTER (WHERE good IS NULL OR ts > good) AS consecutive_failures FROM r GROUP BY feed_id")
def failure_streak(spark, sf_dir):
    runs = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')").select(F.col("user_id").alias("feed_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("ok"))
    return lifecycle.failure_streak(runs)


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(c_name, o_orderpriority) AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200")
def recent_join3(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(200).select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("c_name", "o_orderpriority").alias("title"))


@query(f"WITH {_BOOKS} SELECT id, CASE WHEN origin_book_id % 10 > 0 THEN origin_book_id END AS origin_book_id FROM books WHERE id % 10 > 0")
def delete_cascade(spark, sf_dir):
    b = derived_books(spark, sf_dir)
    return lifecycle.delete_books({"books": b}, b.filter("id % 10 = 0").select("id"))["books"].select("id", "origin_book_id")


@query(f"WITH {_BOOKS} SELECT id, CASE WHEN id % 9 = 0 THEN 'New ' || id ELSE title END AS title, author FROM books")
def edit_whitelist(spark, sf_dir):
    b = books(spark, sf_dir)
    changes = b.filter("id % 9 = 0").select("id", F.concat(F.lit("New "), F.col("id").cast("string")).alias("title"), F.lit("x").alias("author"))
    return lifecycle.patch(b, changes, "id", ["title", "series"]).select("id", "title", "author")


@query(f"WITH {_BOOKS} SELECT id, CASE WHEN device_profile = '' THEN 'filled' ELSE device_profile END AS device_profile FROM books")
def refresh_blanks(spark, sf_dir):
    b = books(spark, sf_dir)
    return lifecycle.fill_blanks(b, b.select("id", F.lit("filled").alias("device_profile")), "id", ["device_profile"]).select("id", "device_profile")


@query("SELECT page_id AS id, page_id % 6 = 0 AS missing, (page_id % 6 = 0) <> (page_id % 4 = 0) AS flipped FROM pages")
def missing_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").cast("string").alias("file_path"), (F.col("page_id") % 4 == 0).alias("missing"))
    return lifecycle.mark_missing(p, p.filter("id % 6 > 0").select(F.col("file_path").alias("path"))).select("id", "missing", "flipped")


# ------------------------------------------------------------ text and html


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS visible FROM pages")
def visible_length(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.visible_length("html").cast("long").alias("visible"))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INT AS sentences FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences("text")).alias("sentences"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS body FROM documents")
def paragraph_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.paragraphs("text").alias("body"))


_VOTES = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stops)}))) AS {lang}" for lang, stops in text.STOP_WORDS.items())


@query(f"WITH v AS (SELECT doc_id, {_VOTES.replace(' AS ', ' AS v_')} FROM (SELECT doc_id, string_split_regex(lower(substr(text, 1, 20000)), '[^\\p{{L}}]+') AS w FROM documents)) SELECT doc_id, CASE WHEN greatest(v_pt, v_en, v_es, v_fr, v_de) = 0 THEN '' WHEN v_pt = greatest(v_pt, v_en, v_es, v_fr, v_de) THEN 'pt' WHEN v_en = greatest(v_en, v_es, v_fr, v_de) THEN 'en' WHEN v_es = greatest(v_es, v_fr, v_de) THEN 'es' WHEN v_fr >= v_de THEN 'fr' ELSE 'de' END AS language FROM v")
def language_vote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.guess_language("text").alias("language"))


_TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1))"


@query(f"WITH t AS (SELECT d.doc_id, {_TOKENS.format('d.text')} AS o, {_TOKENS.format('b.text')} AS s FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40) SELECT doc_id, CASE WHEN len(s) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(o, s))::DOUBLE / len(s) END AS coverage FROM t")
def token_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d")
    b = table(spark, sf_dir, "benchmark").alias("b")
    return d.join(b, F.col("b.item_id") == F.col("d.doc_id") % 40).select("doc_id", text.token_coverage("d.text", "b.text").alias("coverage"))


@query("SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS chapter FROM conversations")
def conversation_chapters(spark, sf_dir):
    return chapters.number_chapters(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "chapter")


_HEAD = rf"""(length(trim(line)) BETWEEN 1 AND 70 AND (regexp_matches(trim(line), '(?i)^(?:{chapters.HEADING_WORDS})([^\p{{L}}\p{{N}}_]|$)') OR (regexp_matches(trim(line), '^[\p{{Lu}}\p{{Nd}} .,:;!?''&-]{{4,}}$') AND regexp_matches(trim(line), '\p{{Lu}}{{2}}'))))"""


@query(rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS x FROM documents), l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS n FROM t),
  g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM (SELECT *, {_HEAD} AS head FROM l)),
  b AS (SELECT doc_id, part, coalesce(max(CASE WHEN head THEN trim(line) END), 'Início') AS title, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head) AS body FROM g GROUP BY doc_id, part)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS chapter, title, regexp_replace(body, '^\n+|\n+$', '', 'g') AS body FROM b WHERE length(trim(body)) > 0""")
def text_chapters(spark, sf_dir):
    return chapters.split_text(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CASE WHEN regexp_extract(html, '(?is)<html[^>]*\\blang\\s*=\\s*[\"'']?([A-Za-z]+)', 1) = '' THEN 'en' ELSE lower(regexp_extract(html, '(?is)<html[^>]*\\blang\\s*=\\s*[\"'']?([A-Za-z]+)', 1)) END AS language FROM pages")
def page_metadata(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title_of("html").alias("title"), html.language_of("html").alias("language"))


@query()
def page_chapters(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages")).select("page_id", html.page(F.col("html"), F.col("url")).alias("p"))
    return p.select("page_id", "p.title", "p.author", "p.language", "p.tags", F.posexplode("p.chapters").alias("chapter", "c")).select("page_id", "title", "author", "language", "tags", "chapter", F.col("c.title").alias("chapter_title"), F.length("c.body").alias("body_length"))


# -------------------------------------------------------- names and formats

_AGENTS = ["KOReader/2024.1", "CrossPoint x", " Mozilla/5.0 (X11) Gecko/20100101 Firefox/1", "curl/8", "", "mystery", "Dalvik/2.1 (Linux)"]
_RANGES = ["bytes=100-", "bytes=0-99", "", "bytes=0-1,5-6", "bytes", "bytes=-500", "bytes=0-"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_CASES = " ".join(f"WHEN contains(lower(u), '{part}') THEN '{family}'" for part, family in files.CLIENTS)


@query(f"WITH e AS (SELECT event_id, trim({_list(_AGENTS)}[event_id % 7 + 1]) AS u FROM events) SELECT event_id, CASE WHEN u = '' THEN NULL {_CASES} ELSE '{files.UNKNOWN_CLIENT}' END AS client, CASE WHEN u <> '' THEN substr(sha256(u), 1, 12) END AS client_key FROM e")
def client_family(spark, sf_dir):
    agent = _pick(_AGENTS, F.col("event_id") % 7)
    return table(spark, sf_dir, "events").select("event_id", files.client(agent).alias("c")).select("event_id", "c.*")


@query(f"SELECT event_id, [true, true, false, true, true, true, true][event_id % 7 + 1] AS range_request, [true, false, false, false, false, false, false][event_id % 7 + 1] AS resume, [true, false, true, false, false, false, true][event_id % 7 + 1] AS countable FROM events")
def range_flags(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.range_flags(_pick(_RANGES, F.col("event_id") % 7)).alias("r")).select("event_id", "r.*")


_NAMES = ["[Group] Deep Sea Vol. 03 (Ana Silva)", "Saga - 07 - The Return", "Runner 012", "plain_name_here", "Old Tale (1999)", "Nine v1.5"]


@query("SELECT event_id, ['Deep Sea 3', 'Saga 7 - The Return', 'Runner 12', 'plain name here', 'Old Tale (1999)', 'Nine 1.5'][event_id % 6 + 1] AS title, ['Ana Silva', NULL, NULL, NULL, NULL, NULL][event_id % 6 + 1] AS author, ['Deep Sea', 'Saga', 'Runner', NULL, NULL, 'Nine'][event_id % 6 + 1] AS series, [3.0, 7.0, 12.0, NULL, NULL, 1.5][event_id % 6 + 1]::DOUBLE AS series_index, [NULL, NULL, NULL, NULL, '1999', NULL][event_id % 6 + 1] AS published FROM events")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.parse_name(_pick(_NAMES, F.col("event_id") % 6)).alias("n")).select("event_id", "n.*")


@query("SELECT doc_id, round_even(n_chars / 1048576.0, 2)::DOUBLE AS mb, regexp_replace(lpad((doc_id * 7919 % 1000003)::VARCHAR, 13, '0'), '[^0-9X]', '', 'g') AS isbn FROM documents")
def sizes_and_isbn(spark, sf_dir):
    made = F.concat(F.lit("ISBN "), F.lpad((F.col("doc_id") * 7919 % 1000003).cast("string"), 13, "0"))
    return table(spark, sf_dir, "documents").select("doc_id", text.size_mb("n_chars").alias("mb"), files.isbn(made).alias("isbn"))


@query("""WITH d AS (SELECT doc_id, n_chars, CASE WHEN n_chars % 6 = 0 THEN 'pdf' WHEN n_chars % 6 = 1 THEN 'zip' WHEN n_chars % 6 = 2 THEN 'mobi' WHEN n_chars % 6 = 3 THEN 'jpg' END AS mark, CASE WHEN lang = 'en' THEN 'pdf' WHEN lang = 'de' THEN 'cbz' ELSE 'txt' END AS ext FROM documents)
  SELECT doc_id, CASE WHEN mark IS NULL OR (mark = 'zip' AND ext = 'cbz') THEN ext ELSE mark END AS resolved, mark IS NOT NULL AND mark <> ext AND NOT (mark = 'zip' AND ext = 'cbz') AS corrected FROM d""")
def sniff_magic(spark, sf_dir):
    """Texts behind the first bytes of a format, by their length; the language stands for the extension."""
    k = F.col("n_chars") % 6
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    blank = F.lit(bytearray(60))
    marked = F.when(k == 0, F.concat(F.lit(bytearray(b"%PDF-1.7")), body)).when(k == 1, F.concat(F.lit(bytearray(b"PK\x03\x04")), body)).when(k == 2, F.concat(blank, F.lit(bytearray(b"BOOKMOBI")), body)).when(k == 3, F.concat(F.lit(bytearray(b"\xff\xd8\xff\xe0")), body)).otherwise(body)
    ext = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "de", "cbz").otherwise("txt")
    return table(spark, sf_dir, "documents").select("doc_id", files.resolve(ext, marked).alias("r")).select("doc_id", F.col("r.format").alias("resolved"), F.col("r.corrected").alias("corrected"))


# ---------------------------------------------------- feeds, sitemaps, plans


@query("SELECT o_orderkey AS id, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, 'order ' || o_orderkey || ' x' AS title, o_orderdate::DATE AS date FROM orders WHERE o_orderdate >= DATE '1998-06-01' - INTERVAL 30 DAY")
def sitemap_posts(spark, sf_dir):
    loc = F.concat(F.lit("<url><loc> https://www.h.org/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/order-"), F.col("o_orderkey").cast("string"), F.lit("_x/ </loc></url><url><loc>https://h.org/2024/01/02/page</loc></url>"))
    xml = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("url")).agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("xml"))
    found = feeds.within_days(feeds.posts(feeds.sitemap_rows(xml)), 30, "1998-06-01")
    return found.select(F.regexp_extract("url", r"order-(\d+)_", 1).cast("long").alias("id"), "year", "month", "day", "title", "date")


@query("""WITH p AS (SELECT page_id, left(html, (600 * (page_id % 4))::INT) AS inl, CASE WHEN page_id % 3 = 0 THEN replace(html, '<p>', '<p><img src="x">') ELSE html END AS page FROM pages),
  f AS (SELECT *, length(inl) AS n, regexp_matches(inl, '(?i)<img\\b') AS has, page_id % 2 = 0 AS fine, octet_length(encode(page)) < greatest(2000, floor(length(inl) * 0.4)) AS thin, regexp_matches(page, '(?i)<img\\b') AS page_has FROM p)
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'podcast' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'article' ELSE 'file' END AS kind,
  CASE WHEN n >= 1000 AND has THEN 'inline' WHEN n >= 1000 AND fine AND NOT thin AND page_has THEN 'page' WHEN n >= 1000 THEN 'inline' WHEN fine AND NOT (thin AND n > 0) THEN 'page' WHEN n > 0 THEN 'inline_fallback' ELSE 'error' END AS source FROM f""")
def entry_outcome(spark, sf_dir):
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages").withColumn("inline", F.col("html").substr(F.lit(1), (i % 4 * 600).cast("int"))).withColumn("page", F.when(i % 3 == 0, F.replace("html", F.lit("<p>"), F.lit('<p><img src="x">'))).otherwise(F.col("html")))
    mime = _pick(["audio/mpeg", "application/pdf", "image/png", "text/html; charset=utf-8", "application/octet-stream"], i % 5)
    source = feeds.obtain(F.col("inline"), F.when(i % 2 == 0, "ok").otherwise("failed"), F.col("page"))
    return p.select("page_id", urls.kind(mime, F.array().cast("array<string>")).alias("kind"), source.alias("source"))


@query(f"""WITH {_BOOKS}, p AS (SELECT * FROM (VALUES ('kindle', 'azw3', 'epub_images', true), ('kobo', 'epub', 'cbz', true), ('', 'epub', 'pdf', false)) v(profile, preferred, comic, reflow))
  SELECT id, CASE WHEN id % 10 = 0 THEN 'cbz' WHEN content_type = 'comic' THEN CASE comic WHEN 'epub_images' THEN 'epub' ELSE comic END WHEN content_type = 'document' AND NOT reflow THEN CASE comic WHEN 'epub_images' THEN 'epub' ELSE comic END WHEN content_type = 'document' THEN preferred WHEN preferred = 'epub' AND format = 'epub' THEN 'epub' WHEN preferred <> 'epub' AND format <> 'epub' THEN 'epub' ELSE preferred END AS target,
  CASE WHEN id % 10 = 0 THEN content_type = 'comic' ELSE content_type = 'comic' OR (content_type = 'document' AND NOT reflow) END AS page_pipeline, id % 10 > 0 AND content_type = 'ebook' AND preferred = 'epub' AND format = 'epub' AS optimize FROM books JOIN p ON p.profile = books.device_profile""")
def profile_plan(spark, sf_dir):
    profiles = spark.createDataFrame([("kindle", "azw3", "epub_images", True), ("kobo", "epub", "cbz", True), ("", "epub", "pdf", False)], "profile string, preferred_format string, comic_output string, reflow_text boolean")
    b = books(spark, sf_dir).select(F.col("id").alias("book_id"), "format", "content_type", F.lit(False).alias("image_only"), F.lit(False).alias("pages"))
    j = books(spark, sf_dir).select(F.col("id").alias("book_id"), F.col("device_profile").alias("profile"), F.when(F.col("id") % 10 == 0, "CBZ").otherwise("").alias("target_format"))
    return planner.plan_jobs(j, b, profiles).select(F.col("book_id").alias("id"), "plan.target", "plan.page_pipeline", "plan.optimize")


# ------------------------------------------------------ records and reports

_NAMED = "SELECT r.file_id, r.book_id, r.state, 'file-' || r.file_id || '.epub' AS file_name, r.last_download_at FROM records r"


def _named(spark, sf_dir):
    return records(spark, sf_dir).withColumn("file_name", F.concat(F.lit("file-"), F.col("file_id").cast("string"), F.lit(".epub")))


@query(f"""WITH {_BOOKS}, {_RECORDS}, n AS ({_NAMED}) SELECT n.file_id, coalesce(nullif(b.title, ''), n.file_name) AS title FROM n LEFT JOIN books b ON b.id = n.book_id
  WHERE n.state = 'downloaded' AND (lower(n.file_name) LIKE '%1%' OR lower(coalesce(b.title, '')) LIKE '%1%') ORDER BY n.last_download_at DESC NULLS LAST, n.file_id LIMIT 10""")
def download_list(spark, sf_dir):
    return desk.download_list(_named(spark, sf_dir), books(spark, sf_dir), "downloaded", "1", per_page=10).select("file_id", "title")


@query(f"WITH {_RECORDS} SELECT file_id FROM records ORDER BY coalesce(last_download_at, updated_at) NULLS FIRST, file_id LIMIT 30")
def least_recent(spark, sf_dir):
    return desk.least_recent(records(spark, sf_dir), 30).select("file_id")


@query(f"WITH {_RECORDS} SELECT file_id, CASE book_id % 10 WHEN 0 THEN 'blocked' WHEN 1 THEN 'downloaded' ELSE state END AS state FROM records")
def set_state(spark, sf_dir):
    i = F.col("book_id")
    changes = records(spark, sf_dir).filter(i % 10 < 2).select("book_id", F.when(i % 10 == 0, "blocked").otherwise("downloaded").alias("new_state"))
    return desk.set_state(records(spark, sf_dir), changes.union(spark.createDataFrame([(-1, "deleted")], "book_id long, new_state string"))).select("file_id", "state")


@query(f"WITH {_EVENTS} SELECT event_id FROM ev WHERE file_id % 3 > 0")
def forget_events(spark, sf_dir):
    log = events(spark, sf_dir)
    return desk.forget(records(spark, sf_dir), log, log.filter("file_id % 3 = 0"))[1].select("event_id")


@query(f"""WITH {_BOOKS} SELECT id AS origin_book_id, CASE WHEN id % 2 = 0 THEN 'New ' || id ELSE title END AS title, author, series, coalesce(nullif((id % 4)::DOUBLE, 0), series_index) AS series_index, category_id, 'kobo' AS device_profile,
  lower(CASE WHEN id % 2 = 0 THEN 'New ' || id ELSE title END) AS sort_title, CASE WHEN id % 2 = 0 THEN 'New ' || id ELSE title END || ' [kobo].epub' AS file_name, 'import' AS source, false AS is_original FROM books WHERE id % 3 = 0""")
def derived_rows(spark, sf_dir):
    i = F.col("id")
    all_books = books(spark, sf_dir)
    made = all_books.filter(i % 3 == 0).select(i.alias("origin_id"), F.lit("kobo").alias("device_profile"), F.lit("epub").alias("format"), F.when(i % 2 == 0, F.concat(F.lit("New "), i.cast("string"))).otherwise("").alias("title"), (i % 4).cast("double").alias("series_index"))
    return desk.derived(made, all_books).drop("language", "description", "format")


@query(f"WITH {_BOOKS} SELECT o_orderkey AS request_id, o_custkey AS book_id, 'pending' AS status, 0 AS progress FROM orders WHERE o_custkey IN (SELECT id FROM books)")
def enqueue_known(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("book_id"))
    return desk.enqueue(wanted, books(spark, sf_dir), NOW).select("request_id", "book_id", "status", "progress")


@query(f"""WITH {_BOOKS}, {_RECORDS} SELECT o_orderkey AS request_id, CASE WHEN b.id IS NULL THEN 'unknown' WHEN EXISTS (SELECT 1 FROM records r WHERE r.book_id = b.id AND r.state IN ('blocked', 'deleted')) THEN 'hidden'
  WHEN b.id % 13 = 0 THEN 'invalid path' WHEN b.id % 4 = 1 THEN 'missing' ELSE 'ok' END AS outcome FROM orders LEFT JOIN books b ON b.id = o_custkey""")
def delivery_outcome(spark, sf_dir):
    i = F.col("id")
    shelved = books(spark, sf_dir).withColumn("file_path", F.concat(F.when(i % 13 == 0, "../").otherwise("shelf/"), i.cast("string")))
    files_ = shelved.filter(i % 4 != 1).select(F.col("file_path").alias("path"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("book_id"))
    return desk.delivery(wanted, shelved, records(spark, sf_dir), files_).select("request_id", "outcome")


@query("""SELECT n_name AS slug, CASE WHEN n_nationkey < 15 AND (n_nationkey < 5 OR n_nationkey % 2 = 0) THEN 'code ' || n_nationkey ELSE 'own' END AS name, n_nationkey < 5 OR n_nationkey % 2 = 0 AS builtin FROM nation""")
def profile_sync(spark, sf_dir):
    k = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    stored = nation.filter(k >= 5).select(F.col("n_name").alias("slug"), F.lit("own").alias("name"), F.lit("{}").alias("spec"), (k % 2 == 0).alias("builtin"))
    code = nation.filter(k < 15).select(F.col("n_name").alias("slug"), F.concat(F.lit("code "), k.cast("string")).alias("name"), F.lit("{}").alias("spec"))
    return desk.sync_profiles(stored, code).select("slug", "name", "builtin")


@query("SELECT page_id AS request_id, page_id = min(page_id) OVER (PARTITION BY url) AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0) AS created FROM pages")
def feed_conflicts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), "url")
    return desk.create_feeds(pages.filter("request_id % 4 = 0").select("url"), pages).select("request_id", "created")


@query("SELECT feed_id, book_id FROM (SELECT page_id % 5 AS feed_id, page_id AS book_id, row_number() OVER (PARTITION BY page_id % 5 ORDER BY length(html) DESC, url DESC) AS n FROM pages) WHERE n <= 7")
def latest_items(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("feed_id"), F.col("url").alias("guid"), F.col("page_id").alias("book_id"), F.length("html").alias("added_at"))
    return desk.latest_items(rows, 7).select("feed_id", "book_id")


@query(f"""WITH h AS (SELECT page_id, split_part({_NORMAL}, '/', 1) AS host FROM pages), f AS (SELECT host, min(page_id) AS feed_id FROM h WHERE page_id % 3 = 0 GROUP BY host)
  SELECT page_id, feed_id, (feed_id % 7)::BIGINT AS category_id FROM h LEFT JOIN f USING (host)""")
def feed_defaults(spark, sf_dir):
    host = F.split_part(urls.normal_form("url"), F.lit("/"), F.lit(1))
    posts = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    sources = posts.filter("page_id % 3 = 0").select(F.col("page_id").alias("id"), "host", (F.col("page_id") % 7).alias("category_id"))
    return desk.feed_defaults(posts, sources).drop("host")


@query(f"""WITH {_BOOKS}, f AS (SELECT id, sha256(coalesce(description, '')) AS h, CASE WHEN format = 'mobi' THEN 'skipped' WHEN coalesce(file_size, 0) < 20 THEN 'error' END AS bad FROM books),
  o AS (SELECT coalesce(bad, CASE WHEN h IN (SELECT h FROM f WHERE id % 9 = 0) OR id <> min(id) FILTER (WHERE bad IS NULL) OVER (PARTITION BY h) THEN 'duplicate' ELSE 'imported' END) AS outcome FROM f)
  SELECT s AS outcome, count(o.outcome) AS n FROM (VALUES ('imported'), ('duplicate'), ('skipped'), ('error')) v(s) LEFT JOIN o ON o.outcome = s GROUP BY s""")
def import_counts(spark, sf_dir):
    found = books(spark, sf_dir).select(F.col("id").alias("file_id"), "format", "file_size", F.sha2(F.coalesce("description", F.lit("")), 256).alias("content_hash"))
    outcomes = reports.import_outcomes(found, found.filter("file_id % 9 = 0"), F.col("format") != "mobi", F.coalesce("file_size", F.lit(0)) < 20)
    return reports.import_counts(outcomes)


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY page_id) AS n FROM pages) SELECT ['article', 'podcast', 'ebook'][page_id % 3 + 1] AS kind, count(*) AS n, count(*) FILTER (WHERE n <= 10) AS sampled FROM r WHERE n <= 200 GROUP BY 1")
def kinds_of_feed(spark, sf_dir):
    entries = table(spark, sf_dir, "pages").select("page_id", _pick(["article", "podcast", "ebook"], F.col("page_id") % 3).alias("kind"))
    return reports.kinds_of_feed(entries, "page_id")


@query("SELECT i AS id, count(page_id) AS items, count(CASE WHEN page_id % 2 = 0 THEN 1 END) AS books FROM range(7) t(i) LEFT JOIN pages ON page_id % 5 = i GROUP BY i")
def feed_counts(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("book_id", F.when(F.col("book_id") % 2 == 0, F.col("book_id")))
    return reports.feed_counts(spark.range(7), rows)


@query(f"WITH {_FEEDS}, e AS (SELECT id FROM feeds WHERE cleanup_enabled AND cleanup_days > 0), p AS (SELECT length(html) AS size, page_id % 2 = 0 AS done FROM pages WHERE page_id % 5 IN (SELECT id FROM e)) SELECT (SELECT count(*) FROM e) AS feeds, count(*) FILTER (WHERE done) AS removed, coalesce(sum(size) FILTER (WHERE done), 0)::BIGINT AS freed, count(*) FILTER (WHERE NOT done) AS skipped FROM p")
def retention_totals(spark, sf_dir):
    removed = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("feed_id"), (F.col("page_id") % 2 == 0).alias("done"), F.length("html").alias("freed"))
    return reports.retention_totals(feed_table(spark), removed)


@query(f"WITH {_BOOKS} SELECT count(format) AS books, least(count(DISTINCT author), 500) AS author, least(count(DISTINCT series), 500) AS series, (SELECT count(*) FROM region) AS categories FROM books")
def key_figures(spark, sf_dir):
    return reports.key_figures(books(spark, sf_dir), table(spark, sf_dir, "region"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS job_id, ts AS t, event_id AS seq, (event_id % 101)::INT AS percent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT *, percent >= 100 OR abs(percent + 1) >= 5 AS due FROM e WHERE n = 1),
  r AS (SELECT job_id, t, seq, percent, n, due, CASE WHEN due THEN percent ELSE -1 END AS last_percent, CASE WHEN due THEN t END AS last_t FROM f
    UNION ALL SELECT job_id, t, seq, percent, n, due, CASE WHEN due THEN percent ELSE last_percent END, CASE WHEN due THEN t ELSE last_t END
    FROM (SELECT e.*, r.last_percent, r.last_t, e.percent >= 100 OR (abs(e.percent - r.last_percent) >= 5 AND (r.last_t IS NULL OR epoch_us(e.t) - epoch_us(r.last_t) >= 1000000)) AS due FROM r JOIN e ON e.job_id = r.job_id AND e.n = r.n + 1))
  SELECT job_id, t AS "at", seq, percent FROM r WHERE due""")
def progress_writes(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (F.col("event_id") % 101).cast("int").alias("percent"))
    return desk.progress_writes(log)


# ------------------------------------------------------- pages and containers

_LINES = """lines AS (SELECT doc_id AS doc, (n // 4)::INT AS page, n AS line, t AS text, n % 4 IN (0, 3) AS edge, 10.0 + (length(t) + n) % 6 AS size, n % 2 = 0 AS bold, CASE WHEN n % 3 = 0 THEN 'B' ELSE 'A' END AS font
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as if laid out four to a page."""
    n = F.col("line")
    split = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    top = (n % 4) * F.lit(30.0)
    return split.select(
        "doc", F.floor(n / 4).cast("int").alias("page"), n.cast("long").alias("line"), "text", lines.at_edge(top, top + 10, F.lit(100.0)).alias("edge"), (F.lit(10.0) + (F.length("text") + n) % 6).alias("size"),
        (n % 2 == 0).alias("bold"), F.when(n % 3 == 0, "B").otherwise("A").alias("font"),
    )


@query(rf"WITH {_LINES}, k AS (SELECT *, lower(trim(regexp_replace(text, '\d+', '', 'g'))) AS key FROM lines), c AS (SELECT doc, key, count(*) AS repeats FROM k WHERE edge AND length(key) BETWEEN 2 AND 80 GROUP BY doc, key), p AS (SELECT doc, count(DISTINCT page) AS pages FROM k GROUP BY doc) SELECT doc, line, coalesce(repeats >= greatest(2, floor(pages * 0.4)), false) OR (edge AND regexp_matches(text, '(?i)^\s*[-–—]?\s*(?:\d{{1,4}}|[ivxlcdm]{{1,7}})\s*[-–—]?\s*$')) AS header FROM k JOIN p USING (doc) LEFT JOIN c USING (doc, key)")
def page_headers(spark, sf_dir):
    return chapters.running_headers(text_lines(spark, sf_dir)).select("doc", "line", "header")


@query(rf"""WITH {_LINES}, w AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, size / 10.0 AS ratio FROM lines), l AS (SELECT *, len(regexp_split_to_array(t, '\s+')) AS words, regexp_replace(regexp_extract(t, '^\S+'), '[.)]+$', '') AS label FROM w)
SELECT doc, line, CASE WHEN t = '' OR length(t) > 90 OR words > 16 OR regexp_matches(t, '[.,;]$') THEN 0 WHEN regexp_matches(t, '{lines.NUMBERED}') THEN least(3, length(label) - length(replace(label, '.', '')) + 1)
  WHEN lower(trim(t, '.:')) IN ({", ".join(f"'{x}'" for x in lines.TITLE_WORDS)}) OR (length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= 3 AND words <= 6 AND t = upper(t)) THEN CASE WHEN ratio >= 1.05 THEN 1 ELSE 2 END
  WHEN ratio >= 1.35 AND words <= 12 THEN 1 WHEN ratio >= 1.12 AND words <= 12 THEN 2 WHEN bold AND ratio >= 1.04 AND words <= 12 AND font <> 'A' THEN 2 ELSE 0 END AS level FROM l""")
def heading_levels(spark, sf_dir):
    level = lines.heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("font"), F.lit(10.0), F.lit("A"))
    return text_lines(spark, sf_dir).select("doc", "line", level.alias("level"))


@query(f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY size DESC, page, line) AS r FROM lines WHERE page <= 1 AND trim(text) <> '' AND length(text) <= 200)
SELECT doc, coalesce(a.text, '') AS title, CASE WHEN b.size >= 0.7 * a.size THEN b.text ELSE '' END AS author FROM (SELECT DISTINCT doc FROM lines) LEFT JOIN (SELECT * FROM r WHERE r = 1) a USING (doc) LEFT JOIN (SELECT * FROM r WHERE r = 2) b USING (doc)""")
def front_matter(spark, sf_dir):
    return lines.front_matter(text_lines(spark, sf_dir))


_BOXES = """boxes AS (SELECT l_orderkey AS doc, (l_partkey % 300)::DOUBLE AS x0, (l_partkey % 300 + l_quantity * 6)::DOUBLE AS x1, (l_suppkey * 7 % 700)::DOUBLE AS y0, (l_suppkey * 7 % 700 + 10)::DOUBLE AS y1, l_linenumber AS line, CASE WHEN l_orderkey % 4 > 0 THEN 300.0::DOUBLE END AS gutter FROM lineitem)"""


@query(f"""WITH {_BOXES}, g AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc) >= 6 THEN gutter END AS g FROM boxes), w AS (SELECT *, coalesce(x0 < g - 2 AND x1 > g + 2, false) AS wide FROM g),
b AS (SELECT *, (SELECT count(*) FROM w v WHERE v.doc = w.doc AND v.wide AND v.y1 <= w.y0 + 0.1)::INT AS band, CASE WHEN wide OR g IS NULL OR (x0 + x1) / 2 < g THEN 0 ELSE 1 END AS side FROM w)
SELECT doc, line, band, side, row_number() OVER (PARTITION BY doc ORDER BY band, NOT wide, side, y0, x0, line) AS place FROM b""")
def reading_order(spark, sf_dir):
    k, top = F.col("l_partkey") % 300, F.col("l_suppkey") * 7 % 700
    items = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber"), "l_orderkey")
    boxes = items.select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), k.cast("double").alias("x0"), (k + F.col("l_quantity") * 6).cast("double").alias("x1"), top.cast("double").alias("y0"), (top + 10).cast("double").alias("y1"),
        F.col("l_linenumber").alias("line"), F.when(F.col("l_orderkey") % 4 > 0, F.lit(300.0)).alias("gutter"),
    )
    return lines.reading_order(boxes).select("doc", "line", "band", "side", "place")


@query()
def plain_chapters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chapters.plain_chapters(F.col("text"))).alias("chapter", "c"))
    return docs.select("doc_id", "chapter", "c.title", "c.body")


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'Doc ' || doc_id ELSE source END AS title, source AS series, (doc_id % 20 + 1)::DOUBLE AS series_index, lang AS language, 1.0::DOUBLE AS page_count, CASE WHEN doc_id % 2 = 0 THEN 'rtl' END AS reading_direction FROM documents")
def comic_round_trip(spark, sf_dir):
    """Comic archives of documents, read again; a comic without a title has that of its series."""
    i = F.col("doc_id")
    text_of = lambda c: F.col(c).cast("string")
    about = F.struct(F.when(i % 3 > 0, F.concat(F.lit("Doc "), i.cast("string"))).alias("title"), text_of("source").alias("series"), (i % 20 + 1).cast("double").alias("series_index"), text_of("lang").alias("language"), F.when(i % 2 == 0, "rtl").alias("reading_direction"))
    page = F.array(F.struct(F.lit("p.PNG").alias("name"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")))
    read = table(spark, sf_dir, "documents").select("doc_id", containers.comic_metadata(containers.comic_archive(page, about)).alias("m"))
    return read.select("doc_id", *(f"m.{c}" for c in ("title", "series", "series_index", "language", "page_count", "reading_direction")))


def _two_chapters():
    chapter = lambda title, body: F.struct(F.lit(title).alias("title"), F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("body"))
    return F.array(chapter("One", F.concat(F.lit("row "), F.col("doc_id").cast("string"))), chapter("Two & last", F.col("lang").cast("string")))


@query("SELECT doc_id, k::INT AS place, 'c' || k || '.xhtml' AS key, ['One', 'Two & last'][k + 1] AS title, 1 AS level FROM documents, range(2) t(k)")
def epub_contents(spark, sf_dir):
    made = file_sources.epub(F.col("source"), F.lit("A"), F.col("lang"), _two_chapters())
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(containers.epub_contents(made)).alias("place", "c"))
    return rows.select("doc_id", "place", "c.*")


@query("SELECT doc_id, k::INT AS chapter, 'A B' AS author, ['One', 'Two & last'][k + 1] AS title, '<p>' || CASE WHEN k = 0 THEN 'row ' || doc_id ELSE coalesce(lang, '') END || '</p>' AS body FROM documents, range(2) t(k)")
def fictionbook_round_trip(spark, sf_dir):
    made = containers.fictionbook_file(F.col("source"), F.lit("A B"), F.col("lang"), _two_chapters())
    rows = table(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit(""))).select("doc_id", containers.fictionbook(made).alias("b"))
    return rows.select("doc_id", F.col("b.author").alias("author"), F.posexplode("b.chapters").alias("chapter", "c")).select("doc_id", "chapter", "author", "c.title", "c.body")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_page(spark, sf_dir)


from quillspark import catalog_queries, function_queries, page_queries, stream_queries  # noqa: E402, F401  (they register more)
