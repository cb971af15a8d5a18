"""Registered queries that run a stream over what is there: cut into slices, with late and repeated rows, stopped after each."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.queries import events, query, table
from quillspark.shared import shared_dir
from quillspark.sources import feed_source
from quillspark.streaming.attempts import attempt_outcomes
from quillspark.streaming.backfill import backfill
from quillspark.streaming.ingest import downloads_per_hour
from quillspark.streaming.runs import drain, drain_batches
from quillspark.streaming.seen import SeenKeys, on_each_batch

SLICES = 3


def _sliced(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the slice in which they come: by time, a tenth one slice late, and a tenth again in the next one."""
    span = rows.agg(F.min(F.unix_micros("at")).alias("low"), ((F.max(F.unix_micros("at")) - F.min(F.unix_micros("at"))) / SLICES + 1).alias("step"))
    mine = F.least(F.floor((F.unix_micros("at") - F.col("low")) / F.col("step")).cast("int"), F.lit(SLICES - 1))
    # one row of bounds
    cut = rows.join(F.broadcast(span), F.lit(True)).withColumn("slice", mine)
    late = F.least(F.col("slice") + (F.col(key) % 10 == 3).cast("int"), F.lit(SLICES - 1))
    again = F.least(F.col("slice") + 1, F.lit(SLICES - 1))
    return cut.withColumn("slice", F.explode(F.when(F.col(key) % 10 == 7, F.array(late, again)).otherwise(F.array(late)))).drop("low", "step")


def _in_slices(rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark, at = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/stream-{uuid4().hex}"
    _sliced(rows, key).write.partitionBy("slice").parquet(f"{at}/all")
    schema = rows.schema
    for k in range(SLICES):
        spark.read.schema(schema).parquet(f"{at}/all/slice={k}").write.mode("append").parquet(f"{at}/in")
        out = drain(make(spark.readStream.schema(schema).parquet(f"{at}/in")), f"{at}/out", f"{at}/checkpoint")
    return out


#: Three events are an attempt: views and sign-ups begin it, others close it.
_ATTEMPTS = """a AS (SELECT event_id // 3 AS attempt_id, event_id // 3 % 97 AS file_id, ts AS t, CASE WHEN event_type IN ('view', 'signup') THEN 'started' WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'error' ELSE 'interrupted' END AS status, event_id % 7 > 0 AS countable FROM events)"""


@query(f"""WITH {_ATTEMPTS}, mark AS (SELECT epoch_ms(max(t)) - 12 * 86400000 AS ms FROM a), s AS (SELECT attempt_id, any_value(file_id) AS file_id, min(t) AS began FROM a WHERE status = 'started' GROUP BY attempt_id),
  c AS (SELECT s.*, min((a.t, a.status, a.countable)) AS first FROM s LEFT JOIN a ON a.attempt_id = s.attempt_id AND a.status <> 'started' AND a.t BETWEEN began AND began + INTERVAL 5 MINUTES GROUP BY ALL),
  o AS (SELECT attempt_id, file_id, coalesce(first[2], 'interrupted') AS status, coalesce(first[3], false) AS countable, began AS started_at, coalesce(first[1], began + INTERVAL 5 MINUTES) AS finished_at FROM c)
  SELECT o.* FROM o, mark WHERE epoch_ms(finished_at) < ms""")
def attempts_streamed(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind.isin("view", "signup"), "started").when(kind == "purchase", "completed").when(kind == "error", "error").otherwise("interrupted")
    attempt = F.floor(i / 3)
    rows = table(spark, sf_dir, "events").select("event_id", attempt.alias("attempt_id"), (attempt % 97).alias("file_id"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), (i % 7 > 0).alias("countable"))
    return _in_slices(rows, "event_id", lambda s: attempt_outcomes(s, 300, "12 days"))


#: Orders are the posts that forty sitemaps show, on one of 23 days.
_POSTS = """p AS (SELECT o_custkey % 40 AS feed_id, 'https://f' || (o_custkey % 40) || '.org/' || o_orderkey AS url, DATE '2024-01-20' - (o_orderkey % 60)::INT AS day, TIMESTAMP '2024-01-01 06:00:00' + INTERVAL 1 DAY * (o_orderkey * 7 % 23) + INTERVAL 20 MINUTES * (o_orderkey % 3) AS t FROM orders)"""


@query(f"""WITH RECURSIVE {_POSTS}, f AS (SELECT feed_id, list({{'day': day, 'url': url, 't': t}}) AS posts FROM p GROUP BY feed_id), mark AS (SELECT max(t) - INTERVAL 9 DAYS AS upto FROM p),
  r AS (SELECT feed_id, -1 AS run, NULL::TIMESTAMP AS run_at, posts AS remain, posts[1:0] AS batch, 0 AS imported, 0 AS total, true AS done FROM f
    UNION ALL SELECT feed_id, run + 1, run_at, list_filter(remain, lambda x: x.t > run_at OR (x.day >= (run_at::DATE - 30) AND NOT list_contains(batch, x))), batch, imported + len(batch), imported + len(todo), len(todo) <= len(batch) FROM
      (SELECT *, todo[1:9] AS batch FROM (SELECT *, list_sort(list_filter(list_transform(remain, lambda x: {{'k': DATE '2100-01-01' - x.day, 'url': x.url, 'day': x.day, 't': x.t}}), lambda x: x.t <= run_at AND x.day >= run_at::DATE - 30)) AS sorted, list_transform(sorted, lambda x: {{'day': x.day, 'url': x.url, 't': x.t}}) AS todo FROM
        (SELECT feed_id, run, remain, imported, greatest(list_min(list_transform(remain, lambda x: x.t)), coalesce(run_at + INTERVAL 1 HOUR, TIMESTAMP '1970-01-01')) AS run_at FROM r WHERE len(remain) > 0))))
  SELECT feed_id, unnest(list_transform(batch, lambda x: x.url)) AS url, run_at, run, unnest(range(len(batch)))::INT AS place, imported::BIGINT AS imported, total::BIGINT AS total, done FROM r, mark WHERE run >= 0 AND run_at < upto""")
def backfill_runs(spark, sf_dir):
    i = F.col("o_orderkey")
    day = F.date_sub(F.lit("2024-01-20").cast("date"), (i % 60).cast("int"))
    at = F.timestamp_seconds(F.lit(1704088800) + i * 7 % 23 * 86400 + i % 3 * 1200)
    feed = F.col("o_custkey") % 40
    rows = table(spark, sf_dir, "orders").select(i.alias("post"), feed.alias("feed_id"), F.concat(F.lit("https://f"), feed.cast("string"), F.lit(".org/"), i.cast("string")).alias("url"), day.alias("day"), at.alias("at"))
    return _in_slices(rows, "post", lambda s: backfill(s, 9, 30, "9 days"))


@query("""WITH e AS (SELECT event_type AS kind, user_id % 3 AS feed_id, 'u' || user_id || '/' || event_type AS guid, event_id FROM events), b AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) / 3.0 AS step FROM e)
  SELECT feed_id, guid, min(least(2, floor((event_id - low) / step)))::INT AS batch_id FROM e, b GROUP BY feed_id, guid""")
def new_by_batch(spark, sf_dir):
    """Events are feed entries, told again and again; each stands in the batch that brought it first."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i, (F.col("user_id") % 3).alias("feed_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("guid"))
    span = rows.agg(F.min(i).alias("low"), ((F.max(i) - F.min(i)) / 3.0).alias("step"))
    # one row of bounds
    cut = rows.join(F.broadcast(span), F.lit(True)).withColumn("slice", F.least(F.lit(2), F.floor((i - F.col("low")) / F.col("step"))))
    at = f"{shared_dir(spark)}/seen-{uuid4().hex}"
    entries = cut.select("slice", "feed_id", "guid")
    entries.write.partitionBy("slice").parquet(f"{at}/all")
    run = on_each_batch(SeenKeys(spark, f"{at}/index", 16), f"{at}/new", merged=2)
    for k in range(SLICES):
        spark.read.parquet(f"{at}/all/slice={k}").write.mode("append").parquet(f"{at}/in")
        drain_batches(spark.readStream.schema("feed_id long, guid string").parquet(f"{at}/in"), run, f"{at}/checkpoint")
    return spark.read.schema("feed_id long, guid string, batch_id int").parquet(f"{at}/new")


#: Ten pages are a feed, each shown by one of two polls; what is after the title tag's text is its article.
_SHOWN = """s AS (SELECT page_id, page_id // 10 AS feed_id, (page_id % 2)::INT AS poll, url, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, html FROM pages)"""


@query(f"""WITH {_SHOWN} SELECT poll, feed_id, (row_number() OVER (PARTITION BY poll, feed_id ORDER BY page_id) - 1)::INT AS position, url AS guid, CASE WHEN title <> '' THEN title END AS title, url, sha256(trim(html)) AS html_sha256 FROM s""")
def feeds_streamed(spark, sf_dir):
    """Pages go out as feed documents and come back through the data source, a poll at a time."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    i = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    pages = table(spark, sf_dir, "pages").select(i, "url", "html", title.alias("title"))
    item = F.concat(F.lit("<item><guid>"), escaped("url"), F.lit("</guid><link>"), escaped("url"), F.lit("</link><title>"), escaped("title"), F.lit("</title><description>"), escaped("html"), F.lit("</description></item>"))
    # ten pages a document
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))), lambda x: x["item"])
    documents = pages.groupBy(F.floor(i / 10).alias("feed_id"), (i % 2).cast("int").alias("poll")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(ordered, ""), F.lit("</channel></rss>")).alias("xml"))
    at = f"{shared_dir(spark)}/feeds-{uuid4().hex}"
    feed_source.register(spark)
    for poll in range(2):
        documents.filter(F.col("poll") == poll).select("feed_id", F.col("xml").alias("value")).write.partitionBy("feed_id").text(f"{at}/polls/poll={poll}")
        stream = spark.readStream.format("feeds").load(f"{at}/polls").filter("error IS NULL")
        out = drain(stream.select("poll", "feed_id", "position", "guid", "title", "url", F.sha2("inline_html", 256).alias("html_sha256")), f"{at}/out", f"{at}/checkpoint")
    return out


@query("""WITH d AS (SELECT ts FROM events WHERE event_type = 'purchase' AND event_id % 10 <> 7), mark AS (SELECT max(ts) - INTERVAL 12 DAY AS upto FROM d)
  SELECT date_trunc('hour', ts) AS hour, count(*) AS downloads FROM d, mark WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= date_trunc('milliseconds', upto) GROUP BY 1""")
def downloads_by_hour(spark, sf_dir):
    """Hours that no late row can change any more; each event comes once here, some of them late."""
    rows = events(spark, sf_dir).filter(F.col("event_id") % 10 != 7)
    out = _in_slices(rows, "event_id", lambda s: downloads_per_hour(s, "12 days").select(F.col("window.start").alias("hour"), "downloads"))
    return out.select("hour", "downloads")
