"""Continuous ingestion and download lifecycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.links import new_items

LIFECYCLE_DDL = "file_id long, download_count long, first_download_at timestamp, last_download_at timestamp, active_downloads long, state string"


def unseen(entries: DataFrame) -> DataFrame:
    """Entries whose (feed_id, guid) never came before; the state is kept for good, as posts never return."""
    return entries.dropDuplicates(["feed_id", "guid"])


def ingest(batch: DataFrame, path: str, cap: int | None = None, batch_id: int | str | None = None) -> DataFrame:
    """New items of one batch, written to the item table at a path and read back.

    The table is its own seen set, with one folder a batch: items and their keys
    are kept by the same write.  A batch that comes again replaces its folder
    and sees what it saw before; without an id, running twice adds nothing.  Each
    batch reads all keys; for a long history ``seen`` reads those it needs.
    """
    spark = batch.sparkSession
    mine = f"{path}/batch_id={uuid4().hex if batch_id is None else batch_id}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    keys = "feed_id long, guid string"
    seen = spark.read.schema(f"{keys}, batch_id string").parquet(path).filter(F.col("batch_id") != mine.rsplit("=", 1)[1]).select("feed_id", "guid") if there else spark.createDataFrame([], keys)
    fresh = new_items(batch, seen, cap).withColumn("feed_id", F.col("feed_id").cast("long"))
    fresh.write.mode("overwrite").parquet(mine)
    return spark.read.schema(fresh.schema).parquet(mine)


def on_each_batch(path: str, sink: Callable[[DataFrame], None], cap: int | None = None) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: the sink gets each batch's new items.

    After a failure the same batch comes again with the same new items, so the
    sink gets each at least once and nothing is lost.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(ingest(batch, path, cap, batch_id))

    return run


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, first, last, opened = state.get if state.exists else (0, None, None, 0)
    for part in parts:
        done = part[(part["status"] == "completed") & part["countable"]]
        count += len(done)
        if len(done):
            first = min(x for x in (first, done["at"].min()) if x is not None)
            last = max(x for x in (last, done["at"].max()) if x is not None)
        opened += int((part["status"] == "started").sum()) - int((part["status"] != "started").sum())
    state.update((count, first, last, opened))
    yield pd.DataFrame([{"file_id": key[0], "download_count": count, "first_download_at": first, "last_download_at": last, "active_downloads": max(0, opened), "state": "downloaded" if count else "available"}])


def lifecycle(events: DataFrame) -> DataFrame:
    """The download fold as a stream: each batch returns the new totals of the files it touches.

    Each event must come once: rows carry no attempt here.  Where they may
    repeat or come late, ``attempts`` tells attempts apart by their number.  The
    state is one row a file, whatever the number of events; after any batch
    the last row of a file equals the batch fold over all its events so far.
    """
    state = "count long, first timestamp, last timestamp, opened long"
    return events.groupBy("file_id").applyInPandasWithState(_fold, LIFECYCLE_DDL, state, "update", GroupStateTimeout.NoTimeout)


def downloads_per_hour(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """Completed downloads by hour of event time; an extension that the recovery horizon bounds."""
    done = events.filter("status = 'completed'").withWatermark("at", late)
    return done.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("downloads"))
