"""The bucketed seen set: exact, replaced by batches that come again, and cheap to ask."""

import random

import pytest

from quillspark.streaming.runs import drain_batches
from quillspark.streaming.seen import SeenKeys, on_each_batch

DDL = "feed_id long, guid string, title string"


def guids(frame):
    return sorted((r.feed_id, r.guid) for r in frame.collect())


def test_batches(spark, tmp_path):
    rng, index, seen = random.Random(1), SeenKeys(spark, str(tmp_path / "i"), 8), set()
    for batch in range(6):
        rows = [(rng.randrange(3), f"g{rng.randrange(60)}", "t") for _ in range(25)]
        fresh = index.fresh(spark.createDataFrame(rows, DDL), batch)
        assert guids(fresh) == sorted({r[:2] for r in rows} - seen) and fresh.columns == ["feed_id", "guid", "title"]
        index.add(fresh, batch)
        seen |= {r[:2] for r in rows}
        if batch == 3:
            index.merge(2)
            assert index._folders() == ["upto=2", "batch=3"]
    again = SeenKeys(spark, str(tmp_path / "i"), 99)
    assert again.buckets == 8
    every = spark.createDataFrame([(f, f"g{g}", "t") for f in range(3) for g in range(60)], DDL)
    assert guids(again.fresh(every, 6)) == sorted({(f, f"g{g}") for f in range(3) for g in range(60)} - seen)


def test_batch_comes_again(spark, tmp_path):
    index = SeenKeys(spark, str(tmp_path / "i"), 4)
    index.add(spark.createDataFrame([(1, "a", "")], DDL), 0)
    second = spark.createDataFrame([(1, "a", ""), (1, "b", ""), (None, "c", ""), (2, None, ""), (1, "b", "")], DDL)
    for _ in range(2):
        fresh = index.fresh(second, 1)
        assert guids(fresh) == [(1, "b")]
        index.add(fresh, 1)
    assert guids(index.fresh(second, 2)) == [] and index.fresh(second.limit(0), 3).count() == 0


def test_stream(spark, tmp_path):
    at, ids = str(tmp_path / "in"), [[1, 2, 3], [2, 4], [1, 5], [6], [4, 6, 7]]
    index = SeenKeys(spark, str(tmp_path / "i"), 4)
    run = on_each_batch(index, str(tmp_path / "out"), merged=2)
    failed = []

    def breaks_once(batch, batch_id):
        run(batch, batch_id)
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after writing")

    for k, part in enumerate(ids):
        spark.createDataFrame([(1, f"g{i}", "t") for i in part], DDL).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema(DDL).parquet(at)
        if k == 2:
            with pytest.raises(Exception, match="lost after writing"):
                drain_batches(stream, breaks_once, str(tmp_path / "c"))
        drain_batches(spark.readStream.schema(DDL).parquet(at), breaks_once, str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.guid for r in got.collect()) == [f"g{i}" for i in range(1, 8)]


def scanned(spark, frame):
    """Rows that the scans of a query give, by its own metrics."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    return sum(int(n) for n in _scans(plan))


def _scans(node):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _scans(node.executedPlan())
        return
    if "QueryStage" in name:
        yield from _scans(node.plan())
        return
    if name.startswith("Scan parquet"):
        metric = node.metrics().get("numOutputRows")
        yield metric.get().value() if metric.isDefined() else 0
    for k in range(node.children().size()):
        yield from _scans(node.children().apply(k))


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    index = SeenKeys(spark, str(tmp_path / "i"), 64)
    history = spark.range(20_000).selectExpr("id % 7 AS feed_id", "concat('https://h.org/', id) AS guid", "'t' AS title")
    index.add(history, 0)
    read = {}
    for n in (1, 8):
        new = spark.createDataFrame([(1, f"new {i}", "t") for i in range(n)], DDL)
        mine = [r[0] for r in new.select(index._bucket().alias("b")).distinct().collect()]
        prints = index._read("prints", "print int", mine)
        read[n] = scanned(spark, prints)
        assert guids(index.fresh(new, 1)) == [(1, f"new {i}") for i in range(n)]
    assert read[1] < 20_000 / 64 * 2 and read[1] < read[8] < 20_000 / 64 * 8 * 1.5
    known = spark.createDataFrame([(3, "https://h.org/10", "t")], DDL)
    assert guids(index.fresh(known, 1)) == []
