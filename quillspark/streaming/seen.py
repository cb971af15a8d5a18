"""A seen set for streams that reads what a batch asks about, not the whole history.

Keys are dealt to buckets by hash.  Each bucket has a filter, the keys' 32-bit
prints, beside the keys themselves.  A batch reads the filters of its own
buckets; only a bucket whose filter knows one of the batch's keys is read in
full and settles it.  New keys of a batch are one folder, which a batch that
comes again replaces; folders are merged from time to time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new index; an index keeps those that it began with.
BUCKETS = 256
#: Batch folders that are merged into one.
MERGED = 32


class SeenKeys:
    """An index of (feed_id, guid) at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        known = [int(n.split("=")[1]) for n in self._names("") if n.startswith("buckets=")]
        self.buckets = known[0] if known else buckets
        if not known:
            self._fs.mkdirs(self._paths(f"{self.path}/buckets={buckets}"))

    def _names(self, under: str) -> list[str]:
        at = self._paths(f"{self.path}/{under}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _folders(self, without: int | None = None) -> list[str]:
        """Complete folders, the last merged one and the batches after it."""
        names = [n for n in self._names("batches") if self._fs.exists(self._paths(f"{self.path}/batches/{n}/keys/_SUCCESS"))]
        merged = max((int(n.split("=")[1]) for n in names if n.startswith("upto=")), default=-1)
        later = [n for n in names if n.startswith("batch=") and int(n.split("=")[1]) > merged and int(n.split("=")[1]) != without]
        return ([f"upto={merged}"] if merged >= 0 else []) + sorted(later)

    def _read(self, kind: str, ddl: str, buckets: list[int], without: int | None = None) -> DataFrame:
        places = [f"{self.path}/batches/{n}/{kind}" for n in self._folders(without)]
        schema = f"{ddl}, bucket int"
        if not places or not buckets:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).option("basePath", p).parquet(p) for p in places]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.filter(F.col("bucket").isin(buckets))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("feed_id", "guid"), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _print() -> Column:
        # another seed than the bucket's hash
        return F.shiftright(F.xxhash64(F.lit(7), "feed_id", "guid"), 32).cast("int")

    def fresh(self, entries: DataFrame, batch_id: int) -> DataFrame:
        """Rows of a batch (feed_id, guid, ...) whose key no other batch had, one for each key; nothing is written."""
        columns = entries.columns
        keyed = entries.filter("feed_id IS NOT NULL AND guid IS NOT NULL").dropDuplicates(["feed_id", "guid"])
        keyed = keyed.select(F.struct(*columns).alias("row"), F.col("feed_id").cast("long").alias("feed_id"), "guid", self._bucket().alias("bucket"), self._print().alias("print")).persist()
        # as many rows as buckets, at most
        mine = [r[0] for r in keyed.select("bucket").distinct().collect()]
        near = keyed.join(self._read("prints", "print int", mine, batch_id), ["bucket", "print"], "left_semi").select("feed_id", "guid", "bucket")
        doubtful = [r[0] for r in near.select("bucket").distinct().collect()]
        seen = near.join(self._read("keys", "feed_id long, guid string", doubtful, batch_id), ["bucket", "feed_id", "guid"], "left_semi")
        out = keyed.join(seen, ["bucket", "feed_id", "guid"], "left_anti").select("row.*")
        out._held = keyed  # for whoever is done with the batch to let go
        return out

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Write a batch's keys and their prints; a batch that comes again replaces its folder."""
        rows = keys.select(F.col("feed_id").cast("long").alias("feed_id"), "guid").select("feed_id", "guid", self._bucket().alias("bucket"), self._print().alias("print"))
        self._write(rows, f"batch={batch_id}")

    def _write(self, rows: DataFrame, name: str) -> None:
        at = f"{self.path}/batches/{name}"
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "print")
        # the keys come last: a folder without them isn't complete
        dealt.select("print", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/prints")
        dealt.select("feed_id", "guid", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/keys")

    def merge(self, upto: int) -> None:
        """Put the folders of all batches up to ``upto`` into one; what comes again later must be a later batch."""
        old = [n for n in self._folders() if n.startswith("upto=") or int(n.split("=")[1]) <= upto]
        if len(old) < 2:
            return
        keys = None
        for n in old:
            part = self.spark.read.schema("feed_id long, guid string, bucket int").parquet(f"{self.path}/batches/{n}/keys")
            keys = part if keys is None else keys.unionByName(part)
        self._write(keys.select("feed_id", "guid", "bucket", self._print().alias("print")), f"upto={upto}")
        for n in old:
            if n != f"upto={upto}":
                self._fs.delete(self._paths(f"{self.path}/batches/{n}"), True)


def on_each_batch(index: SeenKeys, path: str, merged: int = MERGED):
    """For ``writeStream.foreachBatch``: each batch's new items go to a folder of the table at ``path`` and their keys to the index.

    The items are written first: if the keys are lost, the batch comes again,
    sees what it saw before and replaces both.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = index.fresh(batch, batch_id)
        at = f"{path}/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(at)
        fresh._held.unpersist()
        index.add(index.spark.read.schema(fresh.schema).parquet(at), batch_id)
        if batch_id % merged == merged - 1:
            index.merge(batch_id - 1)

    return run
