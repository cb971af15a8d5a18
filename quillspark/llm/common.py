"""What the operators share: column selection, the shared folder, Arrow batches, sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts can be long, so fewer than Spark's default.
BATCH_ROWS = 1000


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches small enough for texts."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id as long and the text, null as empty; other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where that is unset, in local mode only."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write the frame to the shared folder and read it again: cuts the lineage, survives lost executors.

    The table is deleted when the driver ends, or before by ``unstage``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_staged_at", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows at most of a table of dropped rows that is broadcast (some 40 bytes each); more are joined by key.
MAX_BROADCAST_ROWS = 1 << 19


def row_key(text_col: str = "text") -> list[Column]:
    """What tells rows apart: doc_id (null or not) and a 64-bit hash of the text, as __none, __id, __text."""
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return [F.col("doc_id").isNull().alias("__none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), text.alias("__text")]


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows of ``dropped``: __none, __id, __text, one (boolean), one row a key.

    Where ``one`` is true one of the rows with that key stays.  Texts move only
    if the dropped rows are too many to broadcast, and those of which one stays.
    """
    key = ["__none", "__id", "__text"]
    dropped = stage(dropped.select(*key, "one"), "dropped")
    n, ones = dropped.agg(F.count("*"), F.count(F.when(F.col("one"), 1))).first()
    # one column for all of the caller's, whatever their names
    keyed = docs.select(F.struct("*").alias("row"), *row_key())
    if not n:
        return docs
    sent = F.broadcast if n <= MAX_BROADCAST_ROWS else lambda df: df
    kept = keyed.join(sent(dropped.select(*key)), key, "left_anti")
    if ones:
        again = keyed.join(sent(dropped.filter("one").select(*key)), key, "left_semi")
        kept = kept.unionByName(again.dropDuplicates(key))
    return kept.select("row.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
