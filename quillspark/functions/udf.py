"""Vectorised functions that are made when they are called: no session is needed to import a module."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes a core below which an input is small: what Spark takes for the cost of opening a file.
SMALL = 4 << 20
#: Rows of an Arrow batch of pages: a worker holds a batch, as strings and as results, several times.
BATCH_ROWS = 200


def vectorised(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(function, ddl)(*columns)

        return call

    return wrap


def _bytes(frame: DataFrame, files: list[str]) -> int:
    spark = frame.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, files))


def spread(frame: DataFrame) -> DataFrame:
    """The frame with a task for each core where its files are too few and small to give as many; a large input stays as it is.

    For functions that read whole pages: Arrow batches of the caller's session get small enough for these.
    """
    spark = frame.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    cores, files = spark.sparkContext.defaultParallelism, frame.inputFiles()
    if not files or len(files) >= cores:
        return frame
    return frame.repartition(cores) if _bytes(frame, files) < cores * SMALL else frame


def dealt(frame: DataFrame, *keys: str, share: int = SMALL) -> DataFrame:
    """The frame dealt by keys to a task for each ``share`` bytes of its files, one a core at least: a task's part doesn't grow with the input.

    Windows and groups by these keys and any others need no further exchange.
    """
    tasks = -(-_bytes(frame, frame.inputFiles()) // share)
    return frame.repartition(max(frame.sparkSession.sparkContext.defaultParallelism, tasks), *keys)
