"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; everything else is the cluster's to decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
