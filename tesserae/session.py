"""Session defaults: adaptive execution, UTC, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(name: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession.Builder:
    """A session builder with the engine's settings; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b
