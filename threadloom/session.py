"""Session with the settings that the queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, **conf) -> SparkSession:
    """UTC, adaptive execution with skew handling. A cluster's own settings (master, memory, checkpoint folder) are kept."""
    builder = SparkSession.builder.appName("threadloom")
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
