"""A Spark session with the settings that the engine's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "saltmarsh", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, case-sensitive names, ANSI errors and adaptive execution; all else is the cluster's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
