"""The session that the library is used with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "marginalia", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins; time in UTC. Further settings as ``conf``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
