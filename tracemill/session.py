"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tracemill", **settings: str) -> SparkSession:
    """UTC, ANSI off (unparsable numbers become null in lenient reads) and adaptive plans; partition counts are left to the cluster."""
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=own | settings).getOrCreate()
