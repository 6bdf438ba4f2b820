"""A Spark session with the settings that this engine wants."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Only what is neutral to the cluster's own sizing.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "forkline", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map={**SETTINGS, **more}).getOrCreate()
