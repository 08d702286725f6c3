"""A session with the settings the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tectra", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
