"""The driver's tables, and its events as an earthquake catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as a catalog: users are places on a grid, values are magnitudes."""
    return (table(spark, sf_dir, "events") if events is None else events).selectExpr(
        "CAST(event_id AS STRING) AS id",
        "CAST(ts AS TIMESTAMP) AS time",
        "35.5D + (user_id % 28) * 0.25D + 0.125D AS latitude",
        "25.5D + (CAST(floor(user_id / 28) AS BIGINT) % 78) * 0.25D + 0.125D AS longitude",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) AS depth",
        "2.5D + bround(value / 115.13D, 1) AS mag",
        "event_type AS magType",
        "concat('user-', user_id) AS place",
    )


#: The same for DuckDB, as a common table `cat`.
CATALOG_SQL = """cat AS (
    SELECT CAST(event_id AS VARCHAR) AS id, ts AS time,
        CAST(35.5 AS DOUBLE) + (user_id % 28) * CAST(0.25 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS latitude,
        CAST(25.5 AS DOUBLE) + (CAST(floor(user_id / 28) AS BIGINT) % 78) * CAST(0.25 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS longitude,
        CAST(props->>'k' AS DOUBLE) AS depth,
        CAST(2.5 AS DOUBLE) + round_even(value / CAST(115.13 AS DOUBLE), 1) AS mag,
        event_type AS magtype, concat('user-', user_id) AS place FROM events)"""
