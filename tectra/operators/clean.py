"""Cleaning, summarising and merging of catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tectra.functions import exprs, ordering
from tectra.schemas import CATALOG, CATALOG_COLUMNS, REQUIRED


def conform(raw: DataFrame) -> DataFrame:
    """The catalog's columns, in order and typed; missing ones are null, others go."""
    kinds = dict(raw.dtypes)
    out = []
    for c, kind in (x.split() for x in CATALOG.split(", ")):
        if c not in kinds:
            col = F.lit(None)
        elif c == "time":
            col = exprs.utc_time(F.col(c), kinds[c])
        elif kind == "double":
            col = exprs.number(F.col(c))
        else:
            col = F.col(c)
        out.append(col.cast(kind).alias(c))
    return raw.select(out)


def one_per_id(df: DataFrame, order: list, last: bool = False) -> DataFrame:
    """One row of each id, the first or last by `order`; rows without an id stay, each for itself.

    The choice is an aggregate, combined before the shuffle, so that an id that very many rows share is no burden."""
    own = df.columns
    pick = (F.max_by if last else F.min_by)(F.struct(*own), F.struct(*order))
    known = df.filter("id is not null").groupBy("id").agg(pick.alias("r")).select("r.*")
    return known.select(own).unionByName(df.filter("id is null"))


def clean_catalog(raw: DataFrame, order: list | None = None) -> DataFrame:
    """Typed rows with time, place and magnitude; of equal ids the first by `order` (time, else); by time. Adds year and interevent_days,
    null in the first row. Nulls in other columns stay; an empty catalog stays empty."""
    df = conform(raw).dropna(subset=REQUIRED)
    rest = ["time", "latitude", "longitude", "mag", F.coalesce("depth", F.lit(float("inf"))), F.coalesce("magType", F.lit("")), F.coalesce("place", F.lit(""))]
    df = one_per_id(df, order or rest)
    df = ordering.with_index(df, "time", "id", "latitude", "longitude", "mag")
    rows, w = ordering.with_rows_before(df, 1)
    gap = exprs.days((exprs.micros(F.col("time")) - F.lag(exprs.micros(F.col("time"))).over(w)).cast("double"))
    rows = rows.withColumn("year", F.year("time")).withColumn("interevent_days", gap)
    return ordering.own_rows(rows).select(*CATALOG_COLUMNS, "year", "interevent_days")


def completeness_summary(df: DataFrame) -> DataFrame:
    """One row; all but the count null if there are no events."""
    median = ordering.quantile(df, exprs.finite(F.col("depth")), 0.5)
    return df.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(exprs.micros(F.col("time"))).alias("date_min"),
        F.max(exprs.micros(F.col("time"))).alias("date_max"),
        F.min("mag").alias("mag_min"),
        F.max("mag").alias("mag_max"),
        F.lit(median).cast("double").alias("depth_median_km"),
    )


def in_region(df: DataFrame, region) -> DataFrame:
    return df.filter(exprs.in_box(F.col("latitude"), F.col("longitude"), region))


def at_least(df: DataFrame, min_mag: float) -> DataFrame:
    return df.filter(F.col("mag") >= min_mag)


def merge_events(archive: DataFrame, new: DataFrame) -> DataFrame:
    """The archive with new events: of equal ids the new one, and among new ones the later by `ord` if there is one."""
    def typed(df, source):
        ordinal = F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")
        return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("r"), ordinal.alias("ord"), F.lit(source).alias("source")).select("r.*", F.col("source").alias("__source"), F.col("ord").alias("__ord"))

    def shaped(df, source):
        marks = typed(df, source)
        kinds = dict(df.dtypes)
        cols = []
        for c, kind in (x.split() for x in CATALOG.split(", ")):
            col = F.lit(None) if c not in kinds else exprs.utc_time(F.col(c), kinds[c]) if c == "time" else exprs.number(F.col(c)) if kind == "double" else F.col(c)
            cols.append(col.cast(kind).alias(c))
        return marks.select(*cols, "__source", "__ord")

    both = shaped(archive, 0).unionByName(shaped(new, 1))
    tie = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CATALOG_COLUMNS]
    return one_per_id(both, ["__source", "__ord", *tie], last=True).select(CATALOG_COLUMNS)


def coverage_gaps(intervals: DataFrame, start: str = "start", end: str = "end", by: list[str] | None = None) -> DataFrame:
    """Stretches that no interval covers, between the first start and the last end: gap_start, gap_end. Intervals are few: a row a run."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("gap_start", F.max(end).over(w)).filter(F.col("gap_start") < F.col(start)).select(*by, "gap_start", F.col(start).alias("gap_end"))


def quantile_split(df: DataFrame, fraction: float) -> DataFrame:
    """Adds is_train: time up to the quantile (linear between events)."""
    cut = ordering.quantile(df, exprs.micros(F.col("time")), fraction)
    return df.withColumn("is_train", exprs.micros(F.col("time")) <= F.lit(cut).cast("double"))
