"""Magnitude statistics, the hazard raster and exploratory tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tectra.functions import exprs, ordering
from tectra.schemas import DAY_US, YEAR_DAYS, CatalogError, Region


def _magnitudes(df: DataFrame) -> DataFrame:
    return df.select(exprs.finite(F.col("mag")).alias("mag")).dropna()


def frequency_magnitude(df: DataFrame, bin_width: float = 0.1) -> DataFrame:
    """bin_idx, bin_center, incremental, cumulative (events at or above the bin); empty bins too. No rows without magnitudes.

    Bins start at the least magnitude floored to the width; an event's bin is that whose computed edges hold it.
    """
    mags = _magnitudes(df)
    w = F.lit(float(bin_width))
    lo = F.floor(F.min("mag") / w) * w
    span = mags.agg(lo.alias("lo"), (F.rint((F.max("mag") - lo) / w) + 1).cast("int").alias("n")).dropna()
    edge = lambda i: F.col("lo") + w * i.cast("double")
    k = F.floor((F.col("mag") - F.col("lo")) / w).cast("int")
    k = F.when(F.col("mag") < edge(k), k - 1).when(F.col("mag") >= edge(k + 1), k + 1).otherwise(k)
    k = F.when((k == F.col("n")) & (F.col("mag") == edge(F.col("n"))), F.col("n") - 1).otherwise(k)
    counts = mags.crossJoin(F.broadcast(span)).groupBy(k.alias("bin_idx")).agg(F.count(F.lit(1)).alias("incremental"))
    bins = span.select("lo", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin_idx"))
    all_bins = bins.join(counts, "bin_idx", "left").select("bin_idx", (edge(F.col("bin_idx")) + w / 2).alias("bin_center"), F.coalesce("incremental", F.lit(0)).cast("long").alias("incremental"))
    return all_bins.withColumn("cumulative", F.sum("incremental").over(Window.orderBy(F.desc("bin_idx"))))


def completeness_magnitude(df: DataFrame, bin_width: float = 0.1) -> DataFrame:
    """mc: centre of the first fullest bin plus 0.2, to two digits."""
    fmd = frequency_magnitude(df, bin_width)
    top = fmd.agg(F.max_by("bin_center", F.struct("incremental", -F.col("bin_idx"))).alias("c"))
    return top.select(exprs.half_even(F.col("c") + 0.2, 2).alias("mc")).dropna()


def b_value(df: DataFrame, mc: float, bin_width: float = 0.1) -> DataFrame:
    """b, sigma, a, mc, n by maximum likelihood over magnitudes of at least mc (less 1e-9). Fewer than two events or a mean at the
    threshold are an error when the row is computed."""
    m = _magnitudes(df).filter(F.col("mag") >= mc - 1e-9)
    s = m.agg(F.count(F.lit(1)).alias("n"), F.avg("mag").alias("mean"), F.var_pop("mag").alias("var"))
    denom = F.col("mean") - F.lit(mc - bin_width / 2)
    bad = (F.col("n") < 2) | (denom <= 0)
    b = F.when(bad, F.raise_error(F.lit("too few events above the completeness magnitude")).cast("double")).otherwise(F.lit(math.log10(math.e)) / denom)
    s = s.withColumn("b", b)
    sigma = F.lit(2.30) * F.col("b") * F.col("b") * F.sqrt(F.col("var") * F.col("n") / (F.col("n") * (F.col("n") - 1)))
    return s.select("b", sigma.alias("sigma"), (F.log10("n") + F.col("b") * mc).alias("a"), F.lit(float(mc)).alias("mc"), "n")


def grid_size(lo: float, hi: float, cell_deg: float) -> int:
    return max(1, math.ceil((hi - lo) / cell_deg - 1e-9))


def span_years(df: DataFrame) -> DataFrame:
    """years: of all the catalog, not only of what a threshold leaves; an error if there is no span."""
    s = df.agg(((F.max(exprs.micros(F.col("time"))) - F.min(exprs.micros(F.col("time")))) / float(DAY_US) / YEAR_DAYS).alias("y"))
    return s.select(F.when(F.coalesce(F.col("y"), F.lit(0.0)) <= 0, F.raise_error(F.lit("the catalog spans no time")).cast("double")).otherwise(F.col("y")).alias("years"))


def hazard_cells(df: DataFrame, region: Region, cell_deg: float = 0.25, min_mag: float = 4.0) -> DataFrame:
    """Cells with events: lat_bin, lon_bin, lat, lon, n_events, annual_rate. Points outside the box go; its upper edges belong to it."""
    n_lat, n_lon = grid_size(region.min_lat, region.max_lat, cell_deg), grid_size(region.min_lon, region.max_lon, cell_deg)
    hits = df.filter(F.col("mag") >= min_mag).select(exprs.edge_bin(F.col("latitude"), region.min_lat, cell_deg, n_lat).alias("lat_bin"), exprs.edge_bin(F.col("longitude"), region.min_lon, cell_deg, n_lon).alias("lon_bin"))
    counts = hits.dropna().groupBy("lat_bin", "lon_bin").agg(F.count(F.lit(1)).alias("n_events"))
    centre = lambda b, lo: exprs.half_even(F.lit(lo) + (F.col(b) + 0.5) * cell_deg, 3)
    out = counts.crossJoin(F.broadcast(span_years(df)))
    return out.select("lat_bin", "lon_bin", centre("lat_bin", region.min_lat).alias("lat"), centre("lon_bin", region.min_lon).alias("lon"), "n_events", exprs.half_even(F.col("n_events") / F.col("years"), 4).alias("annual_rate"))


def hazard_raster(df: DataFrame, region: Region, cell_deg: float = 0.25, min_mag: float = 4.0) -> DataFrame:
    """Every cell of the box, also the empty ones, with log10 of its rate (null where the rate is 0). Its size is that of the grid."""
    n_lat, n_lon = grid_size(region.min_lat, region.max_lat, cell_deg), grid_size(region.min_lon, region.max_lon, cell_deg)
    spark = df.sparkSession
    grid = spark.range(n_lat * n_lon).select((F.col("id") / n_lon).cast("int").alias("lat_bin"), (F.col("id") % n_lon).cast("int").alias("lon_bin"))
    cells = hazard_cells(df, region, cell_deg, min_mag).select("lat_bin", "lon_bin", "n_events", "annual_rate")
    full = grid.join(cells, ["lat_bin", "lon_bin"], "left").fillna({"n_events": 0, "annual_rate": 0.0})
    return full.withColumn("log10_rate", F.when(F.col("annual_rate") > 0, F.log10("annual_rate")))


def top_cells(cells: DataFrame, k: int) -> DataFrame:
    return cells.orderBy(F.desc("annual_rate"), "lat_bin", "lon_bin").limit(k)


THRESHOLDS = (2.5, 3.5, 4.0, 4.5)


def counts_by_period(df: DataFrame, period, thresholds=THRESHOLDS) -> DataFrame:
    """period and a count of events at or above each threshold, in one pass."""
    return df.groupBy(period.alias("period")).agg(*[F.count_if(F.col("mag") >= t).alias(f"n_m{str(t).replace('.', '')}") for t in thresholds])


def compare_periods(df: DataFrame, first: tuple, second: tuple, period, per: float, thresholds=THRESHOLDS) -> DataFrame:
    """Mean counts in two closed ranges of periods, a row a threshold: threshold, total, mean_first, mean_second."""
    p = period
    aggs = []
    for t in thresholds:
        hit = F.col("mag") >= t
        aggs.append(F.struct(F.lit(t).alias("threshold"), F.count_if(hit).alias("total"), (F.count_if(hit & p.between(*first)) / per).alias("mean_first"), (F.count_if(hit & p.between(*second)) / per).alias("mean_second")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def depth_histogram(df: DataFrame, bins: int = 60, top: float = 200.0) -> DataFrame:
    """bin, n: equal bins over the range of depths cut at `top`, the last one closed; all bins."""
    d = df.select(F.least(exprs.finite(F.col("depth")), F.lit(top)).alias("d")).dropna()
    r = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.least(F.lit(bins - 1), F.when(width > 0, F.floor((F.col("d") - F.col("lo")) / width)).otherwise(0)).cast("int")
    counts = d.crossJoin(F.broadcast(r)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return d.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna({"n": 0})


def fmd_plot(df: DataFrame, bin_width: float = 0.1) -> DataFrame:
    """bin_center, cumulative, and incremental no less than 0.1, for a logarithmic axis."""
    f = frequency_magnitude(df, bin_width)
    return f.select("bin_center", "cumulative", F.greatest(F.col("incremental").cast("double"), F.lit(0.1)).alias("incremental"))


def epicentres(df: DataFrame, min_mag: float = 4.0) -> DataFrame:
    """id, longitude, latitude, mag of all events, and whether they are strong."""
    return df.select("id", "longitude", "latitude", "mag", F.coalesce(F.col("mag") >= min_mag, F.lit(False)).alias("is_strong"))


def cumulative_strong(df: DataFrame, min_mag: float = 4.5) -> DataFrame:
    """id, time_us, n: how many strong events there have been by then."""
    strong = df.filter(F.col("mag") >= min_mag)
    return ordering.with_index(strong, "time", "id", index="n").select("id", exprs.micros(F.col("time")).alias("time_us"), "n")


def require(ok: bool, message: str) -> None:
    if not ok:
        raise CatalogError(message)
