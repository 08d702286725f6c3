"""Out-of-time skill of a ranked surface."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tectra.functions import exprs, tables
from tectra.operators import clean, risk
from tectra.schemas import CatalogError, Region


def _checked(counts: DataFrame, n: str) -> DataFrame:
    bad = count_fault(F.col(n)).isNotNull()
    return counts.withColumn(n, F.when(bad, F.raise_error(F.lit("counts have to be finite and not negative")).cast("double")).otherwise(F.col(n).cast("double")))


def count_fault(n: Column) -> Column:
    """Why a count is refused; null where it is sound."""
    x = n.cast("double")
    return F.when(x.isNull(), "missing").when(F.isnan(x) | (F.abs(x) == float("inf")), "not finite").when(x < 0, "negative")


def area_skill(counts: DataFrame, place: str, n: str) -> DataFrame:
    """area_skill_score of cells in descending risk (`place` from 1): twice the area under the share captured, less 1; four digits. No
    events are an error. Cells are a few thousand, so one window holds them."""
    c = _checked(counts.select(place, n), n)
    run = c.select(F.sum(n).over(Window.orderBy(place)).alias("y"), F.col(n), F.sum(n).over(Window.partitionBy()).alias("t"), F.count(F.lit(1)).over(Window.partitionBy()).alias("k"))
    share = F.when(F.col("t") > 0, F.col("t")).otherwise(F.raise_error(F.lit("no events to score")).cast("double"))
    area = F.sum((F.col("y") + F.col("y") - F.col(n)) / share / (2 * F.col("k")))
    return run.agg(exprs.half_even(2 * area - 1, 4).alias("area_skill_score"))


def concentration_gain(counts: DataFrame, place: str, n: str, fraction: float = 0.25) -> DataFrame:
    """gain: share of events in the first part of the cells over that part; four digits."""
    if not 0 < fraction <= 1:
        raise CatalogError("the fraction has to be in (0, 1]")
    c = _checked(counts.select(place, n), n)
    k = F.greatest(F.lit(1.0), exprs.half_even(F.count(F.lit(1)).over(Window.partitionBy()) * fraction))
    c = c.withColumn("k", k)
    a = c.agg(F.sum(F.when(F.col(place) <= F.col("k"), F.col(n)).otherwise(0.0)).alias("top"), F.sum(n).alias("all"), F.max("k").alias("k"), F.count(F.lit(1)).alias("cells"))
    total = F.when(F.col("all") > 0, F.col("all")).otherwise(F.raise_error(F.lit("no events to score")).cast("double"))
    return a.select(exprs.half_even(F.col("top") / total / (F.col("k") / F.col("cells")), 4).alias("gain"))


def area_skill_ci(counts: DataFrame, place: str, n: str, n_boot: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """low, high: events resampled over cells. Resamples are shared out over tasks, each with a seed of its own; the cells' counts, a few
    thousand numbers, go along."""
    values = np.array([r[0] for r in _checked(counts.select(place, n), n).orderBy(place).select(n).collect()], float)
    if not values.sum() > 0:
        raise CatalogError("no events to score")

    def run(frames):
        p, total, k = values / values.sum(), int(values.sum()), len(values)
        for f in frames:
            out = []
            for boot in f["id"]:
                y = np.cumsum(np.random.default_rng([seed, int(boot)]).multinomial(total, p)) / total
                out.append(2 * ((y + np.concatenate([[0], y[:-1]])) / (2 * k)).sum() - 1)
            yield pd.DataFrame({"s": out})

    a = (1 - confidence) / 2
    boots = counts.sparkSession.range(n_boot).mapInPandas(run, "s double")
    return boots.agg(exprs.half_even(F.percentile("s", F.lit(a)), 4).alias("low"), exprs.half_even(F.percentile("s", F.lit(1 - a)), 4).alias("high"))


def surface_counts(df: DataFrame, region: Region, *, min_mag: float = 4.0, cell_deg: float = 0.25, test_frac: float = 0.25, recent_years: float = 10.0) -> DataFrame:
    """place, lat_bin, lon_bin, risk_index, n: cells of the surface of the earlier events, with the later strong events in each."""
    parts = clean.quantile_split(df, 1.0 - test_frac)
    cells = risk.risk_cells(parts.filter("is_train").drop("is_train"), region, cell_deg=cell_deg, min_mag=min_mag, recent_years=recent_years)
    lat, lon = exprs.cell_bins(F.col("latitude"), F.col("longitude"), region, cell_deg)
    hits = parts.filter(~F.col("is_train") & (F.col("mag") >= min_mag)).groupBy(lat.alias("lat_bin"), lon.alias("lon_bin")).agg(F.count(F.lit(1)).alias("n"))
    out = cells.select("lat_bin", "lon_bin", "risk_index").join(hits, ["lat_bin", "lon_bin"], "left").fillna({"n": 0})
    return out.withColumn("place", F.row_number().over(risk.ordered(out)))


def surface_skill(df: DataFrame, region: Region, n_boot: int = 0, seed: int = 0, **options) -> DataFrame:
    """area_skill_score, gain_top25, ci_low, ci_high, n_train_cells, n_test_events; scores are null where no later event falls into a cell."""
    counts = tables.written(surface_counts(df, region, **options).coalesce(1))
    a = counts.agg(F.count(F.lit(1)).alias("n_train_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_test_events"))
    total = F.sum("n").over(Window.partitionBy())
    hit = counts.withColumn("t", total).filter("t > 0")
    y = F.sum("n").over(Window.orderBy("place"))
    k = F.count(F.lit(1)).over(Window.partitionBy())
    parts = hit.select("place", "n", "t", y.alias("y"), k.alias("k"), F.greatest(F.lit(1.0), exprs.half_even(k * 0.25)).alias("top"))
    s = parts.agg(
        exprs.half_even(2 * F.sum((2 * F.col("y") - F.col("n")) / F.col("t") / (2 * F.col("k"))) - 1, 4).alias("area_skill_score"),
        exprs.half_even(F.sum(F.when(F.col("place") <= F.col("top"), F.col("n")).otherwise(0)) / F.max("t") / (F.max("top") / F.max("k")), 4).alias("gain_top25"),
    )
    out = a.crossJoin(s)
    if n_boot and counts.agg(F.sum("n")).first()[0]:
        return out.crossJoin(area_skill_ci(counts, "place", "n", n_boot, seed=seed).withColumnsRenamed({"low": "ci_low", "high": "ci_high"}))
    return out.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
