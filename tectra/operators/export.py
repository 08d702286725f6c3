"""GeoJSON features and stamps of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.functions import exprs

_JSON = {"ignoreNullFields": "false"}
_SIGNALS = ["annual_rate", "recent_rate", "recency_days", "energy_index", "mean_depth", "shallow_fraction"]


def _json(c: Column) -> Column:
    return F.to_json(c, _JSON)


def cell_features(cells: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """lat_bin, lon_bin, feature: a square polygon a cell; missing depths are nulls, never NaN."""
    h = cell_deg / 2
    corner = lambda dx, dy: F.array(F.col("lon") + dx * h, F.col("lat") + dy * h)
    ring = F.array(*[corner(*c) for c in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    parts = [F.round(F.col(c), 3).alias(c) for c in cells.columns if c.endswith("_component")]
    props = F.struct("risk_model", "risk_index", *[exprs.finite(F.col(c)).alias(c) for c in _SIGNALS], *parts, F.round("max_mag", 1).alias("max_mag"), "n_events", "n_recent")
    return cells.select("lat_bin", "lon_bin", _json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("feature"))


def event_features(df: DataFrame, min_mag: float = 6.0) -> DataFrame:
    """id, feature: a point an event."""
    props = F.struct(F.round("mag", 1).alias("mag"), F.date_format("time", "yyyy-MM-dd").alias("date"), F.coalesce("place", F.lit("")).alias("place"))
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return df.filter(F.col("mag") >= min_mag).select("id", _json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties"))).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """A feature a line, in as many files as there are tasks: a collection of any size that map tools read line by line."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def collection(features: DataFrame, order: list[str]) -> DataFrame:
    """One row with the whole collection as JSON, for a surface of a few thousand cells (`write_features` is for more)."""
    key = F.struct(*order, "feature")
    all_ = F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["feature"]), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), all_, F.lit("]}")).alias("json"))


def meta_stamp(cells: DataFrame, strong: DataFrame, skill: DataFrame, mc: DataFrame, **fixed) -> DataFrame:
    """One row json: counts, skill and completeness beside the values in `fixed` (source, region, cell_deg, min_mag, texts)."""
    one = cells.agg(F.count(F.lit(1)).alias("n_cells")).crossJoin(strong.agg(F.count(F.lit(1)).alias("n_big_events"))).crossJoin(skill).crossJoin(mc)
    return one.select(_json(F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], "mc", "area_skill_score", F.when(F.col("ci_low").isNotNull(), F.array("ci_low", "ci_high")).alias("area_skill_score_ci"), "gain_top25", "n_test_events", "n_cells", "n_big_events")).alias("json"))


def etas_warning(n: Column) -> Column:
    return F.when(n.isNull(), "the branching ratio is undefined; a diagnostic fit only").when(n > 1, "super-critical: a diagnostic fit, not for use as it is").otherwise("sub-critical fit on one split; a diagnostic only")


def etas_stamp(fits: DataFrame, source: str) -> DataFrame:
    """zone, json of each fitted row of `fit_zones`."""
    r = lambda c, d: exprs.half_even(F.col(c), d).alias(c)
    core = F.struct(F.lit(source).alias("source"), r("mu", 5), r("K", 5), r("c", 5), r("p", 4), r("alpha", 4), r("b_value", 3), exprs.half_even(F.col("branching"), 3).alias("branching_ratio"), exprs.half_even(100 * F.col("skill_climatology"), 1).alias("skill_vs_climatology_pct"), F.col("n_windows").alias("n_test_windows"), etas_warning(F.col("branching")).alias("warning"))
    rj = F.struct(F.lit(-1.67).alias("a"), F.lit(1.0).alias("b"), F.lit(1.08).alias("p"), F.lit(0.05).alias("c"))
    return fits.filter("status = 'fitted'").select("zone", _json(F.struct(core.alias("canonical_etas"), rj.alias("rj_aftershock"))).alias("json"))
