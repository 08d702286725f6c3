"""The surface of relative risk, its bands, and the layer of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tectra.functions import exprs
from tectra.schemas import DAY_US, YEAR_DAYS, Region

# The model's name and its weights.
RISK_MODEL = "v2_afad_multi_signal"
WEIGHTS = {"rate": 0.22, "magnitude": 0.18, "recent": 0.18, "energy": 0.18, "recency": 0.16, "shallow": 0.08}


def risk_cells(df: DataFrame, region: Region, *, cell_deg: float = 0.25, min_mag: float, recent_years: float = 10.0, shallow_km: float = 15.0) -> DataFrame:
    """A row a cell with its signals, their ranks (the components) and risk_index (0 to 100).

    Cells outside the box stay. Span and last event are the whole catalog's; no span is an error. Null depths are
    neither shallow nor counted in the mean. One pass over the events and one shuffle of partial sums; the ranks go
    over cells alone.
    """
    if "depth" not in df.columns:
        df = df.withColumn("depth", F.lit(None).cast("double"))
    us = exprs.micros(F.col("time"))
    span = df.agg(F.max(us).alias("t_max"), ((F.max(us) - F.min(us)) / float(DAY_US) / YEAR_DAYS).alias("years"))
    span = span.select("t_max", F.when(F.coalesce(F.col("years"), F.lit(0.0)) <= 0, F.raise_error(F.lit("the catalog spans no time")).cast("double")).otherwise(F.col("years")).alias("years"))
    lat_bin, lon_bin = exprs.cell_bins(F.col("latitude"), F.col("longitude"), region, cell_deg)
    recent = us.cast("double") >= F.col("t_max") - recent_years * YEAR_DAYS * DAY_US
    rows = df.filter(F.col("mag") >= min_mag).crossJoin(F.broadcast(span))
    cells = rows.groupBy(lat_bin.alias("lat_bin"), lon_bin.alias("lon_bin"), "t_max", "years").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max("mag").alias("max_mag"),
        F.avg("depth").alias("depth"),
        F.avg(F.coalesce(F.col("depth") <= shallow_km, F.lit(False)).cast("int")).alias("shallow"),
        F.sum(F.pow(F.lit(10.0), 1.5 * F.col("mag"))).alias("energy"),
        F.max(us).alias("last"),
        F.count_if(recent).alias("n_recent"),
    )
    cells = cells.select(
        "lat_bin",
        "lon_bin",
        (F.lit(region.min_lat) + (F.col("lat_bin") + 0.5) * cell_deg).alias("lat"),
        (F.lit(region.min_lon) + (F.col("lon_bin") + 0.5) * cell_deg).alias("lon"),
        "n_events",
        "n_recent",
        "max_mag",
        exprs.half_even(F.col("n_events") / F.col("years"), 4).alias("annual_rate"),
        exprs.half_even(F.col("n_recent") / F.lit(float(recent_years)), 4).alias("recent_rate"),
        exprs.half_even((F.col("t_max") - F.col("last")) / float(DAY_US), 1).alias("recency_days"),
        exprs.half_even(F.log10("energy"), 2).alias("energy_index"),
        exprs.half_even(F.col("depth"), 1).alias("mean_depth"),
        exprs.half_even(F.col("shallow"), 3).alias("shallow_fraction"),
    )
    ranked = {"rate": F.col("annual_rate"), "magnitude": F.col("max_mag"), "recent": F.col("recent_rate"), "energy": F.col("energy_index"), "recency": -F.col("recency_days"), "shallow": F.col("shallow_fraction")}
    cells = cells.select("*", *[exprs.percent_rank_average(c).alias(f"risk_{k}_component") for k, c in ranked.items()])
    total = sum((F.lit(w) * F.col(f"risk_{k}_component") for k, w in WEIGHTS.items()), F.lit(0.0))
    return cells.withColumn("risk_index", exprs.half_even(total * 100.0, 0).cast("int")).withColumn("risk_model", F.lit(RISK_MODEL))


def top_risk(cells: DataFrame, k: int) -> DataFrame:
    return cells.orderBy(F.desc("risk_index"), "lat_bin", "lon_bin").limit(k)


def risk_band(index: Column) -> Column:
    return F.when(index >= 85, "very high").when(index >= 70, "high").when(index >= 55, "mid-high").when(index >= 40, "mid").otherwise("low")


def amplification_band(amp: Column) -> Column:
    return F.when(amp >= 2.0, 4).when(amp >= 1.6, 3).when(amp >= 1.3, 2).when(amp >= 1.1, 1).otherwise(0)


# Colours of the risk index, of amplification and of liquefaction.
RISK_COLOURS = [(85, "#d10000"), (70, "#ff3b00"), (55, "#ff8c00"), (40, "#ffd500"), (0, "#6b6b1a")]
AMP_COLOURS = [(2.0, "#54278f"), (1.6, "#756bb1"), (1.3, "#9e9ac8"), (1.1, "#cbc9e2")]
AMP_LEAST = "#f2f0f7"
LIQUEFACTION_COLOURS = {"yüksek": "#d10000", "orta": "#ff8c00", "düşük": "#ffd500", "çok düşük": "#6b6b1a"}
OTHER_COLOUR = "#333"


def _steps(value: Column, steps: list[tuple], least: str) -> Column:
    out = F.lit(least)
    for bound, colour in sorted(steps):
        out = F.when(value >= bound, colour).otherwise(out)
    return out


def metric_colour(metric: str, index: Column, amp: Column, liquefaction: Column, site: Column) -> Column:
    """A cell's colour by the metric shown: risk, amp, liq or site_risk. A cell without a site has amplification 1 and site risk 0."""
    if metric == "amp":
        return _steps(F.coalesce(amp, F.lit(1.0)), AMP_COLOURS, AMP_LEAST)
    if metric == "liq":
        known = F.create_map(*[F.lit(x) for pair in LIQUEFACTION_COLOURS.items() for x in pair])
        return F.coalesce(F.try_element_at(known, liquefaction), F.lit(OTHER_COLOUR))
    return _steps(F.coalesce(site, F.lit(0)) if metric == "site_risk" else index, RISK_COLOURS, RISK_COLOURS[-1][1])


def polygon_centre(ring: Column) -> tuple[Column, Column]:
    """Latitude and longitude, four digits, midway between a square's first and third corner ([lon, lat])."""
    middle = lambda k: exprs.half_even((ring[0][k] + ring[2][k]) / 2, 4)
    return middle(1), middle(0)


def displayed(cells: DataFrame, least: int = 40) -> DataFrame:
    return cells.filter(F.col("risk_index") >= least)


def lookup(cells: DataFrame, points: DataFrame, region: Region, cell_deg: float = 0.25) -> DataFrame:
    """points: latitude, longitude and more; with the columns of the cell that holds each, null where there is none."""
    lat, lon = exprs.cell_bins(F.col("latitude"), F.col("longitude"), region, cell_deg)
    return points.withColumns({"lat_bin": lat, "lon_bin": lon}).join(cells, ["lat_bin", "lon_bin"], "left")


# --- sites ---------------------------------------------------------------------------------------------------------

# Slope below which a speed holds, and the speed above all of them.
SLOPE_VS30 = [(3e-4, 150.0), (3.5e-3, 240.0), (1e-2, 300.0), (1.8e-2, 360.0), (5e-2, 490.0), (0.1, 620.0)]
ROCK_VS30 = 760.0
STENCIL_DEG = 0.02


def stencil(cells: DataFrame, d: float = STENCIL_DEG) -> DataFrame:
    """Five points a cell: lat_bin, lon_bin, lat, lon, side, p_lat, p_lon."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), (F.col("lat") + dy).alias("p_lat"), (F.col("lon") + dx).alias("p_lon")) for s, dx, dy in (("c", 0.0, 0.0), ("e", d, 0.0), ("w", -d, 0.0), ("n", 0.0, d), ("s", 0.0, -d))])
    return cells.select("lat_bin", "lon_bin", "lat", "lon", F.inline(sides))


def coordinate_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f,%.4f", lat, lon)


def slope(e: Column, w: Column, n: Column, s: Column, lat: Column, d: float = STENCIL_DEG) -> Column:
    dx = (e - w) / (2 * d * 111320.0 * F.cos(F.radians(lat)))
    return F.hypot(dx, (n - s) / (2 * d * 110540.0))


def vs30(slope: Column) -> Column:
    a, out = F.abs(slope), F.lit(ROCK_VS30)
    for bound, speed in reversed(SLOPE_VS30):
        out = F.when(a < bound, speed).otherwise(out)
    return out


def site_class(v: Column) -> Column:
    return F.when(v >= 1500, "A").when(v >= 760, "B").when(v >= 360, "C").when(v >= 180, "D").otherwise("E")


def amplification(v: Column, ref: float = 760.0) -> Column:
    return exprs.half_even(exprs.clamp(F.sqrt(F.lit(ref) / v), 0.8, 3.0), 2)


def liquefaction_score(v: Column, elevation: Column, slope: Column, precipitation: Column | None = None) -> Column:
    parts = [exprs.clamp((760.0 - v) / 610.0, 0, 1), exprs.clamp((500.0 - elevation) / 500.0, 0, 1), exprs.clamp((0.02 - F.abs(slope)) / 0.02, 0, 1)]
    if precipitation is None:
        weights = (0.50, 0.30, 0.20)
    else:
        weights, parts = (0.45, 0.25, 0.18, 0.12), [*parts, exprs.clamp(precipitation / 1000.0, 0, 1)]
    out = F.lit(weights[0]) * parts[0]
    for w, p in zip(weights[1:], parts[1:]):
        out = out + F.lit(w) * p
    return out


def liquefaction_class(score: Column) -> Column:
    return F.when(score >= 0.66, "yüksek").when(score >= 0.42, "orta").when(score >= 0.22, "düşük").otherwise("çok düşük")


def site_risk(index: Column, amp: Column, ref: float = 1.15) -> Column:
    return exprs.clamp(exprs.half_even(index * amp / F.lit(ref)), 0, 100).cast("int")


def site_metrics(cells: DataFrame, elevations: DataFrame) -> DataFrame:
    """cells with lat, lon, risk_index; elevations: key, elevation. A cell's stencil is looked up by key; a missing one makes nulls."""
    points = stencil(cells).withColumn("key", coordinate_key(F.col("p_lat"), F.col("p_lon"))).join(elevations, "key", "left")
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("elevation"))).alias(s)
    five = points.groupBy("lat_bin", "lon_bin").agg(*map(at, "cewns"))
    out = cells.join(five, ["lat_bin", "lon_bin"])
    out = out.withColumn("slope", slope(F.col("e"), F.col("w"), F.col("n"), F.col("s"), F.col("lat"))).withColumnRenamed("c", "elevation").drop(*"ewns")
    out = out.withColumn("vs30", F.when(F.col("slope").isNotNull(), vs30(F.col("slope")))).withColumn("site_class", F.when(F.col("vs30").isNotNull(), site_class(F.col("vs30"))))
    score = liquefaction_score(F.col("vs30"), F.col("elevation"), F.col("slope"))
    out = out.withColumn("amp", amplification(F.col("vs30"))).withColumn("liq_score", exprs.half_even(score, 2)).withColumn("liq_class", F.when(score.isNotNull(), liquefaction_class(score)))
    return out.withColumn("site_risk", site_risk(F.col("risk_index"), F.col("amp")))


def nearest_cell(spots: DataFrame, cells: DataFrame, region: Region, cell_deg: float = 0.25, rings: int = 2) -> DataFrame:
    """spots: spot, latitude, longitude. The cell whose centre is nearest by squared degrees, the first by bins of equals.

    Cells near a spot meet it by an equality of bins; a spot with none within `rings` cells is held against all of them.
    """
    lat, lon = exprs.cell_bins(F.col("latitude"), F.col("longitude"), region, cell_deg)
    near = F.sequence(F.lit(-rings), F.lit(rings))
    moved = spots.withColumns({"b1": lat, "b2": lon}).withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
    moved = moved.withColumns({"lat_bin": (F.col("b1") + F.col("i")).cast("int"), "lon_bin": (F.col("b2") + F.col("j")).cast("int")})
    centres = cells.select("lat_bin", "lon_bin", "lat", "lon")
    dist = F.pow(F.col("lat") - F.col("latitude"), 2.0) + F.pow(F.col("lon") - F.col("longitude"), 2.0)

    def best(met: DataFrame) -> DataFrame:
        met = met.withColumn("d2", dist)
        pick = F.min(F.struct("d2", "lat_bin", "lon_bin")).alias("m")
        return met.groupBy("spot", "latitude", "longitude").agg(pick).select("spot", "latitude", "longitude", "m.lat_bin", "m.lon_bin", "m.d2")

    # within the rings a cell is sure only if it is nearer than what lies beyond them
    sure = best(moved.join(centres, ["lat_bin", "lon_bin"])).filter(F.col("d2") <= (rings * cell_deg) ** 2)
    rest = spots.join(sure.select("spot"), "spot", "left_anti")
    far = best(rest.crossJoin(centres))
    return sure.unionByName(far)




def ordered(cells: DataFrame) -> Window:
    return Window.orderBy(F.desc("risk_index"), "lat_bin", "lon_bin")
