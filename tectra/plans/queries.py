"""Every query of the catalog operators with its SQL.

A query that SQL can't say (learners, fits, resampling) has none; tests hold these against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tectra.functions import exprs, tables
from tectra.operators import clean, etas, export, forecast, integrity, risk, skill, stats
from tectra.schemas import NATIONAL, ZONES
from tectra.sources.testdata import CATALOG_SQL, catalog, table
from tectra.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

RECENT_YEARS = 7 / 365.25
NOW_US = 1_706_659_200_000_000  # 2024-01-31T00:00:00Z
PARAMS = etas.Params(0.5, 0.05, 0.02, 1.2, 1.0, 4.0)
RISK = {"min_mag": 3.0, "recent_years": RECENT_YEARS}


def query(sql: str | None = None, with_catalog: bool = True):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if with_catalog:
                body = f"WITH {CATALOG_SQL}" + (", " + body[5:] if body.startswith("WITH ") else "\n" + body)
            ORACLE_SQL[f.__name__] = body
        return f

    return add


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, since sums in another order differ in the last ones."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- catalog ---------------------------------------------------------------------------------------------------------


@query("""SELECT id, epoch_us(time) AS time_us, latitude, longitude, depth, mag, magtype AS "magType", place, CAST(year(time) AS INT) AS year,
    round((epoch_us(time) - lag(epoch_us(time)) OVER (ORDER BY time, id)) / CAST(86400000000 AS DOUBLE), 6) AS interevent_days FROM cat""")
def clean_catalog(spark, sf_dir):
    df = clean.clean_catalog(catalog(spark, sf_dir))
    return r6(df.withColumn("time_us", exprs.micros(F.col("time"))).drop("time"))


@query("""SELECT count(*) AS n_events, min(epoch_us(time)) AS date_min, max(epoch_us(time)) AS date_max, min(mag) AS mag_min, max(mag) AS mag_max,
    CAST(median(depth) AS DOUBLE) AS depth_median_km FROM cat""")
def catalog_summary(spark, sf_dir):
    return clean.completeness_summary(catalog(spark, sf_dir))


@query("""SELECT id, epoch_us(time) AS time_us, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN round(mag + CAST(0.1 AS DOUBLE), 6) ELSE round(mag, 6) END AS mag FROM cat""")
def archive_upsert(spark, sf_dir):
    """The catalog with a revision of every third event."""
    df = catalog(spark, sf_dir)
    revised = df.filter(F.col("id").cast("long") % 3 == 0).withColumn("mag", F.col("mag") + 0.1)
    return r6(clean.merge_events(df, revised).select("id", exprs.micros(F.col("time")).alias("time_us"), "mag"))


@query("""SELECT id, latitude, longitude, mag FROM cat WHERE latitude BETWEEN 36.0 AND 39.5 AND longitude BETWEEN 25.5 AND 28.5""")
def bbox_filter(spark, sf_dir):
    return clean.in_region(catalog(spark, sf_dir), ZONES[2]).select("id", "latitude", "longitude", "mag")


@query("""WITH days AS (SELECT DISTINCT CAST(time AS DATE) AS d FROM cat WHERE mag >= 5.0),
g AS (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM days)
SELECT epoch_us(CAST(p AS TIMESTAMP)) + 86400000000 AS gap_start, epoch_us(CAST(d AS TIMESTAMP)) AS gap_end FROM g WHERE date_diff('day', p, d) > 1""")
def gaps(spark, sf_dir):
    """Stretches of whole days without a strong event."""
    us = exprs.micros(F.date_trunc("day", "time"))
    days = catalog(spark, sf_dir).filter("mag >= 5.0").select(us.alias("start"), (us + 86_400_000_000).alias("end")).distinct()
    return clean.coverage_gaps(days)


@query("""WITH q AS (SELECT quantile_cont(epoch_us(time), 0.75) AS c FROM cat)
SELECT epoch_us(time) <= c AS is_train, count(*) AS n, max(mag) AS max_mag FROM cat, q GROUP BY 1""")
def quantile_split(spark, sf_dir):
    return clean.quantile_split(catalog(spark, sf_dir), 0.75).groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.max("mag").alias("max_mag"))


# --- statistics ------------------------------------------------------------------------------------------------------

_FMD = """w AS (SELECT CAST(0.1 AS DOUBLE) AS w),
span AS (SELECT floor(min(mag) / w) * w AS lo, CAST(round_even((max(mag) - floor(min(mag) / w) * w) / w, 0) + 1 AS INT) AS n, w FROM cat, w GROUP BY w),
bins AS (SELECT CAST(unnest(range(n)) AS INT) AS bin_idx, lo, n, w FROM span),
fmd AS (SELECT bin_idx, lo + w * bin_idx + w / 2 AS bin_center, count(mag) AS incremental
    FROM bins LEFT JOIN cat ON mag >= lo + w * bin_idx AND (mag < lo + w * (bin_idx + 1) OR bin_idx = n - 1 AND mag = lo + w * n) GROUP BY bin_idx, lo, w)"""


@query(f"""WITH {_FMD}
SELECT bin_idx, round(bin_center, 6) AS bin_center, incremental, CAST(sum(incremental) OVER (ORDER BY bin_idx DESC) AS BIGINT) AS cumulative FROM fmd""")
def fmd(spark, sf_dir):
    return r6(stats.frequency_magnitude(catalog(spark, sf_dir)))


_MC = f"{_FMD}, mc AS (SELECT round_even(bin_center + CAST(0.2 AS DOUBLE), 2) AS mc FROM fmd ORDER BY incremental DESC, bin_idx LIMIT 1)"


@query(f"WITH {_MC} SELECT mc FROM mc")
def mc(spark, sf_dir):
    return stats.completeness_magnitude(catalog(spark, sf_dir))


@query("""WITH s AS (SELECT count(*) AS n, avg(mag) AS m, var_pop(mag) AS v FROM cat WHERE mag >= CAST(2.85 AS DOUBLE) - CAST(1e-9 AS DOUBLE)),
t AS (SELECT *, log10(exp(1)) / (m - CAST(2.8 AS DOUBLE)) AS b FROM s)
SELECT round(b, 6) AS b, round(2.30 * b * b * sqrt(v * n / (n * (n - 1))), 6) AS sigma, round(log10(n) + b * CAST(2.85 AS DOUBLE), 6) AS a, CAST(2.85 AS DOUBLE) AS mc, n FROM t""")
def b_value(spark, sf_dir):
    return r6(stats.b_value(catalog(spark, sf_dir), 2.85))


_SPAN = "span AS (SELECT (max(epoch_us(time)) - min(epoch_us(time))) / CAST(86400000000 AS DOUBLE) / CAST(365.25 AS DOUBLE) AS years, max(epoch_us(time)) AS t_max FROM cat)"
_CELLS = f"""{_SPAN},
hit AS (SELECT CAST(CASE WHEN latitude = 42.5 THEN 27 ELSE floor((latitude - 35.5) / 0.25) END AS INT) AS lat_bin,
    CAST(CASE WHEN longitude = 45.0 THEN 77 ELSE floor((longitude - 25.5) / 0.25) END AS INT) AS lon_bin FROM cat
    WHERE mag >= 4.0 AND latitude BETWEEN 35.5 AND 42.5 AND longitude BETWEEN 25.5 AND 45.0),
cells AS (SELECT lat_bin, lon_bin, round_even(CAST(35.5 AS DOUBLE) + (lat_bin + CAST(0.5 AS DOUBLE)) * CAST(0.25 AS DOUBLE), 3) AS lat,
    round_even(CAST(25.5 AS DOUBLE) + (lon_bin + CAST(0.5 AS DOUBLE)) * CAST(0.25 AS DOUBLE), 3) AS lon,
    count(*) AS n_events, round_even(count(*) / years, 4) AS annual_rate FROM hit, span GROUP BY lat_bin, lon_bin, years)"""


@query(f"WITH {_CELLS} SELECT * FROM cells")
def hazard_cells(spark, sf_dir):
    return stats.hazard_cells(catalog(spark, sf_dir), NATIONAL)


@query(f"WITH {_CELLS} SELECT lat_bin, lon_bin, n_events, annual_rate FROM cells ORDER BY annual_rate DESC, lat_bin, lon_bin LIMIT 12")
def hazard_topk(spark, sf_dir):
    """A report of twelve cells."""
    return stats.top_cells(stats.hazard_cells(catalog(spark, sf_dir), NATIONAL), 12).select("lat_bin", "lon_bin", "n_events", "annual_rate")


@query(f"""WITH {_CELLS}, grid AS (SELECT CAST(i AS INT) AS lat_bin, CAST(j AS INT) AS lon_bin FROM range(28) a(i), range(78) b(j))
SELECT lat_bin, lon_bin, coalesce(n_events, 0) AS n_events, coalesce(annual_rate, CAST(0 AS DOUBLE)) AS annual_rate,
    round(CASE WHEN annual_rate > 0 THEN log10(annual_rate) END, 6) AS log10_rate FROM grid LEFT JOIN cells USING (lat_bin, lon_bin)""")
def hazard_raster(spark, sf_dir):
    return r6(stats.hazard_raster(catalog(spark, sf_dir), NATIONAL))


@query("""SELECT strftime(time, '%Y-%m-%d') AS period, count(*) FILTER (mag >= 2.5) AS n_m25, count(*) FILTER (mag >= 3.5) AS n_m35,
    count(*) FILTER (mag >= 4.0) AS n_m40, count(*) FILTER (mag >= 4.5) AS n_m45 FROM cat GROUP BY 1""")
def counts_by_day(spark, sf_dir):
    return stats.counts_by_period(catalog(spark, sf_dir), F.date_format("time", "yyyy-MM-dd"))


@query("""SELECT t AS threshold, count(*) FILTER (mag >= t) AS total, count(*) FILTER (mag >= t AND day(time) BETWEEN 1 AND 10) / CAST(10 AS DOUBLE) AS mean_first,
    count(*) FILTER (mag >= t AND day(time) BETWEEN 11 AND 20) / CAST(10 AS DOUBLE) AS mean_second
    FROM cat, (SELECT unnest([2.5, 3.5, 4.0, 4.5])::DOUBLE AS t) GROUP BY t""")
def compare_periods(spark, sf_dir):
    return stats.compare_periods(catalog(spark, sf_dir), (1, 10), (11, 20), F.dayofmonth("time"), 10.0)


@query("""WITH r AS (SELECT min(least(depth, 200)) AS lo, max(least(depth, 200)) AS hi FROM cat),
h AS (SELECT least(59, floor((least(depth, 200) - lo) / ((hi - lo) / 60))) AS bin, count(*) AS n FROM cat, r WHERE depth IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n FROM range(60) x(i) LEFT JOIN h ON h.bin = i""")
def depth_histogram(spark, sf_dir):
    return stats.depth_histogram(catalog(spark, sf_dir))


@query("""SELECT id, epoch_us(time) AS time_us, row_number() OVER (ORDER BY time, id) AS n FROM cat WHERE mag >= 4.5""")
def cumulative_strong(spark, sf_dir):
    return stats.cumulative_strong(catalog(spark, sf_dir))


# --- risk ------------------------------------------------------------------------------------------------------------


def _rank(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER ()"


_RISK = f"""{_SPAN},
agg AS (SELECT CAST(floor((latitude - CAST(35.5 AS DOUBLE)) / CAST(0.25 AS DOUBLE)) AS INT) AS lat_bin, CAST(floor((longitude - CAST(25.5 AS DOUBLE)) / CAST(0.25 AS DOUBLE)) AS INT) AS lon_bin,
    count(*) AS n_events, max(mag) AS max_mag, avg(depth) AS d, avg(CAST(coalesce(depth <= 15, false) AS INT)) AS s, sum(pow(CAST(10 AS DOUBLE), 1.5 * mag)) AS e,
    max(epoch_us(time)) AS last, count(*) FILTER (CAST(epoch_us(time) AS DOUBLE) >= t_max - CAST(604800000000 AS DOUBLE)) AS n_recent, years, t_max
    FROM cat, span WHERE mag >= 3.0 GROUP BY 1, 2, years, t_max),
sig AS (SELECT lat_bin, lon_bin, CAST(35.5 AS DOUBLE) + (lat_bin + CAST(0.5 AS DOUBLE)) * CAST(0.25 AS DOUBLE) AS lat, CAST(25.5 AS DOUBLE) + (lon_bin + CAST(0.5 AS DOUBLE)) * CAST(0.25 AS DOUBLE) AS lon,
    n_events, n_recent, max_mag, round_even(n_events / years, 4) AS annual_rate, round_even(n_recent / (CAST(7 AS DOUBLE) / CAST(365.25 AS DOUBLE)), 4) AS recent_rate,
    round_even((t_max - last) / CAST(86400000000 AS DOUBLE), 1) AS recency_days, round_even(log10(e), 2) AS energy_index, round_even(d, 1) AS mean_depth, round_even(s, 3) AS shallow_fraction FROM agg),
comp AS (SELECT *, {_rank('annual_rate')} AS risk_rate_component, {_rank('max_mag')} AS risk_magnitude_component, {_rank('recent_rate')} AS risk_recent_component,
    {_rank('energy_index')} AS risk_energy_component, {_rank('-recency_days')} AS risk_recency_component, {_rank('shallow_fraction')} AS risk_shallow_component FROM sig),
risk AS (SELECT *, CAST(round_even((CAST(0 AS DOUBLE) + CAST(0.22 AS DOUBLE) * risk_rate_component + CAST(0.18 AS DOUBLE) * risk_magnitude_component + CAST(0.18 AS DOUBLE) * risk_recent_component
    + CAST(0.18 AS DOUBLE) * risk_energy_component + CAST(0.16 AS DOUBLE) * risk_recency_component + CAST(0.08 AS DOUBLE) * risk_shallow_component) * 100, 0) AS INT) AS risk_index,
    'v2_afad_multi_signal' AS risk_model FROM comp)"""


def _risk(spark, sf_dir):
    return risk.risk_cells(catalog(spark, sf_dir), NATIONAL, **RISK)


@query(f"""WITH {_RISK} SELECT * REPLACE (round(risk_rate_component, 6) AS risk_rate_component, round(risk_magnitude_component, 6) AS risk_magnitude_component,
    round(risk_recent_component, 6) AS risk_recent_component, round(risk_energy_component, 6) AS risk_energy_component,
    round(risk_recency_component, 6) AS risk_recency_component, round(risk_shallow_component, 6) AS risk_shallow_component) FROM risk""")
def risk_cells(spark, sf_dir):
    return r6(_risk(spark, sf_dir))


@query(f"WITH {_RISK} SELECT lat_bin, lon_bin, lat, lon, risk_index, n_events, max_mag FROM risk ORDER BY risk_index DESC, lat_bin, lon_bin LIMIT 12")
def risk_topk(spark, sf_dir):
    """A report of the twelve cells of highest relative risk."""
    return risk.top_risk(_risk(spark, sf_dir), 12).select("lat_bin", "lon_bin", "lat", "lon", "risk_index", "n_events", "max_mag")


@query(f"""WITH {_RISK} SELECT lat_bin, lon_bin, risk_index, CASE WHEN risk_index >= 85 THEN 'very high' WHEN risk_index >= 70 THEN 'high' WHEN risk_index >= 55 THEN 'mid-high'
    ELSE 'mid' END AS band FROM risk WHERE risk_index >= 40""")
def risk_bands(spark, sf_dir):
    return risk.displayed(_risk(spark, sf_dir)).select("lat_bin", "lon_bin", "risk_index", risk.risk_band(F.col("risk_index")).alias("band"))


@query(f"""WITH {_RISK} SELECT id, risk_index FROM cat LEFT JOIN risk ON risk.lat_bin = floor((latitude - 35.5) / 0.25) AND risk.lon_bin = floor((longitude - 25.5) / 0.25)""")
def point_lookup(spark, sf_dir):
    points = catalog(spark, sf_dir).select("id", "latitude", "longitude")
    return risk.lookup(_risk(spark, sf_dir).select("lat_bin", "lon_bin", "risk_index"), points, NATIONAL).select("id", "risk_index")


def _height(lat, lon):
    """A made-up terrain that SQL can repeat."""
    return F.floor(F.col(lat) * 100) % 700 + F.floor(F.col(lon) * 100) % 300


_SITE = f"""{_RISK},
pt AS (SELECT lat_bin, lon_bin, lat, lon, risk_index, unnest([0, 1, 2, 3, 4]) AS side FROM risk),
hp AS (SELECT *, CASE side WHEN 3 THEN lat + CAST(0.02 AS DOUBLE) WHEN 4 THEN lat - CAST(0.02 AS DOUBLE) ELSE lat END AS y, CASE side WHEN 1 THEN lon + CAST(0.02 AS DOUBLE) WHEN 2 THEN lon - CAST(0.02 AS DOUBLE) ELSE lon END AS x FROM pt),
h AS (SELECT *, CAST(CAST(floor(y * 100) AS BIGINT) % 700 + CAST(floor(x * 100) AS BIGINT) % 300 AS DOUBLE) AS e FROM hp),
five AS (SELECT lat_bin, lon_bin, lat, risk_index, max(e) FILTER (side = 0) AS c, max(e) FILTER (side = 1) AS ee, max(e) FILTER (side = 2) AS w, max(e) FILTER (side = 3) AS n, max(e) FILTER (side = 4) AS s FROM h GROUP BY ALL),
sl AS (SELECT *, sqrt(pow((ee - w) / (2 * CAST(0.02 AS DOUBLE) * CAST(111320 AS DOUBLE) * cos(radians(lat))), 2) + pow((n - s) / (2 * CAST(0.02 AS DOUBLE) * CAST(110540 AS DOUBLE)), 2)) AS slope FROM five),
v AS (SELECT *, CAST(CASE WHEN slope < 0.0003 THEN 150 WHEN slope < 0.0035 THEN 240 WHEN slope < 0.01 THEN 300 WHEN slope < 0.018 THEN 360 WHEN slope < 0.05 THEN 490 WHEN slope < 0.1 THEN 620 ELSE 760 END AS DOUBLE) AS vs30 FROM sl),
site AS (SELECT *, round_even(least(3, greatest(CAST(0.8 AS DOUBLE), sqrt(760 / vs30))), 2) AS amp, CASE WHEN vs30 >= 1500 THEN 'A' WHEN vs30 >= 760 THEN 'B' WHEN vs30 >= 360 THEN 'C' WHEN vs30 >= 180 THEN 'D' ELSE 'E' END AS site_class,
    CAST(0.5 AS DOUBLE) * least(1, greatest(0, (760 - vs30) / 610)) + CAST(0.3 AS DOUBLE) * least(1, greatest(0, (500 - c) / 500)) + CAST(0.2 AS DOUBLE) * least(1, greatest(0, (CAST(0.02 AS DOUBLE) - slope) / CAST(0.02 AS DOUBLE))) AS liq FROM v)"""


def _sites(spark, sf_dir):
    cells = _risk(spark, sf_dir).select("lat_bin", "lon_bin", "lat", "lon", "risk_index")
    points = risk.stencil(cells).select(risk.coordinate_key(F.col("p_lat"), F.col("p_lon")).alias("key"), _height("p_lat", "p_lon").cast("double").alias("elevation"))
    return risk.site_metrics(cells, points.dropDuplicates(["key"]))


@query(f"""WITH {_SITE} SELECT lat_bin, lon_bin, c AS elevation, round(slope, 6) AS slope, vs30, site_class, amp, round_even(liq, 2) AS liq_score,
    CASE WHEN liq >= 0.66 THEN 'yüksek' WHEN liq >= 0.42 THEN 'orta' WHEN liq >= 0.22 THEN 'düşük' ELSE 'çok düşük' END AS liq_class,
    CAST(least(100, greatest(0, round_even(risk_index * amp / CAST(1.15 AS DOUBLE), 0))) AS INT) AS site_risk FROM site""")
def site_metrics(spark, sf_dir):
    return r6(_sites(spark, sf_dir).drop("lat", "lon", "risk_index"))


@query(f"WITH {_SITE} SELECT site_class, count(*) AS n FROM site GROUP BY 1")
def site_histogram(spark, sf_dir):
    return _sites(spark, sf_dir).groupBy("site_class").agg(F.count(F.lit(1)).alias("n"))


_SPOTS = [("izmir", 38.42, 27.14), ("van", 38.49, 43.38), ("istanbul", 41.01, 28.97), ("ankara", 39.93, 32.86), ("london", 51.5, -0.1)]


@query(f"""WITH {_RISK}, spots(spot, latitude, longitude) AS (VALUES {', '.join(f"('{s}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for s, a, b in _SPOTS)}),
d AS (SELECT spot, latitude, longitude, lat_bin, lon_bin, pow(lat - latitude, 2) + pow(lon - longitude, 2) AS d2 FROM spots, risk)
SELECT * REPLACE (round(d2, 6) AS d2) FROM d QUALIFY row_number() OVER (PARTITION BY spot ORDER BY d.d2, lat_bin, lon_bin) = 1""")
def nearest_cell(spark, sf_dir):
    return r6(risk.nearest_cell(spark.createDataFrame(_SPOTS, "spot string, latitude double, longitude double"), _risk(spark, sf_dir), NATIONAL))


# --- windows, features, baselines, scores ------------------------------------------------------------------------------

_WIN = """sp AS (SELECT epoch_us(date_trunc('day', min(time))) AS t0, max(epoch_us(time)) AS t1 FROM cat WHERE mag >= 3.5),
wins AS (SELECT CAST(unnest(range((t1 - t0) // 21600000000 + 1)) AS INT) AS win_idx, t0 FROM sp),
cnt AS (SELECT CAST((epoch_us(time) - t0) // 21600000000 AS INT) AS win_idx, count(*) AS n, max(mag) AS m FROM cat, sp WHERE mag >= 3.5 GROUP BY 1),
ws AS (SELECT win_idx, t0 + CAST(win_idx AS BIGINT) * 21600000000 AS window_start_us, coalesce(n, 0) AS n_events, coalesce(m, CAST(0 AS DOUBLE)) AS max_mag FROM wins LEFT JOIN cnt USING (win_idx))"""
_LAGS = ", ".join(f"CAST(lag({c}, {i}) OVER (ORDER BY win_idx) AS DOUBLE) AS {c}_lag{i}" for c in ("n_events", "max_mag") for i in range(1, 7))
_BASE = f"""{_WIN},
num AS (SELECT win_idx, CAST(n_events AS DOUBLE) AS y, row_number() OVER (ORDER BY win_idx) <= round_even(count(*) OVER () * CAST(0.75 AS DOUBLE), 0) AS is_train FROM ws),
pre AS (SELECT *, lag(y) OVER (ORDER BY win_idx) AS persistence, avg(CASE WHEN is_train THEN y END) OVER () AS climatology FROM num),
base AS (SELECT win_idx, y, climatology, persistence FROM pre WHERE NOT is_train)"""


def _series(spark, sf_dir):
    return forecast.windowed_series(catalog(spark, sf_dir), 0.25, 3.5)


@query(f"WITH {_WIN} SELECT * FROM ws")
def windowed_series(spark, sf_dir):
    return _series(spark, sf_dir)


@query(f"WITH {_WIN} SELECT count(*) AS n, round(avg(n_events), 6) AS mean_n, CAST(median(n_events) AS DOUBLE) AS median_n, max(n_events) AS max_n FROM ws")
def window_summary(spark, sf_dir):
    return r6(_series(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg("n_events").alias("mean_n"), F.percentile("n_events", F.lit(0.5)).alias("median_n"), F.max("n_events").alias("max_n")))


@query(f"WITH {_WIN}, l AS (SELECT win_idx, {_LAGS}, CAST(n_events AS DOUBLE) AS target, row_number() OVER (ORDER BY win_idx) AS rn FROM ws) SELECT * EXCLUDE (rn) FROM l WHERE rn > 6")
def lag_features(spark, sf_dir):
    return forecast.supervised(_series(spark, sf_dir))


@query("""WITH s AS (SELECT id, epoch_us(time) AS us, time, mag, row_number() OVER (ORDER BY time, id) AS i FROM cat WHERE mag >= 3.5),
f AS (SELECT id, us AS time_us, lag(mag) OVER w AS last_mag, avg(mag) OVER p AS mean_mag, max(mag) OVER p AS max_mag, stddev_pop(mag) OVER p AS std_mag,
    (us - lag(us) OVER w) / CAST(86400000000 AS DOUBLE) AS days_since_last, 10 / greatest((lag(us) OVER w - lag(us, 10) OVER w) / CAST(86400000000 AS DOUBLE), CAST(1e-6 AS DOUBLE)) AS rate, mag AS target, i
    FROM s WINDOW w AS (ORDER BY time, id), p AS (ORDER BY time, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT id, time_us, last_mag, round(mean_mag, 6) AS mean_mag, max_mag, round(std_mag, 5) AS std_mag, round(days_since_last, 6) AS days_since_last, round(rate, 4) AS rate, target FROM f WHERE i > 10""")
def event_features(spark, sf_dir):
    f = forecast.event_features(catalog(spark, sf_dir), 3.5, 10)
    return r6(f.withColumns({"std_mag": F.round("std_mag", 5), "rate": F.round("rate", 4)}))


@query(f"WITH {_BASE} SELECT win_idx, y, round(climatology, 6) AS climatology, persistence FROM base")
def baseline_forecasts(spark, sf_dir):
    return r6(forecast.baselines(_series(spark, sf_dir), "win_idx", "n_events"))


def _score_sql(p: str) -> str:
    q = f"greatest({p}, CAST(1e-9 AS DOUBLE))"
    return f"SELECT '{p}' AS model, avg(abs(y - {p})) AS mae, sqrt(avg((y - {p}) * (y - {p}))) AS rmse, avg(2 * (CASE WHEN y > 0 THEN y * ln(y / {q}) ELSE 0 END - (y - {q}))) AS poisson_deviance, count(*) AS n FROM base"


_SCORES = f"{_BASE}, sc AS ({_score_sql('climatology')} UNION ALL {_score_sql('persistence')})"


def _scored(spark, sf_dir):
    return forecast.scores(forecast.baselines(_series(spark, sf_dir), "win_idx", "n_events"), "y", ["climatology", "persistence"])


@query(f"WITH {_SCORES} SELECT model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(poisson_deviance, 6) AS poisson_deviance, n FROM sc")
def forecast_scores(spark, sf_dir):
    return r6(_scored(spark, sf_dir))


@query(f"""WITH {_SCORES}, b AS (SELECT poisson_deviance AS d FROM sc WHERE model = 'climatology'), l AS (SELECT model, CASE WHEN d = 0 THEN 0 ELSE 1 - poisson_deviance / d END AS skill,
    CAST(row_number() OVER (ORDER BY poisson_deviance, model) AS INT) AS place FROM sc, b) SELECT model, round(skill, 6) AS skill, place, place = 1 AS is_winner FROM l""")
def skill_leaderboard(spark, sf_dir):
    return r6(forecast.leaderboard(_scored(spark, sf_dir), "climatology").select("model", "skill", "place", "is_winner"))


def _binary(spark, sf_dir):
    """Labels with a score that SQL can repeat: does a text's length tell its quality?"""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("quality", (F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("p"))


_BIN = "bin AS (SELECT quality, least(n_chars, 4000) / CAST(4000 AS DOUBLE) AS p FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_BIN}, m AS (SELECT avg(quality) AS m FROM bin), s AS (SELECT avg(pow(p - quality, 2)) AS b, avg(pow(m - quality, 2)) AS base FROM bin, m) SELECT round(b, 6) AS brier, round(base, 6) AS base, round(1 - b / base, 6) AS skill FROM s", with_catalog=False)
def brier_score(spark, sf_dir):
    return r6(forecast.brier(_binary(spark, sf_dir), "quality", "p"))


@query(f"""WITH {_BIN}, r AS (SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / CAST(2 AS DOUBLE) AS rk FROM bin),
s AS (SELECT sum(rk) FILTER (quality = 1) AS s, count(*) FILTER (quality = 1) AS np, count(*) FILTER (quality <> 1) AS nn FROM r)
SELECT round((s - np * (np + 1) / CAST(2 AS DOUBLE)) / (np * nn), 6) AS auc FROM s""", with_catalog=False)
def roc_auc(spark, sf_dir):
    return r6(forecast.roc_auc(_binary(spark, sf_dir), "quality", "p"))


@query(f"WITH {_BASE}, m AS (SELECT avg(y) AS m FROM base), s AS (SELECT 1 - sum(pow(y - persistence, 2)) / sum(pow(y - m, 2)) AS r2, avg(abs(y - persistence)) AS mae FROM base, m) SELECT round(r2, 6) AS r2, round(mae, 6) AS mae, r2 >= 0.05 AS predictable FROM s")
def magnitude_verdict(spark, sf_dir):
    return r6(forecast.r_squared(forecast.baselines(_series(spark, sf_dir), "win_idx", "n_events"), "y", "persistence"))


def _learn(spark, sf_dir, kind, binary=False):
    x = forecast.supervised(_series(spark, sf_dir), target="max_mag" if binary else "n_events")
    if binary:
        x = x.withColumn("target", (F.col("target") >= 4.2).cast("double"))
    split = forecast.temporal_split(x, "win_idx")
    features = [c for c in x.columns if "_lag" in c]
    out = forecast.fit_predict(split.filter("is_train"), split.filter("not is_train"), features, "target", kind)
    return out.select("win_idx", "target", "prediction")


@query()
def poisson_glm(spark, sf_dir):
    return _learn(spark, sf_dir, "poisson_glm")


@query()
def boosted_regressor(spark, sf_dir):
    return _learn(spark, sf_dir, "boosted")


@query()
def boosted_counts(spark, sf_dir):
    return _learn(spark, sf_dir, "boosted_poisson")


@query()
def boosted_classifier(spark, sf_dir):
    return _learn(spark, sf_dir, "boosted_class", binary=True)


@query()
def bootstrap_ci(spark, sf_dir):
    return forecast.bootstrap_mean_ci(catalog(spark, sf_dir), "mag", n_boot=2000)


# --- point process ---------------------------------------------------------------------------------------------------

_EV = """ev AS (SELECT id, mag, (epoch_us(time) - min(epoch_us(time)) OVER ()) / CAST(86400000000 AS DOUBLE) AS t FROM cat WHERE mag >= 4.0),
pr AS (SELECT CAST(0.5 AS DOUBLE) AS mu, CAST(0.05 AS DOUBLE) AS k, CAST(0.02 AS DOUBLE) AS c, CAST(1.2 AS DOUBLE) AS p, CAST(1.0 AS DOUBLE) AS al, CAST(4.0 AS DOUBLE) AS m0)"""
_RATE = f"""{_EV}, rt AS (SELECT a.id, a.t, mu + coalesce(sum(k * exp(al * (b.mag - m0)) * pow(a.t - b.t + c, -p)), 0) AS rate
    FROM pr, ev a LEFT JOIN ev b ON b.t < a.t OR b.t = a.t AND b.id < a.id GROUP BY a.id, a.t, mu)"""


def _strong(spark, sf_dir):
    return etas.event_days(catalog(spark, sf_dir), 4.0)


@query(f"WITH {_RATE} SELECT id, round(t, 6) AS t, round(rate, 6) AS rate FROM rt")
def etas_intensity(spark, sf_dir):
    return r6(etas.intensity(_strong(spark, sf_dir), PARAMS))


_OMORI = "(pow({b} + c, 1 - p) - pow({a} + c, 1 - p)) / (1 - p)"
_COMP = f"{_EV}, cm AS (SELECT mu * 30 + sum(k * exp(al * (mag - m0)) * {_OMORI.format(a='0', b='30 - t')}) AS expected FROM ev, pr GROUP BY mu)"


@query(f"WITH {_COMP} SELECT round(expected, 6) AS expected FROM cm")
def etas_compensator(spark, sf_dir):
    return r6(etas.compensator(_strong(spark, sf_dir), PARAMS, 0.0, 30.0))


@query(f"WITH {_RATE}, cm AS (SELECT mu * 30 + sum(k * exp(al * (mag - m0)) * {_OMORI.format(a='0', b='30 - t')}) AS expected FROM ev, pr GROUP BY mu) SELECT round(expected - s, 4) AS nll FROM cm, (SELECT sum(ln(rate)) AS s FROM rt)")
def etas_likelihood(spark, sf_dir):
    return r6(etas.negative_log_likelihood(_strong(spark, sf_dir), PARAMS, 0.0, 30.0), 4)


_FW = f"{_EV}, fw AS (SELECT CAST(i AS INT) AS win_idx, CAST(20 + i AS DOUBLE) AS ws, CAST(21 + i AS DOUBLE) AS we FROM range(9) x(i))"


@query(f"WITH {_FW} SELECT win_idx, ws, we, (SELECT count(*) FROM ev WHERE t >= ws AND t < we) AS n FROM fw")
def fixed_windows(spark, sf_dir):
    return etas.fixed_windows(_strong(spark, sf_dir), 20.0, 30.0, 1.0)


@query(f"""WITH {_FW} SELECT win_idx, ws, we, round(mu * (we - ws) + coalesce(sum(k * exp(al * (mag - m0)) * ({_OMORI.format(a='0', b='we - t')} - {_OMORI.format(a='0', b='ws - t')})), 0), 6) AS expected
    FROM pr, fw LEFT JOIN ev ON t < ws GROUP BY win_idx, ws, we, mu""")
def etas_expected(spark, sf_dir):
    events = _strong(spark, sf_dir)
    return r6(etas.expected_counts(etas.fixed_windows(events, 20.0, 30.0, 1.0).drop("n"), events, PARAMS))


_Z = "z(zone, a, b, c, d) AS (VALUES " + ", ".join(f"('{z.name}', {z.min_lat}, {z.max_lat}, {z.min_lon}, {z.max_lon})" for z in ZONES) + ")"


@query(f"WITH {_Z} SELECT zone, id FROM cat JOIN z ON latitude BETWEEN a AND b AND longitude BETWEEN c AND d WHERE mag >= 3.0")
def zone_assign(spark, sf_dir):
    return etas.assign_zones(clean.at_least(catalog(spark, sf_dir), 3.0), ZONES).select("zone", "id")


@query()
def zone_etas(spark, sf_dir):
    """Fits of zones and of all strong events: within a task where they are few, else over parts of them, side by side."""
    strong = tables.written(clean.at_least(catalog(spark, sf_dir), 4.0).select("time", "latitude", "longitude", "mag"))
    return etas.fit_zones(etas.assign_zones(strong, ZONES, 20).unionByName(strong.withColumn("zone", F.lit(NATIONAL.name))), 4.0, window_days=1.0)


@query(f"""WITH {_Z}, n AS (SELECT zone, count(*) AS k, count(*) FILTER (WHERE mag >= 4.0) AS strong FROM cat JOIN z ON latitude BETWEEN a AND b AND longitude BETWEEN c AND d GROUP BY zone)
SELECT zone, round(4.0 * strong / nullif(k - strong, 0), 6) AS n, CASE WHEN strong = k THEN 'undefined' WHEN 4.0 * strong / (k - strong) < 1 THEN 'sub-critical' ELSE 'super-critical' END AS flag FROM n""")
def zone_flags(spark, sf_dir):
    """The flag of each zone by four times its strong events to a weaker one."""
    rows = etas.assign_zones(catalog(spark, sf_dir), ZONES).groupBy("zone").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("mag") >= 4.0).alias("strong"))
    n = F.lit(4.0) * F.col("strong") / F.nullif(F.col("k") - F.col("strong"), F.lit(0))
    return r6(rows.select("zone", n.alias("n"), etas.zone_flag(n).alias("flag")))


_RJ = "greatest(0, pow(CAST(10 AS DOUBLE), CAST(-1.67 AS DOUBLE) + (mag - min_mag)) * (pow(t2 + CAST(0.05 AS DOUBLE), CAST(-0.08 AS DOUBLE)) - pow(t1 + CAST(0.05 AS DOUBLE), CAST(-0.08 AS DOUBLE))) / CAST(-0.08 AS DOUBLE))"


@query(f"""WITH e AS (SELECT id, mag, ({NOW_US} - epoch_us(time)) / CAST(86400000000 AS DOUBLE) AS el FROM cat WHERE mag >= 4.5),
g AS (SELECT id, mag, el, min_mag, period, CASE period WHEN 'remaining' THEN el ELSE 0 END AS t1, CASE period WHEN '7d' THEN 7 ELSE 30 END AS t2
    FROM e JOIN (VALUES (CAST(3 AS DOUBLE), '7d'), (3, '30d'), (3, 'remaining'), (4, '7d'), (4, '30d'), (4, 'remaining')) p(min_mag, period) ON period <> 'remaining' OR el < 30),
x AS (SELECT *, {_RJ} AS n FROM g)
SELECT id, mag, round(el, 6) AS elapsed_days, min_mag, period, round(n, 6) AS expected,
    CASE WHEN n < 0.5 THEN '~0' ELSE CAST(floor(n * CAST(0.4 AS DOUBLE) + 0.5) AS BIGINT) || '–' || CAST(floor(greatest(1, n * CAST(2.3 AS DOUBLE)) + 0.5) AS BIGINT) END AS band FROM x""")
def aftershock_panel(spark, sf_dir):
    return r6(etas.aftershock_panel(catalog(spark, sf_dir), F.lit(NOW_US)))


@query(f"""WITH e AS (SELECT id, mag, ({NOW_US} - epoch_us(time)) / CAST(86400000000 AS DOUBLE) AS d FROM cat WHERE mag >= 3.0)
SELECT id, CASE WHEN d < 1.0 / 60 THEN 'az önce' WHEN d < CAST(1 AS DOUBLE) / 24 THEN CAST(floor(d * 1440 + 0.5) AS BIGINT) || ' dakika önce' WHEN d < 1 THEN CAST(floor(d * 24 + 0.5) AS BIGINT) || ' saat önce'
    WHEN d < 2 THEN '1 gün önce' ELSE CAST(floor(d) AS BIGINT) || ' gün önce' END AS elapsed, CASE WHEN mag >= 5.5 THEN '5.5+' WHEN mag >= 4.5 THEN '4.5+' WHEN mag >= 3.5 THEN '3.5+' ELSE '<3.5' END AS band,
    round(CASE WHEN mag >= 5.5 THEN 9 + (mag - 5.5) * 4 WHEN mag >= 4.5 THEN 7.5 WHEN mag >= 3.5 THEN 6 ELSE 4 END, 6) AS radius, d < 1 AS is_fresh FROM e""")
def recent_events(spark, sf_dir):
    df = clean.at_least(catalog(spark, sf_dir), 3.0)
    d = exprs.days((F.lit(NOW_US) - exprs.micros(F.col("time"))).cast("double"))
    band, radius = etas.recent_style(F.col("mag"))
    return r6(df.select("id", etas.elapsed_text(d).alias("elapsed"), band.alias("band"), radius.alias("radius"), (d < 1).alias("is_fresh")))


# --- skill -----------------------------------------------------------------------------------------------------------

_CNT = f"{_RISK}, c AS (SELECT row_number() OVER (ORDER BY risk_index DESC, lat_bin, lon_bin) AS place, n_recent AS n FROM risk), cc AS (SELECT place, n, sum(n) OVER (ORDER BY place) AS y, sum(n) OVER () AS t, count(*) OVER () AS k FROM c)"


def _ranked(spark, sf_dir):
    cells = _risk(spark, sf_dir)
    return cells.select(F.row_number().over(risk.ordered(cells)).alias("place"), F.col("n_recent").alias("n"))


@query(f"WITH {_CNT} SELECT round_even(2 * sum((2 * y - n) / CAST(t AS DOUBLE) / (2 * k)) - 1, 4) AS area_skill_score FROM cc")
def area_skill(spark, sf_dir):
    return skill.area_skill(_ranked(spark, sf_dir), "place", "n")


@query(f"WITH {_CNT}, g AS (SELECT *, greatest(1, round_even(k * CAST(0.25 AS DOUBLE), 0)) AS top FROM cc) SELECT round_even(sum(CASE WHEN place <= top THEN n ELSE 0 END) / CAST(max(t) AS DOUBLE) / (max(top) / max(k)), 4) AS gain FROM g")
def concentration_gain(spark, sf_dir):
    return skill.concentration_gain(_ranked(spark, sf_dir), "place", "n")


@query()
def area_skill_ci(spark, sf_dir):
    return skill.area_skill_ci(_ranked(spark, sf_dir), "place", "n", n_boot=1000)


_LATER = _RISK.replace("FROM cat)", "FROM early)").replace("FROM cat, span", "FROM early, span")


@query(f"""WITH q AS (SELECT quantile_cont(epoch_us(time), 0.75) AS c FROM cat), early AS (SELECT cat.* FROM cat, q WHERE epoch_us(time) <= c), {_LATER},
hit AS (SELECT CAST(floor((latitude - 35.5) / 0.25) AS INT) AS lat_bin, CAST(floor((longitude - 25.5) / 0.25) AS INT) AS lon_bin, count(*) AS n FROM cat, q WHERE epoch_us(time) > c AND mag >= 3.0 GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY risk_index DESC, lat_bin, lon_bin) AS INT) AS place, lat_bin, lon_bin, risk_index, coalesce(n, 0) AS n FROM risk LEFT JOIN hit USING (lat_bin, lon_bin)""")
def surface_counts(spark, sf_dir):
    return skill.surface_counts(catalog(spark, sf_dir), NATIONAL, **RISK)


@query()
def surface_skill(spark, sf_dir):
    return skill.surface_skill(catalog(spark, sf_dir), NATIONAL, n_boot=1000, **RISK)


# --- texts, gates, exports, live ---------------------------------------------------------------------------------------

_PHRASES, _DENIALS = ("the on", "and the", "de la"), ("erre", "ing")


@query(f"""WITH t AS (SELECT doc_id AS id, lower(translate(text, 'İI', 'iı')) AS t FROM documents), p AS (SELECT unnest({list(_PHRASES)!r}) AS phrase),
o AS (SELECT id, phrase, t, unnest(list_filter(range(length(t)), lambda i: substr(t, i + 1, length(phrase)) = phrase)) AS idx FROM t, p WHERE contains(t, phrase)),
n AS (SELECT id, phrase, CAST(idx AS INT) AS idx, substr(t, greatest(idx - 40, 0) + 1, idx - greatest(idx - 40, 0) + length(phrase) + 40) AS near FROM o)
SELECT id, phrase, idx FROM n WHERE NOT ({' OR '.join(f"contains(near, '{d}')" for d in _DENIALS)})""", with_catalog=False)
def claims_scan(spark, sf_dir):
    return integrity.claims(table(spark, sf_dir, "documents"), "text", _PHRASES, _DENIALS, id_col="doc_id")


@query("""SELECT event_id, CASE WHEN json_exists(props, '$.k') THEN ['source', 'z'] ELSE ['k', 'source', 'z'] END AS missing FROM events""", with_catalog=False)
def required_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", integrity.missing_keys(F.col("props"), ["k", "source", "z"]).alias("missing"))


@query("""SELECT page_id, (contains(f, 'rating') OR contains(f, 'fiyatlama')) AND (contains(f, 'değil') OR contains(f, 'degil')) AS restricted FROM (SELECT page_id, lower(translate(html, 'İI', 'iı')) AS f FROM pages)""", with_catalog=False)
def use_restriction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", integrity.has_restriction(F.col("html")).alias("restricted"))


@query(f"""WITH {_RISK} SELECT lat_bin, lon_bin, 'Polygon' AS kind, round(lon - CAST(0.125 AS DOUBLE), 6) AS west, round(lat + CAST(0.125 AS DOUBLE), 6) AS north, CAST(0.25 AS DOUBLE) AS edge, risk_index, mean_depth FROM risk""")
def geojson_cells(spark, sf_dir):
    """Cells as GeoJSON, read back."""
    f = export.cell_features(_risk(spark, sf_dir))
    shape = F.from_json("feature", "geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<risk_index: int, mean_depth: double>")
    ring = F.col("s.geometry.coordinates")[0]
    return r6(f.withColumn("s", shape).select("lat_bin", "lon_bin", F.col("s.geometry.type").alias("kind"), ring[0][0].alias("west"), ring[2][1].alias("north"), integrity.polygon_edge(ring).alias("edge"), "s.properties.risk_index", "s.properties.mean_depth"))


@query("""SELECT id, longitude AS lon, latitude AS lat, round(mag, 1) AS mag, strftime(time, '%Y-%m-%d') AS date FROM cat WHERE mag >= 5.0""")
def geojson_events(spark, sf_dir):
    f = export.event_features(catalog(spark, sf_dir), 5.0)
    s = F.from_json("feature", "geometry struct<coordinates: array<double>>, properties struct<mag: double, date: string>")
    return f.withColumn("s", s).select("id", F.col("s.geometry.coordinates")[0].alias("lon"), F.col("s.geometry.coordinates")[1].alias("lat"), F.col("s.properties.mag").alias("mag"), F.col("s.properties.date").alias("date"))


@query(f"WITH {_RISK}, {_MC.replace('span AS', 'mspan AS').replace('FROM span', 'FROM mspan')} SELECT mc.mc AS mc, (SELECT count(*) FROM risk) AS n_cells, (SELECT count(*) FROM cat WHERE mag >= 5.0) AS n_big_events FROM mc")
def meta_stamp(spark, sf_dir):
    """The stamp's numbers, read back from its JSON."""
    df = catalog(spark, sf_dir)
    none = spark.createDataFrame([(None, None, None, None, None)], "area_skill_score double, gain_top25 double, ci_low double, ci_high double, n_test_events long")
    stamp = export.meta_stamp(_risk(spark, sf_dir), clean.at_least(df, 5.0), none, stats.completeness_magnitude(df), source="events", region=NATIONAL.name, cell_deg=0.25, min_mag=3.0)
    return stamp.select(F.from_json("json", "mc double, n_cells long, n_big_events long").alias("s")).select("s.*")


_CHECKED = 1_706_572_800_000_000  # 2024-01-30T00:00:00Z


@query(f"""SELECT id, epoch_us(time) AS time_us, mag FROM cat WHERE epoch_us(time) >= {_CHECKED} - 86400000000""")
def live_feed(spark, sf_dir):
    """A day's lookback over a feed that repeats every record."""
    df = catalog(spark, sf_dir)
    return live.live_events(df.unionByName(df), F.lit(_CHECKED), 1440).select("id", exprs.micros(F.col("time")).alias("time_us"), "mag")


@query(f"""WITH a AS (SELECT count(*) AS n_events, max(epoch_us(time)) AS newest_us FROM cat), l AS (SELECT *, round_even(({NOW_US} - newest_us) / CAST(60000000 AS DOUBLE), 1) AS lag_minutes FROM a)
SELECT CASE WHEN n_events = 0 THEN 'empty' WHEN lag_minutes <= 30 THEN 'fresh' ELSE 'stale' END AS status, lag_minutes, n_events, newest_us FROM l""")
def live_status(spark, sf_dir):
    return live.live_status(catalog(spark, sf_dir), F.lit(NOW_US))
