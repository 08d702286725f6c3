"""Queries of the operators around the catalog: services, coverage, gates, stamps, streams and outputs, each with its SQL where it has one."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tectra.functions import exprs, tables
from tectra.operators import clean, coverage, etas, export, forecast, integrity, risk, skill, stats
from tectra.plans.queries import _FMD, _LATER, _MC, _RISK, _SITE, _WIN, NOW_US, RISK, _risk, _series, _sites, query, r6
from tectra.schemas import CATALOG_COLUMNS, NATIONAL, CatalogError
from tectra.sources import archive, files, http, outputs, replay
from tectra.sources.testdata import catalog, table
from tectra.streaming import live

_DAYS = http.hour_windows(datetime(2024, 1, 1), datetime(2024, 1, 31), 24)
_TYPED = "id, epoch_us(time) AS time_us, latitude, longitude, depth, round(mag, 6) AS mag, magtype AS \"magType\", place"


def _typed(df):
    return r6(df.select("id", exprs.micros(F.col("time")).alias("time_us"), "latitude", "longitude", "depth", "mag", "magType", "place"))


# --- services, answered from the recorded events ----------------------------------------------------------------------


@query(f"SELECT {_TYPED} FROM cat WHERE time < TIMESTAMP '2024-01-31' AND mag >= 2.5")
def service_csv(spark, sf_dir):
    """The service in CSV, a window a day, one row an id."""
    got = http.fetch_windows(spark, "fdsn", _DAYS, transport=f"tectra.sources.replay:fdsn:{replay.record(catalog(spark, sf_dir))}", tries=1)
    return _typed(clean.conform(clean.one_per_id(got.filter("not failed").drop("failed"), ["window", "ord"])))


@query(f"SELECT {_TYPED} FROM cat WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-13' AND mag >= CAST(3.0 AS DOUBLE)")
def service_json(spark, sf_dir):
    """Three days of the service in JSON, in chunks of eight hours, all or nothing."""
    got = http.window_events(spark, datetime(2024, 1, 10), datetime(2024, 1, 13), chunk_hours=8, min_mag=3.0, transport=f"tectra.sources.replay:afad:{replay.record(catalog(spark, sf_dir))}", tries=1)
    return _typed(clean.conform(got))


@query("""SELECT CAST(i AS INT) AS "window", i = 4 AS failed, CASE WHEN i = 4 THEN 0 ELSE count(id) END AS n
FROM range(30) r(i) LEFT JOIN cat ON CAST(time AS DATE) = DATE '2024-01-01' + CAST(i AS INT) AND mag >= 4.0 GROUP BY i HAVING i = 4 OR count(id) > 0""")
def service_gaps(spark, sf_dir):
    """Windows with a broken one, which is counted and not hidden."""
    got = http.fetch_windows(spark, "afad", _DAYS, min_mag=4.0, transport=f"tectra.sources.replay:afad:{replay.record(catalog(spark, sf_dir))}?2024-01-05", tries=1, on_gap="allow")
    return got.groupBy("window").agg(F.max("failed").alias("failed"), F.count_if(~F.col("failed")).alias("n"))


_POINTS = f"""{_RISK}, five AS (SELECT lat, lon, unnest([0, 1, 2, 3, 4]) AS side FROM risk),
p AS (SELECT CASE side WHEN 3 THEN lat + CAST(0.02 AS DOUBLE) WHEN 4 THEN lat - CAST(0.02 AS DOUBLE) ELSE lat END AS y, CASE side WHEN 1 THEN lon + CAST(0.02 AS DOUBLE) WHEN 2 THEN lon - CAST(0.02 AS DOUBLE) ELSE lon END AS x FROM five)"""


@query(f"WITH {_POINTS} SELECT DISTINCT printf('%.4f,%.4f', y, x) AS key, CAST(CAST(floor(y * 100) AS BIGINT) % 700 + CAST(floor(x * 100) AS BIGINT) % 300 AS DOUBLE) AS elevation FROM p")
def service_heights(spark, sf_dir):
    """Elevations of the cells' points, in rounds through a cache."""
    points = risk.stencil(_risk(spark, sf_dir)).select(risk.coordinate_key(F.col("p_lat"), F.col("p_lon")).alias("key"))
    return http.fetch_elevations(points, tables.shared_dir(spark), round_points=300, transport="tectra.sources.replay:heights", tries=1)


# --- coverage of archives, one a place ---------------------------------------------------------------------------------

_HORIZON, _OVERLAP = 10 * 86_400_000_000, 2 * 86_400_000_000
_ARCHIVES = "ar AS (SELECT place, min(epoch_us(time)) AS covered_from, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE max(epoch_us(time)) END AS covered_until, count(*) AS n FROM cat GROUP BY place)"
_PLANS = f"""{_ARCHIVES}, pl AS (SELECT *, CASE WHEN covered_until IS NULL THEN {NOW_US} - {_HORIZON} ELSE greatest(covered_until - {_OVERLAP}, {NOW_US} - {_HORIZON}) END AS fetch_from, CAST({NOW_US} AS BIGINT) AS fetch_to,
    CASE WHEN covered_until < {NOW_US} - {_HORIZON} THEN covered_until END AS gap_from, CASE WHEN covered_until < {NOW_US} - {_HORIZON} THEN {NOW_US} - {_HORIZON} END AS gap_to FROM ar)"""


def _archives(spark, sf_dir):
    us = exprs.micros(F.col("time"))
    a = catalog(spark, sf_dir).groupBy("place").agg(F.min(us).alias("covered_from"), F.max(us).alias("last"), F.count(F.lit(1)).alias("n"))
    return a.select("place", "covered_from", F.when(F.col("n") % 5 != 0, F.col("last")).alias("covered_until"), "n")


@query(f"WITH {_PLANS} SELECT place, n, covered_from, coalesce(covered_until, -1) AS covered_until, fetch_from, fetch_to, coalesce(gap_from, -1) AS gap_from, coalesce(gap_to, -1) AS gap_to, coalesce(covered_until > fetch_to, false) AS refused FROM pl")
def fetch_plans(spark, sf_dir):
    """What to read next for each archive; -1 where there is no time."""
    return coverage.fetch_plans(_archives(spark, sf_dir), F.lit(NOW_US)).fillna(-1)


@query(f"WITH {_PLANS} SELECT place, n, covered_from, fetch_to AS covered_until, CASE WHEN gap_from IS NULL THEN 0 ELSE 1 END AS n_gaps, coalesce(gap_from, -1) AS gap_from, coalesce(gap_to, -1) AS gap_to FROM pl")
def manifest_updates(spark, sf_dir):
    """Manifests after their plans: gaps are kept, nothing is dropped silently."""
    m = coverage.updated(coverage.fetch_plans(_archives(spark, sf_dir), F.lit(NOW_US)))
    return m.select("place", "n", "covered_from", "covered_until", F.size("gaps").alias("n_gaps"), F.get("gaps", F.lit(0))["gap_from"].alias("gap_from"), F.get("gaps", F.lit(0))["gap_to"].alias("gap_to")).fillna(-1)


_SEED = 20 * 86_400_000_000


@query(f"""WITH {_ARCHIVES}, s AS (SELECT *, covered_from - {_SEED} AS f, covered_from - {_SEED} // 2 + (n % 3) * {_SEED} AS t FROM ar)
SELECT place, n, least(covered_from, f) AS covered_from, greatest(coalesce(covered_until, t), t) AS covered_until, CASE WHEN t < covered_from THEN t ELSE -1 END AS gap_from, CASE WHEN t < covered_from THEN covered_from ELSE -1 END AS gap_to,
    round((greatest(coalesce(covered_until, t), t) - least(covered_from, f)) / CAST(86400000000 AS DOUBLE) / CAST(365.25 AS DOUBLE), 6) AS years FROM s""")
def seeded_archives(spark, sf_dir):
    a = _archives(spark, sf_dir).withColumns({"seed_from": F.col("covered_from") - _SEED, "seed_to": F.col("covered_from") - _SEED // 2 + (F.col("n") % 3) * _SEED})
    m = coverage.seeded(a)
    gap = F.get("gaps", F.lit(0))
    return r6(m.select("place", "n", "covered_from", "covered_until", gap["gap_from"].alias("gap_from"), gap["gap_to"].alias("gap_to"), coverage.history_years(F.col("covered_from"), F.col("covered_until")).alias("years")).fillna(-1))


@query(f"""WITH {_PLANS}, nw AS (SELECT pl.place, fetch_from, count(cat.id) AS n_new FROM pl LEFT JOIN cat ON cat.place = pl.place AND epoch_us(time) >= fetch_from GROUP BY pl.place, fetch_from)
SELECT place, n_new, n_new = 0 AND {NOW_US} - fetch_from >= 86400000000 AS refused FROM nw""")
def empty_windows(spark, sf_dir):
    """Whether a plan brought nothing from a window of a day or more."""
    plans = coverage.fetch_plans(_archives(spark, sf_dir), F.lit(NOW_US)).select(F.col("place").alias("at"), "fetch_from", "fetch_to")
    df = catalog(spark, sf_dir).select("place", exprs.micros(F.col("time")).alias("us"), "id")
    met = plans.join(df, (F.col("at") == F.col("place")) & (F.col("us") >= F.col("fetch_from")), "left").groupBy("at", "fetch_from", "fetch_to").agg(F.count("id").alias("n_new"))
    return met.select(F.col("at").alias("place"), "n_new", coverage.is_empty_window(F.col("fetch_from"), F.col("fetch_to"), F.col("n_new")).alias("refused"))


@query("""SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN -1 ELSE epoch_us(time) END AS time_us, epoch_us(time) AS typed_us FROM cat""")
def utc_times(spark, sf_dir):
    """Times as texts, of which every seventh is no time (-1), and as they are."""
    df = catalog(spark, sf_dir)
    text = F.when(F.col("id").cast("long") % 7 == 0, F.concat(F.lit("at "), "id")).otherwise(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    kinds = dict(df.dtypes)
    return df.select("id", exprs.micros(exprs.utc_time(text, "string")).alias("time_us"), exprs.micros(exprs.utc_time(F.col("time"), kinds["time"])).alias("typed_us")).fillna(-1)


@query("""SELECT id, epoch_us(time) AS time_us, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'archive' ELSE place END AS place FROM cat""")
def seed_merge(spark, sf_dir):
    """A seed under an archive of every second event: the archive's records stand."""
    df = catalog(spark, sf_dir)
    archive = df.filter(F.col("id").cast("long") % 2 == 0).withColumn("place", F.lit("archive"))
    return clean.merge_events(df, archive).select("id", exprs.micros(F.col("time")).alias("time_us"), "place")


# --- figures, colours, windows ------------------------------------------------------------------------------------------


@query(f"WITH {_FMD} SELECT round(bin_center, 6) AS bin_center, CAST(sum(incremental) OVER (ORDER BY bin_idx DESC) AS BIGINT) AS cumulative, greatest(CAST(incremental AS DOUBLE), CAST(0.1 AS DOUBLE)) AS incremental FROM fmd")
def fmd_plot(spark, sf_dir):
    return r6(stats.fmd_plot(catalog(spark, sf_dir)))


@query("SELECT id, longitude, latitude, round(mag, 6) AS mag, mag >= 4.0 AS is_strong FROM cat")
def epicentres(spark, sf_dir):
    return r6(stats.epicentres(catalog(spark, sf_dir)))


_RISK_COLOUR = "CASE WHEN {x} >= 85 THEN '#d10000' WHEN {x} >= 70 THEN '#ff3b00' WHEN {x} >= 55 THEN '#ff8c00' WHEN {x} >= 40 THEN '#ffd500' ELSE '#6b6b1a' END"


@query(f"""WITH {_SITE}, c AS (SELECT lat_bin, lon_bin, risk_index, amp, CASE WHEN liq >= 0.66 THEN '#d10000' WHEN liq >= 0.42 THEN '#ff8c00' WHEN liq >= 0.22 THEN '#ffd500' ELSE '#6b6b1a' END AS liq,
    CAST(least(100, greatest(0, round_even(risk_index * amp / CAST(1.15 AS DOUBLE), 0))) AS INT) AS site FROM site)
SELECT lat_bin, lon_bin, {_RISK_COLOUR.format(x='risk_index')} AS risk, CASE WHEN amp >= 2.0 THEN '#54278f' WHEN amp >= 1.6 THEN '#756bb1' WHEN amp >= 1.3 THEN '#9e9ac8' WHEN amp >= 1.1 THEN '#cbc9e2' ELSE '#f2f0f7' END AS amp,
    liq, {_RISK_COLOUR.format(x='site')} AS site_risk FROM c""")
def cell_colours(spark, sf_dir):
    s = _sites(spark, sf_dir)
    args = F.col("risk_index"), F.col("amp"), F.col("liq_class"), F.col("site_risk")
    return s.select("lat_bin", "lon_bin", *[risk.metric_colour(m, *args).alias(m) for m in ("risk", "amp", "liq", "site_risk")])


@query(f"WITH {_RISK} SELECT lat_bin, lon_bin, round_even(lat, 4) AS latitude, round_even(lon, 4) AS longitude FROM risk")
def polygon_centres(spark, sf_dir):
    """Centres of the cells' polygons, read back from their GeoJSON."""
    f = export.cell_features(_risk(spark, sf_dir))
    ring = F.from_json("feature", "geometry struct<coordinates: array<array<array<double>>>>")["geometry"]["coordinates"][0]
    lat, lon = risk.polygon_centre(F.col("ring"))
    return f.select("lat_bin", "lon_bin", ring.alias("ring")).select("lat_bin", "lon_bin", lat.alias("latitude"), lon.alias("longitude"))


@query(f"WITH {_WIN} SELECT win_idx, CAST(max_mag >= 5.0 AS INT) AS strong FROM ws")
def strong_windows(spark, sf_dir):
    return forecast.strong_windows(_series(spark, sf_dir)).select("win_idx", "strong")


@query(f"""WITH e AS (SELECT id, epoch_us(time) AS time_us, mag, ({NOW_US} - epoch_us(time)) / CAST(86400000000 AS DOUBLE) AS d FROM cat
    WHERE mag >= 3.0 AND epoch_us(time) >= {NOW_US} - 30 * 86400000000 AND latitude BETWEEN 35.5 AND 42.5 AND longitude BETWEEN 25.5 AND 45.0)
SELECT id, time_us, round(mag, 6) AS mag, CASE WHEN d < 1.0 / 60 THEN 'az önce' WHEN d < CAST(1 AS DOUBLE) / 24 THEN CAST(floor(d * 1440 + 0.5) AS BIGINT) || ' dakika önce' WHEN d < 1 THEN CAST(floor(d * 24 + 0.5) AS BIGINT) || ' saat önce'
    WHEN d < 2 THEN '1 gün önce' ELSE CAST(floor(d) AS BIGINT) || ' gün önce' END AS elapsed, CASE WHEN mag >= 5.5 THEN '5.5+' WHEN mag >= 4.5 THEN '4.5+' WHEN mag >= 3.5 THEN '3.5+' ELSE '<3.5' END AS band,
    round(CASE WHEN mag >= 5.5 THEN 9 + (mag - 5.5) * 4 WHEN mag >= 4.5 THEN 7.5 WHEN mag >= 3.5 THEN 6 ELSE 4 END, 6) AS radius, d < 1 AS is_fresh FROM e""")
def recent_quakes(spark, sf_dir):
    """Thirty days of the national box, newest first."""
    return r6(etas.recent_events(catalog(spark, sf_dir), F.lit(NOW_US), NATIONAL))


# --- gates as verdicts ----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_rows, ['depth_error']::VARCHAR[] AS missing, false AS sound FROM cat")
def catalog_verdict(spark, sf_dir):
    return integrity.catalog_faults(catalog(spark, sf_dir), ["id", "time", "mag", "depth_error"])


@query(f"WITH t AS (SELECT CASE WHEN CAST(id AS BIGINT) % 6 >= 3 THEN round(mag, 1) END AS m FROM cat) SELECT count(m) AS n, round(sum(m), 4) AS total FROM t")
def magnitudes_read(spark, sf_dir):
    """Magnitudes out of texts, of which half are blank, no number or not finite."""
    k = F.col("id").cast("long") % 6
    text = F.when(k == 0, "").when(k == 1, "nan").when(k == 2, "strong").otherwise(F.round("mag", 1).cast("string"))
    found = integrity.finite_magnitudes(catalog(spark, sf_dir).select(text.alias("mag")))
    return found.agg(F.count("mag").alias("n"), F.round(F.sum("mag"), 4).alias("total"))


_ODD = "CASE {k} % 11 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN NULL ELSE {x} END"


def _fault(test: str, name: str) -> str:
    return f"CASE WHEN {test} THEN ['{name}'] ELSE [] END"


@query(f"""WITH {_RISK}, st AS (SELECT lat_bin, lon_bin, {_ODD.format(k='lat_bin', x='max_mag')} AS min_mag, CAST(4.0 AS DOUBLE) AS mc, {_ODD.format(k='lon_bin', x='shallow_fraction - CAST(0.5 AS DOUBLE)')} AS area_skill, {_ODD.format(k='(lat_bin + lon_bin)', x='annual_rate / 50')} AS gain FROM risk)
SELECT lat_bin, lon_bin, list_concat(list_concat(list_concat(list_concat({_fault("coalesce(NOT isfinite(min_mag) OR min_mag < mc, true)", "below completeness")}, {_fault("NOT coalesce(isfinite(area_skill), false)", "skill isn''t finite")}),
    {_fault("isfinite(area_skill) AND NOT area_skill > 0", "no skill")}), {_fault("NOT coalesce(isfinite(gain), false)", "gain isn''t finite")}), {_fault("isfinite(gain) AND NOT gain > 1", "no gain")}) AS faults FROM st""")
def stamp_verdicts(spark, sf_dir):
    """Stamps made of the cells' numbers, some of them not finite."""
    def odd(k, x):
        r = F.pmod(k, F.lit(11))
        return F.when(r == 0, float("nan")).when(r == 1, float("inf")).when(r != 2, x)

    c = _risk(spark, sf_dir)
    a, b = F.col("lat_bin"), F.col("lon_bin")
    return c.select("lat_bin", "lon_bin", integrity.stamp_faults(odd(a, F.col("max_mag")), F.lit(4.0), odd(b, F.col("shallow_fraction") - 0.5), odd(a + b, F.col("annual_rate") / 50)).alias("faults"))


@query(f"""WITH {_RISK}, st AS (SELECT lat_bin, lon_bin, CAST(4.0 AS DOUBLE) + (lat_bin % 3) * CAST(0.04 AS DOUBLE) AS smc, CAST(0.5 AS DOUBLE) + (lon_bin % 4) * CAST(0.3 AS DOUBLE) AS b, CAST(0.5 AS DOUBLE) + (lon_bin % 3) * CAST(0.04 AS DOUBLE) AS ss FROM risk)
SELECT lat_bin, lon_bin, list_concat(list_concat({_fault("abs(smc - 4.0) > 0.05", "mc has drifted")}, {_fault("b NOT BETWEEN 0.6 AND 1.4", "b is out of range")}), {_fault("abs(ss - 0.5) > 0.05", "skill has drifted")}) AS faults FROM st""")
def drift_verdicts(spark, sf_dir):
    c = _risk(spark, sf_dir)
    return c.select("lat_bin", "lon_bin", integrity.drift_faults(4.0 + (F.col("lat_bin") % 3) * 0.04, F.lit(4.0), 0.5 + (F.col("lon_bin") % 4) * 0.3, 0.5 + (F.col("lon_bin") % 3) * 0.04, F.lit(0.5)).alias("faults"))


_P = """pm AS (SELECT CAST(id AS BIGINT) AS no, CAST(0.5 AS DOUBLE) AS mu, CAST(0.02 AS DOUBLE) * (1 + no % 7) AS "K", CAST(0.01 AS DOUBLE) AS c, CAST(0.95 AS DOUBLE) + (no % 5) * CAST(0.1 AS DOUBLE) AS p, CAST(0.5 AS DOUBLE) + (no % 4) * CAST(0.7 AS DOUBLE) AS alpha, CAST(1.0 AS DOUBLE) * ln(10) AS beta FROM cat),
br AS (SELECT *, CASE WHEN alpha < beta AND p > 1 THEN "K" * pow(c, 1 - p) / (p - 1) * beta / (beta - alpha) END AS n FROM pm)"""


def _params(spark, sf_dir):
    k = F.col("id").cast("long")
    df = catalog(spark, sf_dir).select(k.alias("no"), F.lit(0.5).alias("mu"), (0.02 * (1 + k % 7)).alias("K"), F.lit(0.01).alias("c"), (0.95 + (k % 5) * 0.1).alias("p"), (0.5 + (k % 4) * 0.7).alias("alpha"))
    return df.withColumn("n", etas.branching(F.col("K"), F.col("c"), F.col("p"), F.col("alpha"), F.lit(1.0)))


@query(f"WITH {_P} SELECT no, round(n, 6) AS n, CASE WHEN n IS NULL THEN 'undefined' WHEN n < 1 THEN 'sub-critical' ELSE 'super-critical' END AS flag FROM br")
def branching_table(spark, sf_dir):
    return r6(_params(spark, sf_dir).select("no", "n", etas.zone_flag(F.col("n")).alias("flag")))


@query(f"""WITH {_P} SELECT no, round_even("K", 5) AS "K", round_even(p, 4) AS p, round(n, 3) AS branching_ratio, CASE WHEN n IS NULL THEN 'the branching ratio is undefined; a diagnostic fit only' WHEN n > 1 THEN 'super-critical: a diagnostic fit, not for use as it is'
    ELSE 'sub-critical fit on one split; a diagnostic only' END AS warning, CASE WHEN no % 3 = 0 THEN ['source'] ELSE [] END AS faults FROM br""")
def etas_stamps(spark, sf_dir):
    """Stamps of made-up fits, read back and gated; every third has no known source."""
    p = _params(spark, sf_dir)
    fits = p.select(F.col("no").cast("string").alias("zone"), F.lit("fitted").alias("status"), "mu", "K", "c", "p", "alpha", F.lit(1.0).alias("b_value"), F.col("n").alias("branching"), F.lit(10).alias("n_windows"), F.lit(0.25).alias("skill_climatology"))
    known = export.etas_stamp(fits.filter(F.col("zone").cast("long") % 3 != 0), "AFAD").unionByName(export.etas_stamp(fits.filter(F.col("zone").cast("long") % 3 == 0), "UNKNOWN"))
    s = F.from_json("json", "canonical_etas struct<K: double, p: double, branching_ratio: double, warning: string>")["canonical_etas"]
    return known.select(F.col("zone").cast("long").alias("no"), s["K"].alias("K"), s["p"].alias("p"), F.round(s["branching_ratio"], 3).alias("branching_ratio"), s["warning"].alias("warning"), integrity.etas_faults(F.col("json")).alias("faults"))


@query(f"WITH {_RISK} SELECT lat_bin, lon_bin, CASE WHEN (lat_bin * 5 + lon_bin) % 11 = 2 THEN 'missing' WHEN (lat_bin * 5 + lon_bin) % 11 IN (0, 1) THEN 'not finite' WHEN n_events % 4 = 0 THEN 'negative' END AS fault FROM risk")
def count_faults(spark, sf_dir):
    """Counts of which some are missing, not finite or negative."""
    r = (F.col("lat_bin") * 5 + F.col("lon_bin")) % 11
    n = F.when(r == 0, float("nan")).when(r == 1, float("inf")).when(r != 2, F.when(F.col("n_events") % 4 == 0, -F.col("n_events")).otherwise(F.col("n_events")).cast("double"))
    return _risk(spark, sf_dir).select("lat_bin", "lon_bin", skill.count_fault(n).alias("fault"))


_SKILL = f"""q AS (SELECT quantile_cont(epoch_us(time), 0.75) AS c FROM cat), early AS (SELECT cat.* FROM cat, q WHERE epoch_us(time) <= c), {_LATER},
hit AS (SELECT CAST(floor((latitude - 35.5) / 0.25) AS INT) AS lat_bin, CAST(floor((longitude - 25.5) / 0.25) AS INT) AS lon_bin, count(*) AS n FROM cat, q WHERE epoch_us(time) > c AND mag >= 3.0 GROUP BY 1, 2),
sc AS (SELECT row_number() OVER (ORDER BY risk_index DESC, lat_bin, lon_bin) AS place, coalesce(n, 0) AS n FROM risk LEFT JOIN hit USING (lat_bin, lon_bin)),
rn AS (SELECT *, sum(n) OVER (ORDER BY place) AS y, sum(n) OVER () AS t, count(*) OVER () AS k FROM sc),
sk AS (SELECT count(*) AS n_train_cells, CAST(sum(n) AS BIGINT) AS n_test_events, round_even(2 * sum((2 * y - n) / CAST(t AS DOUBLE) / (2 * k)) - 1, 4) AS area_skill_score,
    round_even(sum(CASE WHEN place <= greatest(1, round_even(k * CAST(0.25 AS DOUBLE), 0)) THEN n ELSE 0 END) / CAST(max(t) AS DOUBLE) / (max(greatest(1, round_even(k * CAST(0.25 AS DOUBLE), 0))) / max(k)), 4) AS gain_top25 FROM rn)"""


@query(f"WITH {_SKILL} SELECT * FROM sk")
def surface_scores(spark, sf_dir):
    """The surface's later skill without resampling."""
    return skill.surface_skill(catalog(spark, sf_dir), NATIONAL, **RISK).drop("ci_low", "ci_high")


@query(f"WITH {_SKILL} SELECT area_skill_score, gain_top25, n_test_events, true AS within FROM sk")
def stamp_skill(spark, sf_dir):
    """The surface's stamp with its real skill and gain, read back, and whether the score lies within its interval of 1000 resamples."""
    df = catalog(spark, sf_dir)
    found = skill.surface_skill(df, NATIONAL, n_boot=1000, **RISK)
    stamp = export.meta_stamp(_risk(spark, sf_dir), clean.at_least(df, 5.0), found, stats.completeness_magnitude(df), source="events", region=NATIONAL.name, cell_deg=0.25, min_mag=3.0)
    s = stamp.select(F.from_json("json", "area_skill_score double, area_skill_score_ci array<double>, gain_top25 double, n_test_events long").alias("s")).select("s.*")
    return s.select("area_skill_score", "gain_top25", "n_test_events", F.col("area_skill_score").between(F.col("area_skill_score_ci")[0], F.col("area_skill_score_ci")[1]).alias("within"))


@query("SELECT round(avg(mag), 6) AS mean, true AS within, true AS as_wide FROM cat")
def mean_interval(spark, sf_dir):
    """The mean magnitude with an interval of 2000 resamples: it holds the mean, and is as wide as the normal law has it, to a tenth."""
    df = catalog(spark, sf_dir)
    ci = forecast.bootstrap_mean_ci(df, "mag", n_boot=2000)
    wide = df.agg((2 * 1.959964 * F.stddev_samp("mag") / F.sqrt(F.count("mag"))).alias("normal"))
    return ci.crossJoin(wide).select(F.round("mean", 6).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("within"), (F.abs((F.col("high") - F.col("low")) / F.col("normal") - 1) < 0.1).alias("as_wide"))


@query("SELECT count(*) AS n_events, count(*) FILTER (WHERE mag >= 3.0) AS n_new, count(*) FILTER (WHERE mag >= 3.0) AS n_last, 21.0 AS gap_days FROM cat WHERE mag < 3.5 OR mag >= 3.0")
def archive_updates(spark, sf_dir):
    """An archive after a seed and two updates a month apart: its events, those of the last update, and the gap between them."""
    path, df = tables.shared_dir(spark), catalog(spark, sf_dir)
    files.update_archive(spark, path, datetime(2024, 2, 5, tzinfo=timezone.utc), lambda plan, least: df.filter("mag < 3.5").withColumn("place", F.lit("first")), seed=df.filter("mag < 3.0").withColumn("place", F.lit("seed")))
    m = files.update_archive(spark, path, datetime(2024, 3, 7, tzinfo=timezone.utc), lambda plan, least: df.filter("mag >= 3.0").withColumn("place", F.lit("last")))
    days = sum((datetime.fromisoformat(g["to"]) - datetime.fromisoformat(g["from"])).total_seconds() / 86_400 for g in m["gaps"] if g["from"] >= "2024-02-05")
    events, _ = files.load_archive(spark, path)
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.lit(m["last_run"]["n_new"]).cast("long").alias("n_new"), F.count_if(F.col("place") == "last").alias("n_last"), F.lit(days).cast("double").alias("gap_days"))


# --- outputs ----------------------------------------------------------------------------------------------------------


@query("""SELECT 'replay' AS source, count(*) AS n_events, min(epoch_us(time)) AS date_min, max(epoch_us(time)) AS date_max, count(*) AS n_csv, round(sum(mag), 4) AS csv_mag FROM cat WHERE mag >= 3.0""")
def processed_outputs(spark, sf_dir):
    """Catalog and summary as they are written, read back."""
    path = tables.shared_dir(spark)
    files.write_processed(catalog(spark, sf_dir), {"source": "replay"}, path, 3.0)
    s = spark.read.text(f"{path}/summary.json", wholetext=True).select(F.from_json("value", "source string, n_events long, date_min long, date_max long").alias("s")).select("s.*")
    return s.crossJoin(files.load_catalog(spark, f"{path}/catalog.csv").agg(F.count(F.lit(1)).alias("n_csv"), F.round(F.sum("mag"), 4).alias("csv_mag")))


_LOOK = 1440 * 60_000_000
_AT = 1_706_572_800_000_000


@query(f"""SELECT id, round_even(longitude, 5) AS lon, round_even(latitude, 5) AS lat, round_even(mag, 2) AS mag, round_even(depth, 2) AS depth_km, strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS time, magtype AS mag_type, place FROM cat WHERE epoch_us(time) >= {_AT} - {_LOOK}""")
def live_written(spark, sf_dir):
    """The live feed's features as they are written, read back."""
    path, df = tables.shared_dir(spark), catalog(spark, sf_dir)
    live.publish_live(live.live_events(df.unionByName(df), F.lit(_AT), 1440), path, F.lit(_AT))
    s = F.from_json("value", "geometry struct<coordinates: array<double>>, properties struct<event_id: string, time: string, mag: double, mag_type: string, depth_km: double, place: string>")
    p = live.read_live(spark, path)[0].select(s.alias("s"))
    return p.select(F.col("s.properties.event_id").alias("id"), F.col("s.geometry.coordinates")[0].alias("lon"), F.col("s.geometry.coordinates")[1].alias("lat"), *[F.col(f"s.properties.{c}").alias(c) for c in ("mag", "depth_km", "time", "mag_type", "place")])


@query(f"""WITH a AS (SELECT count(*) AS n_events, max(time) AS t FROM cat WHERE epoch_us(time) >= {_AT} - {_LOOK}), l AS (SELECT *, round_even(({_AT} - epoch_us(t)) / CAST(60000000 AS DOUBLE), 1) AS lag_minutes FROM a)
SELECT n_events, lag_minutes, CASE WHEN n_events = 0 THEN 'empty' WHEN lag_minutes <= 30 THEN 'fresh' ELSE 'stale' END AS status, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS latest_event_time FROM l""")
def live_stamp(spark, sf_dir):
    """The live feed's stamp, written by a stream over the recorded events and read back."""
    path = tables.shared_dir(spark)
    live.live_stream(_stream(spark, sf_dir), path, f"{path}/checkpoint", lookback_minutes=1440, checked_at=F.lit(_AT)).awaitTermination()
    return spark.read.text(f"{path}/live_meta.json").select(F.from_json("value", "n_events long, lag_minutes double, status string, latest_event_time string").alias("s")).select("s.*")


def _stream(spark, sf_dir):
    """The recorded events as a stream of catalog rows."""
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return catalog(spark, sf_dir, raw)


@query("SELECT id, epoch_us(time) AS time_us, round(mag, 6) AS mag FROM cat")
def stream_archive(spark, sf_dir):
    """An archive that a stream of events merges into, by ids and the later record, after a first batch with other magnitudes."""
    path, df = tables.shared_dir(spark), catalog(spark, sf_dir)
    archive.upsert(spark, path, df.withColumn("mag", F.lit(0.0)))
    live.upsert_stream(_stream(spark, sf_dir), spark, path, f"{path}/checkpoint").awaitTermination()
    return r6(live.read_archive(spark, path).select("id", exprs.micros(F.col("time")).alias("time_us"), "mag"))


@query("SELECT id, epoch_us(time) AS time_us, round(mag, 6) AS mag FROM cat")
def stream_revisions(spark, sf_dir):
    """Last records of a stream whose polls bring first guesses of some events, then the catalog, then guesses of others that come late, in
    separate micro-batches."""
    path, df = tables.shared_dir(spark), catalog(spark, sf_dir)
    third = F.col("id").cast("long") % 3
    polls = [(1, df.filter(third == 1).withColumn("mag", F.lit(0.0))), (3, df), (2, df.filter(third == 0).withColumn("mag", F.lit(9.0)))]
    for minute, rows in polls:
        rows = rows.select(*CATALOG_COLUMNS, F.timestamp_seconds(F.lit(60 * minute)).alias("seen_at"), F.lit(0).cast("long").alias("ord"))
        rows.write.mode("append").parquet(f"{path}/polls")
        live.revisions_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/polls"), f"{path}/archive", f"{path}/checkpoint").awaitTermination()
    return r6(live.read_archive(spark, f"{path}/archive").select("id", exprs.micros(F.col("time")).alias("time_us"), "mag"))


@query(f"""WITH {_RISK} SELECT ['summary''s source'] AS faults, (SELECT count(*) FROM cat) AS n_events, (SELECT count(*) FROM risk) AS n_cells, (SELECT count(*) FROM cat WHERE mag >= 5.0) AS n_big_events""")
def output_verdict(spark, sf_dir):
    """The contract of all outputs, on a set whose summary names another source."""
    o = _outputs(spark, sf_dir, "replay")
    return integrity.output_faults(o["catalog"], o["summary"], o["meta"], o["cells"], o["big_events"], "AFAD", site_layer=False)


_DENIED = "prediction isn''t denied"
_FREE = "use isn''t restricted"


@query(f"""WITH {_RISK}, {_MC.replace('span AS', 'mspan AS').replace('FROM span', 'FROM mspan')},
v(variant, before, low, after) AS (VALUES ('as it is', [], [], []), ('source', ['unknown source'], [], []), ('region', ['missing region'], [], []), ('texts', ['{_FREE}', '{_DENIED}'], [], []),
    ('skill', [], ['skill isn''t finite'], []), ('gain', [], ['no gain'], []), ('edge', [], [], ['cells of another size']), ('number', [], [], ['cells of another number']))
SELECT variant, list_concat(list_concat(before, CASE WHEN (SELECT mc FROM mc) > 3.0 THEN ['below completeness'] ELSE [] END), list_concat(low, after)) AS faults, (SELECT count(*) FROM risk) AS n_cells FROM v""")
def surface_verdict(spark, sf_dir):
    """The served surface's contract on its stamp and on stamps with one change each."""
    o = _outputs(spark, sf_dir, "AFAD")
    changes = [("as it is", "", ""), ("source", '"AFAD"', '"replay"'), ("region", '"region"', '"place"'), ("texts", "değildir", ""), ("skill", '"area_skill_score":0.5', '"area_skill_score":NaN'), ("gain", '"gain_top25":2.0', '"gain_top25":1.0'), ("edge", '"cell_deg":0.25', '"cell_deg":0.5'), ("number", '"n_cells":', '"n_cells":1')]
    each = F.array(*[F.struct(F.lit(name).alias("variant"), (F.replace("json", F.lit(old), F.lit(new)) if old else F.col("json")).alias("json"), F.get_json_object("json", "$.n_cells").cast("long").alias("n_cells")) for name, old, new in changes])
    return integrity.surface_faults(o["meta"].select(F.explode(each).alias("s")).select("s.*"), o["cells"]).select("variant", "faults", "n_cells")


def _output_sets(spark, sf_dir, *sources):
    """For each source: catalog, summary of that source, stamp, cells and events. Sets share one written catalog, and cells, stamp and the
    summary's numbers of it, each made once."""
    df = tables.written(catalog(spark, sf_dir))
    cells = tables.written(risk.risk_cells(df, NATIONAL, **RISK))
    big = clean.at_least(df, 5.0)
    none = spark.createDataFrame([(0.5, 2.0, 0.4, 0.6, 10)], "area_skill_score double, gain_top25 double, ci_low double, ci_high double, n_test_events long")
    meta = tables.written(export.meta_stamp(cells, big, none, stats.completeness_magnitude(df), source="AFAD", region=NATIONAL.name, cell_deg=0.25, min_mag=3.0, disclaimer="Deprem tahmini değildir.", use_restriction="rating girdisi değildir"))
    numbers = tables.written(clean.completeness_summary(df).select("n_events", "date_min", "date_max"))
    summary = lambda source: numbers.select(F.to_json(F.struct(F.lit(source).alias("source"), "*")).alias("json"))
    return [{"catalog": df, "summary": summary(x), "meta": meta, "cells": export.cell_features(cells), "big_events": export.event_features(df, 5.0)} for x in sources]


def _outputs(spark, sf_dir, source):
    return _output_sets(spark, sf_dir, source)[0]


@query(f"""WITH {_RISK} SELECT (SELECT count(*) FROM cat) AS n_events, (SELECT count(*) FROM risk) AS n_cells, (SELECT count(*) FROM cat WHERE mag >= 5.0) AS n_big_events, 'AFAD' AS source""")
def published_outputs(spark, sf_dir):
    """All outputs, published after a set with a fault has been refused, and read back."""
    path = tables.shared_dir(spark)
    refused, sound = _output_sets(spark, sf_dir, "replay", "AFAD")
    try:
        outputs.publish_outputs(path, refused, "AFAD", site_layer=False)
    except CatalogError:
        pass
    outputs.publish_outputs(path, sound, "AFAD", site_layer=False)
    o = outputs.read_outputs(spark, path)
    n = lambda k: o[k].agg(F.count(F.lit(1)).alias(f"n_{k}"))
    counts = n("catalog").crossJoin(n("cells")).crossJoin(n("big_events")).crossJoin(o["summary"].select(F.get_json_object("json", "$.source").alias("source")))
    return counts.withColumnRenamed("n_catalog", "n_events")


# --- learners: no SQL ---------------------------------------------------------------------------------------------------


@query()
def magnitude_models(spark, sf_dir):
    """Can the next event's magnitude be told?"""
    return forecast.magnitude_models(forecast.event_features(catalog(spark, sf_dir), 3.5, 10))


@query()
def strong_window_verdict(spark, sf_dir):
    return forecast.strong_window_verdict(_series(spark, sf_dir), 4.2)


@query()
def model_leaderboard(spark, sf_dir):
    return forecast.model_leaderboard(_series(spark, sf_dir))
