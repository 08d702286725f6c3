import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tectra.functions import exprs, ordering
from tectra.operators import clean, stats
from tectra.schemas import CATALOG_COLUMNS, DAY_US, RAW_CATALOG, CatalogError, Region
from tectra.sources import files

RAW = [
    ("b", "2020-01-02T00:00:00", "38", "30", "7", "4.0", "ML", "x"),
    ("a", "2020-01-01T00:00:00", "39", "31", None, "3.5", "ML", "y"),
    ("a", "2020-01-03T00:00:00", "39", "31", "9", "5.5", "ML", "later copy"),
    ("c", "12:30", "39", "31", "9", "5.5", "ML", "no date"),
    ("d", "2020-01-04", "39", "NaN", "9", "5.5", "ML", "no longitude"),
    ("e", "2020-01-05T06:00:00+03:00", "39", "31", "junk", "2.5", "ML", "offset"),
]


def raw(spark, rows=RAW):
    return spark.createDataFrame([(a, b, *c) for a, b, *c in rows], RAW_CATALOG.replace("double", "string"))


def test_clean(spark):
    got = {r.id: r for r in clean.clean_catalog(raw(spark)).collect()}
    assert set(got) == {"a", "b", "e"}
    assert got["a"].interevent_days is None and got["b"].interevent_days == 1.0
    assert got["e"].time == datetime(2020, 1, 5, 3) and got["e"].depth is None and got["a"].year == 2020
    assert clean.clean_catalog(raw(spark).limit(0)).count() == 0


def test_time_of_the_great_event_is_utc(spark):
    df = raw(spark, [("543428", "2023-02-06T01:17:32", "37.27728", "37.03996", "8.6", "7.7", "MW", "p")])
    us = clean.clean_catalog(df).select(exprs.micros(F.col("time"))).first()[0]
    assert us == int(datetime(2023, 2, 6, 1, 17, 32, tzinfo=timezone.utc).timestamp() * 1e6)


def test_index_and_frames_over_blocks(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") * 3571 % 500 * 7000).alias("time"), F.col("id").cast("double").alias("v"))
    rows, w = ordering.with_rows_before(ordering.with_index(df, "time", "id"), 3, block=7)
    got = ordering.own_rows(rows.withColumn("s", F.sum("v").over(w.rowsBetween(-3, -1)))).toPandas().sort_values("idx")
    v = got["v"].tolist()
    assert got["idx"].tolist() == list(range(1, 501)) and got["time"].is_monotonic_increasing
    assert [x for x in got["s"].tolist()[1:]] == [sum(v[max(0, i - 3) : i]) for i in range(1, 500)]


def test_merge_keeps_revisions_and_is_idempotent(spark):
    a, b = raw(spark, [("1", "2020-01-01", "38", "30", "7", "4.0", "ML", "old"), (None, "2020-01-01", "38", "30", "7", "4.0", "ML", "n")]), raw(spark, [("1", "2020-01-01", "38", "30", "7", "4.4", "ML", "new")])
    once = clean.merge_events(a, b)
    assert {(r.id, r.mag) for r in once.collect()} == {("1", 4.4), (None, 4.0)}
    assert {(r.id, r.mag) for r in clean.merge_events(once, b).collect()} == {("1", 4.4), (None, 4.0)}
    assert once.columns == CATALOG_COLUMNS


def test_bins_by_edges(spark):
    import numpy as np

    m = [round(2 + 0.1 * k, 1) for k in range(40)] + [3.3] * 5
    df = spark.createDataFrame([(x,) for x in m], "mag double")
    got = stats.frequency_magnitude(df).toPandas().sort_values("bin_idx")
    lo = np.floor(min(m) / 0.1) * 0.1
    n = int(round((max(m) - lo) / 0.1)) + 1
    want, _ = np.histogram(m, lo + 0.1 * np.arange(n + 1))
    assert got["incremental"].tolist() == want.tolist()
    assert got["cumulative"].iloc[0] == len(m) and got["cumulative"].is_monotonic_decreasing
    assert stats.frequency_magnitude(df.limit(0)).count() == 0


def test_b_of_an_exponential_sample(spark):
    import numpy as np

    m = 3 + np.random.default_rng(0).exponential(0.43, 3000)
    df = spark.createDataFrame([(float(x),) for x in m], "mag double")
    assert 0.7 < stats.b_value(df, 3.0).first().b < 1.2
    with pytest.raises(Exception, match="too few"):
        stats.b_value(df.limit(1), 3.0).collect()


def test_hazard_cells(spark):
    box = Region("box", 38, 42, 30, 36)
    rows = [("2000-01-01", 40.1, 30.1, 5.0), ("2001-01-01", 40.1, 30.1, 5.0), ("2010-01-01", 40.1, 30.1, 5.0), ("2005-01-01", 42.0, 36.0, 5.0), ("2005-01-01", 50.0, 30.0, 5.0), ("2005-01-01", 40.1, 30.1, 3.0)]
    df = spark.createDataFrame(rows, "time string, latitude double, longitude double, mag double").withColumn("time", F.col("time").cast("timestamp"))
    cells = stats.hazard_cells(df, box).orderBy(F.desc("n_events")).collect()
    assert [c.n_events for c in cells] == [3, 1] and cells[1].lat_bin == 15
    assert stats.hazard_raster(df, box).count() == 16 * 24
    assert stats.hazard_cells(df, box, min_mag=9).count() == 0
    assert stats.grid_size(35.5, 42.5, 0.1) == 70 and stats.grid_size(25.5, 45.0, 0.1) == 195
    with pytest.raises(Exception, match="spans no time"):
        stats.hazard_cells(df.limit(1), box).collect()


NOW = datetime(2026, 10, 25, 12, tzinfo=timezone.utc)


def test_plans_and_manifests():
    with pytest.raises(CatalogError):
        files.plan_fetch({"covered_until": (NOW + timedelta(days=1)).isoformat()}, NOW)
    p = files.plan_fetch({"covered_until": (NOW - timedelta(days=30)).isoformat()}, NOW)
    assert p.start == NOW - timedelta(days=10) and p.gap == (NOW - timedelta(days=30), p.start)
    q = files.plan_fetch({"covered_until": (NOW - timedelta(days=1)).isoformat()}, NOW)
    assert q.start == NOW - timedelta(days=3) and q.gap is None
    m = files.update_manifest({}, p, n_events=3, n_new=2, now=NOW)
    assert len(m["gaps"]) == 1 and m["covered_from"] == p.start.isoformat()
    s = files.apply_seed(m, NOW - timedelta(days=9000), NOW - timedelta(days=60))
    assert [g["from"] for g in s["gaps"]] == sorted(g["from"] for g in s["gaps"]) and files.export_ready(s) and not files.export_ready(m)
    assert files.history_years({}) == 0


def test_archive_round_trip(spark, tmp_path):
    path, calls = str(tmp_path / "archive"), []

    def fetch(plan, min_mag):
        calls.append(plan)
        return raw(spark, [("a", "2026-10-24T00:00:00", "39", "35", "10", "3.0", "ML", "p")]) if len(calls) < 3 else raw(spark, []).limit(0)

    files.update_archive(spark, path, NOW, fetch)
    m = files.update_archive(spark, path, NOW + timedelta(hours=1), fetch)
    events, manifest = files.load_archive(spark, path)
    assert events.count() == 1 and m["n_events"] == 1 and manifest == m
    with pytest.raises(CatalogError):
        files.update_archive(spark, path, NOW + timedelta(days=2), fetch)
    assert files.load_archive(spark, path)[1] == m
    assert files.load_archive(spark, str(tmp_path / "none"))[0].count() == 0
    summary = files.write_processed(events, manifest, str(tmp_path / "out"), 2.5).first()
    assert summary.n_events == 1 and json.loads(summary.gaps) == []


def test_seed_and_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("eventID,date,latitude,longitude,depth,magnitude,type,location\n1,2020-01-01T00:00:00,38,30,5,4.1,ML,here\n")
    (tmp_path / "b.csv").write_text("id,time\n1,2\n")
    assert files.read_seed(spark, str(tmp_path / "a.csv")).first().mag == "4.1"
    assert files.load_catalog(spark, str(tmp_path / "a.csv")).count() == 1
    with pytest.raises(CatalogError):
        files.read_seed(spark, str(tmp_path / "b.csv"))
    for text, want in (('{"source": "AFAD"}', "AFAD"), ("{", files.UNKNOWN), ("[]", files.UNKNOWN), ('{"source": ""}', files.UNKNOWN)):
        (tmp_path / "s.json").write_text(text)
        assert files.catalog_source(spark, str(tmp_path / "s.json")) == want
    assert files.catalog_source(spark, str(tmp_path / "gone.json")) == files.UNKNOWN


def test_summary_of_nothing(spark):
    r = clean.completeness_summary(clean.conform(raw(spark).limit(0))).first()
    assert r.n_events == 0 and r.mag_max is None and r.depth_median_km is None


def test_gaps(spark):
    df = spark.createDataFrame([(0, 2 * DAY_US), (DAY_US, 3 * DAY_US), (5 * DAY_US, 6 * DAY_US)], "start long, end long")
    assert [tuple(r) for r in clean.coverage_gaps(df).collect()] == [(3 * DAY_US, 5 * DAY_US)]
