"""Learners on planted data, resampling, block sums, quantiles, services that stop half-way, and gates that accept."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tectra.functions import ordering, tables
from tectra.operators import coverage, etas, export, forecast, integrity, skill, stats
from tectra.schemas import NATIONAL, CatalogError
from tectra.sources import files, http
from tectra.streaming import live
from tests.test_models import events, hotspots, simulate
from tests.test_sources import HERE, ROWS, record

CALLS = "tests.test_around:"


def test_blocks_sum_like_one(spark, monkeypatch):
    """Intensities and expected counts over a deep tree of small leaves, with events at one time."""
    monkeypatch.setattr(etas, "LEAF", 3)
    t, m = simulate(0.8, 0.02, 0.05, 1.2, 1.0, 4.0, 60, 5)
    t = np.round(t * 86_400e6) / 86_400e6
    t[5] = t[4]
    p = etas.Params(0.5, 0.02, 0.05, 1.2, 1.0, 4.0)
    df = spark.createDataFrame([(f"{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(zip(t, m))], "id string, t double, mag double").repartition(3)
    want = [0.5 + sum(0.02 * math.exp(m[j] - 4) * (t[i] - t[j] + 0.05) ** -1.2 for j in range(i)) for i in range(len(t))]
    assert np.allclose([r.rate for r in etas.intensity(df, p).orderBy("id").collect()], want)
    wins = etas.fixed_windows(df, 20.0, 60.0, 4.0).drop("n")
    omori = lambda a, b: ((b + 0.05) ** -0.2 - (a + 0.05) ** -0.2) / -0.2
    for r in etas.expected_counts(wins, df, p).collect():
        s = sum(0.02 * math.exp(m[j] - 4) * (omori(0, r.we - t[j]) - omori(0, r.ws - t[j])) for j in range(len(t)) if t[j] < r.ws)
        assert math.isclose(r.expected, 0.5 * (r.we - r.ws) + s, rel_tol=1e-9)
    assert etas.intensity(df.limit(0), p).count() == 0
    assert {r.expected for r in etas.expected_counts(wins, df.limit(0), p).collect()} == {2.0}


def test_branching_of_rows_and_of_numbers(spark):
    rows = [(0.1, 0.01, 1.2, 1.0, 1.0), (0.1, 0.01, 0.9, 1.0, 1.0), (0.1, 0.01, 1.2, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "k double, c double, p double, a double, b double")
    got = [r[0] for r in df.select(etas.branching(*map(F.col, "kcpab"))).collect()]
    want = [etas.branching_ratio(etas.Params(0.5, k, c, p, a, 4.0), b) for k, c, p, a, b in rows]
    assert [x is None for x in got] == [x is None for x in want] == [False, True, True] and math.isclose(got[0], want[0])


@pytest.mark.parametrize("few", [10_000, 3])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "RANGES", 16)
    r = np.random.default_rng(0)
    for values in (r.exponential(5, 500), r.integers(0, 9, 300).astype(float), np.array([1e300, -1e300, 0.0, 1.0]), np.array([3.0]), np.full(50, 2.0)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert math.isclose(ordering.quantile(df, F.col("x"), q), np.quantile(values, q), rel_tol=1e-12)
    assert ordering.quantile(spark.createDataFrame([(None,)], "x double"), F.col("x"), 0.5) is None


def test_auc_in_ranges(spark):
    r = np.random.default_rng(1)
    y, p = r.integers(0, 2, 400), np.round(r.normal(size=400), 2)
    want = np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    for buckets in (2, 1024):
        assert math.isclose(forecast.roc_auc(df, "y", "p", buckets).first().auc, want)
    assert forecast.roc_auc(df.withColumn("p", F.lit(0.5)), "y", "p").first().auc == 0.5
    assert forecast.roc_auc(df.filter("y = 1"), "y", "p").first().auc is None


def test_bootstrap_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(r.normal(5, 2, 1500))], "id string, x double")
    a, b = (forecast.bootstrap_mean_ci(df.repartition(n), "x", 500).first() for n in (1, 7))
    assert math.isclose(a.low, b.low) and math.isclose(a.high, b.high)
    se = 2 / 1500**0.5
    assert a.low < a.mean < a.high and abs((a.high - a.low) / (2 * 1.96 * se) - 1) < 0.15
    w = forecast.poisson_weights(np.arange(2000), 50, 0)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert forecast.bootstrap_mean_ci(df.limit(0), "x", 10).first().low is None


def _windows(spark, n, f, seed=0):
    r = np.random.default_rng(seed)
    y, m = [0.0, 0.0], [0.0, 0.0]
    for _ in range(n):
        y.append(float(r.poisson(f(y))))
        m.append(float(3 + y[-1] / 5))
    return spark.createDataFrame([(k, int(a), b) for k, (a, b) in enumerate(zip(y, m))], "win_idx int, n_events long, max_mag double")


def test_learners_beat_climatology_where_there_is_a_signal(spark):
    """A planted dependence on the window before is found, and pure chance isn't."""
    clustered = _windows(spark, 400, lambda y: 1 + 0.85 * y[-1])
    found = {r.model: r for r in forecast.model_leaderboard(clustered, rounds=20).collect()}
    assert found["poisson_glm"].skill > 0.1 and found["boosted"].skill > 0.1 and found["climatology"].skill == 0
    assert sum(r.is_winner for r in found.values()) == 1
    chance = {r.model: r.skill for r in forecast.model_leaderboard(_windows(spark, 400, lambda y: 5), rounds=20).collect()}
    assert chance["poisson_glm"] < 0.1 and chance["persistence"] < 0
    swing = _windows(spark, 400, lambda y: 12 if y[-1] < 6 else 1)
    v = forecast.strong_window_verdict(swing, 4.2, rounds=20).first()
    assert v.skill > 0.5 and v.auc > 0.9
    none = forecast.strong_window_verdict(swing, 99.0).first()
    assert none.positive_rate == 0 and none.auc is None and none.brier == 0


def test_magnitudes_are_told_only_if_they_can_be(spark):
    r = np.random.default_rng(3)
    random = events(spark, [(float(k), 38.0, 30.0, float(round(4 + r.exponential(0.4), 2))) for k in range(400)])
    got = {x.model: x for x in forecast.magnitude_models(forecast.event_features(random, 4.0, 10), rounds=10).collect()}
    assert not got["boosted"].predictable and got["persistence"].r2 < 0
    planted = events(spark, [(float(k), 38.0, 30.0, 4.0 if k % 2 else 6.0) for k in range(400)])
    got = {x.model: x for x in forecast.magnitude_models(forecast.event_features(planted, 4.0, 10), rounds=10).collect()}
    assert got["boosted"].predictable and got["boosted"].r2 > 0.9


def test_zone_that_fits(spark):
    t, m = simulate(0.4, 0.02, 0.05, 1.2, 1.0, 4.0, 300, 4)
    df = events(spark, [(float(a), 38.0, 27.0, float(round(b, 2))) for a, b in zip(t, m)]).withColumn("zone", F.lit("z"))
    f = etas.fit_zones(df, 4.0, window_days=10.0)
    row = f.first()
    assert row.status == "fitted" and row.mu > 0 and row.n_windows > 3
    stamp = json.loads(export.etas_stamp(f, "AFAD").first().json)
    integrity.etas_gate(stamp)
    assert f.sparkSession.createDataFrame([(json.dumps(stamp),)], "json string").select(integrity.etas_faults(F.col("json"))).first()[0] == []
    bad = json.dumps(stamp).replace('"mu":', '"mu": true, "was":')
    assert f.sparkSession.createDataFrame([(bad,)], "json string").select(integrity.etas_faults(F.col("json"))).first()[0] == ["mu"]


def test_science_gate_accepts_a_sound_stamp(spark):
    df = hotspots(spark, (900, 200, 40), (300, 60, 12))
    mc = stats.completeness_magnitude(df).first().mc
    s = skill.surface_skill(df, NATIONAL, min_mag=max(3.0, mc), cell_deg=0.25).first()
    stamp = {"mc": mc, "cell_deg": 0.25, "area_skill_score": s.area_skill_score}
    out = integrity.science_gate(df, NATIONAL, stamp, min_mag=max(3.0, mc), cell_deg=0.25)
    assert out["area_skill_score"] == s.area_skill_score and out["gain_top25"] > 1
    for k, v in (("mc", mc + 0.2), ("cell_deg", 0.5), ("area_skill_score", s.area_skill_score - 0.2), ("area_skill_score", float("nan")), ("mc", None)):
        with pytest.raises(CatalogError):
            integrity.science_gate(df, NATIONAL, stamp | {k: v}, min_mag=max(3.0, mc), cell_deg=0.25)


def test_output_gate(spark):
    frame = lambda c, *x: spark.createDataFrame([(v,) for v in x], f"{c} string")
    catalog = events(spark, [(1.0, 38.0, 30.0, 5.0)])
    props = {k: 1 for k in integrity.CELL_KEYS + integrity.SITE_KEYS}
    good = {
        "summary": {"source": "AFAD", "n_events": 1, "date_min": 1, "date_max": 1},
        "meta": {"source": "AFAD", "n_cells": 1, "n_big_events": 1, "disclaimer": "Deprem TAHMİNİ değildir", "mc": 2.9, "use_restriction": "rating için değil"},
        "cell": {"properties": props},
        "event": {"properties": {"mag": 6.1}},
    }

    def gate(x, **options):
        return integrity.output_gate(catalog, frame("json", json.dumps(x["summary"])), frame("json", json.dumps(x["meta"])), frame("feature", json.dumps(x["cell"])), frame("feature", json.dumps(x["event"])), source="AFAD", **options)

    assert gate(good) == {"n_events": 1, "n_cells": 1, "n_big_events": 1}
    without_sites = {"cell": {"properties": {k: 1 for k in integrity.CELL_KEYS}}}
    assert gate(good | without_sites, site_layer=False)["n_cells"] == 1
    for part, value in (("summary", good["summary"] | {"source": "USGS"}), ("summary", {"source": "AFAD"}), ("meta", good["meta"] | {"disclaimer": "?"}), ("meta", good["meta"] | {"use_restriction": ""}), ("cell", without_sites["cell"]), ("event", {"properties": 1})):
        with pytest.raises(CatalogError):
            gate(good | {part: value})


def test_collection_and_lines(spark, tmp_path):
    f = export.event_features(events(spark, [(1.0, 38.0, 30.0, 6.5), (2.0, 39.0, 31.0, 6.1)]).withColumn("place", F.lit(None).cast("string")))
    whole = json.loads(export.collection(f, ["id"]).first().json)
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == 2
    export.write_features(f, str(tmp_path / "f"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert sorted(x["properties"]["mag"] for x in lines) == [6.1, 6.5]


def test_backfill_counts_what_failed(spark):
    r = http.backfill_result(spark, "afad", 1998, 2001, on_gap="allow", transport=HERE + "afad", tries=1)
    assert (r.n_windows, r.n_failed, r.thin) == (4, 2, (1998, 1999)) and r.events.count() == 3


def some_heights(url, body):
    """Answers for the north alone."""
    found = [p["latitude"] for p in json.loads(body)["locations"]]
    if any(x < 38 for x in found):
        raise OSError("no answer")
    return json.dumps({"results": [{"elevation": x} for x in found]}).encode()


def test_elevations_go_on_where_they_stopped(spark, tmp_path):
    points = spark.createDataFrame([(f"{37 + k / 10:.4f},30.0000",) for k in range(20)] * 2, "key string")
    cache, o = str(tmp_path / "cache"), {"round_points": 2, "tries": 1, "batch": 1}
    with pytest.raises(Exception):
        http.fetch_elevations(points, cache, transport=CALLS + "some_heights", **o)
    kept = spark.read.parquet(cache).count() if (tmp_path / "cache").exists() else 0
    assert kept < 20
    got = http.fetch_elevations(points, cache, transport=HERE + "heights", **o)
    assert got.count() == 20 == spark.read.parquet(cache).count() and got.select("key").distinct().count() == 20
    assert http.fetch_elevations(points, cache, transport=CALLS + "some_heights", **o).count() == 20


def polled(url):
    return json.dumps([record(7, "2026-06-27", place=url.split("start=")[1][:19])]).encode()


def test_live_service_replays_the_same_window(spark, tmp_path):
    reader = http._LiveReader({"region": json.dumps(NATIONAL.__dict__), "min_mag": "3", "lookback": "120", "transport": CALLS + "polled"})
    start = reader.initialOffset()
    rows, end = reader.read(start)
    rows = list(rows)
    assert end["poll"] == 1 and list(reader.readBetweenOffsets(start, end)) == rows == list(reader.readBetweenOffsets(start, json.loads(json.dumps(end))))
    assert rows[0][7] == end["from"] and list(reader.readBetweenOffsets(start, start)) == []
    spark.dataSource.register(http.LiveService)
    stream = spark.readStream.format("live_service").options(region=json.dumps(NATIONAL.__dict__), min_mag="3", lookback="120", transport=CALLS + "polled").load()
    q = live.upsert_stream(stream, spark, str(tmp_path / "a"), str(tmp_path / "cp"), once=False)
    try:
        for _ in range(60):
            if live._version(spark, str(tmp_path / "a")) or q.exception():
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert q.exception() is None and [r.id for r in live.read_archive(spark, str(tmp_path / "a")).collect()] == ["7"]


def test_live_stream_overwrites(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    checked = F.lit(1_782_537_000_000_000)  # 2026-06-27T05:10:00Z
    for k, mag in enumerate((3.0, 3.456)):
        spark.createDataFrame([("1", "2026-06-27T04:30:00", 38.0, 30.123456, 5.0, mag, "ML", None, k)], ROWS).coalesce(1).write.mode("append").parquet(src)
        live.live_stream(spark.readStream.schema(ROWS).parquet(src), out, str(tmp_path / "cp"), checked_at=checked).awaitTermination(120)
    (f,) = [json.loads(r[0]) for r in spark.read.text(f"{out}/live_events.geojsonl").collect()]
    assert f["geometry"]["coordinates"] == [30.12346, 38.0] and f["properties"]["mag"] == 3.46 and f["properties"]["place"] == "" and f["properties"]["time"].startswith("2026-06-27T04:30:00")
    m = json.loads(spark.read.text(f"{out}/live_meta.json").first()[0])
    assert (m["status"], m["lag_minutes"], m["n_events"]) == ("stale", 40.0, 1)


def test_archive_survives_a_writer_that_stops(spark, tmp_path):
    """Events without a manifest, or a manifest under its first name, are as if they weren't there."""
    path = str(tmp_path / "archive")
    one = events(spark, [(1.0, 38.0, 30.0, 5.0)]).select("id", "time", "latitude", "longitude", F.lit(1.0).alias("depth"), "mag", F.lit("ML").alias("magType"), F.lit("p").alias("place"))
    files.save_archive(spark, path, one, {"covered_until": "2026-01-01T00:00:00+00:00"})
    (tmp_path / "archive" / "manifest-events-99999999T000000000000.json.x.new").write_text("{")
    one.write.parquet(f"{path}/events-99999999T000000000000")
    rows, manifest = files.load_archive(spark, path)
    assert rows.count() == 1 and manifest["covered_until"].startswith("2026")
    files.save_archive(spark, path, one.union(one), manifest)
    assert files.load_archive(spark, path)[0].count() == 2


def test_tables_agree_with_one_archive(spark):
    """A row of the coverage tables says what one archive's manifest says."""
    from datetime import datetime, timezone

    us = lambda d: int(datetime(2026, 10, d, tzinfo=timezone.utc).timestamp() * 1e6)
    now = datetime(2026, 10, 25, tzinfo=timezone.utc)
    for until in (None, 24, 10, 31):
        m = {} if until is None else {"covered_from": "2026-10-01T00:00:00+00:00", "covered_until": f"2026-10-{until}T00:00:00+00:00"}
        row = coverage.fetch_plans(spark.createDataFrame([(us(1) if until else None, us(until) if until else None)], "covered_from long, covered_until long"), F.lit(us(25)))
        got = row.first()
        if until == 31:
            assert got.refused
            with pytest.raises(CatalogError):
                files.plan_fetch(m, now)
            continue
        plan = files.plan_fetch(m, now)
        assert got.fetch_from == int(plan.start.timestamp() * 1e6) and not got.refused
        assert (got.gap_from is None) == (plan.gap is None)
        new, want = coverage.updated(row).first(), files.update_manifest(m, plan, n_events=1, n_new=1, now=now)
        assert len(new.gaps) == len(want["gaps"]) and new.covered_from == int(datetime.fromisoformat(want["covered_from"]).timestamp() * 1e6)
    seeded = coverage.seeded(spark.createDataFrame([(us(10), us(20), us(1), us(5))], "covered_from long, covered_until long, seed_from long, seed_to long")).first()
    want = files.apply_seed({"covered_from": "2026-10-10T00:00:00+00:00", "covered_until": "2026-10-20T00:00:00+00:00"}, datetime(2026, 10, 1, tzinfo=timezone.utc), datetime(2026, 10, 5, tzinfo=timezone.utc))
    assert (seeded.covered_from, seeded.covered_until, len(seeded.gaps)) == (us(1), us(20), len(want["gaps"]))


def test_shared_folder(spark, tmp_path):
    assert tables.read_text(spark, str(tmp_path / "none")) is None
    for text in ("a", "b\nc"):
        tables.write_text(spark, str(tmp_path / "x.json"), text)
        assert tables.read_text(spark, str(tmp_path / "x.json")) == text
    assert tables.written(spark.range(3)).count() == 3


def test_claims_in_one_walk(spark):
    r = np.random.default_rng(4)
    for _ in range(5):
        text = "".join(r.choice(list("aab "), 200))
        phrases, denials, reach = ("aa", "aba", "a b"), ("bb",), 3
        want = sorted((p, k) for p in phrases for k in range(len(text)) if text.startswith(p, k) and not any(d in text[max(0, k - reach) : k + len(p) + reach] for d in denials))
        got = integrity.claims(spark.createDataFrame([(1, text)], "id int, t string"), "t", phrases, denials, reach)
        assert sorted((x.phrase, x.idx) for x in got.collect()) == want
    assert integrity.claims(spark.createDataFrame([(1, None), (2, "")], "id int, t string"), "t").count() == 0


def test_claims_grow_with_the_text():
    """Four times the text takes four times the walk, also where phrases and denials stand close."""
    import time

    scanner = integrity.Scanner(integrity.CLAIMS, integrity.DENIALS, integrity.REACH)
    part = "bir deprem tahmini değil, " + "uzun bir metin " * 6 + "burada erken uyarı var. " + "uzun bir metin " * 6

    def seconds(times):
        text = part * times
        began = time.process_time()
        assert len(scanner.hits(text)) >= times
        return time.process_time() - began

    seconds(1000)
    small = min(seconds(17_000) for _ in range(3))  # some 4 million characters
    assert min(seconds(68_000) for _ in range(2)) < 4.5 * small + 0.5


def test_claims_that_deny_themselves():
    s = integrity.Scanner(("ab", "abc", "no"), ("no", "none"), 2)
    assert s.hits("abc") == [("ab", 0), ("abc", 0)] and s.hits("abc no") == [("ab", 0), ("abc", 0)] and s.hits("abcno") == [("ab", 0)] and s.hits("ab none") == [("ab", 0)] and s.hits("abno") == s.hits("no") == []
    assert integrity.Scanner((), (), 5).hits("abc") == []
