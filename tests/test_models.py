import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tectra.operators import etas, forecast, integrity, risk, skill
from tectra.schemas import NATIONAL, ZONES, CatalogError, Region


def events(spark, rows):
    """rows: (days since 2000, lat, lon, mag[, depth])"""
    rows = [(str(i), *r, *([10.0] if len(r) == 4 else [])) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, t double, latitude double, longitude double, mag double, depth double")
    return df.withColumn("time", F.timestamp_micros((F.lit(946684800000000) + F.col("t") * 86400000000).cast("long"))).drop("t")


def test_risk_surface(spark):
    rows = [(float(k), 38.1, 28.1, 4.0 + k % 2 / 10, 50.0) for k in range(4)] + [(7000.0 + k, 40.7, 30.2, 5.8 + k / 10, None if k else 5.0) for k in range(2)]
    cells = risk.top_risk(risk.risk_cells(events(spark, rows), NATIONAL, min_mag=4.0), 5).collect()
    top = cells[0]
    assert (round(top.lat, 3), round(top.lon, 3), round(top.max_mag, 3), top.shallow_fraction) == (40.625, 30.125, 5.9, 0.5)
    assert top.mean_depth == 5.0 and top.n_recent == 2 and cells[1].n_recent == 0 and top.risk_index > cells[1].risk_index
    assert risk.risk_cells(events(spark, rows).drop("depth"), NATIONAL, min_mag=4.0).filter("mean_depth is null").count() == 2
    with pytest.raises(Exception, match="spans no time"):
        risk.risk_cells(events(spark, rows[:1]), NATIONAL, min_mag=4.0).collect()


def test_site_thresholds(spark):
    v = lambda x: spark.range(1).select(x).first()[0]
    assert v(risk.vs30(F.lit(0.0))) == 150 and v(risk.vs30(F.lit(-0.3))) == 760 and v(risk.vs30(F.lit(0.1))) == 760
    assert [v(risk.site_class(F.lit(x))) for x in (1500, 760, 360, 180, 179)] == list("ABCDE")
    assert v(risk.liquefaction_class(risk.liquefaction_score(F.lit(150.0), F.lit(10.0), F.lit(0.0005)))) == "yüksek"
    assert v(risk.liquefaction_class(risk.liquefaction_score(F.lit(760.0), F.lit(1800.0), F.lit(0.3), F.lit(0.0)))) == "çok düşük"
    assert v(risk.site_risk(F.lit(50), F.lit(1.15))) == 50 and v(risk.site_risk(F.lit(95), F.lit(2.5))) == 100
    assert v(risk.amplification(F.lit(760.0))) == 1.0 and v(risk.amplification_band(F.lit(2.0))) == 4


def test_windows_fill_gaps_and_start_at_midnight(spark):
    s = forecast.windowed_series(events(spark, [(0.9, 38.0, 30.0, 5.0), (1.1, 38.0, 30.0, 4.5), (95.0, 38.0, 30.0, 4.2)]), 30, 4.0).orderBy("win_idx").collect()
    assert [r.n_events for r in s] == [2, 0, 0, 1] and s[0].window_start_us == 946684800000000 and s[1].max_mag == 0.0
    assert forecast.windowed_series(events(spark, [(0.0, 38.0, 30.0, 2.0)]), 30, 4.0).count() == 0


def test_lags_know_only_the_past(spark):
    s = spark.createDataFrame([(i, i * i, float(i)) for i in range(8)], "win_idx int, n_events long, max_mag double")
    x = forecast.supervised(s, 2).orderBy("win_idx").collect()
    assert len(x) == 6 and x[0].n_events_lag1 == 1 and x[0].n_events_lag2 == 0 and x[0].target == 4
    assert forecast.supervised(s.limit(1), 6).count() == 0 and len(forecast.supervised(s.limit(0), 6).columns) == 14


def test_baselines(spark):
    s = spark.createDataFrame(list(enumerate([1.0, 2.0, 9.0, 10.0, 20.0, 30.0])), "i int, y double")
    got = forecast.baselines(s, "i", "y", 0.5).orderBy("i").collect()
    assert [r.persistence for r in got] == [9, 10, 20] and {r.climatology for r in got} == {4.0}
    with pytest.raises(Exception, match="no history"):
        forecast.baselines(s.limit(1), "i", "y", 1.0).collect()


def test_scores(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (3.0, 3.0, 2.0)], "y double, perfect double, other double")
    by = {r.model: r for r in forecast.leaderboard(forecast.scores(df, "y", ["perfect", "other"]), "other").collect()}
    assert by["perfect"].poisson_deviance < 1e-6 and by["perfect"].is_winner and by["other"].skill == 0 and by["perfect"].mae == 0
    ranked = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, p double")
    assert forecast.roc_auc(ranked, "y", "p").first().auc == 0.875
    assert forecast.roc_auc(ranked.filter("y = 1"), "y", "p").first().auc is None
    ci = forecast.bootstrap_mean_ci(spark.range(1000).selectExpr("id", "id % 10 as x"), "x", 300).first()
    assert ci.low < 4.5 < ci.high and ci.high - ci.low < 0.6


def simulate(mu, K, c, p, alpha, m0, end, seed):
    """Background and their offspring, generation by generation."""
    r = np.random.default_rng(seed)
    n = r.poisson(mu * end)
    now = list(zip(r.uniform(0, end, n), m0 + r.exponential(1 / 2.3, n)))
    out = list(now)
    while now:
        nxt = []
        for t, m in now:
            k = r.poisson(K * math.exp(alpha * (m - m0)) * c ** (1 - p) / (p - 1))
            u = r.uniform(size=k)
            dt = c * ((1 - u) ** (1 / (1 - p)) - 1)
            nxt += [(t + d, m0 + r.exponential(1 / 2.3)) for d in dt if t + d < end]
        out += nxt
        now = nxt
    out.sort()
    return np.array([t for t, _ in out]), np.array([m for _, m in out])


def test_gradient():
    t, m = simulate(0.3, 0.02, 0.05, 1.2, 1.0, 4.0, 200, 1)
    x = np.array([0.3, 0.02, 0.05, 1.2, 1.0])
    f, g = etas._nll(x, t, m, 4.0, 200.0)
    for k in range(5):
        h = 1e-6 * x[k]
        up, down = x.copy(), x.copy()
        up[k] += h
        down[k] -= h
        assert abs((etas._nll(up, t, m, 4.0, 200.0)[0] - etas._nll(down, t, m, 4.0, 200.0)[0]) / (2 * h) - g[k]) < 1e-3 * max(1, abs(g[k]))


def test_fit_recovers_branching_and_poisson_has_no_skill():
    t, m = simulate(0.4, 0.015, 0.05, 1.3, 1.0, 4.0, 2000, 3)
    p, nll = etas.fit_vectors(t, m, 4.0, 2000.0)
    assert nll <= etas._nll(np.array([0.4, 0.015, 0.05, 1.3, 1.0]), t, m, 4.0, 2000.0)[0]
    true = etas.branching_ratio(etas.Params(0.4, 0.015, 0.05, 1.3, 1.0, 4.0), 1.0)
    assert abs(etas.branching_ratio(p, 1.0) - true) < 0.25
    r = np.random.default_rng(0)
    flat = etas.evaluate_vectors(np.sort(r.uniform(0, 3000, 400)), 4 + r.exponential(0.4, 400), 4.0, 0.75, 30)
    assert flat["skill_climatology"] < 0.2
    for bad in (([1.0], [4.0]), ([2.0, 1.0], [4, 4]), ([1.0, 2.0], [4.0])):
        with pytest.raises(CatalogError):
            etas.evaluate_vectors(np.array(bad[0]), np.array(bad[1]), 4.0, 0.75, 30)


def test_intensity_and_likelihood(spark):
    t, m = simulate(0.5, 0.02, 0.05, 1.2, 1.0, 4.0, 60, 2)
    p = etas.Params(0.5, 0.02, 0.05, 1.2, 1.0, 4.0)
    df = spark.createDataFrame([(f"{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(zip(t, m))], "id string, t double, mag double")
    got = [r.rate for r in etas.intensity(df, p).orderBy("t").collect()]
    want = [0.5 + sum(0.02 * math.exp(m[j] - 4) * (t[i] - t[j] + 0.05) ** -1.2 for j in range(i)) for i in range(len(t))]
    assert np.allclose(got, want) and got[0] == 0.5
    assert np.allclose([r.rate for r in etas.intensity(df, p, horizon_days=100).orderBy("t").collect()], want)
    nll = etas._nll(np.array([0.5, 0.02, 0.05, 1.2, 1.0]), t, m, 4.0, 60.0)[0]
    assert abs(etas.negative_log_likelihood(df, p, 0.0, 60.0).first().nll - nll) < 1e-6
    assert etas.branching_ratio(p, 0.1) is None
    assert abs(etas.compensator(df, etas.Params(0.5, 0.0, 0.05, 1.2, 1.0, 4.0), 0, 60).first().expected - 30) < 1e-9


def test_zones(spark):
    df = events(spark, [(1.0, 39.5, 27.0, 5.0), (2.0, 10.0, 10.0, 5.0), (3.0, 38.0, 43.0, 5.0)])
    assert {(r.id, r.zone) for r in etas.assign_zones(df, ZONES).collect()} == {("0", "KAF"), ("0", "Ege"), ("2", "Van")}
    assert etas.assign_zones(df, ZONES, 2).count() == 0
    assert etas.fit_zones(df.withColumn("zone", F.lit("z")), 4.0).first().status == "too few events"


def test_aftershocks(spark):
    df = events(spark, [(0.0, 38.0, 30.0, 7.0), (0.0, 38.0, 30.0, 4.0)])
    now = F.lit(946684800000000 + 86400000000 * 10)
    rows = etas.aftershock_panel(df, now).collect()
    assert len(rows) == 6 and {r.id for r in rows} == {"0"}
    assert etas.aftershock_panel(df, now + 86400000000 * 25).count() == 4
    v = lambda x: spark.range(1).select(x).first()[0]
    assert v(etas.display_band(F.lit(0.4))) == "~0" and v(etas.display_band(F.lit(10.0))) == "4–23"
    assert v(etas.elapsed_text(F.lit(0.001))) == "az önce" and v(etas.elapsed_text(F.lit(1.5))) == "1 gün önce" and v(etas.elapsed_text(F.lit(3.9))) == "3 gün önce"


def counts(spark, xs):
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(xs)], "place int, n double")


@pytest.mark.parametrize(("xs", "want"), [([23] + [0] * 7, 0.875), ([1] * 8, 0.0), ([0] * 7 + [23], -0.875), ([5], 0.0)])
def test_area_skill(spark, xs, want):
    assert skill.area_skill(counts(spark, xs), "place", "n").first()[0] == want


def test_skill_refuses(spark):
    for xs in ([0, 0], [float("nan"), 1], [-1, 2]):
        with pytest.raises(Exception):
            skill.area_skill(counts(spark, xs), "place", "n").collect()
    with pytest.raises(CatalogError):
        skill.concentration_gain(counts(spark, [1]), "place", "n", 0)
    assert skill.concentration_gain(counts(spark, [8, 0, 0, 0]), "place", "n").first()[0] == 4.0


def hotspots(spark, early, late):
    r = np.random.default_rng(0)
    rows = []
    for (lat, lon), n_early, n_late in zip([(38.1, 28.1), (39.1, 33.1), (40.1, 37.1)], early, late):
        for n, a, b in ((n_early, 0, 5000), (n_late, 5100, 7300)):
            rows += [(float(r.uniform(a, b)), float(lat + r.normal(0, 0.02)), float(lon + r.normal(0, 0.02)), float(round(3 + r.exponential(0.45), 1))) for _ in range(n)]
    return events(spark, rows)


def test_surface_skill_and_gate(spark):
    good, bad = hotspots(spark, (300, 60, 10), (95, 20, 3)), hotspots(spark, (300, 10, 0), (0, 100, 0))
    s = skill.surface_skill(good, NATIONAL, n_boot=100, min_mag=3.0).first()
    assert s.area_skill_score > 0 and s.ci_low <= s.area_skill_score <= s.ci_high and s.n_test_events > 0
    assert skill.surface_skill(bad, NATIONAL, min_mag=3.0).first().area_skill_score < s.area_skill_score
    none = skill.surface_skill(hotspots(spark, (9, 0, 0), (0, 0, 3)), NATIONAL, min_mag=3.0).first()
    assert none.n_test_events == 0 and none.area_skill_score is None
    with pytest.raises(CatalogError):
        integrity.science_gate(good, NATIONAL, {"mc": 9.0, "cell_deg": 0.25, "area_skill_score": 0.5}, min_mag=3.5, cell_deg=0.25)


@pytest.mark.parametrize("x", [float("nan"), float("inf"), None, "1", True, 0.0])
def test_numbers_that_gates_refuse(x):
    with pytest.raises(CatalogError):
        integrity.require_finite(x, "x", above=0)


def test_claims(spark):
    texts = ["DEPREM TAHMİNİ yapıyoruz", "Bu bir deprem tahmini değildir", "deprem tahmini deprem tahmini", "sinir ağı", None, "", "Erken Uyarı sistemi; mümkün değil"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.phrase, r.idx) for r in integrity.claims(df, "text").collect())
    assert got == [(0, "deprem tahmini", 0), (2, "deprem tahmini", 0), (2, "deprem tahmini", 15)]
    over = spark.createDataFrame([(0, "aaaa")], "id int, text string")
    assert sorted(r.idx for r in integrity.claims(over, "text", ("aa",), ("zz",)).collect()) == [0, 1, 2]


def test_surface_gate(spark):
    meta = '{"source": "AFAD", "region": "n", "cell_deg": 0.25, "min_mag": 3.0, "mc": 2.85, "area_skill_score": 0.5, "gain_top25": 2.0, "n_cells": 1, "disclaimer": "deprem tahmini DEĞİLDİR", "use_restriction": "premium rating için DEĞİL"}'
    cell = '{"geometry": {"coordinates": [[[28.0, 38.0], [28.25, 38.0], [28.25, 38.25], [28.0, 38.25], [28.0, 38.0]]]}}'
    frame = lambda x, c: spark.createDataFrame([(x,)], f"{c} string")
    integrity.surface_gate(frame(meta, "json"), frame(cell, "feature"))
    for old, new in (("0.5", "NaN"), ("AFAD", "?"), ("0.25,", "0.5,"), ('"n_cells": 1', '"n_cells": 2'), ("DEĞİLDİR", "dir"), ('"mc": 2.85', '"mc": 3.5'), ('"region"', '"regio"')):
        with pytest.raises(CatalogError):
            integrity.surface_gate(frame(meta.replace(old, new, 1), "json"), frame(cell, "feature"))
    with pytest.raises(CatalogError):
        integrity.surface_gate(frame(meta, "json").limit(0), frame(cell, "feature"))
    faults = lambda m, c: integrity.surface_faults(frame(m, "json"), c).first().faults
    assert faults(meta, frame(cell, "feature")) == []
    assert faults(meta, frame(cell, "feature").limit(0)) == ["no cells", "cells of another number"]
    assert faults(meta, frame("{}", "feature")) == ["cells of another size"] == faults(meta, frame(None, "feature"))
    assert faults(meta.replace("0.5", "true", 1), frame(cell, "feature")) == ["skill isn't finite"]
    assert len(faults(None, frame(cell, "feature"))) == 9
    good = {"canonical_etas": {"mu": 0.1, "K": 0.1, "c": 0.1, "p": 1.1, "alpha": 1.0, "skill_vs_climatology_pct": 10.0, "branching_ratio": None, "source": "AFAD"}}
    integrity.etas_gate(good)
    for k, v in (("mu", True), ("p", "1"), ("source", "UNKNOWN"), ("skill_vs_climatology_pct", float("nan"))):
        with pytest.raises(CatalogError):
            integrity.etas_gate({"canonical_etas": good["canonical_etas"] | {k: v}})


def test_nearest_cell_beyond_the_rings(spark):
    cells = spark.createDataFrame([(0, 0, 35.625, 25.625), (20, 60, 40.625, 40.625)], "lat_bin int, lon_bin int, lat double, lon double")
    spots = spark.createDataFrame([("near", 35.7, 25.7), ("far", 39.0, 34.0)], "spot string, latitude double, longitude double")
    got = {r.spot: r.lat_bin for r in risk.nearest_cell(spots, cells, Region("r", 35.5, 42.5, 25.5, 45.0)).collect()}
    assert got == {"near": 0, "far": 20}
