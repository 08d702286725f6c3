"""The fit over pairs of time blocks against the fit within one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tectra.operators import etas
from tests.test_models import simulate


@pytest.fixture
def planted(spark, monkeypatch):
    monkeypatch.setattr(etas, "BLOCK", 120)
    t, m = simulate(0.3, 0.02, 0.05, 1.2, 1.0, 4.0, 1500, 5)
    t[7] = t[6]  # events at one time
    df = spark.createDataFrame([(f"{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(zip(t, m))], "id string, t double, mag double").repartition(3)
    return t, m, df


def test_likelihood_and_gradient(planted):
    t, m, df = planted
    points = [np.array(x) for x in ([0.3, 0.02, 0.05, 1.2, 1.0], [0.1, 0.1, 0.01, 1.01, 4.0], [1e-6, 1e-6, 5.0, 3.0, 0.1])]
    pairs = etas._block_pairs(df)
    blocks = -(-len(t) // 120)
    assert pairs.count() == blocks * (blocks + 1) // 2
    for (f, g), x in zip(etas._evaluate(pairs, points, 4.0, 1500.0), points):
        f1, g1 = etas._nll(x, t, m, 4.0, 1500.0)
        assert np.isclose(f, f1, rtol=1e-10) and np.allclose(g, g1, rtol=1e-8)


def test_bad_rates_are_refused(planted):
    _, _, df = planted
    assert etas._evaluate(etas._block_pairs(df), [np.array([-1.0, 1e-6, 0.01, 1.1, 1.0])], 4.0, 1500.0)[0][0] == 1e12


def test_same_fit(planted):
    t, m, df = planted
    (a, fa), (b, fb) = etas.fit_events(df, 4.0, 1500.0, rounds=6), etas.fit_vectors(t, m, 4.0, 1500.0, rounds=6)
    assert np.isclose(fa, fb, rtol=1e-6) and all(np.isclose(getattr(a, k), getattr(b, k), rtol=1e-6) for k in ("mu", "K", "c", "p", "alpha"))


def test_catalog_like_a_zone(spark):
    t, m = simulate(0.4, 0.02, 0.05, 1.2, 1.0, 4.0, 500, 3)
    us = np.round((t - t[0]) * 86_400e6).astype(np.int64)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(us, m)], "us long, mag double").select(F.timestamp_micros("us").alias("time"), "mag")
    want = etas.fit_zones(df.withColumn("zone", F.lit("national")), 4.0).first().asDict()
    got = etas.fit_catalog(df, 4.0).first().asDict()
    assert want["status"] == "fitted" and want.keys() == got.keys()
    for k, v in want.items():
        assert got[k] == v if isinstance(v, (str, int)) else v is got[k] is None or np.isclose(got[k], v, rtol=1e-5), k
    assert etas.fit_catalog(df.limit(10), 4.0).first().status == "too few events"
    assert etas.fit_catalog(df, 4.0, window_days=1e4).first().status == "no window fits into training or test"


def test_far_sums(spark, monkeypatch):
    """Sums over a deep tree against all pairs, to eleven digits: bursts, events at one time, windows before and after all events. Differences
    of times hold some 1e-12 of a day, so that with a small c fewer digits are known."""
    monkeypatch.setattr(etas, "LEAF", 4)
    r = np.random.default_rng(2)
    t = np.sort(np.concatenate([r.uniform(0, 5000, 300), 1000 + r.exponential(0.01, 200), np.full(9, 2500.0)]))
    m = 4 + r.exponential(0.4, len(t))
    df = spark.createDataFrame([(f"{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(zip(t, m))], "id string, t double, mag double").repartition(3)
    for p in (etas.Params(0.5, 0.02, 0.05, 1.2, 1.0, 4.0), etas.Params(0.1, 0.3, 1e-4, 3.0, 0.1, 4.0), etas.Params(0.1, 0.3, 5.0, 1.01, 2.0, 4.0)):
        gain = p.K * np.exp(p.alpha * (m - 4))
        want = [p.mu + (gain[:i] * (t[i] - t[:i] + p.c) ** -p.p).sum() for i in range(len(t))]
        assert np.allclose([x.rate for x in etas.intensity(df, p).orderBy("id").collect()], want, rtol=max(1e-11, 4e-12 * p.p / p.c))
        wins = spark.createDataFrame([(k, float(a), float(a + w)) for k, (a, w) in enumerate([(-50, 10), (0, 30), (999, 2), (1000.005, 1), (2500, 1), (4990, 30), (9000, 500)])], "win_idx int, ws double, we double")
        whole = lambda x: x ** (1 - p.p) / (1 - p.p)  # noqa: B023, E731
        for x in etas.expected_counts(wins, df, p).collect():
            s = t < x.ws
            assert np.isclose(x.expected, p.mu * (x.we - x.ws) + (gain[s] * (whole(x.we - t[s] + p.c) - whole(x.ws - t[s] + p.c))).sum(), rtol=1e-7)  # differences of near values
    none = df.limit(0)
    assert etas.intensity(none, p).count() == 0 and [x.expected for x in etas.expected_counts(wins.limit(1), none, p).collect()] == [p.mu * 10]


def test_terms():
    """What is left out of the series is as small as stated, at the edge of its range."""
    for power in (0.01, 0.2, 1.2, 3.0):
        terms = etas._terms(power)
        for x in (1 / 3, -1 / 3, 0.1):
            assert np.isclose(sum(c * x**k for k, c in enumerate(terms)), (1 - x) ** -power, rtol=1e-12)


def test_likelihood_grows_with_the_events():
    """Sums of exponentials against all pairs, where times tie and parameters lie at their bounds; a fit of many events takes no pairs."""
    t, m = simulate(0.3, 0.02, 0.05, 1.2, 1.0, 4.0, 1500, 5)
    t[40:60] = t[40]
    points = [np.array(x) for x in ([0.3, 0.02, 0.05, 1.2, 1.0], [0.1, 0.1, 1e-4, 1.01, 4.0], [1e-6, 1e-6, 5.0, 3.0, 0.1], [0.2, 1e-3, 1e-4, 3.0, 1.0])]
    for (f, g), x in zip(etas._scanned(points, t, m, 4.0, 1500.0), points):
        f1, g1 = etas._nll(x, t, m, 4.0, 1500.0)
        assert np.isclose(f, f1, rtol=1e-12) and np.allclose(g, g1, rtol=1e-10)
    assert etas._scanned([np.array([-1.0, 1e-6, 0.01, 1.1, 1.0])], t, m, 4.0, 1500.0)[0][0] == 1e12


def test_zones_in_parts(spark, monkeypatch):
    """Large zones as jobs over parts give what a task gives, with no pairs of blocks; a zone of few events stays a task's."""
    frames = []
    for name, seed, end in (("a", 3, 500), ("b", 4, 700), ("few", 5, 30)):
        t, m = simulate(0.4, 0.02, 0.05, 1.2, 1.0, 4.0, end, seed)
        t[8:11] = t[8]
        frames += [(name, int(round(x * 86_400e6)), float(y)) for x, y in zip(t, m)]
    df = spark.createDataFrame(frames, "zone string, us long, mag double").select("zone", F.timestamp_micros("us").alias("time"), "mag")
    want = {r.zone: r.asDict() for r in etas.fit_zones(df, 4.0).collect()}
    monkeypatch.setattr(etas, "ZONE", 50)
    monkeypatch.setattr(etas, "PART", 70)
    monkeypatch.setattr(etas, "_block_pairs", None)
    got = {r.zone: r.asDict() for r in etas.fit_zones(df, 4.0).collect()}
    assert want.keys() == got.keys() and [want[z]["status"] for z in ("a", "b", "few")] == ["fitted", "fitted", "too few events"]
    for z in want:
        for k, v in want[z].items():
            assert got[z][k] == v if isinstance(v, (str, int)) else v is got[z][k] is None or np.isclose(got[z][k], v, rtol=1e-5), (z, k)
