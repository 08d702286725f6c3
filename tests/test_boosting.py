"""Boosting by histograms against trees grown the plain way, within a task and over tasks."""

import numpy as np
import pytest

from tectra.operators import boosting
from tectra.schemas import CatalogError


def planted(loss, n=400, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 1)
    raw = 0.4 + 0.8 * (x[:, 0] > 0.35) - 0.5 * x[:, 1]
    y = raw + r.normal(0, 0.2, n) if loss == "squared" else r.poisson(np.exp(raw)) if loss == "poisson" else r.random(n) < 1 / (1 + np.exp(-raw))
    return x, np.asarray(y, float)


def plain(x, y, loss, rounds, rate=0.1):
    """Predictions after each round, by trying every value as a cut and recursing."""
    raw = np.full(len(y), boosting.first_guess(loss, y.mean()))

    def grow(rows, g, h, depth, out):
        best = (1e-12, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = rows & (x[:, f] <= cut)
                right = rows & ~left
                if min(left.sum(), right.sum()) < 20 or min(h[left].sum(), h[right].sum()) < 1e-3:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[rows].sum() ** 2 / h[rows].sum()
                if gain > best[0] * (1 + 1e-9):
                    best = gain, (left, right)
        if depth == 0 or best[1] is None:
            out[rows] = -rate * g[rows].sum() / h[rows].sum()
            return
        for side in best[1]:
            grow(side, g, h, depth - 1, out)

    for _ in range(rounds):
        g, h = boosting.gradients(loss, raw, y)
        step = np.zeros(len(y))
        grow(np.ones(len(y), bool), g, h, 3, step)
        raw = raw + step
    return raw if loss == "squared" else np.exp(raw) if loss == "poisson" else 1 / (1 + np.exp(-raw))


def table(spark, x, y):
    return spark.createDataFrame([(k, *map(float, row), float(v)) for k, (row, v) in enumerate(zip(x, y))], "k long, f0 double, f1 double, f2 double, y double").repartition(3)


@pytest.mark.parametrize("loss", boosting.LOSSES)
def test_like_plain_trees(spark, loss):
    x, y = planted(loss)
    want = plain(x, y, loss, 8)
    df, features = table(spark, x, y), ["f0", "f1", "f2"]
    for within_task in (10**6, 0):  # in one task, and a job a level
        model = boosting.fit(df, features, "y", loss, rounds=8 if within_task else 3, within_task=within_task)
        got = np.array([r.p for r in df.withColumn("p", boosting.prediction(model)).orderBy("k").collect()])
        assert np.allclose(got, want if within_task else plain(x, y, loss, 3), rtol=1e-8)


def test_poisson_learns_rates(spark):
    """A hundred rounds halve the deviance of counts on rows not seen, which the mean alone leaves."""
    x, y = planted("poisson", 3000, 1)
    model = boosting.fit(table(spark, x[:2000], y[:2000]), ["f0", "f1", "f2"], "y", "poisson")
    assert len(model.trees) == boosting.ROUNDS
    q, t = model.predict(x[2000:]), y[2000:]
    deviance = lambda q: 2 * np.mean(np.where(t > 0, t * np.log(np.where(t > 0, t, 1) / q), 0) - (t - q))
    assert (q > 0).all() and deviance(q) < 0.65 * deviance(np.full(len(t), y[:2000].mean()))


def test_many_values_and_odd_tables(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 1))
    df = spark.createDataFrame([(float(a), float(3 * a > 1)) for (a,) in x] + [(None, 1.0), (float("nan"), 1.0)], "f double, y double")
    model = boosting.fit(df, ["f"], "y", "binomial", bins=64)
    assert len(model.edges[0]) <= 64 and ((model.predict(x) > 0.5) == (3 * x[:, 0] > 1)).mean() > 0.97
    same = spark.createDataFrame([(1.0, 0.0)] * 50, "f double, y double")
    for loss in boosting.LOSSES:  # one value alone: it is the prediction
        m = boosting.fit(same, ["f"], "y", loss)
        assert m.trees == [] and m.predict(np.ones((2, 1))).tolist() == [0.0, 0.0]
    for bad, loss in ((same.limit(0), "squared"), (same.selectExpr("f", "-1.0 as y"), "poisson"), (same.selectExpr("f", "2.0 as y"), "binomial"), (same, "other")):
        with pytest.raises(CatalogError):
            boosting.fit(bad, ["f"], "y", loss)
