"""Resamples drawn block by block have the law of draws with replacement from all rows."""

import numpy as np
from pyspark.sql import functions as F

from tectra.operators import forecast


def test_blocks_share_a_multinomial():
    n, boots = 95, 4000
    parts = np.stack([forecast.block_draws(k, n, boots, 3, size=20) for k in range(5)])
    assert (parts.sum(0) == n).all()  # never more or fewer than a resample has
    p = np.array([20, 20, 20, 20, 15]) / n
    assert np.allclose(parts.mean(1), n * p, atol=0.4)
    cov = np.cov(parts)
    assert np.allclose(cov, n * (np.diag(p) - np.outer(p, p)), atol=1.2)
    again = np.stack([forecast.block_draws(k, n, boots, 4, size=20) for k in range(5)])
    assert (parts != again).any()


def test_like_draws_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(forecast, "RESAMPLE_BLOCK", 50)
    r = np.random.default_rng(1)
    x = np.concatenate([r.exponential(1.0, 300), [40.0, 55.0]])
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(999, None)], "id long, x double")
    a, b = (forecast.bootstrap_mean_ci(df.repartition(n), "x", 3000).first() for n in (1, 7))
    assert np.allclose(a[:], b[:])  # wherever rows are
    means = x[r.integers(len(x), size=(20_000, len(x)))].mean(1)
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs(a.mean - x.mean()) < 1e-9 and abs(a.low - low) < 0.04 and abs(a.high - high) < 0.06
    assert forecast.bootstrap_mean_ci(df.filter(F.col("x").isNull()), "x", 10).first().low is None
