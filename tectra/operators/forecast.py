"""Windows over time, lags, event features, baselines, scores and learners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tectra.functions import exprs, ordering, tables
from tectra.operators import boosting
from tectra.schemas import DAY_US, CatalogError


def windowed_series(df: DataFrame, freq_days: float = 30.0, min_mag: float = 4.0) -> DataFrame:
    """win_idx, window_start_us, n_events, max_mag (0.0 if none) of windows that tile time from the midnight before the first
    strong event; windows without events too. No events, no rows."""
    strong = df.filter(F.col("mag") >= min_mag)
    width = int(freq_days * DAY_US)
    us = exprs.micros(F.col("time"))
    span = strong.agg(exprs.micros(F.date_trunc("day", F.min("time"))).alias("t0"), F.max(us).alias("t1")).dropna()
    k = F.floor((us - F.col("t0")) / width).cast("int")
    counts = strong.crossJoin(F.broadcast(span)).groupBy(k.alias("win_idx")).agg(F.count(F.lit(1)).alias("n"), F.max("mag").alias("m"))
    all_ = span.select("t0", F.explode(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / width).cast("int"))).alias("win_idx"))
    out = all_.join(counts, "win_idx", "left")
    return out.select("win_idx", (F.col("t0") + F.col("win_idx").cast("long") * width).alias("window_start_us"), F.coalesce("n", F.lit(0)).cast("long").alias("n_events"), F.coalesce("m", F.lit(0.0)).alias("max_mag"))


def supervised(series: DataFrame, n_lags: int = 6, target: str = "n_events") -> DataFrame:
    """win_idx, n_events_lag1.., max_mag_lag1.., target; windows before n_lags go. One row a window, so one partition holds them."""
    w = Window.orderBy("win_idx")
    lags = [F.lag(c, i).over(w).cast("double").alias(f"{c}_lag{i}") for c in ("n_events", "max_mag") for i in range(1, n_lags + 1)]
    return series.select("win_idx", *lags, F.col(target).cast("double").alias("target"), F.row_number().over(w).alias("rn")).filter(F.col("rn") > n_lags).drop("rn")


def strong_windows(series: DataFrame, least: float = 5.0) -> DataFrame:
    """Adds strong: 1 where a window's greatest magnitude is at least so much, else 0."""
    return series.withColumn("strong", (F.col("max_mag") >= least).cast("int"))


def event_features(df: DataFrame, min_mag: float = 4.0, k: int = 10) -> DataFrame:
    """Of each strong event after the first k: id, time_us, last_mag, mean_mag, max_mag, std_mag (population), days_since_last,
    rate (k over the days of the k before it), target. Nothing of the event itself enters but the target."""
    strong = ordering.with_index(df.filter(F.col("mag") >= min_mag).select("id", "time", "mag"), "time", "id")
    rows, w = ordering.with_rows_before(strong, k)
    us = exprs.micros(F.col("time"))
    past = w.rowsBetween(-k, -1)
    rows = rows.select(
        "id",
        us.alias("time_us"),
        F.lag("mag", 1).over(w).alias("last_mag"),
        F.avg("mag").over(past).alias("mean_mag"),
        F.max("mag").over(past).alias("max_mag"),
        F.stddev_pop("mag").over(past).alias("std_mag"),
        exprs.days((us - F.lag(us, 1).over(w)).cast("double")).alias("days_since_last"),
        (k / F.greatest(exprs.days((F.lag(us, 1).over(w) - F.lag(us, k).over(w)).cast("double")), F.lit(1e-6))).alias("rate"),
        F.col("mag").alias("target"),
        "idx",
        "__own",
        "__block",
    )
    return ordering.own_rows(rows).filter(F.col("idx") > k).drop("idx")


def temporal_split(df: DataFrame, order: str, test_frac: float = 0.25) -> DataFrame:
    """Adds is_train: the first round(n (1 - test_frac)) rows, half to even. For series and matrices, a row a window."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return df.withColumn("is_train", F.row_number().over(Window.orderBy(order)) <= exprs.half_even(n * (1 - test_frac)))


def baselines(series: DataFrame, order: str, y: str, test_frac: float = 0.25) -> DataFrame:
    """Test rows: order, y, climatology (the training mean), persistence (the value before). No training rows are an error."""
    rows = temporal_split(series.select(order, F.col(y).cast("double").alias("y")), order, test_frac)
    rows = rows.withColumn("persistence", F.lag("y").over(Window.orderBy(order)))
    rows = rows.withColumn("climatology", F.avg(F.when(F.col("is_train"), F.col("y"))).over(Window.partitionBy()))
    guard = F.when(F.col("climatology").isNull(), F.raise_error(F.lit("no history to forecast from")).cast("double")).otherwise(F.col("climatology"))
    return rows.filter("not is_train").select(order, "y", guard.alias("climatology"), "persistence")


def poisson_deviance(y: Column, p: Column) -> Column:
    q = F.greatest(p, F.lit(1e-9))
    return F.avg(2 * (F.when(y > 0, y * F.ln(F.when(y > 0, y).otherwise(F.lit(1.0)) / q)).otherwise(F.lit(0.0)) - (y - q)))


def scores(df: DataFrame, y: str, predictions: list[str]) -> DataFrame:
    """model, mae, rmse, poisson_deviance, n, in one pass."""
    rows = []
    for p in predictions:
        e = F.col(y) - F.col(p)
        rows.append(F.struct(F.lit(p).alias("model"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), poisson_deviance(F.col(y).cast("double"), F.col(p).cast("double")).alias("poisson_deviance"), F.count(F.lit(1)).alias("n")))
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def skill(metric: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, F.lit(0.0)).otherwise(1 - metric / F.when(baseline != 0, baseline))


def leaderboard(scored: DataFrame, baseline: str) -> DataFrame:
    """Adds skill against the baseline's deviance, rank, is_winner. A row a model."""
    base = F.max(F.when(F.col("model") == baseline, F.col("poisson_deviance"))).over(Window.partitionBy())
    out = scored.withColumn("skill", skill(F.col("poisson_deviance"), base))
    out = out.withColumn("place", F.row_number().over(Window.orderBy("poisson_deviance", "model")))
    return out.withColumn("is_winner", F.col("place") == 1)


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    """brier, base (of the mean), skill."""
    mean = df.agg(F.avg(y).alias("m"))
    a = df.crossJoin(F.broadcast(mean)).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg((F.col("m") - F.col(y)) ** 2).alias("base"))
    return a.withColumn("skill", skill(F.col("brier"), F.col("base")))


def roc_auc(df: DataFrame, y: str, p: str, buckets: int = 200) -> DataFrame:
    """auc by average ranks; null without both classes. Scores are summed by distinct value, then by `buckets` ranges of about as many distinct
    values each, however the scores are spread: the window over ranges has a row a range, and those within one its distinct values."""
    by = df.groupBy(F.col(p).cast("double").alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    by = tables.written(by.repartitionByRange(buckets, "p").withColumn("bucket", F.spark_partition_id()))
    sums = by.groupBy("bucket").agg(F.sum("neg").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).drop("n")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.join(F.broadcast(sums), "bucket").withColumn("below", F.col("before") + below)
    a = by.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return a.select(F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def r_squared(df: DataFrame, y: str, p: str, least: float = 0.05) -> DataFrame:
    """r2, mae, predictable (r2 of at least `least`)."""
    mean = df.agg(F.avg(y).alias("m"))
    e, d = F.col(y) - F.col(p), F.col(y) - F.col("m")
    a = df.crossJoin(F.broadcast(mean)).agg((1 - F.sum(e * e) / F.nullif(F.sum(d * d), F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"))
    return a.withColumn("predictable", F.coalesce(F.col("r2") >= least, F.lit(False)))


#: Rows that weights are drawn for at once.
_DRAWN = 256


def poisson_weights(keys, n_boot: int, seed: int):
    """Poisson(1) variates, a row a key: they depend on the key, the resample and the seed alone, not on where a row is."""
    import numpy as np

    u64 = np.uint64
    x = keys.astype(np.int64).view(u64)[:, None] + (np.arange(n_boot, dtype=u64) + u64(1))[None] * u64(0x9E3779B97F4A7C15) + u64(seed) * u64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u64(shift))) * u64(factor)
    u = ((x ^ (x >> u64(31))) >> u64(11)) / 2.0**53
    steps, p, total = [], np.exp(-1.0), 0.0
    for k in range(20):
        total += p
        steps.append(total)
        p /= k + 1
    return np.searchsorted(np.array(steps), u, "right")


#: Rows of a block that resamples are drawn from.
RESAMPLE_BLOCK = 10_000


def block_draws(block: int, n: int, n_boot: int, seed: int, size: int = RESAMPLE_BLOCK):
    """How many of a resample's n draws fall into a block of `size` rows (the last block may have fewer), a number for each resample. Draws are
    split between halves of the blocks, of halves of these, and so on, by binomial variates that all blocks below a half share, so
    that the blocks' numbers are one multinomial variate and always add up to n."""
    import numpy as np

    first, end = 0, -(-n // size)
    draws = np.full(n_boot, n, np.int64)
    while end - first > 1:
        mid = (first + end) // 2
        share = (min(n, mid * size) - first * size) / (min(n, end * size) - first * size)
        left = np.random.default_rng([seed, first, end]).binomial(draws, share)
        if block < mid:
            draws, end = left, mid
        else:
            draws, first = draws - left, mid
    return draws


def bootstrap_mean_ci(df: DataFrame, x: str, n_boot: int = 2000, confidence: float = 0.95, seed: int = 0, key: str = "id") -> DataFrame:
    """mean, low, high: resamples of as many rows as there are, drawn with replacement. Rows are numbered by their key's hash and value, so that
    partitions don't matter, and each block of them draws its own part of every resample: no resample is gathered, and sums alone are
    shuffled."""
    import numpy as np
    import pandas as pd

    rows = df.select(F.xxhash64(key).alias("k"), F.col(x).cast("double").alias("x")).dropna()
    size = RESAMPLE_BLOCK
    rows = ordering.with_index(rows, "k", "x").select(F.floor((F.col("idx") - 1) / size).alias("block"), "idx", "x")
    n = rows.count()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block, values = int(key[0]), frame.sort_values("idx")["x"].to_numpy()
        rng = np.random.default_rng([seed, n, block, 1])
        sums = [values[rng.integers(len(values), size=d)].sum() for d in block_draws(block, n, n_boot, seed, size).tolist()]
        return pd.DataFrame({"boot": np.arange(n_boot), "s": sums})

    means = rows.groupBy("block").applyInPandas(run, "boot int, s double").groupBy("boot").agg((F.sum("s") / n).alias("m"))
    a = (1 - confidence) / 2
    ci = means.agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"))
    return df.agg(F.avg(x).alias("mean")).crossJoin(ci)


# --- learners ------------------------------------------------------------------------------------------------------


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, kind: str, rounds: int = 100) -> DataFrame:
    """test with a column prediction; rows with a null feature go. kind: poisson_glm, boosted (squared loss), boosted_poisson (counts, with a
    logarithmic link) or boosted_class (the probability of 1), with so many trees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression

    made = {
        "poisson_glm": lambda: GeneralizedLinearRegression(family="poisson", link="log", regParam=1e-3, maxIter=500, tol=1e-6, labelCol=target),
        "boosted": lambda: GBTRegressor(maxDepth=3, maxIter=rounds, seed=0, labelCol=target),
        "boosted_class": lambda: GBTClassifier(maxDepth=3, maxIter=rounds, seed=0, labelCol=target),
    }
    if kind == "boosted_poisson":
        model = boosting.fit(train, features, target, "poisson", rounds)
        return test.dropna(subset=features).withColumn("prediction", boosting.prediction(model))
    if kind not in made:
        raise CatalogError(f"no learner is named {kind}")
    if kind == "boosted_class" and train.select(target).distinct().limit(2).count() < 2:
        only = train.agg(F.avg(target).alias("prediction"))  # one class alone: its share
        return test.crossJoin(F.broadcast(only))
    model = made[kind]().fit(_vectors(train, features))
    out = model.transform(_vectors(test, features))
    p = vector_to_array("probability")[1] if kind == "boosted_class" else F.greatest(F.col("prediction"), F.lit(0.0)) if kind == "poisson_glm" else F.col("prediction")
    return out.withColumn("p", p).select(*test.columns, F.col("p").alias("prediction"))


def magnitude_models(features: DataFrame, rounds: int = 100, test_frac: float = 0.25) -> DataFrame:
    """model, mae, r2, predictable for the next event's magnitude from `event_features`: the mean, the last magnitude, and boosted trees."""
    inputs = ["last_mag", "mean_mag", "max_mag", "std_mag", "days_since_last", "rate"]
    rows = ordering.with_index(features.withColumn("time", F.timestamp_micros("time_us")), "time", "id")
    n = rows.count()
    k = round(n * (1 - test_frac))
    train, test = rows.filter(F.col("idx") <= k), rows.filter(F.col("idx") > k)
    mean = train.agg(F.avg("target").alias("climatology"))
    out = fit_predict(train, test, inputs, "target", "boosted", rounds).withColumnRenamed("prediction", "boosted")
    out = out.crossJoin(F.broadcast(mean)).withColumn("persistence", F.col("last_mag"))
    scored = [r_squared(out, "target", m).select(F.lit(m).alias("model"), "mae", "r2", "predictable") for m in ("climatology", "persistence", "boosted")]
    return scored[0].unionByName(scored[1]).unionByName(scored[2])


def strong_window_verdict(series: DataFrame, least: float = 5.0, rounds: int = 100) -> DataFrame:
    """brier, base, skill, auc, positive_rate of boosted trees that tell from lags whether a window has a strong event. The base is the
    training share."""
    x = supervised(strong_windows(series, least), target="strong")
    split = temporal_split(x, "win_idx")
    train, test = split.filter("is_train"), split.filter("not is_train")
    share = train.agg(F.avg("target").alias("share"))
    out = fit_predict(train, test, [c for c in x.columns if "_lag" in c], "target", "boosted_class", rounds).crossJoin(F.broadcast(share))
    a = out.agg(F.avg((F.col("prediction") - F.col("target")) ** 2).alias("brier"), F.avg((F.col("share") - F.col("target")) ** 2).alias("base"), F.avg("target").alias("positive_rate"))
    return a.crossJoin(roc_auc(out, "target", "prediction")).select("brier", "base", skill(F.col("brier"), F.col("base")).alias("skill"), "auc", "positive_rate")


def model_leaderboard(series: DataFrame, rounds: int = 100) -> DataFrame:
    """`leaderboard` of climatology, persistence, the Poisson GLM and trees boosted by the Poisson loss on the same later windows."""
    x = supervised(series)
    split = temporal_split(x, "win_idx")
    train, test = split.filter("is_train"), split.filter("not is_train")
    inputs = [c for c in x.columns if "_lag" in c]
    out = baselines(x, "win_idx", "target")
    for kind, learner in (("poisson_glm", "poisson_glm"), ("boosted", "boosted_poisson")):
        p = fit_predict(train, test, inputs, "target", learner, rounds).select("win_idx", F.greatest("prediction", F.lit(0.0)).alias(kind))
        out = out.join(p, "win_idx")
    return leaderboard(scores(out, "y", ["climatology", "persistence", "poisson_glm", "boosted"]), "climatology")
