"""The self-exciting point process of aftershocks, and the generic aftershock rate."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tectra.functions import exprs, ordering, tables
from tectra.operators import stats
from tectra.schemas import DAY_US, CatalogError, Region


@dataclass(frozen=True)
class Params:
    mu: float
    K: float
    c: float
    p: float
    alpha: float
    m0: float


# Generic aftershock parameters, and bounds and start of the fit.
RJ_A, RJ_B, RJ_P, RJ_C = -1.67, 1.0, 1.08, 0.05
LOWER = np.array([1e-6, 1e-6, 1e-4, 1.01, 0.1])
UPPER = np.array([np.inf, np.inf, 5.0, 3.0, 4.0])


def event_days(df: DataFrame, min_mag: float) -> DataFrame:
    """id, mag, t: days since the first strong event."""
    strong = df.filter(F.col("mag") >= min_mag)
    first = strong.agg(F.min(exprs.micros(F.col("time"))).alias("t0"))
    return strong.crossJoin(F.broadcast(first)).select("id", "mag", exprs.days((exprs.micros(F.col("time")) - F.col("t0")).cast("double")).alias("t"))


def _gain(p: Params, mag: Column) -> Column:
    return F.lit(p.K) * F.exp(F.lit(p.alpha) * (mag - p.m0))


#: Events of a block of the fit; its pairs are summed within a task, block against block, and are never rows.
BLOCK = 2000


def _numbered(events: DataFrame) -> tuple[DataFrame, int]:
    """t, mag, id, idx (from 1, by t and id) and block of each event, and the number of blocks."""
    us = F.timestamp_micros(F.round(F.col("t") * DAY_US).cast("long"))
    rows = ordering.with_index(events.select("id", "t", "mag").withColumn("__at", us), "__at", "t", "id").drop("__at")
    blocks = -(-events.count() // BLOCK)
    return rows.withColumn("block", F.floor((F.col("idx") - 1) / BLOCK).cast("int")), blocks


#: Events of a leaf of the time tree at most, as far as MOST_LEVELS halvings of the time span part them; relative error of a far sum.
LEAF, MOST_LEVELS, FAR_ERROR = 256, 40, 1e-13


@dataclass(frozen=True)
class _Tree:
    """Halvings of a time span: cells of level l are the leaves' numbers without their last levels - l bits."""

    start: float
    width: float  # of a leaf
    levels: int

    def leaf(self, t: Column) -> Column:
        return F.floor((t - self.start) / self.width).cast("long")

    def at(self, leaf: Column, level: Column) -> Column:
        return F.call_function("shiftright", leaf, F.lit(self.levels) - level)


def _time_tree(times: DataFrame, sources: DataFrame) -> _Tree:
    """A tree over all times (t) whose leaves hold few sources (t). A row a leaf is summed for its depth, a few times at most."""
    r = times.agg(F.min("t"), F.max("t")).first()
    n = sources.count()
    start, span = (r[0] or 0.0), max((r[1] or 0.0) - (r[0] or 0.0), 1e-9) * (1 + 1e-9)
    levels = max(2, math.ceil(math.log2(max(1, n / LEAF))))
    while True:
        tree = _Tree(start, span / 2**levels, levels)
        most = sources.groupBy(tree.leaf(F.col("t"))).count().agg(F.max("count")).first()[0] or 0
        if most <= LEAF or levels >= MOST_LEVELS:
            return tree
        levels = min(MOST_LEVELS, levels + max(1, math.ceil(math.log2(most / LEAF))))


def _terms(power: float, error: float = FAR_ERROR) -> list[float]:
    """Coefficients of (1 - x)^-power up to where, for |x| <= 1/3, all that is left out is less than `error` of the smallest value."""
    out, k = [1.0], 0
    while True:
        k += 1
        out.append(out[-1] * (power + k - 1) / k)
        # from here on terms shrink by a third times (power + k) / (k + 1) at most
        ratio = (power + k) / (k + 1) / 3
        if ratio < 1 and abs(out[-1]) * 3.0**-k * ratio / (1 - ratio) < error * (4 / 3) ** -abs(power):
            return out


def _moments(sources: DataFrame, tree: _Tree, n: int) -> DataFrame:
    """level, cell, m0, m1, ...: sums of gain times powers of the place in the cell, from -1 to 1; combined before the shuffle."""
    levels = F.explode(F.sequence(F.lit(2), F.lit(tree.levels))).alias("level")
    rows = sources.select("t", "gain", "leaf", levels).withColumn("cell", tree.at(F.col("leaf"), F.col("level")))
    half = F.lit(tree.width / 2) * F.pow(F.lit(2.0), F.lit(tree.levels) - F.col("level"))
    rows = rows.withColumn("x", (F.col("t") - tree.start) / half - 2 * F.col("cell") - 1)
    return rows.groupBy("level", "cell").agg(*[F.sum(F.col("gain") * F.pow("x", F.lit(float(k)))).alias(f"m{k}") for k in range(n)])


def _far_cells(tree: _Tree) -> Column:
    """(level, cell) that lie a cell or more before a leaf's own, while those of the level above don't: one or two a level."""
    def of(level: Column) -> Column:
        a = tree.at(F.col("leaf"), level)
        both = F.array(F.struct(level.alias("level"), (a - 2).alias("cell")), F.struct(level.alias("level"), (a - 3).alias("cell")))
        return F.filter(F.slice(both, F.lit(1), (1 + a % 2).cast("int")), lambda x: x["cell"] >= 0)

    return F.inline(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(tree.levels)), of)))


def _far_sum(tree: _Tree, p: Params, at: Column, power: float, terms: list[float]) -> Column:
    """Of a row's cell: the sum of gain (at - t + c)^-power by its moments."""
    half = F.lit(tree.width / 2) * F.pow(F.lit(2.0), F.lit(tree.levels) - F.col("level"))
    d = at - (tree.start + (2 * F.col("cell") + 1) * half) + p.c
    z, out = half / d, F.lit(0.0)
    for k in reversed(range(len(terms))):
        out = out * z + F.col(f"m{k}") * terms[k]
    return out * F.pow(d, F.lit(-power))


def intensity(events: DataFrame, p: Params, horizon_days: float | None = None, block_days: float = 1.0) -> DataFrame:
    """id, t, rate: background plus what each earlier event (by t, then id) adds.

    Without a horizon every earlier event counts: those of an event's own leaf of a time tree and of the one before it singly, all others by
    moments of cells that lie far enough away, with an error of FAR_ERROR at most. Rows grow with n log n, and no task holds a group.
    With a horizon, an event looks back so many days at most and events meet by an equality of time blocks.
    """
    if horizon_days is None:
        rows = tables.written(events.select(F.monotonically_increasing_id().alias("key"), "id", "t", "mag"))
        tree, terms = _time_tree(rows, rows), _terms(p.p)
        rows = rows.select("key", "id", "t", _gain(p, F.col("mag")).alias("gain"), tree.leaf(F.col("t")).alias("leaf"))
        far = rows.select("key", "t", _far_cells(tree)).join(_moments(rows, tree, len(terms)), ["level", "cell"]).select("key", _far_sum(tree, p, F.col("t"), p.p, terms).alias("part"))
        before = rows.select(F.explode(F.array(F.col("leaf"), F.col("leaf") + 1)).alias("leaf"), F.col("id").alias("i"), F.col("t").alias("s"), F.col("key").alias("k"), F.col("gain").alias("g"))
        earlier = (F.col("s") < F.col("t")) | (F.col("s") == F.col("t")) & (F.struct("i", "k") < F.struct("id", "key"))
        near = rows.join(before, "leaf").filter(earlier).select("key", (F.col("g") * F.pow(F.col("t") - F.col("s") + p.c, F.lit(-p.p))).alias("part"))
        sums = far.unionByName(near).groupBy("key").agg(F.sum("part").alias("part"))
        return rows.join(sums, "key", "left").select("id", "t", (F.lit(p.mu) + F.coalesce("part", F.lit(0.0))).alias("rate"))
    a = events.select("id", "t", "mag")
    b = events.select(F.col("id").alias("i"), F.col("t").alias("s"), F.col("mag").alias("m"))
    earlier = (F.col("s") < F.col("t")) | (F.col("s") == F.col("t")) & (F.col("i") < F.col("id"))
    part = _gain(p, F.col("m")) * F.pow(F.col("t") - F.col("s") + p.c, F.lit(-p.p))
    span = math.ceil(horizon_days / block_days)
    left = a.withColumn("k", F.floor(F.col("t") / block_days))
    right = b.withColumn("k", F.explode(F.sequence(F.floor(F.col("s") / block_days), F.floor(F.col("s") / block_days) + span)))
    on = (left["k"] == right["k"]) & earlier & (F.col("t") - F.col("s") <= horizon_days)
    return left.join(right, on, "left").groupBy("id", "t").agg((F.lit(p.mu) + F.coalesce(F.sum(part), F.lit(0.0))).alias("rate"))


def _omori(p: Params, t1: Column, t2: Column) -> Column:
    """The integral of (u + c)^-p from t1 to t2."""
    return (F.pow(t2 + p.c, F.lit(1 - p.p)) - F.pow(t1 + p.c, F.lit(1 - p.p))) / (1 - p.p)


def compensator(events: DataFrame, p: Params, t_start: float, t_end: float) -> DataFrame:
    """expected: the integral of the intensity."""
    part = _gain(p, F.col("mag")) * _omori(p, F.lit(0.0), F.lit(t_end) - F.col("t"))
    return events.agg((F.lit(p.mu * (t_end - t_start)) + F.coalesce(F.sum(part), F.lit(0.0))).alias("expected"))


def negative_log_likelihood(events: DataFrame, p: Params, t_start: float, t_end: float) -> DataFrame:
    """nll; 1e12 where an intensity isn't positive or the sum isn't finite."""
    rates = intensity(events, p).agg(F.sum(F.ln(F.when(F.col("rate") > 0, F.col("rate")))).alias("s"), F.count_if(~(F.col("rate") > 0) | F.isnan("rate")).alias("bad"))
    x = F.col("expected") - F.coalesce("s", F.lit(0.0))
    return rates.crossJoin(compensator(events, p, t_start, t_end)).select(F.when((F.col("bad") > 0) | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(1e12)).otherwise(x).alias("nll"))


def expected_counts(windows: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    """windows: win_idx, ws, we. Adds expected, from events before each window's start: those of the start's leaf of a time tree and of the
    one before it singly, all others by moments (see `intensity`)."""
    rows = tables.written(events.select("t", "mag"))
    wins = windows.select("win_idx", "ws", "we")
    q = p.p - 1
    tree, terms = _time_tree(rows.select("t").unionByName(wins.select(F.col("ws").alias("t"))), rows), _terms(q)
    rows = rows.select("t", _gain(p, F.col("mag")).alias("gain"), tree.leaf(F.col("t")).alias("leaf"))
    wins = wins.withColumn("leaf", tree.leaf(F.col("ws")))
    met = wins.select("win_idx", "ws", "we", _far_cells(tree)).join(_moments(rows, tree, len(terms)), ["level", "cell"])
    far = met.select("win_idx", ((_far_sum(tree, p, F.col("ws"), q, terms) - _far_sum(tree, p, F.col("we"), q, terms)) / q).alias("part"))
    before = rows.select("t", "gain", F.explode(F.array(F.col("leaf"), F.col("leaf") + 1)).alias("leaf"))
    near = wins.join(before, "leaf").filter("t < ws").select("win_idx", (F.col("gain") * _omori(p, F.col("ws") - F.col("t"), F.col("we") - F.col("t"))).alias("part"))
    sums = far.unionByName(near).groupBy("win_idx").agg(F.sum("part").alias("part"))
    return windows.join(sums, "win_idx", "left").select(*windows.columns, (F.lit(p.mu) * (F.col("we") - F.col("ws")) + F.coalesce("part", F.lit(0.0))).alias("expected"))


def fixed_windows(events: DataFrame, start: float, end: float, width: float) -> DataFrame:
    """win_idx, ws, we, n: windows from start, a partial one at the end goes; each event falls into its window by its number."""
    n = max(0, math.ceil((end - width - start) / width))
    spark = events.sparkSession
    wins = spark.range(n).select(F.col("id").cast("int").alias("win_idx"), (F.lit(start) + F.col("id") * width).alias("ws"), (F.lit(start) + F.col("id") * width + width).alias("we"))
    k = F.floor((F.col("t") - start) / width)
    near = F.explode(F.array(k - 1, k, k + 1))  # rounding may put an event one window off; the bounds decide
    met = events.select("t", near.alias("k")).join(F.broadcast(wins), (F.col("k") == F.col("win_idx")) & (F.col("t") >= F.col("ws")) & (F.col("t") < F.col("we")))
    return wins.join(met.groupBy("win_idx").agg(F.count(F.lit(1)).alias("n")), "win_idx", "left").fillna({"n": 0})


def branching(K: Column, c: Column, p: Column, alpha: Column, b: Column) -> Column:
    """`branching_ratio` of a table's rows; null where it has no finite value."""
    beta = b * math.log(10)
    return F.when((alpha < beta) & (p > 1), K * F.pow(c, 1 - p) / (p - 1) * beta / (beta - alpha))


def branching_ratio(p: Params, b: float) -> float | None:
    """Mean direct offspring; None where it has no finite value."""
    beta = b * math.log(10)
    if p.alpha >= beta or p.p <= 1:
        return None
    return p.K * p.c ** (1 - p.p) / (p.p - 1) * beta / (beta - p.alpha)


# --- fitting: one task fits one zone of some thousand strong events -----------------------------------------------------


def _nll(x: np.ndarray, t: np.ndarray, m: np.ndarray, m0: float, t1: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood over (0, t1) and its gradient in (mu, K, c, p, alpha)."""
    mu, K, c, p, alpha = x
    dm = m - m0
    g = np.exp(alpha * dm)
    grad, total = np.zeros(5), 0.0
    for lo in range(0, len(t), 512):  # rows in blocks, so that memory stays linear
        hi = min(lo + 512, len(t))
        dt = t[lo:hi, None] - t[None, :hi] + c
        earlier = np.arange(hi)[None] < np.arange(lo, hi)[:, None]
        ld = np.log(np.where(earlier, dt, 1.0))
        base = np.where(earlier, g[None, :hi] * np.exp(-p * ld), 0.0)
        s = base.sum(1)
        rate = mu + K * s
        if not (rate > 0).all():
            return 1e12, grad
        total += np.log(rate).sum()
        r = 1 / rate
        grad -= [r.sum(), (s * r).sum(), (K * (-p) * (base / dt).sum(1) * r).sum(), (-K * (base * ld).sum(1) * r).sum(), (K * (base * dm[None, :hi]).sum(1) * r).sum()]
    q = 1 - p
    u = t1 - t + c
    U, C = u**q, c**q
    h = (U - C) / q
    total = mu * t1 + K * (g * h).sum() - total
    dh_dp = (-U * np.log(u) + C * np.log(c)) / q + (U - C) / q**2
    grad += [t1, (g * h).sum(), K * (g * (u**-p - c**-p)).sum(), K * (g * dh_dp).sum(), K * (g * dm * h).sum()]
    return (float(total), grad) if np.isfinite(total) and np.isfinite(grad).all() else (1e12, np.zeros(5))


def _descent(z: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int):
    """Projected quasi-Newton steps from z in log parameters, as a conversation: yields the points that it wants the likelihood and gradient
    of, at once, and returns the last point and value. A step that fails is halved, four halves being asked for together."""
    ((f, g),) = yield [np.exp(z)]
    g = g * np.exp(z)
    H = np.eye(5) / max(1.0, np.abs(g).max())
    for _ in range(rounds):
        held = (z <= low) & (g > 0) | (z >= high) & (g < 0)
        if np.abs(np.where(held, 0, g)).max() < 1e-5 * max(1.0, abs(f)):
            break
        d = -H @ np.where(held, 0, g)
        d[held] = 0
        if d @ g >= 0:
            H, d = np.eye(5) / max(1.0, np.abs(g).max()), np.where(held, 0, -g) / max(1.0, np.abs(g).max())
        steps, taken = [1.0], None
        while taken is None and steps[0] > 1e-8:
            points = [np.clip(z + step * d, low, high) for step in steps]
            found = yield [np.exp(x) for x in points]
            taken = next(((x, *y) for x, y in zip(points, found) if y[0] < f + 1e-4 * (g @ (x - z))), None)
            steps = [steps[-1] / 2**k for k in range(1, 5)]
        if taken is None:
            break
        z2, f2, g2 = taken
        g2 = g2 * np.exp(z2)
        s, y = z2 - z, g2 - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            V = np.eye(5) - r * np.outer(s, y)
            H = V @ H @ V.T + r * np.outer(s, s)
        done = abs(f - f2) < 1e-9 * max(1.0, abs(f))
        z, f, g = z2, f2, g2
        if done:
            break
    return z, f


def searches(objective, groups: dict, m0: float, rounds: int = 200) -> dict:
    """Of each group of n events over (0, t1), {key: (n, t1)}, the parameters of greatest likelihood and minus its logarithm. `objective` takes
    points (mu, K, c, p, alpha) by group and gives each one's minus log-likelihood and gradient; two starts of each group, and all groups, go
    side by side, so that one call serves them all."""
    low, high = np.log(LOWER), np.log(np.where(np.isinf(UPPER), 1e6, UPPER))
    runs = {}
    for key, (n, t1) in groups.items():
        starts = ([0.5 * n / max(t1, 1e-9), 0.1, 0.01, 1.1, 1.0], [0.8 * n / max(t1, 1e-9), 0.02, 0.05, 1.3, 0.6])
        runs |= {(key, k): _descent(np.clip(np.log(np.maximum(x, 1e-12)), low, high), low, high, rounds) for k, x in enumerate(starts)}
    asked, ends = {k: next(run) for k, run in runs.items()}, {}
    while asked:
        found = objective({key: [x for k in (0, 1) for x in asked.get((key, k), [])] for key in dict.fromkeys(key for key, _ in asked)})
        answers = {key: iter(values) for key, values in found.items()}
        again = {}
        for at, points in asked.items():
            try:
                again[at] = runs[at].send([next(answers[at[0]]) for _ in points])
            except StopIteration as end:
                ends[at] = end.value
        asked = again
    best = {key: min((ends[key, 0], ends[key, 1]), key=lambda x: x[1]) for key in groups}
    return {key: (Params(*map(float, np.exp(z)), m0), float(f)) for key, (z, f) in best.items()}


def greatest_likelihood(objective, n: int, m0: float, t1: float, rounds: int = 200) -> tuple[Params, float]:
    """`searches` of one group; `objective` takes its points alone."""
    return searches(lambda asked: {0: objective(asked[0])}, {0: (n, t1)}, m0, rounds)[0]


def fit_vectors(t: np.ndarray, m: np.ndarray, m0: float, t1: float, rounds: int = 200) -> tuple[Params, float]:
    """The fit of a zone's events within one task; of more than FEW events not by all pairs."""
    t, m = np.asarray(t, float), np.asarray(m, float)
    return greatest_likelihood(lambda points: [_nll(x, t, m, m0, t1) for x in points] if len(t) <= FEW else _scanned(points, t, m, m0, t1), len(t), m0, t1, rounds)


# --- likelihoods without all pairs: the kernel as a sum of exponentials, whose sums over earlier events are carried along ----

#: Events up to which a fit takes all pairs; of a slab, within which pairs are summed singly; of a part at most; of a zone that a task fits.
FEW, SLAB, PART, ZONE = 512, 64, 50_000, 5000
#: Step of the nodes.
STEP = 0.22


def _nodes(span: float) -> np.ndarray:
    """u of the rates e^u with x^-q = STEP / gamma(q) * sum e^(q u - x e^u), to some 1e-13 for q from 1 to 4 and x from the least c to the span
    and the greatest c: the trapezoidal rule for the gamma function's integral, whose error falls as e^(-pi^2 / STEP)."""
    return np.arange(-33 - math.log(span + UPPER[2]), math.log(45 / LOWER[2]) + STEP, STEP)


def _digamma(x: float) -> float:
    out = 0.0
    while x < 20:
        out, x = out - 1 / x, x + 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _weights(u: np.ndarray, c: float, p: float) -> np.ndarray:
    return STEP * np.exp(p * u - c * np.exp(u) - math.lgamma(p))


def _gains(m: np.ndarray, points: list[np.ndarray], m0: float) -> np.ndarray:
    """For each point, gains and the same times m - m0."""
    g = np.exp(np.outer([x[4] for x in points], m - m0))
    return np.stack([g, g * (m - m0)], 1)


def _left(t: np.ndarray, gains: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each point, sums over events of `_gains` times e^(-s (end - t)), by rate s; the end is the last time."""
    out = np.zeros((*gains.shape[:2], len(s)))
    for lo in range(0, len(t), 512):
        out += gains[:, :, lo : lo + 512] @ np.exp(-np.outer(t[-1] - t[lo : lo + 512], s))
    return out


def _slab_sums(t: np.ndarray, gains: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`_pair_sums` of each slab with itself: pairs a lag apart at once, over all slabs."""
    _, _, c, p, _ = x
    n = -(-len(t) // SLAB) * SLAB
    whole = lambda v: np.concatenate([v, np.full(n - len(v), v[-1])]).reshape(-1, SLAB)
    t, (g, gdm), out = whole(t), map(whole, gains), np.zeros((4, n // SLAB, SLAB))
    for d in range(1, min(SLAB, t.size)):
        dt = t[:, d:] - t[:, :-d]
        dt += c
        ld = np.log(dt)
        kernel = np.exp(-p * ld)
        base = kernel * g[:, :-d]
        kernel *= gdm[:, :-d]
        out[0, :, d:] += base
        out[3, :, d:] += kernel
        ld *= base
        out[2, :, d:] += ld
        base /= dt
        out[1, :, d:] += base
    return out.reshape(4, -1)


def _scan(t: np.ndarray, m: np.ndarray, points: list[np.ndarray], m0: float, t1: float, u: np.ndarray, carried: np.ndarray | None = None) -> np.ndarray:
    """What a part's events add to minus the log-likelihood and to its gradient, a row a point; without the background's integral. `carried` is
    `_left` of all earlier events at the part's first time. A rate that isn't positive makes the row NaN."""
    s, held, at = np.exp(u), np.zeros((len(points), 2, len(u))) if carried is None else carried.copy(), t[0]
    sums = np.array([_integral_parts(t, m, x, m0, t1) for x in points])
    gains = _gains(m, points, m0)
    weights = np.array([[w := _weights(u, x[2], x[3]), w * s / x[3], w * (_digamma(x[3]) - u), w] for x in points])
    for block in range(0, len(t), 128 * SLAB):  # some slabs at once, so that memory stays small
        own = slice(block, block + 128 * SLAB)
        v = np.stack([_slab_sums(t[own], gains[k, :, own], x)[:, : len(t[own])] for k, x in enumerate(points)])
        for lo in range(block, min(len(t), own.stop), SLAB):
            ti = t[lo : lo + SLAB]
            held *= np.exp(-s * (ti[0] - at))
            far = weights * held[:, [0, 0, 0, 1]]
            v[:, :, lo - block : lo - block + len(ti)] += far @ np.exp(-np.outer(s, ti - ti[0]))
            at = ti[-1]
            held = held * np.exp(-s * (at - ti[0])) + _left(ti, gains[:, :, lo : lo + SLAB], s)
        for k, (mu, K, _, p, _) in enumerate(points):
            rate = mu + K * v[k, 0]
            if not (rate > 0).all():
                sums[k] = np.nan
                continue
            r = 1 / rate
            sums[k] -= [np.log(rate).sum(), r.sum(), v[k, 0] @ r, -K * p * (v[k, 1] @ r), -K * (v[k, 2] @ r), K * (v[k, 3] @ r)]
    return sums


def _answers(points: list[np.ndarray], sums: np.ndarray, t1: float) -> list[tuple[float, np.ndarray]]:
    """Minus log-likelihoods and gradients from all parts' sums."""
    whole = [v + [x[0] * t1, t1, 0, 0, 0, 0] for x, v in zip(points, sums)]
    return [(float(v[0]), v[1:]) if np.isfinite(v).all() else (1e12, np.zeros(5)) for v in whole]


def _scanned(points: list[np.ndarray], t: np.ndarray, m: np.ndarray, m0: float, t1: float) -> list[tuple[float, np.ndarray]]:
    """`_nll` at each point, in a time that grows with the number of events."""
    with np.errstate(all="ignore"):
        return _answers(points, _scan(t, m, points, m0, t1, _nodes(t1)), t1)


# --- fitting over the cluster: parts of the events are summed in tasks, the driver sees few numbers a part and point -----


def _block_pairs(events: DataFrame) -> DataFrame:
    """i, j, ti, tj, mj: the times of block i with times and magnitudes of each block j no later, in order of (i, j); a written table."""
    rows, _ = _numbered(events)
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", "t", "mag"))).alias("e"))
    blocks = tables.written(blocks.select("block", F.transform("e", lambda x: x["t"]).alias("t"), F.transform("e", lambda x: x["mag"]).alias("m")))
    later = blocks.select(F.col("block").alias("i"), F.col("t").alias("ti"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("j"))
    pairs = later.join(blocks.select(F.col("block").alias("j"), F.col("t").alias("tj"), F.col("m").alias("mj")), "j").select("i", "j", "ti", "tj", "mj")
    return tables.written(pairs.repartitionByRange("i", "j").sortWithinPartitions("i", "j"))


_SIX = ["f", *(f"g{k}" for k in range(5))]


def _pair_sums(ti, tj, mj, same: bool, x: np.ndarray, m0: float) -> np.ndarray:
    """For each event of block i, sums over those of block j before it: of the kernel, and of its derivatives' parts by c, p and alpha."""
    _, _, c, p, alpha = x
    dm = mj - m0
    g, out = np.exp(alpha * dm), np.empty((4, len(ti)))
    for lo in range(0, len(ti), 256):  # rows in blocks, so that memory stays small
        dt = ti[lo : lo + 256, None] - tj[None] + c
        if same:
            earlier = np.arange(len(tj))[None] < np.arange(lo, min(lo + 256, len(ti)))[:, None]
            dt = np.where(earlier, dt, 1.0)
        ld = np.log(dt)
        base = np.exp(-p * ld) * g
        if same:
            base = np.where(earlier, base, 0.0)
        out[:, lo : lo + 256] = base.sum(1), (base / dt).sum(1), (base * ld).sum(1), base @ dm
    return out


def _integral_parts(t: np.ndarray, m: np.ndarray, x: np.ndarray, m0: float, t1: float) -> np.ndarray:
    """What a block's events add to the integral of the intensity, and to its gradient; without the background."""
    _, K, c, p, alpha = x
    dm = m - m0
    g, q, u = np.exp(alpha * dm), 1 - p, t1 - t + c
    U, C = u**q, c**q
    h = (U - C) / q
    dh_dp = (-U * np.log(u) + C * np.log(c)) / q + (U - C) / q**2
    return np.array([K * (g * h).sum(), 0.0, (g * h).sum(), K * (g * (u**-p - c**-p)).sum(), K * (g * dh_dp).sum(), K * (g * dm * h).sum()])


def _evaluate(pairs: DataFrame, points: list[np.ndarray], m0: float, t1: float) -> list[tuple[float, np.ndarray]]:
    """Minus log-likelihood and gradient at each point, in one job."""

    def sums(batches):
        at, held = None, []

        def out():
            return pa.record_batch([pa.array([at] * len(points), pa.int32()), pa.array(range(len(points)), pa.int32()), pa.array([h.tobytes() for h in held], pa.binary()), *(pa.array(v) for v in own.T)], ["i", "k", "sums", *_SIX])

        for b in batches:
            for r in range(b.num_rows):
                i, j = b.column("i")[r].as_py(), b.column("j")[r].as_py()
                ti, tj, mj = (b.column(c)[r].values.to_numpy() for c in ("ti", "tj", "mj"))
                if i != at:
                    if at is not None:
                        yield out()
                    at, held, own = i, [np.zeros((4, len(ti))) for _ in points], np.zeros((len(points), 6))
                for k, x in enumerate(points):
                    held[k] += _pair_sums(ti, tj, mj, i == j, x, m0)
                    if i == j:
                        own[k] += _integral_parts(tj, mj, x, m0, t1)
        if at is not None:
            yield out()

    def whole(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        mu, K, _, p, _ = points[k]
        s, by_c, by_p, by_alpha = sum(np.frombuffer(x, float).reshape(4, -1) for x in table.column("sums").to_pylist())
        own = np.array([sum(table.column(c).to_pylist()) for c in _SIX])
        rate = mu + K * s
        if not (rate > 0).all():
            own[:] = np.nan
        else:
            r = 1 / rate
            own -= [np.log(rate).sum(), r.sum(), (s * r).sum(), (-K * p * by_c * r).sum(), (-K * by_p * r).sum(), (K * by_alpha * r).sum()]
        return pa.table({"k": pa.array([k], pa.int32())} | {c: [v] for c, v in zip(_SIX, own.tolist())})

    six = ", ".join(f"{c} double" for c in _SIX)
    parts = pairs.mapInArrow(sums, f"i int, k int, sums binary, {six}").groupBy("i", "k").applyInArrow(whole, f"k int, {six}")
    found = {r.k: np.array([r[c] for c in _SIX]) for r in parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in _SIX]).collect()}
    out = []
    for k, x in enumerate(points):
        v = found[k] + [x[0] * t1, t1, 0, 0, 0, 0]
        out.append((float(v[0]), v[1:]) if np.isfinite(v).all() else (1e12, np.zeros(5)))
    return out


def _parts(rows: DataFrame) -> DataFrame:
    """zone, part, start, t, m: a row for each stretch of a zone's events (zone, n from 1 in order of time, t, mag), as a written table. A part
    is as large as the cluster's cores ask for, and PART events at most."""
    size = min(PART, max(2000, -(-rows.count() // (3 * rows.sparkSession.sparkContext.defaultParallelism))))
    n = sum(-(-r["n"] // size) for r in rows.groupBy("zone").agg(F.max("n").alias("n")).collect())
    dealt = rows.withColumn("part", F.floor((F.col("n") - 1) / size).cast("int")).groupBy("zone", "part").agg(F.array_sort(F.collect_list(F.struct("n", "t", "mag"))).alias("e"))
    dealt = dealt.select("zone", "part", (F.col("part").cast("long") * size).alias("start"), F.transform("e", lambda x: x["t"]).alias("t"), F.transform("e", lambda x: x["mag"]).alias("m"))
    return tables.written(dealt.repartitionByRange(max(1, n), "zone", "part"))


def _each_part(parts: DataFrame, run, schema: str) -> DataFrame:
    """Rows of run(zone, part, start, t, m) for every part, one at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    shape = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, schema.split(", "))])

    def batches(found):
        for b in found:
            for r in range(b.num_rows):
                zone, part, start = (b.column(c)[r].as_py() for c in ("zone", "part", "start"))
                rows = run(zone, part, start, *(b.column(c)[r].values.to_numpy() for c in ("t", "m")))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], shape)

    return parts.mapInArrow(batches, schema)


def _carried(parts: DataFrame, asked: dict, counts: dict, spans: dict, m0: float) -> dict:
    """By zone and part, `_left` of all events before the part at its first time, for each point asked; of each zone's first `counts` events.
    Tasks sum their parts; the driver sees 4 KB a part and point."""

    def run(zone, part, start, t, m):
        k = min(len(t), counts.get(zone, 0) - start) if zone in asked else 0
        if k <= 0:
            return []
        own = _left(t[:k], _gains(m[:k], asked[zone], m0), np.exp(_nodes(spans[zone]))).tobytes() if start + k < counts[zone] else b""
        return [(zone, part, float(t[0]), float(t[k - 1]), own)]

    out, state, at = {}, None, None
    for r in sorted(_each_part(parts, run, "zone string, part int, first double, last double, own binary").collect(), key=lambda r: (r["zone"], r["part"])):
        s = np.exp(_nodes(spans[r["zone"]]))
        state = np.zeros((len(asked[r["zone"]]), 2, len(s))) if r["part"] == 0 else state * np.exp(-s * (r["first"] - at))
        out[r["zone"], r["part"]], at = state, r["last"]
        if r["own"]:
            state = state * np.exp(-s * (at - r["first"])) + np.frombuffer(r["own"], float).reshape(state.shape)
    return out


def _likelihoods(parts: DataFrame, asked: dict, counts: dict, spans: dict, m0: float) -> dict:
    """Minus log-likelihoods and gradients of each zone's first `counts` events over (0, spans) at the points asked, {zone: points}: a job for
    what parts leave to later ones, where a zone has several, and one for their sums."""
    before = _carried(parts, asked, counts, spans, m0)

    def run(zone, part, start, t, m):
        if (zone, part) not in before:
            return []
        k = min(len(t), counts[zone] - start)
        with np.errstate(all="ignore"):
            return [(zone, part, _scan(t[:k], m[:k], asked[zone], m0, spans[zone], _nodes(spans[zone]), before[zone, part]).tobytes())]

    sums = {zone: np.zeros((len(points), 6)) for zone, points in asked.items()}
    for r in sorted(_each_part(parts, run, "zone string, part int, sums binary").collect(), key=lambda r: (r["zone"], r["part"])):
        sums[r["zone"]] += np.frombuffer(r["sums"], float).reshape(-1, 6)
    return {zone: _answers(points, sums[zone], spans[zone]) for zone, points in asked.items()}


def fit_events(events: DataFrame, m0: float, t1: float, rounds: int = 200, all_pairs: bool = False) -> tuple[Params, float]:
    """The fit of any number of events (id, t, mag; t in days from the start), like `fit_vectors` on one task's: each point of the search is a
    job or two over parts of the events. With all_pairs it sums over all pairs of time blocks instead, which is quadratic: for checks."""
    n = events.count()
    if n <= BLOCK:  # one task's in any case, and so is the whole search

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["t", "id"])
            p, f = fit_vectors(frame["t"].to_numpy(), frame["mag"].to_numpy(), m0, t1, rounds)
            return pd.DataFrame([[p.mu, p.K, p.c, p.p, p.alpha, f]], columns=["mu", "K", "c", "p", "alpha", "f"])

        r = events.select("id", "t", "mag").groupBy().applyInPandas(run, "mu double, K double, c double, p double, alpha double, f double").first()
        return Params(r.mu, r.K, r.c, r.p, r.alpha, m0), r.f
    if all_pairs:
        pairs = _block_pairs(events)
        best = greatest_likelihood(lambda points: _evaluate(pairs, points, m0, t1), n, m0, t1, rounds)
        tables.forget(pairs)
        return best
    parts = _parts(_numbered(events)[0].select(F.lit("").alias("zone"), F.col("idx").alias("n"), "t", "mag"))
    best = searches(lambda asked: _likelihoods(parts, asked, {"": n}, {"": t1}, m0), {"": (n, t1)}, m0, rounds)[""]
    tables.forget(parts)
    return best


def _window_sums(parts: DataFrame, fitted: dict, counts: dict, bounds: dict, m0: float, width: float) -> DataFrame:
    """zone, test, win_idx, n, expected: what each part holds of a zone's windows, (0, split) and then (split, end) of `bounds`. A later window
    is expected by the last part that begins before it, of its own events singly and of all earlier ones by what they left."""
    ends = {zone: bounds[zone][1] for zone in fitted}
    before = _carried(parts, {zone: [np.array([p.mu, p.K, p.c, p.p, p.alpha])] for zone, p in fitted.items()}, counts, ends, m0)
    first = {zone: dict(enumerate(sorted(x for x in before if x[0] == zone))) for zone in fitted}
    starts = {(r["zone"], r["part"]): r["first"] for r in _each_part(parts, lambda zone, part, start, t, m: [(zone, part, float(t[0]))], "zone string, part int, first double").collect()}
    until = {key: starts[following] if (following := first[key[0]].get(k + 1)) else math.inf for zone in fitted for k, key in first[zone].items()}

    def run(zone, part, start, t, m):
        if zone not in fitted:
            return []
        p, (split, end), out = fitted[zone], bounds[zone], []
        for test, ws in ((False, _windows(0.0, split, width)), (True, _windows(split, end, width))):
            n = np.searchsorted(t, ws + width) - np.searchsorted(t, ws)
            own = (t[0] < ws) & (ws <= until[zone, part]) if test else np.zeros(len(ws), bool)
            for k in np.flatnonzero((n > 0) | own):
                expected = None
                if own[k]:
                    u, a, b = _nodes(end), ws[k] - t[t < ws[k]], ws[k] - t[0]
                    s, gain = np.exp(u), p.K * np.exp(p.alpha * (m[: len(a)] - m0))
                    far = p.K * (_weights(u, p.c, p.p) * -np.expm1(-s * width) / s * np.exp(-s * b)) @ before[zone, part][0, 0]
                    expected = p.mu * width + float(far) + float(gain @ (_vector_omori(p, 0.0, a + width) - _vector_omori(p, 0.0, a)))
                out.append((zone, int(test), int(k), int(n[k]), expected))
        return out

    return _each_part(parts, run, "zone string, test int, win_idx int, n long, expected double").groupBy("zone", "test", "win_idx").agg(F.sum("n").alias("n"), F.sum("expected").alias("expected"))


def fit_large(events: DataFrame, m0: float, train_frac: float = 0.75, window_days: float = 30.0, least_train: int = 30, least_test: int = 8, bin_width: float = 0.1) -> DataFrame:
    """events: zone, time, mag (strong ones). Rows like `fit_zones`' for zones of any size, as jobs over parts of all of them: fits, whose
    searches go side by side, expected counts of later windows, and their deviance against climatology and persistence."""
    spark = events.sparkSession
    order = ordering.with_index(events.select("zone", "time", "mag"), "zone", "time", "mag", index="at")
    us = exprs.micros(F.col("time"))
    zones = order.groupBy("zone").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("of"), F.min(us).alias("t0"))
    rows = tables.written(order.join(F.broadcast(zones), "zone").select("zone", (F.col("at") - F.col("first") + 1).alias("n"), "of", exprs.days((us - F.col("t0")).cast("double")).alias("t"), "mag"))
    k = F.floor(F.col("of") * train_frac)
    known = {r["zone"]: r for r in rows.groupBy("zone", "of").agg(F.max(F.when(F.col("n") == k + 1, F.col("t"))).alias("split"), F.max("t").alias("end")).collect()}
    names = [x.split()[0] for x in ZONE_SCHEMA.split(", ")]
    out = {zone: dict.fromkeys(names) | {"zone": zone, "n_events": r["of"]} for zone, r in known.items()}
    counts, bounds = {}, {}
    for zone, r in known.items():
        train = int(r["of"] * train_frac)
        if train < least_train or r["of"] - train < least_test:
            out[zone]["status"] = "too few events"
        elif not len(_windows(r["split"], r["end"], window_days)) or not len(_windows(0.0, r["split"], window_days)):
            out[zone]["status"] = "no window fits into training or test"
        else:
            counts[zone], bounds[zone] = train, (r["split"], r["end"])
    if counts:
        parts = _parts(rows.filter(F.col("zone").isin(list(counts))))
        splits = {zone: split for zone, (split, _) in bounds.items()}
        found = searches(lambda asked: _likelihoods(parts, asked, counts, splits, m0), {zone: (n, splits[zone]) for zone, n in counts.items()}, m0)
        fitted = {zone: p for zone, (p, _) in found.items()}
        seen = tables.written(_window_sums(parts, fitted, {zone: known[zone]["of"] for zone in counts}, bounds, m0, window_days))
        tables.forget(parts)
        for zone, p in fitted.items():
            trains, tests = (len(_windows(*x, window_days)) for x in ((0.0, bounds[zone][0]), bounds[zone]))
            of = seen.filter(F.col("zone") == zone)
            history = of.filter("test = 0").agg((F.coalesce(F.sum("n"), F.lit(0)) / trains).alias("mean"), F.coalesce(F.max(F.when(F.col("win_idx") == trains - 1, F.col("n"))), F.lit(0)).alias("last")).first()
            later = spark.range(tests).select(F.col("id").cast("int").alias("win_idx")).join(of.filter("test = 1"), "win_idx", "left").select("win_idx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(p.mu * window_days)).alias("expected"))
            later = later.withColumn("before", F.coalesce(F.lag("n").over(Window.orderBy("win_idx")), F.lit(history["last"])))
            d = later.agg(*[_deviance(q).alias(c) for c, q in (("etas", F.col("expected")), ("climatology", F.lit(history["mean"])), ("persistence", F.col("before")))]).first()
            against = lambda b: 0.0 if d[b] == 0 else 1 - d["etas"] / d[b]  # noqa: B023, E731
            b = _large_b_value(rows.filter(F.col("zone") == zone), bin_width)
            out[zone] |= {"status": "fitted", "mu": p.mu, "K": p.K, "c": p.c, "p": p.p, "alpha": p.alpha, "b_value": b, "branching": branching_ratio(p, b), "n_windows": tests, "skill_climatology": against("climatology"), "skill_persistence": against("persistence")}
        tables.forget(seen)
    tables.forget(rows)
    return spark.createDataFrame([tuple(row.values()) for row in out.values()], ZONE_SCHEMA)


def _deviance(q: Column) -> Column:
    """Of counts n from what was expected."""
    q = F.greatest(q.cast("double"), F.lit(1e-9))
    return 2 * F.avg(F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n") / q)).otherwise(0.0) - (F.col("n") - q))


def _large_b_value(events: DataFrame, bin_width: float) -> float:
    """`_b_value` of a table's events."""
    mc = stats.completeness_magnitude(events, bin_width).first()["mc"]
    above = events.filter(F.col("mag") >= mc - 1e-9).agg(F.count(F.lit(1)).alias("n"), F.avg("mag").alias("mean")).first()
    room = above["mean"] - (mc - bin_width / 2) if above["n"] >= 2 else 0
    return math.log10(math.e) / room if room > 0 else 1.0


def fit_catalog(events: DataFrame, m0: float, *args, label: str = "national", **options) -> DataFrame:
    """events: time, mag (strong ones). One row like `fit_zones`' of all events together."""
    spark = events.sparkSession
    if events.isEmpty():
        return spark.createDataFrame([(label, 0, "too few events", *[None] * 10)], ZONE_SCHEMA)
    return fit_large(events.withColumn("zone", F.lit(label)), m0, *args, **options)


def _windows(start: float, end: float, width: float) -> np.ndarray:
    return np.arange(start, end - width, width)


def _vector_omori(p: Params, t1, t2):
    return ((t2 + p.c) ** (1 - p.p) - (t1 + p.c) ** (1 - p.p)) / (1 - p.p)


def evaluate_vectors(t: np.ndarray, m: np.ndarray, m0: float, train_frac: float, window_days: float) -> dict:
    """Fit on the first events, counts on later windows, against climatology and persistence. Unfit inputs are errors."""
    if len(t) != len(m):
        raise CatalogError("times and magnitudes differ in number")
    if len(t) < 2 or (np.diff(t) < 0).any():
        raise CatalogError("times have to be at least two, in order")
    k = int(len(t) * train_frac)
    if not 0 < k < len(t):
        raise CatalogError("the split leaves training or test without events")
    split = float(t[k])
    tests, trains = _windows(split, float(t[-1]), window_days), _windows(0.0, split, window_days)
    if not len(tests) or not len(trains):
        raise CatalogError("no window fits into training or test")
    p, nll = fit_vectors(t[:k], m[:k], m0, split)
    gain = p.K * np.exp(p.alpha * (m - m0))
    count = lambda s: np.searchsorted(t, s + window_days) - np.searchsorted(t, s)
    y = count(tests).astype(float)
    etas = np.array([p.mu * window_days + (gain[t < s] * (_vector_omori(p, 0.0, s + window_days - t[t < s]) - _vector_omori(p, 0.0, s - t[t < s]))).sum() for s in tests])
    history = count(trains).astype(float)

    def deviance(q):
        q = np.maximum(q, 1e-9)
        return float(2 * np.mean(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / q), 0) - (y - q)))

    dev = {"etas": deviance(etas), "climatology": deviance(np.full(len(y), history.mean())), "persistence": deviance(np.concatenate([history[-1:], y[:-1]]))}
    against = lambda b: 0.0 if dev[b] == 0 else 1 - dev["etas"] / dev[b]
    return {"params": p, "nll": nll, "n_train": k, "n_windows": len(y), "skill_climatology": against("climatology"), "skill_persistence": against("persistence")}


ZONE_SCHEMA = "zone string, n_events long, status string, mu double, K double, c double, p double, alpha double, b_value double, branching double, n_windows int, skill_climatology double, skill_persistence double"


def assign_zones(df: DataFrame, zones: list[Region], least: int = 0) -> DataFrame:
    """Rows with zone, once for each box that holds them (edges belong to both sides); zones of fewer than `least` events go."""
    names = F.filter(F.array(*[F.when(exprs.in_box(F.col("latitude"), F.col("longitude"), z), F.lit(z.name)) for z in zones]), lambda x: x.isNotNull())
    out = df.withColumn("zone", F.explode(names))
    if least:
        out = out.join(F.broadcast(out.groupBy("zone").count().filter(F.col("count") >= least).select("zone")), "zone")
    return out


def fit_zones(events: DataFrame, m0: float, train_frac: float = 0.75, window_days: float = 30.0, least_train: int = 30, least_test: int = 8, bin_width: float = 0.1) -> DataFrame:
    """events: zone, time, mag (strong ones). A row a zone with its fit and skill, or why there is none. A task fits a zone at a time; zones of
    more than ZONE events are fitted by jobs over parts of them, all side by side."""
    options = (m0, train_frac, window_days, least_train, least_test, bin_width)
    large = [r["zone"] for r in events.groupBy("zone").count().filter(F.col("count") > ZONE).collect()]
    if large:
        few = events.filter(F.col("zone").isNull() | ~F.col("zone").isin(large))
        return _fit_small(few, *options).unionByName(fit_large(events.filter(F.col("zone").isin(large)), *options))
    return _fit_small(events, *options)


def _fit_small(events: DataFrame, m0: float, train_frac: float, window_days: float, least_train: int, least_test: int, bin_width: float) -> DataFrame:
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["us", "mag"], kind="stable")
        t, m = (frame["us"].to_numpy() - frame["us"].iloc[0]) / 86_400e6, frame["mag"].to_numpy()
        k = int(len(t) * train_frac)
        row = dict.fromkeys([x.split()[0] for x in ZONE_SCHEMA.split(", ")]) | {"zone": key[0], "n_events": len(t), "status": "fitted"}
        if k < least_train or len(t) - k < least_test:
            return pd.DataFrame([row | {"status": "too few events"}])
        try:
            e = evaluate_vectors(t, m, m0, train_frac, window_days)
        except CatalogError as x:
            return pd.DataFrame([row | {"status": str(x)}])
        b = _b_value(m, bin_width)
        p = e["params"]
        return pd.DataFrame([row | {"mu": p.mu, "K": p.K, "c": p.c, "p": p.p, "alpha": p.alpha, "b_value": b, "branching": branching_ratio(p, b), "n_windows": e["n_windows"], "skill_climatology": e["skill_climatology"], "skill_persistence": e["skill_persistence"]}])

    return events.select("zone", exprs.micros(F.col("time")).alias("us"), "mag").groupBy("zone").applyInPandas(run, ZONE_SCHEMA)


def _b_value(m: np.ndarray, width: float) -> float:
    """At the completeness magnitude; 1 where it can't be told."""
    lo = math.floor(m.min() / width) * width
    n = round((m.max() - lo) / width) + 1
    counts, edges = np.histogram(m, lo + width * np.arange(n + 1))
    mc = round(float(edges[int(counts.argmax())]) + width / 2 + 0.2, 2)
    above = m[m >= mc - 1e-9]
    denom = above.mean() - (mc - width / 2) if len(above) >= 2 else 0
    return math.log10(math.e) / denom if denom > 0 else 1.0


def zone_flag(n: Column) -> Column:
    return F.when(n.isNull(), "undefined").when(n < 1, "sub-critical").otherwise("super-critical")


# --- generic aftershocks ---------------------------------------------------------------------------------------------


def aftershocks(mag: Column, min_mag: Column, t1: Column, t2: Column) -> Column:
    rate = F.pow(F.lit(10.0), F.lit(RJ_A) + F.lit(RJ_B) * (mag - min_mag))
    return F.greatest(F.lit(0.0), rate * (F.pow(t2 + RJ_C, F.lit(1 - RJ_P)) - F.pow(t1 + RJ_C, F.lit(1 - RJ_P))) / (1 - RJ_P))


def display_band(n: Column) -> Column:
    half_up = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.when(n < 0.5, "~0").otherwise(F.concat(half_up(n * 0.4), F.lit("–"), half_up(F.greatest(F.lit(1.0), n * 2.3))))


def aftershock_panel(events: DataFrame, now_us: Column, least: float = 4.5) -> DataFrame:
    """id, mag, elapsed_days, min_mag, period, expected, band, for strong events: M3 and M4 over 7 days, 30 days and what remains of 30."""
    rows = events.filter(F.col("mag") >= least).withColumn("elapsed_days", exprs.days((now_us - exprs.micros(F.col("time"))).cast("double")))
    e = F.col("elapsed_days")
    cells = [F.struct(F.lit(m).alias("min_mag"), F.lit(name).alias("period"), t1.alias("t1"), t2.alias("t2")) for m in (3.0, 4.0) for name, t1, t2 in (("7d", F.lit(0.0), F.lit(7.0)), ("30d", F.lit(0.0), F.lit(30.0)), ("remaining", e, F.lit(30.0)))]
    rows = rows.select("id", "mag", "elapsed_days", F.inline(F.array(*cells))).filter((F.col("period") != "remaining") | (e < 30))
    n = aftershocks(F.col("mag"), F.col("min_mag"), F.col("t1"), F.col("t2"))
    return rows.select("id", "mag", "elapsed_days", "min_mag", "period", n.alias("expected"), display_band(n).alias("band"))


def recent_events(events: DataFrame, now_us: Column, region: Region, days: int = 30, min_mag: float = 3.0) -> DataFrame:
    """Events of the box since the midnight so many days ago, newest first: id, time_us, mag, elapsed, band, radius, is_fresh."""
    start = exprs.micros(F.date_trunc("day", F.timestamp_micros(now_us - days * DAY_US)))
    us = exprs.micros(F.col("time"))
    rows = events.filter((F.col("mag") >= min_mag) & (us >= start) & exprs.in_box(F.col("latitude"), F.col("longitude"), region))
    d = exprs.days((now_us - us).cast("double"))
    band, radius = recent_style(F.col("mag"))
    return rows.select("id", us.alias("time_us"), "mag", elapsed_text(d).alias("elapsed"), band.alias("band"), radius.alias("radius"), (d < 1).alias("is_fresh")).orderBy(F.desc("time_us"), "id")


def elapsed_text(days: Column) -> Column:
    half_up = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return (
        F.when(days < 1 / 60, "az önce")
        .when(days < 1 / 24, F.concat(half_up(days * 1440), F.lit(" dakika önce")))
        .when(days < 1, F.concat(half_up(days * 24), F.lit(" saat önce")))
        .when(days < 2, "1 gün önce")
        .otherwise(F.concat(F.floor(days).cast("long").cast("string"), F.lit(" gün önce")))
    )


def recent_style(mag: Column) -> tuple[Column, Column]:
    """Band and radius of a recent event."""
    band = F.when(mag >= 5.5, "5.5+").when(mag >= 4.5, "4.5+").when(mag >= 3.5, "3.5+").otherwise("<3.5")
    return band, F.when(mag >= 5.5, 9 + (mag - 5.5) * 4).when(mag >= 4.5, 7.5).when(mag >= 3.5, 6.0).otherwise(4.0)
