"""Gradient boosting by histograms of gradients and Hessians.

Features are put into bins once. A level of a tree is one aggregation: each task adds up gradients, Hessians and rows of every open
node by feature and bin, and the driver, which sees these sums alone (at most nodes x features x bins), splits the nodes. Losses
are squared, Poisson with a logarithmic link, and binomial with a logistic one. A table that fits a task is boosted within one, by
the same sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.functions import tables
from tectra.schemas import CatalogError

# The learner's usual defaults.
ROUNDS, RATE, DEPTH, BINS, LEAST_ROWS, LEAST_HESSIAN = 100, 0.1, 3, 255, 20, 1e-3
#: Values (rows times features) of a table that one task boosts.
WITHIN_TASK = 8_000_000
LOSSES = ("squared", "poisson", "binomial")


@dataclass
class Tree:
    """Nodes by their place in a heap, the root at 1. A node without a feature is a leaf; rows of at most `cut` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls) -> Tree:
        n = 2 ** (DEPTH + 1)
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Where each row stands."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            f = self.feature[at]
            down = 2 * at + (bins[rows, np.maximum(f, 0)] > self.cut[at])
            at = np.where(f < 0, at, down)
        return at


@dataclass
class Model:
    loss: str
    features: list[str]
    edges: list[np.ndarray]  # a value in bin k is greater than edge k - 1 and at most edge k
    base: float
    trees: list[Tree]

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.nodes(bins)] for t in self.trees), np.zeros(len(bins)))

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, k], "left") for k, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(values), 0), np.int64)

    def predict(self, values: np.ndarray) -> np.ndarray:
        raw = self.raw(self.binned(values))
        return raw if self.loss == "squared" else np.exp(raw) if self.loss == "poisson" else 1 / (1 + np.exp(-raw))


def first_guess(loss: str, mean: float) -> float:
    if loss == "squared":
        return mean
    with np.errstate(divide="ignore"):
        return float(np.log(mean)) if loss == "poisson" else float(np.log(mean) - np.log1p(-mean))


def gradients(loss: str, raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return raw - y, np.ones(len(y))
    if loss == "poisson":
        rate = np.exp(raw)
        return rate - y, rate
    p = 1 / (1 + np.exp(-raw))
    return p - y, p * (1 - p)


def level_sums(bins: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, open_: list[int], width: int) -> np.ndarray:
    """Sums of gradients, Hessians and rows by open node, feature and bin."""
    place = np.full(2 ** (DEPTH + 1), -1)
    place[open_] = np.arange(len(open_))
    node = place[at]
    in_ = node >= 0
    out = np.zeros((len(open_), bins.shape[1], width, 3))
    for f in range(bins.shape[1]):
        key = node[in_] * width + bins[in_, f]
        for k, w in enumerate((g, h, None)):
            out[:, f, :, k] = np.bincount(key, None if w is None else w[in_], len(open_) * width).reshape(len(open_), width)
    return out


def best_split(sums: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Feature, cut and the two sides' totals of the greatest gain; the first of equals. None where no split gains anything."""
    left = sums.cumsum(1)
    total = left[:, -1:]
    right = total - left
    ok = (left[..., 2] >= LEAST_ROWS) & (right[..., 2] >= LEAST_ROWS) & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN)
    gain = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-300)
    value = np.where(ok, gain(left) + gain(right) - gain(total), 0.0)
    f, b = np.unravel_index(int(value.argmax()), value.shape)
    return (int(f), int(b), left[f, b], right[f, b]) if value[f, b] > 1e-12 else None


def boost(sums: Callable[[list[Tree], Tree, list[int]], np.ndarray], rounds: int, rate: float) -> list[Tree]:
    """Trees from level to level. `sums` gives those of the open nodes, after earlier trees and this one's upper levels."""
    trees: list[Tree] = []
    leaf = lambda s: -rate * s[0] / s[1] if s[1] > 0 else 0.0
    for _ in range(rounds):
        tree, open_ = Tree.empty(), [1]
        for level in range(DEPTH):
            below = []
            for node, s in zip(open_, sums(trees, tree, open_)):
                if level == 0:
                    tree.value[1] = leaf(s[0].sum(0))
                if found := best_split(s):
                    tree.feature[node], tree.cut[node] = found[:2]
                    tree.value[2 * node], tree.value[2 * node + 1] = leaf(found[2]), leaf(found[3])
                    below += [2 * node, 2 * node + 1]
            open_ = below
            if not open_:
                break
        if tree.feature[1] < 0 and abs(tree.value[1]) < 1e-12:
            break  # nothing is left to learn, now and later
        trees.append(tree)
    return trees


def _edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Between neighbouring values where a feature has few, else quantiles; `bins` values a feature at most reach the driver."""
    levels = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = []
    for f in features:
        few = sorted(r[0] for r in df.select(f).distinct().limit(bins + 1).collect())
        if len(few) > bins:
            found.append(np.unique(df.agg(F.percentile_approx(f, levels, 10_000)).first()[0]))
        else:
            v = np.array(few, float)
            found.append((v[:-1] + v[1:]) / 2)
    return found


def boost_arrays(values: np.ndarray, y: np.ndarray, model: Model, rounds: int, rate: float) -> list[Tree]:
    """Within one task."""
    bins, width = model.binned(values), 1 + max(map(len, model.edges), default=0)
    state = {"n": 0, "raw": np.full(len(y), model.base)}

    def sums(trees: list[Tree], tree: Tree, open_: list[int]) -> np.ndarray:
        for t in trees[state["n"] :]:
            state["raw"] = state["raw"] + t.value[t.nodes(bins)]
        state["n"] = len(trees)
        return level_sums(bins, tree.nodes(bins), *gradients(model.loss, state["raw"], y), open_, width)

    return boost(sums, rounds, rate)


def _boost_table(df: DataFrame, model: Model, target: str, rounds: int, rate: float) -> list[Tree]:
    """Over tasks: one job a level."""
    spark, width, n = df.sparkSession, 1 + max(map(len, model.edges), default=0), len(model.features)

    def put(batches):
        for b in batches:
            values = np.stack([b.column(f).to_numpy() for f in model.features], 1).astype(float) if n else np.zeros((b.num_rows, 0))
            yield pa.record_batch([*(pa.array(c.astype(np.int16)) for c in model.binned(values).T), b.column("y")], [*(f"b{k}" for k in range(n)), "y"])

    typed = df.select(*model.features, F.col(target).cast("double").alias("y"))
    rows = tables.written(typed.mapInArrow(put, ", ".join([*(f"b{k} short" for k in range(n)), "y double"])))

    def sums(trees: list[Tree], tree: Tree, open_: list[int]) -> np.ndarray:
        so_far = Model(model.loss, model.features, model.edges, model.base, trees)

        def run(batches):
            total = np.zeros((len(open_), n, width, 3))
            for b in batches:
                bins = np.stack([b.column(f"b{k}").to_numpy() for k in range(n)], 1).astype(np.int64)
                total += level_sums(bins, tree.nodes(bins), *gradients(model.loss, so_far.raw(bins), b.column("y").to_numpy()), open_, width)
            at = np.flatnonzero(total[..., 2])
            yield pa.record_batch([pa.array(at), *(pa.array(total[..., k].ravel()[at]) for k in range(3))], ["at", "g", "h", "n"])

        found = rows.mapInArrow(run, "at long, g double, h double, n double").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()
        out = np.zeros((len(open_) * n * width, 3))
        out[found.column("at").to_numpy()] = np.stack([found.column(c).to_numpy() for c in ("g", "h", "n")], 1)
        return out.reshape(len(open_), n, width, 3)

    trees = boost(sums, rounds, rate)
    tables.forget(rows)
    return trees


def fit(df: DataFrame, features: list[str], target: str, loss: str, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, within_task: int = WITHIN_TASK) -> Model:
    """Rows with a null or NaN are let go; a table without rows is an error. Counts have to be 0 or more for Poisson, 0 or 1 for binomial."""
    if loss not in LOSSES:
        raise CatalogError(f"no loss is named {loss}")
    df = df.dropna(subset=[*features, target])
    y = F.col(target).cast("double")
    n, mean, low, high = df.agg(F.count(F.lit(1)), F.avg(y), F.min(y), F.max(y)).first()
    if not n:
        raise CatalogError("there is nothing to learn from")
    if loss != "squared" and low < 0 or loss == "binomial" and high > 1:
        raise CatalogError(f"values from {low} to {high} don't suit the {loss} loss")
    model = Model(loss, features, _edges(df, features, bins), first_guess(loss, mean), [])
    if low == high or not features:  # one value: there is no gradient
        return model
    if n * len(features) > within_task:
        model.trees = _boost_table(df, model, target, rounds, rate)
        return model
    size = len(Tree.empty().value)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        trees = boost_arrays(frame[features].to_numpy(float), frame["__y"].to_numpy(float), model, rounds, rate)
        return pd.DataFrame([(k, t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for k, t in enumerate(trees)], columns=["k", "feature", "cut", "value"])

    rows = df.select(*features, y.alias("__y")).groupBy().applyInPandas(run, "k int, feature array<long>, cut array<long>, value array<double>")
    model.trees = [Tree(np.array(r.feature), np.array(r.cut), np.array(r.value)) for r in sorted(rows.collect(), key=lambda r: r.k)]
    assert all(len(t.value) == size for t in model.trees)
    return model


def prediction(model: Model) -> Column:
    """The model's value for a row, a column; features may be null nowhere."""

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack([c.to_numpy(float) for c in columns], 1)))

    return of(*[F.col(c).cast("double") for c in model.features]) if model.features else F.lit(float(model.predict(np.zeros((1, 0)))[0]))
