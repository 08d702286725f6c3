"""Near-duplicate vectors by cosine, label by label, in tiles of PCA-ordered coordinates.

Coordinates are rotated to the principal axes of all vectors, scaled to length one. Two vectors within a distance differ by
no more than it on any axis, so on a grid of that width a vector meets only its own and the next cell on every axis. The
two leading axes give cells that meet by equality; within one, vectors are ordered by their places on the axes after
these and cut into tiles, each of which knows the range of its places. Pairs of tiles whose ranges are apart on any axis go
before a vector moves. Within a pair of tiles the products of the leading coordinates are summed first, the rest is
bounded by the product of the suffix norms, and a pair stops when the bound falls short of the threshold. What is left
is decided by the cosine of the original vectors in double precision.

Vectors of all lengths go through the same jobs; the length is a part of the label. Axes are found by length. Bounds
hold on any orthonormal axes, so where the axes of many lengths would fill the driver (AXES_CELLS), the lengths of
fewest vectors keep their own coordinates: that costs comparisons there, and no pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Rows of a tile, on average.
TILE = 1024
#: Cells of all axes together (8 bytes each); a length has its square of them.
AXES_CELLS = 1 << 22
#: Room for rounding in bounds; the decision itself has none.
_SLACK = 1e-9
_STEPS = (8, 16, 32)
#: Axes after the first two whose places order the vectors of a cell.
_AXES = 4
#: Equal vectors are told by two 64-bit hashes.
_KEY = ["label", "h1", "h2"]


def _clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    ok &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label_col).cast("string").alias("label")).withColumn("ok", F.coalesce(ok, F.lit(False)))


def _hashed(rows: DataFrame) -> DataFrame:
    """label (with the length), h1, h2, v. -0.0 counts as 0.0."""
    v = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.select("vec_id", F.concat_ws("/", F.size("v").cast("string"), "label").alias("label"), v.alias("v"))
    return rows.select("vec_id", "label", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), F.reverse("v")).alias("h2"), "v")


def _axes(classes: DataFrame, most: int | None = None) -> dict[int, np.ndarray]:
    """By length, the principal axes of the unit vectors, from sums over all of them; what comes to the driver has at most
    `most` cells. Lengths of most vectors first; a length of fewer vectors than coordinates has no axes of its own."""
    most, lengths = AXES_CELLS if most is None else most, []
    for d, n in sorted(classes.groupBy(F.size("v")).count().collect(), key=lambda r: (-r[1], r[0])):
        if n >= d and d * d <= most:
            most -= d * d
            lengths.append(d)
    if not lengths:
        return {}

    def sums(frames):
        total = {}
        for f in frames:
            for d, part in f.groupby(f["v"].map(len)):
                x = _unit(np.stack(part["v"].to_numpy()))
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pd.DataFrame({"d": d, "i": np.arange(d), "row": list(m)})

    rows = classes.filter(F.size("v").isin(lengths)).select("v").mapInPandas(sums, "d int, i int, row array<double>")
    cells = rows.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    of, i, j, x = (cells.column(c).to_numpy() for c in ("d", "i", "j", "x"))
    axes = {}
    for d in lengths:
        m, here = np.zeros((d, d)), of == d
        m[i[here], j[here]] = x[here]
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        axes[d] = vectors[:, np.argsort(-values, kind="stable")]
    return axes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _suffix_norms(z: np.ndarray) -> np.ndarray:
    """norms[:, d]: of coordinates d and after."""
    tail = np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([tail, np.zeros((len(z), 1))], axis=1))


def close_pairs(a: np.ndarray, b: np.ndarray, za: np.ndarray, zb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with a cosine of at least the threshold: rows of a, rows of b (if same, each pair once)."""
    dims = za.shape[1]
    na, nb, least = _suffix_norms(za), _suffix_norms(zb), threshold - _SLACK
    d = min(_STEPS[0], dims)
    partial = za[:, :d] @ zb[:, :d].T
    i, j = np.nonzero(partial + na[:, d][:, None] * nb[:, d][None] >= least)
    if same:
        i, j = i[i < j], j[i < j]
    p = partial[i, j]
    del partial
    for step in (*_STEPS[1:], dims):
        e = min(step, dims)
        if e > d and len(i):
            p = p + np.concatenate([np.einsum("ij,ij->i", za[i[k : k + 65536], d:e], zb[j[k : k + 65536], d:e]) for k in range(0, len(i), 65536)])
            alive = p + na[i, e] * nb[j, e] >= least
            i, j, p, d = i[alive], j[alive], p[alive], e
    if len(i):
        ua, ub = _unit(a), _unit(b)
        cos = np.concatenate([np.einsum("ij,ij->i", ua[i[k : k + 65536]], ub[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        i, j = i[cos >= threshold], j[cos >= threshold]
    return i, j


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that hold together what the pairs (i, j) hold together, at most one a row: each with its group's least id."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        x, y = root(x), root(y)
        if x != y:
            if ids[y] < ids[x]:
                x, y = y, x
            parent[y] = x
    roots = [root(x) for x in range(len(ids))]
    links = [(int(ids[x]), int(ids[r])) for x, r in enumerate(roots) if x != r]
    return [a for a, _ in links], [b for _, b in links]


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (least vec_id reached by links), kept.

    Rows link when their labels are equal and not null and their cosine is at least the threshold (> 0). Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    Repeated rows count as rows of their own, equal vectors are compared once and counted as often as they stand; an
    empty table gives an empty one; other columns are ignored. A null vec_id links with nothing
    and has no component.
    """
    rows = _clean(vectors, id_col, vector_col, label_col)
    good = _hashed(rows.filter("ok"))
    # equal vectors of a label are one class: class_id (the least vec_id) and n
    classes = common.cut(good.groupBy(*_KEY).agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v")))
    found = common.cut(_links(classes, threshold, tile))
    group = components(found.filter("other is not null").select(F.col("class_id").alias("a"), F.col("other").alias("b")))
    more = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    each = classes.select(*_KEY, "class_id", "n").join(more, "class_id", "left").join(group, F.col("class_id") == F.col("node"), "left")
    each = common.cut(each.select(*_KEY, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "class_id").alias("component")))
    of = good.select("vec_id", *_KEY).join(common.hinted(each), _KEY).select("vec_id", "links", "component")
    lone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    out = of.unionByName(lone)
    return out.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def _links(classes: DataFrame, threshold: float, tile: int) -> DataFrame:
    """class_id, links (rows linked in a pair of tiles), other (a class of the same component, or null). Vectors of a label
    have one length."""
    axes = classes.sparkSession.sparkContext.broadcast(_axes(classes))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-6) + 1e-9

    grid = [f"g{k}" for k in range(_AXES)]

    def place(frames):
        for f in frames:
            for d, part in f.groupby(f["v"].map(len)):
                z = _unit(np.stack(part["v"].to_numpy()))
                z = z @ axes.value[d][:, : 2 + _AXES] if d in axes.value else z
                cells = {c: np.floor(z[:, k] / reach).astype(np.int64) if d > k else 0 for k, c in enumerate(["x", "y", *grid])}
                yield part.assign(**cells)[["label", "class_id", "n", "v", "x", "y", *grid]]

    schema = "label string, class_id long, n long, v array<double>, x long, y long, " + ", ".join(f"{g} long" for g in grid)
    placed = common.cut(classes.select("label", "class_id", "n", "v").mapInPandas(place, schema))
    cell = ["label", "x", "y"]
    # places in order are cut into tiles; a place of more vectors than a tile is dealt over several by hash
    spots = placed.groupBy(*cell, *grid).count()
    before = F.sum("count").over(Window.partitionBy(*cell).orderBy(*grid)) - F.col("count")
    spots = spots.withColumn("first", F.floor(before / tile).cast("int")).withColumn("parts", F.ceil(F.col("count") / tile).cast("int"))
    spots = common.cut(spots.withColumn("t", F.when(F.col("parts") > 1, F.concat_ws("/", "first", *grid)).otherwise(F.col("first").cast("string"))))
    placed = placed.join(common.hinted(spots.select(*cell, *grid, "t", "parts")), [*cell, *grid])
    placed = placed.withColumn("t", F.when(F.col("parts") > 1, F.concat_ws("#", "t", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("string"))).otherwise(F.col("t")))

    tiles = spots.withColumn("t", F.explode(F.when(F.col("parts") > 1, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.concat_ws("#", "t", k.cast("string")))).otherwise(F.array("t"))))
    tiles = common.cut(tiles.groupBy(*cell, "t").agg(*[f(g).alias(f"{name}_{g}") for g in grid for name, f in (("lo", F.min), ("hi", F.max))]))
    # a cell meets itself and the four neighbours after it; the other four meet it from their side
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    pairs = tiles.withColumn("s", F.explode(steps)).withColumns({"x2": F.col("x") + F.col("s.dx"), "y2": F.col("y") + F.col("s.dy")}).drop("s")
    other = tiles.select("label", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"), *[F.col(f"{n}_{g}").alias(f"{n}2_{g}") for g in grid for n in ("lo", "hi")])
    near = (F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2")) | (F.col("t") <= F.col("t2"))
    for g in grid:
        near &= (F.col(f"lo_{g}") <= F.col(f"hi2_{g}") + 1) & (F.col(f"lo2_{g}") <= F.col(f"hi_{g}") + 1)
    base = ["label", "x", "y", "x2", "y2", "t", "t2"]
    pairs = common.cut(pairs.join(other, ["label", "x2", "y2"]).filter(near).select(*base))
    left = placed.select(*cell, "t", "class_id", "n", "v").join(pairs, [*cell, "t"]).select(*base, F.lit(0).alias("side"), "class_id", "n", "v")
    right = placed.select("label", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"), "class_id", "n", "v").join(pairs, ["label", "x2", "y2", "t2"])
    right = right.filter("x <> x2 or y <> y2 or t <> t2").select(*base, F.lit(1).alias("side"), "class_id", "n", "v")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "class_id"], kind="stable")
        side = frame["side"].to_numpy()
        v, ids, n = np.stack(frame["v"].to_numpy()), frame["class_id"].to_numpy(), frame["n"].to_numpy()
        z = _unit(v)
        z = z @ axes.value[v.shape[1]] if v.shape[1] in axes.value else z
        same = key[1:3] == key[3:5] and key[5] == key[6]
        k = int((side == 0).sum())
        a, b = (slice(0, k), slice(0, k)) if same else (slice(0, k), slice(k, len(v)))
        i, j = close_pairs(v[a], v[b], z[a], z[b], threshold, same)
        j = j if same else j + k
        links = np.bincount(i, n[j], len(v)) + np.bincount(j, n[i], len(v))
        x, y = _forest(ids, i, j)
        some = np.flatnonzero(links)
        return pd.DataFrame({"class_id": np.concatenate([ids[some], np.array(x, np.int64)]), "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(x), np.int64)]), "other": pd.array([None] * len(some) + y, "Int64")})

    return left.unionByName(right).groupBy(*base).applyInPandas(compare, "class_id long, links long, other long")
