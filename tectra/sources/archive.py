"""An event archive in hash buckets, kept up by delta layers.

    path/_log/000000000007.json            the state after the seventh change: layers of each bucket, counts, manifest
    path/layers/layer=<rank>-<name>/bucket=<n>/part-*.parquet

A change writes its own rows as a layer, in the buckets of their ids, and then one small state file that names the layers; buckets
without such ids keep their files. A reader takes the newest state: it reads buckets of one layer as they are and merges only those
of several, of equal ids the record of the highest layer. A bucket with more than MAX_LAYERS layers is merged into one, alone.
Files of a writer that stopped before its state file are named nowhere. One writer at a time; a second one's state is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tectra.functions import tables
from tectra.operators import clean
from tectra.schemas import CATALOG, CATALOG_COLUMNS, CatalogError

#: Buckets of a new archive, and layers of a bucket before it is merged into one.
BUCKETS, MAX_LAYERS = 64, 8
_MIDDLE = 10**9
_STORED = f"{CATALOG}, layer string, bucket int"


@dataclass
class State:
    version: int = 0
    buckets: int = BUCKETS
    layers: dict[str, list[str]] = field(default_factory=dict)  # by bucket, lowest first
    counts: dict[str, int] = field(default_factory=dict)  # events by bucket
    batches: dict[str, int] = field(default_factory=dict)  # last batch of each stream
    manifest: dict = field(default_factory=dict)

    @property
    def n_events(self) -> int:
        return sum(self.counts.values())


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, root = tables.file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []


def current(spark: SparkSession, path: str) -> State | None:
    """The newest state; None where there is no archive."""
    states = [x for x in _names(spark, f"{path}/_log") if x.endswith(".json")]
    return State(**json.loads(tables.read_text(spark, f"{path}/_log/{states[-1]}"))) if states else None


def _commit(spark: SparkSession, path: str, state: State) -> State:
    state.version += 1
    at = f"{path}/_log/{state.version:012d}.json"
    fs, p = tables.file_system(spark, at)
    if fs.exists(p):
        raise CatalogError(f"another writer has made version {state.version} of {path}")
    tables.write_text(spark, at, json.dumps(asdict(state)))
    return state


def _bucket(buckets: int) -> Column:
    """Rows without an id spread by what they hold."""
    own = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CATALOG_COLUMNS])
    return F.pmod(F.xxhash64(F.coalesce("id", own)), F.lit(buckets)).cast("int")


def _write_layer(events: DataFrame, path: str, buckets: int, rank: int) -> tuple[str, list[str]]:
    """The layer's name and the buckets that it has rows in."""
    spark, name = events.sparkSession, f"{rank + _MIDDLE:010d}-{uuid.uuid4().hex}"
    rows = events.select(CATALOG_COLUMNS).withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "time")
    rows.write.partitionBy("bucket").parquet(f"{path}/layers/layer={name}")
    return name, [x.removeprefix("bucket=") for x in _names(spark, f"{path}/layers/layer={name}") if x.startswith("bucket=")]


def _stored(spark: SparkSession, path: str, state: State, buckets: Iterable[str]) -> DataFrame:
    paths = [f"{path}/layers/layer={layer}/bucket={b}" for b in buckets for layer in state.layers[b]]
    if not paths:
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).option("basePath", f"{path}/layers").parquet(*paths)


def _split(state: State, buckets: Iterable[str] | None) -> tuple[list[str], list[str]]:
    """Buckets of one layer and of several."""
    chosen = [b for b in (state.layers if buckets is None else buckets) if b in state.layers]
    return [b for b in chosen if len(state.layers[b]) == 1], [b for b in chosen if len(state.layers[b]) > 1]


def _merged(spark: SparkSession, path: str, state: State, buckets: Iterable[str]) -> DataFrame:
    return clean.one_per_id(_stored(spark, path, state, buckets), ["layer"], last=True)


def read(spark: SparkSession, path: str, state: State | None = None, buckets: Iterable[str] | None = None) -> DataFrame:
    """The archive's events, or those of some buckets. Only buckets of several layers are shuffled."""
    state = state or current(spark, path) or State()
    one, many = _split(state, buckets)
    found = _stored(spark, path, state, one)
    return (found.unionByName(_merged(spark, path, state, many)) if many else found).select(CATALOG_COLUMNS)


def lookup(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """Events of some ids, from their buckets alone."""
    state = current(spark, path) or State()
    blank = [F.lit(None).cast("string").alias(c) for c in CATALOG_COLUMNS[1:]]
    near = {str(r[0]) for r in spark.createDataFrame([(x,) for x in ids], "id string").select("id", *blank).select(_bucket(state.buckets)).distinct().collect()} if ids else set()
    return read(spark, path, state, near).filter(F.col("id").isin(ids))


def _count(spark: SparkSession, path: str, state: State, buckets: list[str]) -> dict[str, int]:
    """Events by bucket, from the ids alone."""
    one, many = _split(state, buckets)
    rows = _stored(spark, path, state, one).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    both = _stored(spark, path, state, many).groupBy("bucket").agg((F.count_distinct("id") + F.count_if(F.col("id").isNull())).alias("n"))
    return {str(r.bucket): r.n for r in rows.unionByName(both).collect()}  # a row a bucket


def upsert(
    spark: SparkSession, path: str, new: DataFrame, *, under: DataFrame | None = None, buckets: int = BUCKETS, max_layers: int = MAX_LAYERS,
    manifest: Callable[[int], dict] | None = None, stream: str | None = None, batch: int | None = None,
) -> State:
    """Merges new events, of equal ids the later by `ord`, over what is there, and `under` beneath it. Only buckets of their ids are
    written, counted or merged. A stream's batch that has been merged before changes nothing. `manifest` makes the manifest from the
    number of events."""
    state = current(spark, path) or State(buckets=buckets)
    if stream is not None and batch <= state.batches.get(stream, -1):
        return state
    ranks = [int(x.split("-")[0]) - _MIDDLE for layers in state.layers.values() for x in layers]
    touched: set[str] = set()
    none = spark.createDataFrame([], CATALOG)
    for rows, rank in ((under, min(ranks, default=0) - 1), (new, max(ranks, default=0) + 1)):
        if rows is not None:
            name, into = _write_layer(clean.merge_events(none, rows), path, state.buckets, rank)
            for b in into:
                state.layers[b] = sorted([*state.layers.get(b, []), name])
            touched.update(into)
    state.counts |= _count(spark, path, state, sorted(touched))
    if stream is not None:
        state.batches[stream] = batch
    if manifest:
        state.manifest = manifest(state.n_events) | {"version": f"{state.version + 1:012d}"}
    _commit(spark, path, state)
    return compact(spark, path, max_layers) if any(len(state.layers[b]) > max_layers for b in touched) else state


def compact(spark: SparkSession, path: str, max_layers: int = 1) -> State:
    """Merges each bucket of more than `max_layers` layers into one; others keep their files."""
    state = current(spark, path) or State()
    many = [b for b, layers in state.layers.items() if len(layers) > max_layers]
    if not many:
        return state
    rank = max(int(state.layers[b][-1].split("-")[0]) for b in many) - _MIDDLE
    name, into = _write_layer(_merged(spark, path, state, many), path, state.buckets, rank)
    if sorted(into) != sorted(many):
        raise CatalogError(f"buckets of {path} changed in number while they were merged")
    state.layers |= {b: [name] for b in many}
    return _commit(spark, path, state)


def replace(spark: SparkSession, path: str, events: DataFrame, manifest: dict, buckets: int = BUCKETS) -> State:
    """A new version that holds `events` as they are and nothing else."""
    state = current(spark, path) or State(buckets=buckets)
    name, into = _write_layer(events, path, state.buckets, 0)
    state.layers = {b: [name] for b in into}
    state.counts = _count(spark, path, state, into)
    state.manifest = manifest | {"version": f"{state.version + 1:012d}"}
    return _commit(spark, path, state)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes what the last `keep` states don't name; returns the number of bucket folders removed. For the writer, between changes."""
    logs = [x for x in _names(spark, f"{path}/_log") if x.endswith(".json")]
    states = [State(**json.loads(tables.read_text(spark, f"{path}/_log/{x}"))) for x in logs[-keep:]]
    named = {(layer, b) for s in states for b, layers in s.layers.items() for layer in layers}
    gone = [f"{path}/_log/{x}" for x in logs[:-keep]]
    folders = 0
    for layer in (x.removeprefix("layer=") for x in _names(spark, f"{path}/layers")):
        held = [x.removeprefix("bucket=") for x in _names(spark, f"{path}/layers/layer={layer}") if x.startswith("bucket=")]
        dead = [b for b in held if (layer, b) not in named]
        folders += len(dead)
        gone += [f"{path}/layers/layer={layer}"] if len(dead) == len(held) else [f"{path}/layers/layer={layer}/bucket={b}" for b in dead]
    for x in gone:
        fs, p = tables.file_system(spark, x)
        fs.delete(p, True)
    return folders
