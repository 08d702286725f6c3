"""The bucketed archive: what a change writes, what readers see, and what stopped writers leave."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tectra.schemas import CATALOG, CATALOG_COLUMNS, CatalogError
from tectra.sources import archive

SCHEMA = f"{CATALOG}, ord long"


def row(key, mag, order=0, day=1):
    from datetime import datetime

    return (key, datetime(2026, 1, day), 38.0, 30.0, None, float(mag), "ML", "x", order)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path, state=None):
    return sorted((r.id or "", r.mag) for r in archive.read(spark, path, state).collect())


def data_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/layers") for f in names if f.endswith(".parquet")}


def test_only_the_buckets_of_its_ids(spark, tmp_path):
    path = str(tmp_path)
    archive.upsert(spark, path, frame(spark, [row(str(i), i % 7) for i in range(2000)]))
    before, first = data_files(path), archive.current(spark, path)
    assert len(first.layers) == archive.BUCKETS and first.n_events == 2000
    state = archive.upsert(spark, path, frame(spark, [row("5", 9.0), row("6", 9.5), row("new", 1.0)]))
    after = data_files(path)
    assert {f: t for f, t in after.items() if f in before} == before  # nothing is written again
    fresh = [f for f in after if f not in before]
    touched = [b for b, layers in state.layers.items() if len(layers) == 2]
    assert 1 <= len(touched) <= 3 and {f.split("bucket=")[1].split("/")[0] for f in fresh} == set(touched)
    assert sum(spark.read.parquet(f).count() for f in fresh) == 3
    assert state.n_events == 2001 and archive.read(spark, path).count() == 2001
    assert [(r.id, r.mag) for r in archive.lookup(spark, path, ["5", "new", "none"]).orderBy("id").collect()] == [("5", 9.0), ("new", 1.0)]
    assert archive.lookup(spark, path, []).count() == 0
    # buckets of one layer are read without a shuffle, and a lookup reads its ids' buckets alone
    plan = archive.lookup(spark, path, ["5"])._jdf.queryExecution().toString()
    assert plan.count("bucket=") <= 4 or "InMemoryFileIndex(1 paths)" in plan or "InMemoryFileIndex(2 paths)" in plan
    single = next(b for b in state.layers if b not in touched)
    assert "Exchange" not in archive.read(spark, path, state, [single])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [0, 1])
def test_any_batches_like_a_dict(spark, tmp_path, seed):
    """Upserts, compactions and vacuums in any order hold what a dict would, and rows without ids stay."""
    r, path, want, loose = random.Random(seed), str(tmp_path), {}, []
    for step in range(12):
        batch = [row(r.choice(["a", "b", "c", "d", "e", "f", "g", None]), step * 10 + k, k) for k in range(r.randint(0, 6))]
        archive.upsert(spark, path, frame(spark, batch), buckets=3, max_layers=3)
        for x in batch:
            if x[0] is None:
                loose.append(("", x[5]))
            else:
                want[x[0]] = x[5]
        if step % 5 == 4:
            archive.vacuum(spark, path)
        assert held(spark, path) == sorted([*want.items(), *loose])
        assert archive.current(spark, path).n_events == len(want) + len(loose)
    state = archive.compact(spark, path)
    assert all(len(x) == 1 for x in state.layers.values()) and held(spark, path) == sorted([*want.items(), *loose])


def test_a_seed_lies_under_all(spark, tmp_path):
    path = str(tmp_path)
    archive.upsert(spark, path, frame(spark, [row("1", 1.0)]))
    archive.upsert(spark, path, frame(spark, [row("2", 2.0)]), under=frame(spark, [row("1", 7.0), row("3", 7.0)]))
    archive.upsert(spark, path, frame(spark, []), under=frame(spark, [row("3", 8.0), row("4", 8.0)]))
    assert held(spark, path) == [("1", 1.0), ("2", 2.0), ("3", 7.0), ("4", 8.0)]


def test_batches_again_and_stopped_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    archive.upsert(spark, path, frame(spark, [row("1", 1.0)]), stream="s", batch=0)
    archive.upsert(spark, path, frame(spark, [row("1", 2.0)]), stream="s", batch=1)
    again = archive.upsert(spark, path, frame(spark, [row("1", 1.0)]), stream="s", batch=0)
    assert again.version == 2 and held(spark, path) == [("1", 2.0)]
    archive.upsert(spark, path, frame(spark, [row("1", 3.0)]), stream="another", batch=0)
    assert held(spark, path) == [("1", 3.0)]
    old = archive.current(spark, path)

    def stops(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(archive, "_commit", stops)
        with pytest.raises(OSError):
            archive.upsert(spark, path, frame(spark, [row("1", 4.0), row("9", 4.0)]))
    assert held(spark, path) == [("1", 3.0)]  # files without a state are not there
    archive.upsert(spark, path, frame(spark, [row("2", 5.0)]))
    assert held(spark, path, old) == [("1", 3.0)] and held(spark, path) == [("1", 3.0), ("2", 5.0)]
    assert archive.vacuum(spark, path, keep=1) > 0
    assert held(spark, path) == [("1", 3.0), ("2", 5.0)]
    with pytest.raises(CatalogError):
        archive._commit(spark, path, archive.State(version=archive.current(spark, path).version - 1))


def test_many_rows_of_one_id(spark, tmp_path):
    """A third of all rows are one id: combined before the shuffle, one record stays."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.timestamp_seconds("id").alias("time"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(1.0).alias("depth"), (F.col("id") % 9).cast("double").alias("mag"), F.lit("ML").alias("magType"), F.lit("p").alias("place"), F.col("id").alias("ord"))
    state = archive.upsert(spark, str(tmp_path), rows)
    assert state.n_events == 20_001
    assert [r.mag for r in archive.lookup(spark, str(tmp_path), ["hot"]).select(*CATALOG_COLUMNS).collect()] == [29_997 % 9]
