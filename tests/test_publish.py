"""A feed under one pointer: whole, or as it was."""

import json

import pytest
from pyspark.sql import functions as F

from tectra.functions import tables
from tectra.streaming import live
from tests.test_sources import ROWS

def checked():
    return F.lit(1_782_536_400_000_000)


def rows(spark, *mags):
    return spark.createDataFrame([(str(k), f"2026-06-27T04:5{k}:00", 38.0, 30.0, 5.0, m, "ML", None, k) for k, m in enumerate(mags)], ROWS)


def seen(spark, path):
    features, stamp = live.read_live(spark, path)
    return [json.loads(r[0])["properties"]["mag"] for r in features.collect()], json.loads(stamp.first()[0])["n_events"]


@pytest.mark.parametrize("stops", ["features", "stamp", "pointer"])
def test_a_writer_that_stops(spark, tmp_path, monkeypatch, stops):
    path = str(tmp_path / "live")
    assert live.read_live(spark, path) is None
    feed = lambda *m: live.live_events(rows(spark, *m), checked(), 10**9)
    live.publish_live(feed(3.0), path, checked())
    assert seen(spark, path) == ([3.0], 1)

    def fail(*a, **b):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(*{"features": (live, "live_features", fail), "stamp": (live, "live_status", fail), "pointer": (tables, "write_text", fail)}[stops])
        with pytest.raises(OSError):
            live.publish_live(feed(4.0, 5.0), path, checked())
    assert seen(spark, path) == ([3.0], 1)  # neither mixed nor empty
    live.publish_live(feed(4.0, 5.0), path, checked())
    assert seen(spark, path) == ([5.0, 4.0], 2)
    for k in range(4):
        live.publish_live(feed(float(k)), path, checked())
    assert seen(spark, path) == ([3.0], 1) and len(list((tmp_path / "live" / "feeds").iterdir())) == 3


def test_published_stream(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "live")
    for mag in (2.0, 3.0):
        rows(spark, mag).write.mode("append").parquet(src)
        live.published_stream(spark.readStream.schema(ROWS).parquet(src), path, str(tmp_path / "cp"), lookback_minutes=10**9, checked_at=checked()).awaitTermination(120)
        assert seen(spark, path) == ([mag], 1)
