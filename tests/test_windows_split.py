"""Windows of more rows than one answer may hold, and recordings that are read by stretches of time."""

from datetime import datetime, timedelta, timezone
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from tectra.schemas import CatalogError
from tectra.sources import http, replay

HERE = "tests.test_windows_split:"
DAY = ("2024-01-01T00:00:00", "2024-01-02T00:00:00")
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: 50 000 events, most of them within two seconds.
TIMES = [timedelta(microseconds=k * 50) for k in range(40_000)] + [timedelta(hours=1, seconds=k) for k in range(10_000)]


def crowd(url):
    q = parse_qs(urlsplit(url).query)
    a, b = (datetime.fromisoformat(q[c][0]).replace(tzinfo=timezone.utc) - T0 for c in ("starttime", "endtime"))
    rows = [f"{k},{(T0 + t).isoformat()},38,30,5,4.5,mb,there" for k, t in enumerate(TIMES) if a <= t < b]
    return ("id,time,latitude,longitude,depth,mag,magType,place\n" + "\n".join(rows)).encode() if rows else None


def broken_evening(url):
    if parse_qs(urlsplit(url).query)["starttime"][0] >= "2024-01-01T02":
        raise OSError("no answer")
    return crowd(url)


def instant(url):
    return b"id\n" + b"1\n" * http.FDSN_LIMIT


def fetched(spark, name, **o):
    return http.fetch_windows(spark, "fdsn", [DAY], transport=HERE + name, tries=1, **o)


def test_crowded_window_is_whole(spark):
    rows = [(r.ord, int(r.id), r.failed) for r in fetched(spark, "crowd").orderBy("ord").collect()]
    assert rows == [(k, k, False) for k in range(len(TIMES))]


def test_failed_window_leaves_no_rows(spark):
    """The first halves of the window were answered before a later one failed."""
    assert [(r.id, r.failed) for r in fetched(spark, "broken_evening", on_gap="allow").collect()] == [(None, True)]
    with pytest.raises(Exception, match="no answer"):
        fetched(spark, "broken_evening").collect()


def test_crowded_instant_is_an_error():
    o = {"service": "fdsn", "transport": HERE + "instant", "min_mag": "2.5", "region": '{"name": "n", "min_lat": 1, "max_lat": 2, "min_lon": 1, "max_lon": 2}'}
    with pytest.raises(CatalogError):
        list(http.answers(o, *DAY))


def test_recording_is_read_by_stretches(spark, monkeypatch):
    """An answer opens the row groups of its own time alone, and one that would hold too many rows is refused early."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(replay, "GROUP_BYTES", 1 << 12)
    monkeypatch.setattr(http, "FDSN_LIMIT", 4000)
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.lit(T0.timestamp()).cast("long") + F.col("id")).alias("time"), *[F.lit(4.0).alias(c) for c in ("latitude", "longitude", "depth", "mag")], F.sha2(F.col("id").cast("string"), 256).alias("magType"), F.lit("p").alias("place"))
    path, read = replay.record(rows), []
    whole = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, k, **o: read.append((t := whole(self, k, **o)).num_rows) or t)
    found = replay._recorded(path)
    got = found("2024-01-01T05:00:00", "2024-01-01T05:10:00", 2.5)
    assert [r["id"] for r in got] == [str(k) for k in range(18_000, 18_600)] and sum(read) < 10_000
    read.clear()
    with pytest.raises(http.TooMany):
        found("2024-01-01T00:00:00", "2024-01-02T00:00:00", 2.5)
    assert sum(read) < 10_000
