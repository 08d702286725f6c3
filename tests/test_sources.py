import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tectra.operators import clean
from tectra.schemas import NATIONAL, CatalogError
from tectra.sources import http
from tectra.streaming import live
from tests.conftest import DATA

HERE = "tests.test_sources:"


def record(i, day, mag="4.0", place="here"):
    return {"eventID": str(i), "date": f"{day}T00:00:00", "latitude": "38.0", "longitude": "30.0", "depth": "7.0", "magnitude": mag, "type": "ML", "location": place}


def afad(url):
    year = int(url.split("start=")[1][:4])
    if year == 1999:
        raise OSError("no answer")
    if year == 1998:
        return b'{"error": 1}'
    return json.dumps([] if year == 2003 else [record(year, f"{year}-05-05"), record("same", f"{year}-06-06", place=str(year))]).encode()


def fdsn(url):
    return b"id,time,latitude,longitude,depth,mag,magType,place,extra\nu1,2001-01-01T00:00:00,38,30,5,4.5,mb,there,1\n"


def heights(url, body):
    return json.dumps({"results": [{"elevation": p["latitude"] * 10} for p in json.loads(body)["locations"]]}).encode()


def test_addresses():
    url = http.afad_url(NATIONAL, "2023-02-06 00:00:00", "2023-02-07", 3)
    assert "start=2023-02-06%2000:00:00" in url and "minlat=35.5" in url
    assert "starttime=2001-01-01" in http.fdsn_url(NATIONAL, "2001-01-01", "2002-01-01", 3)


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return 7

    assert http.with_retry(call, 4, 5, waits.append) == 7 and waits == [5, 10, 20]
    with pytest.raises(OSError):
        http.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, 0, waits.append)


def test_backfill(spark):
    o = {"transport": HERE + "afad", "tries": 1}
    got = http.backfill(spark, "afad", 2000, 2002, **o)
    assert {(r.id, r.place) for r in got.collect()} == {("2000", "here"), ("2001", "here"), ("2002", "here"), ("same", "2000")}
    for first, last in ((1998, 1998), (2002, 2003)):
        with pytest.raises(Exception):
            http.backfill(spark, "afad", first, last, **o)
    assert http.backfill(spark, "afad", 1999, 2000, on_gap="allow", **o).count() == 2
    with pytest.raises(CatalogError):
        http.backfill(spark, "afad", 1999, 1999, on_gap="allow", **o)
    assert clean.clean_catalog(http.backfill(spark, "fdsn", 2001, 2001, transport=HERE + "fdsn")).count() == 1


def test_window(spark):
    day = lambda d: datetime(2010, 1, d, tzinfo=timezone.utc)
    got = http.window_events(spark, day(1), day(3), transport=HERE + "afad", tries=1)
    assert got.count() == 2
    assert [w[0] for w in http.hour_windows(day(1), day(3), 24)] == ["2010-01-01T00:00:00", "2010-01-02T00:00:00"]
    with pytest.raises(CatalogError):
        http.hour_windows(day(2), day(2))


def test_parsers():
    assert http.parse_csv(None) == [] and http.parse_csv(b" \n") == []
    with pytest.raises(CatalogError):
        http.parse_json(b'{"a": 1}')
    with pytest.raises(CatalogError):
        http.parse_csv(b"id\n" + b"1\n" * http.FDSN_LIMIT)


def test_elevations(spark):
    points = spark.createDataFrame([("38.0000,30.0000",), ("39.0000,30.0000",), ("38.0000,30.0000",)], "key string")
    known = spark.createDataFrame([("39.0000,30.0000", 1.0)], "key string, elevation double")
    got = {r.key: r.elevation for r in http.elevations(points, known, transport=HERE + "heights").collect()}
    assert got == {"38.0000,30.0000": 380.0, "39.0000,30.0000": 1.0}


ROWS = "id string, time string, latitude double, longitude double, depth double, mag double, magType string, place string, ord long"


def test_live(spark):
    rows = [("1", "2026-06-27 04:30:00", 38.0, 30.0, 5.0, 3.0, "ML", "old", 1), ("1", "2026-06-27 04:30:00", 38.0, 30.0, 5.0, 3.2, "ML", "new", 2), ("2", "2026-06-27 04:56:00", 38.0, 30.0, 5.0, 3.1, "ML", "p", 3), ("3", "2026-06-26 04:56:00", 38.0, 30.0, 5.0, 3.1, "ML", "late", 4)]
    checked = F.lit(int(datetime(2026, 6, 27, 5, 1, tzinfo=timezone.utc).timestamp() * 1e6))
    df = live.live_events(spark.createDataFrame(rows, ROWS), checked, order=["ord"])
    assert [(r.id, r.mag) for r in df.collect()] == [("2", 3.1), ("1", 3.2)]
    s = live.live_status(df, checked).first()
    assert (s.status, s.lag_minutes) == ("fresh", 5.0)
    assert live.live_status(df, checked + 62 * 60_000_000 + 6_000_000).first().status == "stale"
    assert live.live_status(df.limit(0), checked).first().status == "empty"
    broken = spark.createDataFrame([("1", "2026-06-27 04:30:00", "x")], "id string, time string, mag string")
    with pytest.raises(Exception):
        live.live_events(broken, checked).collect()


def test_stream_merges_revisions(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, mag in enumerate((3.0, 3.5)):
        spark.createDataFrame([("1", "2026-06-27T04:30:00", 38.0, 30.0, 5.0, mag, "ML", "p", k)], ROWS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ROWS).parquet(src)
        live.upsert_stream(stream, spark, out, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.id, r.mag) for r in live.read_archive(spark, out).collect()] == [("1", 3.5)]


def test_stream_windows_equal_batch(spark, tmp_path):
    from tectra.sources.testdata import catalog

    df = catalog(spark, f"{DATA}/sf0.001").select("time", "mag")
    df.write.parquet(str(tmp_path / "in"))
    q = live.closed_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.window_start: r.n_events for r in spark.table("closed").collect()}
    want = {r.w.start: r.n for r in df.groupBy(F.window("time", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(got) >= len(want) - 1 and all(want[k] == v for k, v in got.items())
