"""Filters on a service's table become what is asked of the service."""

import json
from datetime import datetime, timezone
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from tectra.schemas import NATIONAL, Region
from tectra.sources import http

WINDOWS = [(f"{y}-01-01T00:00:00", f"{y + 1}-01-01T00:00:00") for y in range(2000, 2006)]


def answer(log):
    """A service that keeps the addresses asked for in a file, and answers with an event a month, whose magnitude is its number."""

    def of(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        out = []
        for y in range(2000, 2006):
            for m in range(1, 13):
                at = f"{y}-{m:02d}-15T12:00:00"
                if q["start"] <= at < q["end"] and float(q["minmag"]) <= m and float(q["minlat"]) <= 36 + m / 10 <= float(q["maxlat"]):
                    out.append({"eventID": f"{y}-{m}", "date": at, "latitude": str(36 + m / 10), "longitude": "30.0", "depth": None, "magnitude": str(m), "type": "ML", "location": "here"})
        return json.dumps(out).encode()

    return of


@pytest.fixture
def asked(spark, tmp_path):
    log = tmp_path / "asked"
    df = http.service_events(spark, "afad", WINDOWS, min_mag=2.0, transport=f"tests.test_pushdown:answer:{log}", tries=1)

    def of(condition):
        log.write_text("")
        rows = {r.id for r in df.filter(condition).collect()}
        urls = [{k: v[0] for k, v in parse_qs(urlsplit(u).query).items()} for u in log.read_text().split()]
        return rows, urls, df.filter(condition)

    return of


def ids(keep):
    return {f"{y}-{m}" for y in range(2000, 2006) for m in range(2, 13) if keep(y, m)}


def test_time_prunes_windows(asked):
    rows, urls, df = asked((F.col("time") >= datetime(2002, 3, 1, tzinfo=timezone.utc)) & (F.col("time") < datetime(2003, 2, 15, 12, tzinfo=timezone.utc)))
    assert rows == ids(lambda y, m: (2002, 3) <= (y, m) < (2003, 2))
    assert sorted((u["start"], u["end"]) for u in urls) == [("2002-03-01T00:00:00", "2003-01-01T00:00:00"), ("2003-01-01T00:00:00", "2003-02-15T12:00:01")]
    plan = df._jdf.queryExecution().toString()
    assert "Pushed" in plan or "typed_events" in plan


def test_magnitude_and_box(asked):
    rows, urls, _ = asked((F.col("mag") > 5) & (F.col("latitude") <= 36.8) & (F.col("longitude") >= 28.5))
    assert rows == ids(lambda y, m: 5 < m <= 8)
    assert len(urls) == len(WINDOWS) and {(u["minmag"], u["minlat"], u["maxlat"], u["minlon"], u["maxlon"]) for u in urls} == {("5.0", "35.5", "36.8", "28.5", "45.0")}
    rows, urls, _ = asked(F.col("mag") == 4.0)
    assert rows == ids(lambda y, m: m == 4) and {u["minmag"] for u in urls} == {"4.0"}


def test_what_cannot_be_handed_on(asked):
    """Other filters, looser ones and disjunctions ask for all; a contradiction asks for nothing."""
    everything = lambda urls: len(urls) == len(WINDOWS) and {u["minmag"] for u in urls} == {"2.0"}
    for condition, keep in ((F.col("mag") >= 1, lambda y, m: True), (F.col("depth").isNull(), lambda y, m: True), ((F.col("mag") > 11) | (F.col("latitude") < 36.25), lambda y, m: m > 11 or m < 3), (F.col("id").endswith("-3"), lambda y, m: m == 3)):
        rows, urls, _ = asked(condition)
        assert rows == ids(keep) and everything(urls)
    rows, urls, _ = asked((F.col("latitude") > 40) & (F.col("latitude") < 39))
    assert rows == set() and urls == []
    rows, urls, _ = asked(F.col("time") > datetime(2030, 1, 1, tzinfo=timezone.utc))
    assert rows == set() and urls == []


def test_a_failed_window_is_an_error(spark):
    df = http.service_events(spark, "afad", WINDOWS[:1], region=Region("none", 0, 1, 0, 1), transport="tests.test_sources:afad", tries=1)
    assert df.count() == 2 and df.schema["time"].dataType.typeName() == "timestamp"
    with pytest.raises(Exception, match="no answer"):
        http.service_events(spark, "afad", [("1999-01-01T00:00:00", "2000-01-01T00:00:00")], region=NATIONAL, transport="tests.test_sources:afad", tries=1).collect()
