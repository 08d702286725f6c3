"""Event services over HTTP as Spark data sources, a partition a window of time.

A transport is a function url -> bytes, or None for no content; it is named as "module:function" so that tasks can load
it, and tests put their own in its place.
"""

from __future__ import annotations

import csv
import importlib
import io
import json
import pickle
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from itertools import chain
from urllib.parse import quote, urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tectra.functions import tables
from tectra.operators import clean
from tectra.schemas import NATIONAL, CatalogError, Region

# The services' addresses and the most rows one answer of the first holds.
FDSN_URL = "https://earthquake.usgs.gov/fdsnws/event/1/query"
AFAD_URL = "https://deprem.afad.gov.tr/apiv2/event/filter"
FDSN_LIMIT = 20_000
RECORD = "id string, time string, latitude string, longitude string, depth string, mag string, magType string, place string, ord long, window int, failed boolean"


def get(url: str, timeout: float = 90) -> bytes | None:
    """No content is None; a service that refuses a window for its number of rows is TooMany."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as r:  # noqa: S310
            return None if r.status == 204 else r.read()
    except HTTPError as e:
        if e.code == 413 or e.code == 400 and b"exceeds search limit" in e.read():
            raise TooMany(f"a window holds too many rows: {url}") from e
        raise


def load(name: str) -> Callable:
    """The transport "module:function", or what "module:function:argument" makes of its argument."""
    module, _, rest = name.partition(":")
    function, _, argument = rest.partition(":")
    found = getattr(importlib.import_module(module), function)
    return found(argument) if argument else found


def fdsn_url(region: Region, start: str, end: str, min_mag: float) -> str:
    return FDSN_URL + "?" + urlencode({"format": "csv", "starttime": start, "endtime": end, "minlatitude": region.min_lat, "maxlatitude": region.max_lat, "minlongitude": region.min_lon, "maxlongitude": region.max_lon, "minmagnitude": min_mag, "orderby": "time-asc"})


def afad_url(region: Region, start: str, end: str, min_mag: float) -> str:
    """Blanks become %20; colons and dashes stay."""
    args = {"start": start, "end": end, "minlat": region.min_lat, "maxlat": region.max_lat, "minlon": region.min_lon, "maxlon": region.max_lon, "minmag": min_mag, "orderby": "time"}
    return AFAD_URL + "?" + "&".join(f"{k}={quote(str(v), safe=':-')}" for k, v in args.items())


def with_retry(call: Callable, tries: int = 4, backoff: float = 5.0, sleep: Callable = time.sleep):
    """The call's result; after failures it waits backoff * 2^k. The last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(backoff * 2**k)


class TooMany(CatalogError):
    """A window of more rows than a service answers at once; shorter ones have to be asked for."""


def parse_csv(body: bytes | None) -> list[dict]:
    if not body or not body.strip():
        return []
    rows = list(csv.DictReader(io.StringIO(body.decode())))
    if len(rows) >= FDSN_LIMIT:
        raise TooMany(f"a window holds {FDSN_LIMIT} rows or more; take shorter windows")
    return rows


def parse_json(body: bytes | None) -> list[dict]:
    """Records under the catalog's names. An answer that is no list is an error."""
    records = json.loads(body or b"[]")
    if not isinstance(records, list):
        raise CatalogError("the answer is no list")
    names = {"eventID": "id", "date": "time", "latitude": "latitude", "longitude": "longitude", "depth": "depth", "magnitude": "mag", "type": "magType", "location": "place"}
    return [{new: r.get(old) for old, new in names.items()} for r in records]


def year_windows(first: int, last: int) -> list[tuple[str, str]]:
    return [(f"{y}-01-01T00:00:00", f"{y + 1}-01-01T00:00:00") for y in range(first, last + 1)]


def hour_windows(start: datetime, end: datetime, hours: float = 24) -> list[tuple[str, str]]:
    if end <= start:
        raise CatalogError("the window ends before it starts")
    out, step = [], timedelta(hours=hours)
    while start < end:
        out.append((start.strftime("%Y-%m-%dT%H:%M:%S"), min(start + step, end).strftime("%Y-%m-%dT%H:%M:%S")))
        start += step
    return out


def answers(o: dict, start: str, end: str) -> Iterator[list[dict]]:
    """A window's rows, in order of time, an answer at a time. A window of too many rows for one answer is asked for in halves, at whole
    seconds as long as there are any, so that a task holds one answer whatever the window holds. Only an instant can't be halved: an error."""
    service = (fdsn_url, parse_csv) if o["service"] == "fdsn" else (afad_url, parse_json)
    region, fetch = Region(**json.loads(o["region"])), load(o["transport"])
    left = [(start, end)]
    while left:
        a, b = left.pop()

        def ask():
            url, parse = service
            try:
                return parse(fetch(url(region, a, b, float(o["min_mag"]))))  # noqa: B023
            except TooMany as e:  # asking again wouldn't help
                return e

        found = with_retry(ask, int(o.get("tries", 4)), float(o.get("backoff", 5)))
        if not isinstance(found, TooMany):
            yield found
            continue
        first, last = datetime.fromisoformat(a), datetime.fromisoformat(b)
        middle = first + (last - first) / 2
        whole = middle.replace(microsecond=0)
        cut = whole if first < whole else middle
        if not first < cut < last:
            raise found
        left += [(cut.isoformat(), b), (a, cut.isoformat())]


@dataclass
class Window(InputPartition):
    number: int
    start: str
    end: str


def _whole(found: Iterator[list[dict]]) -> Iterator[list[dict]]:
    """All answers or an error, before the first is given; they wait in a file of the task's."""
    held = tempfile.TemporaryFile()
    n = 0
    for rows in found:
        pickle.dump(rows, held)
        n += 1
    held.seek(0)
    return (pickle.load(held) for _ in range(n))  # noqa: S301


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[Window]:
        return [Window(k, *w) for k, w in enumerate(json.loads(self.o["windows"]))]

    def read(self, window: Window) -> Iterator[tuple]:
        found = answers(self.o, window.start, window.end)
        if self.o["fail"] != "true":
            try:
                found = _whole(found)
            except Exception:
                yield (None,) * 8 + (0, window.number, True)
                return
        for k, r in enumerate(chain.from_iterable(found)):
            text = lambda c: None if r.get(c) in (None, "") else str(r[c])  # noqa: E731, B023
            yield tuple(text(c) for c in ("id", "time", "latitude", "longitude", "depth", "mag", "magType", "place")) + (k, window.number, False)


class EventService(DataSource):
    """format("event_service") with options service (fdsn or afad), windows, region, min_mag, transport, tries, backoff, fail."""

    @classmethod
    def name(cls) -> str:
        return "event_service"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


#: The catalog's columns as the services hold them, typed, so that plain filters can be handed on.
EVENTS = "id string, time timestamp, latitude double, longitude double, depth double, mag double, magType string, place string"
_BOX = {"latitude": ("min_lat", "max_lat"), "longitude": ("min_lon", "max_lon")}


@dataclass
class _Asked:
    """What is asked of a service: windows, box and least magnitude; each filter that is handed on makes it narrower."""

    windows: list[tuple[int, datetime, datetime]]
    box: dict
    min_mag: float

    def narrow(self, f: Filter) -> None:
        """Bounds are kept closed and times rounded outwards to seconds, so that no event is lost; Spark filters what comes again."""
        column, value = f.attribute[0], f.value
        low = isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo))
        high = isinstance(f, (LessThan, LessThanOrEqual, EqualTo))
        if column == "mag" and low:
            self.min_mag = max(self.min_mag, float(value))
        elif column in _BOX:
            a, b = _BOX[column]
            if low:
                self.box[a] = max(self.box[a], float(value))
            if high:
                self.box[b] = min(self.box[b], float(value))
        elif column == "time":
            at = value.astimezone(timezone.utc)
            first, last = at.replace(microsecond=0), at.replace(microsecond=0) + timedelta(seconds=1)
            self.windows = [(k, max(a, first) if low else a, min(b, last) if high else b) for k, a, b in self.windows if (not low or b >= first) and (not high or a <= last)]

    @property
    def empty(self) -> bool:
        return self.box["min_lat"] > self.box["max_lat"] or self.box["min_lon"] > self.box["max_lon"]


class _TypedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        utc = lambda t: datetime.fromisoformat(t).replace(tzinfo=timezone.utc)
        self.asked = _Asked([(k, utc(a), utc(b)) for k, (a, b) in enumerate(json.loads(options["windows"]))], json.loads(options["region"]), float(options["min_mag"]))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) and len(f.attribute) == 1 and f.value is not None:
                self.asked.narrow(f)
            yield f  # Spark holds rows against all of them again

    def partitions(self) -> list[Window]:
        text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S")
        windows = [] if self.asked.empty else [Window(k, text(a), text(b)) for k, a, b in self.asked.windows if a < b]
        return windows or [Window(-1, "", "")]

    def read(self, window: Window) -> Iterator[tuple]:
        if window.number < 0:  # filters left nothing to ask for
            return
        options = self.o | {"region": json.dumps(self.asked.box), "min_mag": str(self.asked.min_mag), "fail": "true"}
        number = lambda x: None if x is None else float(x)
        for key, when, *numbers, kind, place, _, _, _ in _Reader(options).read(window):
            at = None if when is None else datetime.fromisoformat(when.replace("Z", "+00:00"))
            at = at if at is None or at.tzinfo else at.replace(tzinfo=timezone.utc)
            yield key, at, *map(number, numbers), kind, place


class TypedEvents(DataSource):
    """format("typed_events"): like event_service, but typed, all or nothing, and with filters on time, place and magnitude handed to the
    service: windows that they exclude are not asked for at all."""

    @classmethod
    def name(cls) -> str:
        return "typed_events"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _TypedReader(dict(self.options))


def service_events(spark: SparkSession, service: str, windows: list[tuple[str, str]], *, region: Region = NATIONAL, min_mag: float = 2.5, transport: str = "tectra.sources.http:get", tries: int = 4, backoff: float = 5.0) -> DataFrame:
    """A service as a table of typed events, of which a `filter` reads only what it needs. Windows that overlap give an event twice. Turns on
    the session's handing of filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TypedEvents)
    o = {"service": service, "windows": json.dumps(windows), "region": json.dumps(region.__dict__), "min_mag": str(min_mag), "transport": transport, "tries": str(tries), "backoff": str(backoff)}
    return spark.read.format("typed_events").options(**o).load()


def fetch_windows(spark: SparkSession, service: str, windows: list[tuple[str, str]], *, region: Region = NATIONAL, min_mag: float = 2.5, transport: str = "tectra.sources.http:get", tries: int = 4, backoff: float = 5.0, on_gap: str = "fail") -> DataFrame:
    """Records of all windows with ord, window and failed. on_gap: "fail" stops at a window that can't be read, "allow" leaves a row of nulls for it."""
    spark.dataSource.register(EventService)
    o = {"service": service, "windows": json.dumps(windows), "region": json.dumps(region.__dict__), "min_mag": str(min_mag), "transport": transport, "tries": str(tries), "backoff": str(backoff), "fail": str(on_gap == "fail").lower()}
    return spark.read.format("event_service").options(**o).load()


@dataclass(frozen=True)
class FetchResult:
    """Events, one row an id, and how many windows were asked for, couldn't be read, or held too few events."""

    events: DataFrame
    n_windows: int
    n_failed: int
    thin: tuple[int, ...]


def backfill(spark: SparkSession, service: str, first: int, last: int, *, least_per_year: int = 1, on_gap: str = "fail", **options) -> DataFrame:
    """The events of `backfill_result`."""
    return backfill_result(spark, service, first, last, least_per_year=least_per_year, on_gap=on_gap, **options).events


def backfill_result(spark: SparkSession, service: str, first: int, last: int, *, least_per_year: int = 1, on_gap: str = "fail", **options) -> FetchResult:
    """Years of events, one row an id, the first kept. Years that are missing or too thin are an error unless on_gap is "allow"; with no
    readable year at all it is one anyway."""
    got = fetch_windows(spark, service, year_windows(first, last), on_gap=on_gap, **options).cache()
    per = {r.window: (r.n, r.bad) for r in got.groupBy("window").agg(F.count_if(~F.col("failed")).alias("n"), F.max("failed").alias("bad")).collect()}
    thin = [first + k for k in range(last - first + 1) if per.get(k, (0, False))[0] < least_per_year]
    if thin and on_gap != "allow" or len(thin) == last - first + 1:
        raise CatalogError(f"too few events in {thin}")
    events = clean.one_per_id(got.filter("not failed").drop("failed"), ["window", "ord"]).drop("window", "ord")
    return FetchResult(events, last - first + 1, sum(bool(bad) for _, bad in per.values()), tuple(thin))


def window_events(spark: SparkSession, start: datetime, end: datetime, *, chunk_hours: float = 24, service: str = "afad", **options) -> DataFrame:
    """Events of any stretch of time, all or nothing, the last record of an id kept."""
    got = fetch_windows(spark, service, hour_windows(start, end, chunk_hours), on_gap="fail", **options)
    return clean.one_per_id(got.drop("failed"), ["window", "ord"], last=True).drop("window", "ord")


class _LiveReader(SimpleDataSourceStreamReader):
    """Each poll reads the lookback again; merging by id makes the overlap harmless. An offset holds the window it stands for, so that a batch
    that is done again asks for the same one."""

    def __init__(self, options: dict):
        self.o = options

    def initialOffset(self) -> dict:
        return {"poll": 0, "from": None, "to": None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = datetime.now(timezone.utc)
        text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S")
        end = {"poll": start["poll"] + 1, "from": text(now - timedelta(minutes=float(self.o["lookback"]))), "to": text(now)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        o = self.o
        if end["to"] is None:
            return iter(())
        rows = chain.from_iterable(answers(o | {"service": "afad"}, end["from"], end["to"]))
        return iter([tuple(None if r[c] is None else str(r[c]) for c in ("id", "time", "latitude", "longitude", "depth", "mag", "magType", "place")) + (k, end["poll"], False) for k, r in enumerate(rows)])


class LiveService(DataSource):
    """format("live_service"): options region, min_mag, lookback (minutes), transport."""

    @classmethod
    def name(cls) -> str:
        return "live_service"

    def schema(self) -> str:
        return RECORD

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _LiveReader(dict(self.options))


ELEVATION_URL = "https://api.open-elevation.com/api/v1/lookup"


def post(url: str, body: bytes, timeout: float = 90) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:  # noqa: S310
        return r.read()


def elevations(points: DataFrame, known: DataFrame, *, transport: str = "tectra.sources.http:post", batch: int = 500, tries: int = 5, backoff: float = 5.0) -> DataFrame:
    """points: key ("lat,lon" of four digits); known: key, elevation. key and elevation of all points: known ones, and others from the service in
    batches. Repeated points are asked for once."""
    new = points.select("key").distinct().join(known, "key", "left_anti")

    def run(frames):
        import pandas as pd

        call = load(transport)

        def ask(keys):
            body = json.dumps({"locations": [dict(zip(("latitude", "longitude"), map(float, k.split(",")))) for k in keys]}).encode()
            found = json.loads(with_retry(lambda: call(ELEVATION_URL, body), tries, backoff))["results"]
            if len(found) != len(keys):
                raise CatalogError("the service left points out")
            return [float(r["elevation"]) for r in found]

        for f in frames:
            keys = f["key"].tolist()
            for k in range(0, len(keys), batch):
                yield pd.DataFrame({"key": keys[k : k + batch], "elevation": ask(keys[k : k + batch])})

    asked = new.mapInPandas(run, "key string, elevation double")
    return points.select("key").distinct().join(known, "key").select("key", "elevation").unionByName(asked)


def fetch_elevations(points: DataFrame, cache: str, *, round_points: int = 50_000, **options) -> DataFrame:
    """As `elevations`, with a cache in a folder of Parquet: points are asked for in rounds, and each round's answers are in the cache before
    the next one starts, so that a run that stops goes on where it was."""
    spark = points.sparkSession
    fs, at = tables.file_system(spark, cache)
    known = lambda: spark.read.schema("key string, elevation double").parquet(cache) if fs.exists(at) else spark.createDataFrame([], "key string, elevation double")
    wanted = points.select("key").distinct()
    n = wanted.join(known(), "key", "left_anti").count()
    rounds = -(-n // round_points)
    for k in range(rounds):
        some = wanted.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
        new = elevations(some, known(), **options).join(known().select("key"), "key", "left_anti")
        new.write.mode("append").parquet(cache)
    return wanted.join(known(), "key").select("key", "elevation")
