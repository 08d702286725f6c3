"""Transports that answer as the event services do, from recorded events in a folder of Parquet: for runs without a network.

A recording lies in order of time in small row groups, so that an answer reads its own stretch and no more. As real services do, these refuse
a window of more rows than one answer may hold.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tectra.functions import exprs, tables
from tectra.schemas import CATALOG_COLUMNS
from tectra.sources import http

#: Bytes of a row group of a recording.
GROUP_BYTES = 1 << 20


def record(events: DataFrame) -> str:
    """Writes a catalog's events for the transports below, by time and then id; returns the folder."""
    path = tables.shared_dir(events.sparkSession)
    text = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = events.filter("time is not null and mag is not null").select(exprs.micros(F.col("time")).alias("us"), *[text.alias(c) if c == "time" else c for c in CATALOG_COLUMNS])
    rows.repartitionByRange("us").sortWithinPartitions("us", "id").write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return path


def _groups(folder: str) -> Callable[[int, int], Iterator]:
    """From the recording's footers, which are read once: the row groups that meet a stretch of time, in order of time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = []
    for x in store.get_file_info(fs.FileSelector(at)):
        if x.base_name.startswith("part-"):
            meta = pq.read_metadata(x.path, filesystem=store)
            for k in range(meta.num_row_groups):
                c = next(c for c in (meta.row_group(k).column(i) for i in range(meta.num_columns)) if c.path_in_schema == "us")
                found.append((c.statistics.min, c.statistics.max, x.path, k))
    found.sort()

    def meeting(low: int, high: int) -> Iterator:
        for first, last, path, k in found:
            if first < high and last >= low:
                with store.open_input_file(path) as f:
                    yield pq.ParquetFile(f).read_row_group(k)

    return meeting


def _recorded(folder: str) -> Callable[[str, str, float], list[dict]]:
    """Recorded events from start to end, the end left out, in order of time and id; TooMany where one answer doesn't hold them."""
    import pyarrow.compute as pc

    meeting = _groups(folder)

    def events(start: str, end: str, least: float) -> list[dict]:
        low, high = (round(datetime.fromisoformat(x).replace(tzinfo=timezone.utc).timestamp() * 1e6) for x in (start, end))
        held, n = [], 0
        for rows in meeting(low, high):
            us = rows.column("us")
            held.append(rows.filter(pc.and_(pc.and_(pc.greater_equal(us, low), pc.less(us, high)), pc.greater_equal(rows.column("mag"), least))))
            n += held[-1].num_rows
            if n >= http.FDSN_LIMIT:
                raise http.TooMany(f"{start} to {end} holds {http.FDSN_LIMIT} rows or more")
        return [r for rows in held for r in rows.drop_columns("us").to_pylist()]

    return events


def _asked(url: str, *names: str) -> list[str]:
    q = parse_qs(urlsplit(url).query)
    return [q[n][0] for n in names]


def fdsn(folder: str) -> Callable[[str], bytes | None]:
    """The service that answers in CSV; no content where there is no event."""
    events = _recorded(folder)

    def answer(url: str) -> bytes | None:
        start, end, least = _asked(url, "starttime", "endtime", "minmagnitude")
        rows = events(start, end, float(least))
        if not rows:
            return None
        out = io.StringIO()
        w = csv.DictWriter(out, list(rows[0]))
        w.writeheader()
        w.writerows(rows)
        return out.getvalue().encode()

    return answer


def afad(folder: str) -> Callable[[str], bytes]:
    """The service that answers in JSON under names of its own, all values as text. "folder?day" answers nothing for windows that start that day."""
    folder, _, broken = folder.partition("?")
    events = _recorded(folder)
    names = {"id": "eventID", "time": "date", "latitude": "latitude", "longitude": "longitude", "depth": "depth", "mag": "magnitude", "magType": "type", "place": "location"}

    def answer(url: str) -> bytes:
        start, end, least = _asked(url, "start", "end", "minmag")
        if broken and start.startswith(broken):
            raise OSError("no answer")
        rows = events(start, end, float(least))
        return json.dumps([{names[k]: None if v is None else str(v) for k, v in r.items()} for r in rows]).encode()

    return answer


def heights(url: str, body: bytes) -> bytes:
    """A made-up terrain: hundredths of a degree north by 700, and east by 300."""
    points = json.loads(body)["locations"]
    return json.dumps({"results": [{"elevation": int(p["latitude"] * 100) % 700 + int(p["longitude"] * 100) % 300} for p in points]}).encode()
