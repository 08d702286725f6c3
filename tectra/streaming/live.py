"""The near-live feed: polls that look back, last record of an id wins, newest first."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.functions import exprs, tables
from tectra.operators import clean
from tectra.schemas import CATALOG, CATALOG_COLUMNS
from tectra.sources import archive

LOOKBACK_MINUTES, STALE_MINUTES, POLL_SECONDS = 120, 30, 60


def live_events(records: DataFrame, checked_at: Column, lookback_minutes: int = LOOKBACK_MINUTES, order: list | None = None) -> DataFrame:
    """Catalog rows no older than the lookback, the last record of each id (by `order`, else by all values), newest first. A field that
    can't be read is an error: a broken feed shows nothing rather than less."""
    kinds = dict(records.dtypes)
    strict = []
    for c in CATALOG_COLUMNS:
        kind = "timestamp" if c == "time" else "double" if c in ("latitude", "longitude", "depth", "mag") else "string"
        strict.append((F.col(c).cast(kind) if c in kinds else F.lit(None).cast(kind)).alias(c))
    typed = records.select(*strict, *[F.col(c) for c in (order or []) if c not in CATALOG_COLUMNS])
    kept = typed.filter(exprs.micros(F.col("time")) >= checked_at - lookback_minutes * 60_000_000)
    last = clean.one_per_id(kept, order or CATALOG_COLUMNS, last=True)
    return last.select(CATALOG_COLUMNS).orderBy(F.desc("time"), "id")


def live_status(events: DataFrame, checked_at: Column, stale_minutes: float = STALE_MINUTES) -> DataFrame:
    """status (empty, fresh or stale), lag_minutes (one digit), n_events, newest_us."""
    a = events.agg(F.count(F.lit(1)).alias("n_events"), F.max(exprs.micros(F.col("time"))).alias("newest_us"))
    lag = exprs.half_even((checked_at - F.col("newest_us")) / 60_000_000.0, 1)
    status = F.when(F.col("n_events") == 0, "empty").when(lag <= stale_minutes, "fresh").otherwise("stale")
    return a.select(status.alias("status"), lag.alias("lag_minutes"), "n_events", "newest_us")


# Fixed value: the note that a live feed carries.
LIVE_NOTE = "AFAD yakın-canlı katalog verisidir; gecikme olabilir. Deprem tahmini değildir."


def live_features(events: DataFrame, source: str = "AFAD") -> DataFrame:
    """time_us, id, feature: a point an event, places to five digits."""
    r = lambda c, d: exprs.half_even(F.col(c), d)
    point = F.struct(F.lit("Point").alias("type"), F.array(r("longitude", 5), r("latitude", 5)).alias("coordinates"))
    time = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ssXXX")
    props = F.struct(F.coalesce("id", F.lit("")).alias("event_id"), time.alias("time"), r("mag", 2).alias("mag"), F.col("magType").alias("mag_type"), r("depth", 2).alias("depth_km"), F.coalesce("place", F.lit("")).alias("place"), F.lit(source).alias("source"))
    whole = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties"))
    return events.select(exprs.micros(F.col("time")).alias("time_us"), "id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("feature"))


def write_live(events: DataFrame, path: str, checked_at: Column, **stated) -> None:
    """Overwrites the feed's features (a line each, newest first) and its one-row stamp with status, lag and count."""
    live_features(events).orderBy(F.desc("time_us"), "id").select(F.col("feature").alias("value")).write.mode("overwrite").text(f"{path}/live_events.geojsonl")
    newest = F.date_format(F.timestamp_micros("newest_us"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    fixed = [F.lit(v).alias(k) for k, v in ({"source": "AFAD", "disclaimer": LIVE_NOTE} | stated).items()]
    stamp = F.struct(*fixed, "status", "lag_minutes", "n_events", newest.alias("latest_event_time"), F.date_format(F.timestamp_micros(checked_at), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("checked_at"))
    live_status(events, checked_at).select(F.to_json(stamp, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/live_meta.json")


def publish_live(events: DataFrame, path: str, checked_at: Column, keep: int = 3, **stated) -> str:
    """Writes the feed's features and stamp into a folder of their own and then names it in one step, by a pointer file that replaces none.
    A reader sees the old feed or the new one, never parts of both or nothing, whenever the writer stops. The last `keep` feeds stay
    for readers that are under way. Returns the folder."""
    spark = events.sparkSession
    name = uuid.uuid4().hex
    write_live(events, f"{path}/feeds/{name}", checked_at, **stated)
    pointers = _pointers(spark, path)
    tables.write_text(spark, f"{path}/_current/{int(pointers[-1][:12]) + 1 if pointers else 0:012d}-{name}", name)
    pointers = _pointers(spark, path)
    named = {x[13:] for x in pointers[-keep:]}
    fs, feeds = tables.file_system(spark, f"{path}/feeds")
    gone = [x.getPath() for x in fs.listStatus(feeds) if x.getPath().getName() not in named]
    gone += [tables.file_system(spark, f"{path}/_current/{x}")[1] for x in pointers[:-keep]]
    for x in gone:
        fs.delete(x, True)
    return f"{path}/feeds/{name}"


def _pointers(spark, path: str) -> list[str]:
    """Names of the pointers, the oldest first: a number of twelve digits and the feed's name."""
    fs, at = tables.file_system(spark, f"{path}/_current")
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(x for x in names if len(x) == 45)


def read_live(spark, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Features and stamp (value: a line of JSON each) of the feed that is named last; None before the first."""
    pointers = _pointers(spark, path)
    if not pointers:
        return None
    at = f"{path}/feeds/{pointers[-1][13:]}"
    return spark.read.text(f"{at}/live_events.geojsonl"), spark.read.text(f"{at}/live_meta.json")


def published_stream(stream: DataFrame, path: str, checkpoint: str, *, lookback_minutes: int = LOOKBACK_MINUTES, checked_at: Column | None = None, once: bool = True):
    """Publishes the feed anew with every poll, as `publish_live` does. A batch that is done again publishes the same feed again. Returns the
    running query."""

    def write(batch: DataFrame, n: int) -> None:
        now = F.unix_micros(F.current_timestamp()) if checked_at is None else checked_at
        publish_live(live_events(batch, now, lookback_minutes), path, now, lookback_minutes=lookback_minutes, stale_after_minutes=STALE_MINUTES)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")).start()


def live_stream(stream: DataFrame, path: str, checkpoint: str, *, lookback_minutes: int = LOOKBACK_MINUTES, checked_at: Column | None = None, once: bool = True):
    """Writes the feed anew with every poll. A poll holds a whole lookback, so no state is kept between polls. Returns the running query."""

    def write(batch: DataFrame, n: int) -> None:
        now = F.unix_micros(F.current_timestamp()) if checked_at is None else checked_at
        write_live(live_events(batch, now, lookback_minutes), path, now, lookback_minutes=lookback_minutes, stale_after_minutes=STALE_MINUTES)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")).start()


def upsert_stream(stream: DataFrame, spark, path: str, checkpoint: str, once: bool = True):
    """Merges each micro-batch into the archive in a folder; later batches win. Returns the running query.

    A batch writes its own rows into the buckets of their ids (see `tectra.sources.archive`); one that is done again, after a lost
    driver, finds that it has been merged and changes nothing. Late records are merged, never dropped.
    """

    def merge(batch: DataFrame, n: int) -> None:
        archive.upsert(batch.sparkSession, path, batch, stream=checkpoint, batch=n)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")).start()


#: Ids are held in so many groups of state: a group's call, frame and state serve all of its ids, as each costs some milliseconds.
GROUPS = 256
#: What the function sees and gives: times are microseconds; _NO_TIME is none. The state is a table of _IDS.
_HELD = f"{CATALOG.replace('time timestamp', 'time long')}, seen_us long, ord long, n_records long, n_late long"
_IDS = ["key", "seen_us", "ord", "n_records", "n_late"]
_NO_TIME = -(1 << 63)


def _packed(ids: dict[str, tuple]) -> bytes:
    table = pa.table([pa.array(ids, pa.string()), *(pa.array(x, pa.int64()) for x in zip(*ids.values()))], _IDS)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, tuple]:
    keys, *columns = (c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns)
    return dict(zip(keys, zip(*columns)))


def last_records(stream: DataFrame, late: str = "10 minutes", keep_minutes: int = LOOKBACK_MINUTES, groups: int = GROUPS) -> DataFrame:
    """The last record of each id over micro-batches, by seen_at (when a poll saw it) and ord: a row whenever it changes, with how many
    records of the id there have been and how many of them came after a later one. Runs in update mode.

    What is known of an id is state for `keep_minutes` after it was last seen, so that polls need not bring a whole lookback again. State
    holds an id's last place and counts, in `groups` groups of ids by hash; a record that changes is in the batch itself. A stream keeps
    its number of groups. Records of polls older than the watermark are dropped and counted in the query's progress
    (numRowsDroppedByWatermark). Rows without an id stay, each for itself: their key is what they hold.
    """
    whole = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CATALOG_COLUMNS]), 256)
    columns = [F.coalesce(F.unix_micros("time"), F.lit(_NO_TIME)).alias(c) if c == "time" else F.col(c) for c in CATALOG_COLUMNS]
    key = F.coalesce(F.concat(F.lit("i"), F.col("id")), F.concat(F.lit("r"), whole)).alias("key")
    rows = stream.withWatermark("seen_at", late).select(*columns, "seen_at", F.unix_micros("seen_at").alias("seen_us"), F.coalesce("ord", F.lit(0)).cast("long").alias("ord"), key)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    names = [x.split()[0] for x in _HELD.split(", ")]
    ends = lambda x: x[0] // 1000 + keep_minutes * 60_000

    def of_group(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids = _unpacked(state.get[0]) if state.exists else {}
        came, last = set(), {}
        frames = [] if state.hasTimedOut else [f.reset_index(drop=True) for f in frames]
        for k, frame in enumerate(frames):
            for i, (x, *at) in enumerate(zip(*[frame[c].tolist() for c in _IDS[:3]])):
                came.add(x)
                seen, order, n, n_late = ids.get(x, (None, None, 0, 0))
                if seen is None or at >= [seen, order]:
                    if at != [seen, order] or x in last:
                        last[x] = k, i
                    ids[x] = (*at, n + 1, n_late)
                else:
                    ids[x] = seen, order, n + 1, n_late + 1
        passed = state.getCurrentWatermarkMs()
        ids = {x: held for x, held in ids.items() if x in came or ends(held) >= passed}
        if ids:
            state.update((_packed(ids),))
            state.setTimeoutTimestamp(max(min(map(ends, ids.values())), passed + 1))
        elif state.exists:
            state.remove()
        for k, frame in enumerate(frames):
            mine = {i: x for x, (at, i) in last.items() if at == k}
            if mine:
                counts = pd.DataFrame([ids[x][2:] for x in mine.values()], columns=names[-2:])
                yield pd.concat([frame.iloc[list(mine)][names[:-2]].reset_index(drop=True), counts], axis=1)

    out = rows.groupBy("group").applyInPandasWithState(of_group, _HELD, "ids binary", "update", "EventTimeTimeout")
    time = F.timestamp_micros(F.nullif("time", F.lit(_NO_TIME))).alias("time")
    return out.select(*[time if c == "time" else F.col(c) for c in CATALOG_COLUMNS], F.timestamp_micros("seen_us").alias("seen_at"), "ord", "n_records", "n_late")


def revisions_stream(stream: DataFrame, path: str, checkpoint: str, *, late: str = "10 minutes", keep_minutes: int = LOOKBACK_MINUTES, partitions: int | None = None, once: bool = True):
    """Merges last records into the archive in a folder as they change. Returns the running query. Each partition of state costs some files
    a batch, however little it holds: a new stream has `partitions` of them, two a core of the cluster if none is given, and keeps them."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        once_read = tables.written(batch)  # the merge reads it twice, which would run the state's function twice
        archive.upsert(batch.sparkSession, path, once_read, stream=checkpoint, batch=n)
        tables.forget(once_read)

    writer = last_records(stream, late, keep_minutes).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions or min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:  # a query keeps the settings that it was started with
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _version(spark, path: str) -> int | None:
    """The archive's version; None before the first batch."""
    state = archive.current(spark, path)
    return state.version if state else None


def read_archive(spark, path: str) -> DataFrame | None:
    state = archive.current(spark, path)
    return archive.read(spark, path, state) if state else None


def closed_windows(stream: DataFrame, time: str = "time", late: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Counts and greatest magnitude of tumbling windows that the watermark has closed."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width))
    return w.agg(F.count(F.lit(1)).alias("n_events"), F.max("mag").alias("max_mag")).select(F.col("window.start").alias("window_start"), "n_events", "max_mag")
