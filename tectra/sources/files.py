"""Catalogs, seeds and archives in files."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tectra.functions import tables
from tectra.operators import clean
from tectra.schemas import CATALOG_COLUMNS, YEAR_DAYS, CatalogError
from tectra.sources import archive

UNKNOWN = "UNKNOWN"
# How far back the service answers, how much is read again, and how many years an export takes.
HORIZON_DAYS, OVERLAP_DAYS, MIN_HISTORY_YEARS = 10, 2, 10.0
_SERVICE_NAMES = {"eventID": "id", "date": "time", "magnitude": "mag", "type": "magType", "location": "place"}


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog in CSV, also gzipped, or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return clean.conform(spark.read.parquet(path))
    return clean.conform(spark.read.csv(path, header=True, inferSchema=False))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A seed in CSV under the service's or the catalog's names, all as text. Missing columns are an error."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if "eventID" in df.columns:
        df = df.withColumnsRenamed(_SERVICE_NAMES)
    if gone := sorted(set(CATALOG_COLUMNS) - set(df.columns)):
        raise CatalogError(f"the seed lacks {', '.join(gone)}")
    return df.select(CATALOG_COLUMNS)


def catalog_source(spark: SparkSession, path: str) -> str:
    """The source that a summary names; UNKNOWN where there is none, never a guess."""
    try:
        found = json.loads(tables.read_text(spark, path) or "{}")
    except ValueError:
        return UNKNOWN
    return (found.get("source") or UNKNOWN) if isinstance(found, dict) else UNKNOWN


def load_archive(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Events and manifest of the last version; an empty table and {} where there are none."""
    state = archive.current(spark, path)
    return archive.read(spark, path, state), state.manifest if state else {}


def save_archive(spark: SparkSession, path: str, events: DataFrame, manifest: dict) -> dict:
    """Writes events as a new version that holds nothing else. No file is replaced, so a reader sees the old archive or the new one,
    whenever the writer stops."""
    return archive.replace(spark, path, events, manifest).manifest


@dataclass(frozen=True)
class FetchPlan:
    start: datetime
    end: datetime
    gap: tuple[datetime, datetime] | None = None


def _time(x: str | None) -> datetime | None:
    return None if x is None else datetime.fromisoformat(x)


def plan_fetch(manifest: dict, now: datetime, *, horizon_days: float = HORIZON_DAYS, overlap_days: float = OVERLAP_DAYS) -> FetchPlan:
    """What to read next: from a little before the covered time, but no earlier than the service answers; what lies between is a gap."""
    horizon, until = now - timedelta(days=horizon_days), _time(manifest.get("covered_until"))
    if until is None:
        return FetchPlan(horizon, now)
    if until > now:
        raise CatalogError("the archive is covered beyond now")
    return FetchPlan(max(until - timedelta(days=overlap_days), horizon), now, (until, horizon) if until < horizon else None)


def update_manifest(manifest: dict, plan: FetchPlan, *, n_events: int, n_new: int, now: datetime) -> dict:
    gaps = list(manifest.get("gaps") or [])
    if plan.gap:
        gaps.append({"from": plan.gap[0].isoformat(), "to": plan.gap[1].isoformat()})
    return manifest | {"covered_from": manifest.get("covered_from") or plan.start.isoformat(), "covered_until": plan.end.isoformat(), "gaps": gaps, "n_events": n_events, "last_run": {"at": now.isoformat(), "fetched_from": plan.start.isoformat(), "n_new": n_new}}


def apply_seed(manifest: dict, start: datetime, end: datetime) -> dict:
    """Coverage goes back to the seed's start; what lies between seed and archive is a gap."""
    first = _time(manifest.get("covered_from"))
    gaps = list(manifest.get("gaps") or [])
    if first is not None and end < first:
        gaps.append({"from": end.isoformat(), "to": first.isoformat()})
    return manifest | {"covered_from": min(x for x in (first, start) if x is not None).isoformat(), "covered_until": max(x for x in (_time(manifest.get("covered_until")), end) if x is not None).isoformat(), "gaps": sorted(gaps, key=lambda g: g["from"])}


def history_years(manifest: dict) -> float:
    a, b = _time(manifest.get("covered_from")), _time(manifest.get("covered_until"))
    return 0.0 if a is None or b is None else (b - a) / timedelta(days=YEAR_DAYS)


def export_ready(manifest: dict, least: float = MIN_HISTORY_YEARS) -> bool:
    return history_years(manifest) >= least


def update_archive(spark: SparkSession, path: str, now: datetime, fetch, *, min_mag: float = 2.5, seed: DataFrame | None = None) -> dict:
    """Merges what `fetch(plan, min_mag)` brings into the archive, and a seed beneath it; only buckets of their ids are written. A window
    of a day or more without any event is an error, and then nothing is saved. Returns the manifest."""
    state = archive.current(spark, path)
    manifest, under = state.manifest if state else {}, None
    if seed is not None:
        typed = clean.conform(seed)
        lo, hi = typed.agg(F.min("time"), F.max("time")).first()
        if lo is not None:
            manifest = apply_seed(manifest, lo.replace(tzinfo=timezone.utc), hi.replace(tzinfo=timezone.utc))
            under = typed
    plan = plan_fetch(manifest, now)
    new = fetch(plan, min_mag)
    n_new = new.count()
    if not n_new and plan.end - plan.start >= timedelta(days=1):
        raise CatalogError("no events in a window of a day or more")
    return archive.upsert(spark, path, new, under=under, manifest=lambda n: update_manifest(manifest, plan, n_events=n, n_new=n_new, now=now)).manifest


def write_processed(events: DataFrame, manifest: dict, path: str, min_mag: float) -> DataFrame:
    """Writes the clean catalog as Parquet and CSV and its summary, with the coverage, as JSON; returns the summary."""
    spark = events.sparkSession
    df = clean.clean_catalog(events.filter(F.col("mag") >= min_mag))
    df.write.mode("overwrite").parquet(f"{path}/catalog.parquet")
    df = spark.read.parquet(f"{path}/catalog.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/catalog.csv")
    lit = lambda k: F.lit(manifest.get(k)).cast("string").alias(k)
    summary = clean.completeness_summary(df).select("*", lit("source"), lit("covered_from"), lit("covered_until"), F.lit(float(min_mag)).alias("min_mag"), F.lit(json.dumps(manifest.get("gaps") or [])).alias("gaps"), F.lit(history_years(manifest)).alias("history_years"))
    row = summary.first().asDict()
    tables.write_text(spark, f"{path}/summary.json", json.dumps(row | {"gaps": json.loads(row["gaps"])}, indent=1))
    return summary
