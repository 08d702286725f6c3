"""Outputs that are checked while they are written and published only if they are sound.

Each table is written once, into a folder that no reader knows, and its gate's numbers are observed by the job that writes it. Then all
numbers are judged together: a fault removes the folder and is an error; otherwise one pointer names it (as for the live feed).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tectra.functions import tables
from tectra.operators import integrity
from tectra.schemas import CatalogError


def _text(key: str) -> Column:
    return F.get_json_object("json", f"$.{key}")


def _measures(source: str, site_layer: bool) -> dict[str, dict[str, Column]]:
    """What is observed of each table; names are those that faults are told by."""
    required = integrity.CELL_KEYS + (integrity.SITE_KEYS if site_layer else [])
    props = F.get_json_object("feature", "$.properties")
    count = F.count(F.lit(1))
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    of_source = bad(_text("source") != source)
    return {
        "catalog": {"n_events": count},
        "summary": {"n_summary": count, "summary_gone": bad(F.size(integrity.missing_keys(F.col("json"), integrity.SUMMARY_KEYS)) > 0), "summary_source": of_source},
        "meta": {
            "n_meta": count,
            "meta_gone": bad(F.size(integrity.missing_keys(F.col("json"), integrity.STAMP_KEYS)) > 0),
            "meta_source": of_source,
            "unrestricted": bad(~integrity.has_restriction(_text("use_restriction"))),
            "undenied": bad(~integrity.fold(F.coalesce(_text("disclaimer"), F.lit(""))).contains("tahmini")),
        },
        "cells": {"n_cells": count, "poor": bad(F.size(integrity.missing_keys(props, required)) > 0)},
        "big_events": {"n_big_events": count, "bare": bad(~props.startswith("{"))},
    }


def _faults(m: dict[str, int]) -> list[str]:
    """What `integrity.output_faults` would find, in its order."""
    found = [
        (not m["n_events"], "no events"),
        (m["n_summary"] != 1 or m["summary_gone"], "summary lacks keys"),
        (m["summary_source"], "summary's source"),
        (m["n_meta"] != 1 or m["meta_gone"], "stamp lacks keys"),
        (m["unrestricted"], "use isn't restricted"),
        (m["meta_source"], "stamp's source"),
        (m["undenied"], "disclaimer"),
        (not m["n_cells"] or m["poor"], "cells lack keys"),
        (not m["n_big_events"] or m["bare"], "events lack properties"),
    ]
    return [name for bad, name in found if bad]


def publish_outputs(path: str, outputs: dict[str, DataFrame], source: str, site_layer: bool = True) -> dict[str, int]:
    """outputs: catalog, summary, meta (one row json each), cells and big_events (GeoJSON features in a column feature). Writes each as Parquet
    in one job that also measures it, and names them all at once if nothing is at fault; returns the counts. A refused or interrupted set is
    never seen by `read_outputs`."""
    measures = _measures(source, site_layer)
    if outputs.keys() != measures.keys():
        raise CatalogError(f"outputs are {', '.join(measures)}")
    spark, name, found = outputs["catalog"].sparkSession, uuid.uuid4().hex, {}
    for k, df in outputs.items():
        seen = Observation(f"{k}-{name}")
        df.observe(seen, *[c.alias(n) for n, c in measures[k].items()]).write.parquet(f"{path}/sets/{name}/{k}")
        found |= seen.get
    if faults := _faults(found):
        fs, p = tables.file_system(spark, f"{path}/sets/{name}")
        fs.delete(p, True)
        raise CatalogError(", ".join(faults))
    before = _pointers(spark, path)
    tables.write_text(spark, f"{path}/_current/{int(before[-1][:12]) + 1 if before else 0:012d}-{name}", name)
    return {k: found[k] for k in ("n_events", "n_cells", "n_big_events")}


def _pointers(spark: SparkSession, path: str) -> list[str]:
    fs, at = tables.file_system(spark, f"{path}/_current")
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(x for x in names if len(x) == 45)


def read_outputs(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The set that is named last; None before the first."""
    named = _pointers(spark, path)
    return {k: spark.read.parquet(f"{path}/sets/{named[-1][13:]}/{k}") for k in ("catalog", "summary", "meta", "cells", "big_events")} if named else None
