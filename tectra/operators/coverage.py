"""What archives cover, as tables: a row an archive, so that thousands of stations or regions are planned in one job.

Times are microseconds. The rules are those of one archive's manifest in `tectra.sources.files`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.schemas import DAY_US, YEAR_DAYS

GAPS = "array<struct<gap_from: bigint, gap_to: bigint>>"


def _gap(when: Column, start: Column, end: Column) -> Column:
    return F.when(when, F.array(F.struct(start.alias("gap_from"), end.alias("gap_to")))).otherwise(F.array().cast(GAPS))


def fetch_plans(manifests: DataFrame, now: Column, horizon_days: float = 10, overlap_days: float = 2) -> DataFrame:
    """manifests: covered_until and more. Adds fetch_from, fetch_to, gap_from, gap_to (null where nothing is lost) and refused: covered beyond
    now. Reading starts a little before the covered time, but no earlier than the service answers; what lies between is a gap."""
    now = now.cast("long")
    until, horizon = F.col("covered_until"), now - int(horizon_days * DAY_US)
    start = F.when(until.isNull(), horizon).otherwise(F.greatest(until - int(overlap_days * DAY_US), horizon))
    lost = F.coalesce(until < horizon, F.lit(False))
    return manifests.select("*", start.alias("fetch_from"), now.alias("fetch_to"), F.when(lost, until).alias("gap_from"), F.when(lost, horizon).alias("gap_to"), F.coalesce(until > now, F.lit(False)).alias("refused"))


def updated(plans: DataFrame) -> DataFrame:
    """Plans that were carried out: covered_from where there was none, covered_until, and gaps with the new one after the old."""
    own = F.coalesce("gaps", F.array().cast(GAPS)) if "gaps" in plans.columns else F.array().cast(GAPS)
    gaps = F.concat(own, _gap(F.col("gap_from").isNotNull(), F.col("gap_from"), F.col("gap_to")))
    new = {"covered_from": F.coalesce("covered_from", "fetch_from"), "covered_until": F.col("fetch_to"), "gaps": gaps}
    return plans.withColumns(new).drop("fetch_from", "fetch_to", "gap_from", "gap_to", "refused")


def seeded(manifests: DataFrame, seed_from: str = "seed_from", seed_to: str = "seed_to") -> DataFrame:
    """Coverage goes back to the seed's start and on to its end; what lies between seed and archive is a gap. Gaps by their start."""
    own = F.coalesce("gaps", F.array().cast(GAPS)) if "gaps" in manifests.columns else F.array().cast(GAPS)
    lost = F.coalesce(F.col(seed_to) < F.col("covered_from"), F.lit(False))
    gaps = F.sort_array(F.concat(own, _gap(lost, F.col(seed_to), F.col("covered_from"))))
    new = {"covered_from": F.least("covered_from", seed_from), "covered_until": F.greatest("covered_until", seed_to), "gaps": gaps}
    return manifests.withColumns(new).drop(seed_from, seed_to)


def history_years(start: Column, end: Column) -> Column:
    return F.coalesce((end - start) / float(DAY_US) / YEAR_DAYS, F.lit(0.0))


def is_empty_window(start: Column, end: Column, n_new: Column) -> Column:
    """Whether a window of a day or more brought nothing: an error of the service, and nothing may be saved."""
    return (n_new == 0) & (end - start >= DAY_US)
