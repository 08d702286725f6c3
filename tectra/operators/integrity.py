"""Claims in texts, and gates that refuse what isn't sound."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.functions import exprs
from tectra.operators import skill, stats
from tectra.schemas import CatalogError, Region

# Claims that no text may make, the markers that deny one, and how far from it.
CLAIMS = ("deprem tahmini", "deprem öngörüsü", "erken uyarı", "ne zaman deprem", "nerede deprem", "kaç büyüklüğünde deprem")
DENIALS = ("mümkün değil", "mumkun degil", "değil", "degil", "yapmaz")
REACH = 40


def fold(c: Column) -> Column:
    """Lower case with the two Turkish letters i kept apart."""
    return F.lower(F.translate(c, "İI", "iı"))


class Scanner:
    """Finds phrases that no denial stands near. One automaton holds phrases and denials; it walks a text once and gives the ends of all
    their occurrences in order, so that the work grows with the text's length alone."""

    def __init__(self, phrases: tuple[str, ...], denials: tuple[str, ...], reach: int):
        import ahocorasick

        self.reach, self.automaton = reach, ahocorasick.Automaton()
        for x in {*phrases, *denials} - {""}:
            self.automaton.add_word(x, (x, x in phrases, x in denials))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[str, int]]:
        """(phrase, place of its first character), by place and phrase."""
        found, starts, ends = [], [], {}  # the shortest denial's end by its start
        for last, (word, claimed, denies) in self.automaton.iter(text) if self.any else ():
            first = last + 1 - len(word)
            if claimed:
                found.append((first, word))
            if denies:
                starts.append(first)
                ends[first] = min(last + 1, ends.get(first, last + 1))
        starts.sort()
        return [(word, at) for at, word in sorted(found) if not self._denied(at, at + len(word), starts, ends)]

    def _denied(self, at: int, end: int, starts: list[int], ends: dict[int, int]) -> bool:
        """A denial lies whole within reach of the phrase. No more starts are looked at than fit there."""
        k = bisect_left(starts, at - self.reach)
        while k < len(starts) and starts[k] < end + self.reach:
            if ends[starts[k]] <= end + self.reach:
                return True
            k = bisect_right(starts, starts[k])
        return False


def claims(df: DataFrame, text: str, phrases: tuple[str, ...] = CLAIMS, denials: tuple[str, ...] = DENIALS, reach: int = REACH, id_col: str = "id") -> DataFrame:
    """id, phrase, idx (from 0, in the folded text) of each occurrence, overlapping ones too, that no denial stands near.

    Texts without any phrase stay in the JVM; others are walked once, whatever their length and the number of phrases. Null and empty texts
    have no occurrence; a text that stands in several rows has its own in each."""
    rows = df.select(F.col(id_col).alias("id"), fold(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    some = reduce(or_, [F.contains("t", F.lit(x)) for x in phrases if x], F.lit(False))
    kind = rows.schema["id"].dataType

    def run(batches):
        scanner = Scanner(phrases, denials, reach)
        for b in batches:
            for k in range(b.num_rows):  # a text at a time, as they may be long
                found = scanner.hits(b.column("t")[k].as_py())
                ids = pa.concat_arrays([b.column("id").slice(k, 1)] * len(found)) if found else b.column("id").slice(0, 0)
                yield pa.record_batch([ids, pa.array([x for x, _ in found], pa.string()), pa.array([at for _, at in found], pa.int32())], ["id", "phrase", "idx"])

    return rows.filter(some).mapInArrow(run, f"id {kind.simpleString()}, phrase string, idx int")


def has_restriction(text: Column) -> Column:
    """Whether a text says that it is no input to rating."""
    t = fold(F.coalesce(text, F.lit("")))
    return (t.contains("rating") | t.contains("fiyatlama")) & (t.contains("değil") | t.contains("degil"))


def missing_keys(json: Column, required: list[str]) -> Column:
    """Required keys that an object lacks; all of them where there is no object. Numbers that aren't finite may stand in it."""
    keys = F.coalesce(F.json_object_keys(json), F.map_keys(F.from_json(json, "map<string, string>")), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys))


def catalog_faults(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: n_rows, missing (required columns that aren't there), sound."""
    gone = sorted(set(required) - set(df.columns))
    missing = F.array(*map(F.lit, gone)).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", missing.alias("missing"), (F.lit(not gone) & (F.col("n_rows") > 0)).alias("sound"))


def _sound(c: Column) -> Column:
    """Finite, tested before any comparison, as NaN is greater than every number."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def stamp_faults(min_mag: Column, mc: Column, area_skill: Column, gain: Column) -> Column:
    """What a gate refuses a surface's numbers for, in order; empty where they are sound."""
    faults = [
        (~(_sound(min_mag) & _sound(mc)) | (min_mag < mc), "below completeness"),
        (~_sound(area_skill), "skill isn't finite"),
        (_sound(area_skill) & ~(area_skill > 0), "no skill"),
        (~_sound(gain), "gain isn't finite"),
        (_sound(gain) & ~(gain > 1), "no gain"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in faults]), lambda x: x.isNotNull())


def drift_faults(stamped_mc: Column, mc: Column, b: Column, stamped_skill: Column, skill_: Column, drift: float = 0.05) -> Column:
    """What a recomputed completeness, b and skill refuse a stamp for, in order."""
    faults = [
        (~(_sound(stamped_mc) & (F.abs(stamped_mc - mc) <= drift)), "mc has drifted"),
        (~(_sound(b) & b.between(0.6, 1.4)), "b is out of range"),
        (~(_sound(stamped_skill) & (F.abs(stamped_skill - skill_) <= drift)), "skill has drifted"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in faults]), lambda x: x.isNotNull())


def etas_faults(json: Column) -> Column:
    """What the gate refuses an ETAS stamp for, in order. Values are read with their JSON kinds, so that true is no number."""
    core = "$.canonical_etas"
    numbers = []
    for k in ("mu", "K", "c", "p", "alpha", "skill_vs_climatology_pct"):
        raw = F.get_json_object(json, f"{core}.{k}")
        numbers.append(F.when(F.coalesce(~raw.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), F.lit(True)), F.lit(k)))
    source = F.get_json_object(json, f"{core}.source")
    numbers.append(F.when(F.coalesce(source.contains("UNKNOWN") | (source == ""), F.lit(True)), F.lit("source")))
    return F.filter(F.array(*numbers), lambda x: x.isNotNull())


def require_columns(df: DataFrame, required: list[str]) -> None:
    if gone := sorted(set(required) - set(df.columns)):
        raise CatalogError(f"columns are missing: {', '.join(gone)}")


def require_rows(df: DataFrame) -> None:
    if not df.limit(1).count():
        raise CatalogError("the table is empty")


def finite_magnitudes(df: DataFrame, mag: str = "mag") -> DataFrame:
    """mag, as finite numbers only; an error if there are none."""
    out = df.select((exprs.number if dict(df.dtypes)[mag] == "string" else exprs.finite)(F.col(mag)).alias("mag")).dropna()
    require_rows(out)
    return out


def require_finite(value, name: str, above: float | None = None) -> float:
    """A number that is finite, no bool, and above a bound if there is one. Comes before any comparison: NaN passes many."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise CatalogError(f"{name} isn't a finite number: {value!r}")
    if above is not None and not value > above:
        raise CatalogError(f"{name} is {value}, not above {above}")
    return float(value)


def require_complete(min_mag: float, mc: float) -> None:
    if not require_finite(min_mag, "min_mag") >= require_finite(mc, "mc"):
        raise CatalogError(f"min_mag {min_mag} is below the completeness magnitude {mc}")


def polygon_edge(ring: Column) -> Column:
    """East-west extent of a ring of [lon, lat], six digits."""
    lon = F.transform(ring, lambda p: p[0])
    return F.round(F.array_max(lon) - F.array_min(lon), 6)


def require_grid(edges: DataFrame, ring: str, cell_deg: float, tolerance: float = 1e-6) -> None:
    if edges.filter(F.abs(polygon_edge(F.col(ring)) - cell_deg) > tolerance).limit(1).count():
        raise CatalogError(f"a cell's edge isn't {cell_deg}")


def science_gate(df: DataFrame, region: Region, stamped: dict, *, min_mag: float, cell_deg: float, recent_years: float = 10.0, drift: float = 0.05) -> dict:
    """Recomputes completeness, b and skill and refuses a stamp that they don't bear out. The catalog is summed on the cluster; a few
    numbers decide."""
    require_rows(df)
    mc = stats.completeness_magnitude(df).first()
    if mc is None:
        raise CatalogError("no magnitudes")
    require_complete(min_mag, mc.mc)
    if abs(require_finite(stamped.get("mc"), "stamped mc") - mc.mc) > drift:
        raise CatalogError(f"stamped mc {stamped['mc']} has drifted from {mc.mc}")
    if stamped.get("cell_deg") != cell_deg:
        raise CatalogError("the stamped cell size differs")
    b = stats.b_value(df, mc.mc).first().b
    if not 0.6 <= require_finite(b, "b") <= 1.4:
        raise CatalogError(f"b is {b}")
    s = skill.surface_skill(df, region, min_mag=min_mag, cell_deg=cell_deg, recent_years=recent_years).first()
    require_finite(s.area_skill_score, "area_skill_score", 0)
    require_finite(s.gain_top25, "gain_top25", 1)
    if abs(require_finite(stamped.get("area_skill_score"), "stamped skill") - s.area_skill_score) > drift:
        raise CatalogError("the stamped skill has drifted")
    return {"mc": mc.mc, "b": b, "area_skill_score": s.area_skill_score, "gain_top25": s.gain_top25}


# What a published surface's stamp holds.
META_KEYS = ["source", "region", "cell_deg", "min_mag", "mc", "area_skill_score", "gain_top25", "n_cells", "disclaimer", "use_restriction"]


def surface_faults(meta: DataFrame, cells: DataFrame, known_sources: tuple[str, ...] = ("AFAD", "USGS")) -> DataFrame:
    """Rows of meta with `faults`, what a served surface is refused for, in order; needs no catalog.

    meta: stamps in a column json; cells: GeoJSON features in a column feature, read once whatever the number of stamps. A number of
    another JSON kind, a missing one and a null count as not finite, a cell without a ring as one of another size."""
    m = F.from_json("json", "source string, cell_deg double, min_mag double, mc double, area_skill_score double, gain_top25 double, n_cells long, disclaimer string, use_restriction string")
    edge = polygon_edge(F.from_json("feature", "geometry struct<coordinates: array<array<array<double>>>>")["geometry"]["coordinates"][0])
    measured = cells.select(edge.alias("edge")).agg(F.count(F.lit(1)).alias("n"), F.count("edge").alias("with_edge"), F.min("edge").alias("least"), F.max("edge").alias("most"))
    denial = fold(F.coalesce(F.col("m.disclaimer"), F.lit("")))
    gone = missing_keys(F.col("json"), META_KEYS)
    edges = (F.col("c.with_edge") == F.col("c.n")) & (F.col("c.least") >= F.col("m.cell_deg") - 1e-6) & (F.col("c.most") <= F.col("m.cell_deg") + 1e-6)
    before = [
        (F.size(gone) > 0, F.concat(F.lit("missing "), F.array_join(gone, ", "))),
        (~F.col("m.source").isin(*known_sources), F.lit("unknown source")),
        (~has_restriction(F.col("m.use_restriction")), F.lit("use isn't restricted")),
        (~(denial.contains("tahmini") & (denial.contains("değil") | denial.contains("degil"))), F.lit("prediction isn't denied")),
    ]
    after = [
        (F.col("c.n") == 0, F.lit("no cells")),
        ((F.col("c.n") > 0) & ~F.coalesce(edges, F.lit(False)), F.lit("cells of another size")),
        (F.col("c.n") != F.col("m.n_cells"), F.lit("cells of another number")),
    ]
    named = lambda faults: F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in faults])
    numbers = stamp_faults(F.col("m.min_mag"), F.col("m.mc"), F.col("m.area_skill_score"), F.col("m.gain_top25"))
    faults = F.filter(F.concat(named(before), numbers, named(after)), lambda x: x.isNotNull())
    judged = meta.withColumn("m", m).crossJoin(F.broadcast(measured.select(F.struct("*").alias("c"))))  # one row of four numbers
    return judged.withColumn("faults", faults).select(*meta.columns, "faults")


def surface_gate(meta: DataFrame, cells: DataFrame, known_sources: tuple[str, ...] = ("AFAD", "USGS")) -> None:
    """Refuses a surface whose one stamp is missing or has any of `surface_faults`."""
    found = surface_faults(meta.select("json"), cells, known_sources).select("faults").first()
    if found is None:
        raise CatalogError("there is no stamp")
    if found.faults:
        raise CatalogError("; ".join(found.faults))


def etas_gate(stamp: dict) -> None:
    """Numbers that are finite and no bools, and a known source."""
    core = stamp.get("canonical_etas") or {}
    for k in ("mu", "K", "c", "p", "alpha", "skill_vs_climatology_pct"):
        require_finite(core.get(k), k)
    if core.get("branching_ratio") is not None:
        require_finite(core["branching_ratio"], "branching_ratio")
    if not core.get("source") or "UNKNOWN" in str(core["source"]):
        raise CatalogError("the source is unknown")


# What a summary, a stamp and a cell's properties hold.
SUMMARY_KEYS = ["source", "n_events", "date_min", "date_max"]
STAMP_KEYS = ["source", "n_cells", "n_big_events", "disclaimer", "mc", "use_restriction"]
CELL_KEYS = ["risk_model", "risk_index", "annual_rate", "recent_rate", "recency_days", "energy_index", "shallow_fraction"]
SITE_KEYS = ["site_risk", "site_class", "amp", "liq_class"]


def output_faults(catalog: DataFrame, summary: DataFrame, meta: DataFrame, cells: DataFrame, big_events: DataFrame, source: str, site_layer: bool = True) -> DataFrame:
    """faults, n_events, n_cells, n_big_events: what the contract of all outputs refuses, in order. summary and meta: one row json; cells and
    big_events: GeoJSON features in a column feature. Every feature is checked, and counts alone meet in one row."""
    text = lambda k: F.get_json_object("json", f"$.{k}")
    required = CELL_KEYS + (SITE_KEYS if site_layer else [])
    s = summary.select(missing_keys(F.col("json"), SUMMARY_KEYS).alias("s_gone"), text("source").alias("s_source"))
    m = meta.select(missing_keys(F.col("json"), STAMP_KEYS).alias("m_gone"), text("source").alias("m_source"), has_restriction(text("use_restriction")).alias("restricted"), fold(F.coalesce(text("disclaimer"), F.lit(""))).contains("tahmini").alias("denies"))
    props = F.get_json_object("feature", "$.properties")
    c = cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.size(missing_keys(props, required)) > 0).alias("poor"))
    b = big_events.agg(F.count(F.lit(1)).alias("n_big_events"), F.count_if(F.coalesce(~props.startswith("{"), F.lit(True))).alias("bare"))
    one = catalog.agg(F.count(F.lit(1)).alias("n_events")).crossJoin(c).crossJoin(b).crossJoin(s).crossJoin(m)
    faults = [
        (F.col("n_events") == 0, "no events"),
        (F.size("s_gone") > 0, "summary lacks keys"),
        (F.coalesce(F.col("s_source") != source, F.lit(True)), "summary's source"),
        (F.size("m_gone") > 0, "stamp lacks keys"),
        (~F.col("restricted"), "use isn't restricted"),
        (F.coalesce(F.col("m_source") != source, F.lit(True)), "stamp's source"),
        (~F.col("denies"), "disclaimer"),
        ((F.col("n_cells") == 0) | (F.col("poor") > 0), "cells lack keys"),
        ((F.col("n_big_events") == 0) | (F.col("bare") > 0), "events lack properties"),
    ]
    listed = F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in faults]), lambda x: x.isNotNull())
    return one.select(listed.alias("faults"), "n_events", "n_cells", "n_big_events")


def output_gate(*tables, **options) -> dict:
    """The counts, or an error with what `output_faults` finds."""
    r = output_faults(*tables, **options).first()
    if r is None or r.faults:
        raise CatalogError(", ".join(r.faults) if r else "nothing to check")
    return {k: r[k] for k in ("n_events", "n_cells", "n_big_events")}
