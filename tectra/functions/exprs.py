"""Column expressions with the catalog's rules for nulls, bins, ranks and rounding."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tectra.schemas import DAY_US, Region


def finite(c: Column) -> Column:
    """NaN and infinities as null, since NaN is greater than every number in Spark."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def number(c: Column) -> Column:
    """A text as a finite number, else null."""
    return finite(c.try_cast("double"))


def utc_time(c: Column, kind: str) -> Column:
    """UTC time of an ISO text that begins with a date; a typed time as it is. Garbage is null."""
    if kind == "string":
        return F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(c).try_cast("timestamp"))
    return c.cast("timestamp")


def micros(c: Column) -> Column:
    return F.unix_micros(c)


def days(us: Column) -> Column:
    return us / float(DAY_US)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c.cast("double"), digits)


def in_box(lat: Column, lon: Column, r: Region) -> Column:
    """Both ends belong to the box."""
    return lat.between(r.min_lat, r.max_lat) & lon.between(r.min_lon, r.max_lon)


def cell_bins(lat: Column, lon: Column, r: Region, cell_deg: float) -> tuple[Column, Column]:
    """Cell of a point by flooring; points outside the box have cells too, below zero as well."""
    return tuple(F.floor((x - F.lit(lo)) / F.lit(float(cell_deg))).cast("int") for x, lo in ((lat, r.min_lat), (lon, r.min_lon)))


def edge_bin(x: Column, lo: float, width: float, n: int) -> Column:
    """Bin of x among edges lo + width * i, each compared as the double it is; the last bin holds its upper edge. Else null.

    Flooring names a bin, and the edges next to it decide."""
    k = F.floor((x - F.lit(lo)) / F.lit(width)).cast("long")
    edge = lambda i: F.lit(lo) + F.lit(width) * i.cast("double")
    k = F.when(x < edge(k), k - 1).when(x >= edge(k + 1), k + 1).otherwise(k)
    k = F.when((k == n) & (x == edge(F.lit(n))), F.lit(n - 1).cast("long")).otherwise(k)
    return F.when((k >= 0) & (k < n), k).cast("int")


def percent_rank_average(c: Column) -> Column:
    """Average rank over the number of rows, for aggregated tables only: the window has one partition."""
    return (F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy())


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), c))
