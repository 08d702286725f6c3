"""Order over a whole table without one task that holds it.

Rows are numbered by ranges: a row's number is its place in its task's range after all earlier ranges.
Frames over the k rows before go block by block, each block with the k rows that precede it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tectra.functions import tables

#: Rows of a block; ranges that values are counted in, and distinct values of a range that are looked at one by one.
BLOCK, RANGES, FEW = 100_000, 1024, 10_000


def with_index(df: DataFrame, time: str = "time", *ties: str, index: str = "idx") -> DataFrame:
    """Adds a number from 1, by time and ties; rows without time come last. Tasks take ranges of (time, ties), so that no day or time of many
    rows is one task's alone, and number their own rows; the sums of rows before them have a row a task. The rows are a written table."""
    order = [F.col(time).asc_nulls_last(), *ties]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = tables.written(rows)
    part = F.shiftright("__at", 33)
    parts = rows.groupBy(part.alias("__part")).count()
    before = parts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    out = rows.join(F.broadcast(before), part == F.col("__part"))
    return out.withColumn(index, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def with_rows_before(df: DataFrame, k: int, index: str = "idx", block: int = BLOCK) -> tuple[DataFrame, Window]:
    """The rows, some twice, and a window of the block in order. Rows with `__own` false only stand before a block."""
    block = max(block, k)
    at = F.floor((F.col(index) - 1) / block)
    spill = (F.col(index) - 1) % block >= block - k
    rows = df.withColumn("__block", F.explode(F.when(spill, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("__own", F.col("__block") == at)
    return rows, Window.partitionBy("__block").orderBy(index)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__own", "__block")


def quantile(df: DataFrame, x: Column, q: float) -> float | None:
    """The quantile of a column's values, linear between neighbours; None without values. Values are counted in ranges, and the range
    that holds the place wanted is counted in ranges again until few distinct values are left: no task or driver sees them all."""
    rows = df.select(x.cast("double").alias("x")).dropna()
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    place = q * (n - 1)
    low = _at(rows, int(place), lo, hi)
    return low if place == int(place) else low + (place - int(place)) * (_at(rows, int(place) + 1, lo, hi) - low)


def _at(rows: DataFrame, k: int, lo: float, hi: float) -> float:
    """The value at place k, from 0, of those between lo and hi."""
    while True:
        within = rows.filter(F.col("x").between(lo, hi))
        some = within.groupBy("x").count().limit(FEW + 1)
        if some.count() <= FEW:
            for value, count in some.orderBy("x").collect():
                if k < count:
                    return value
                k -= count
            raise ValueError("no value has this place")
        width = (hi - lo) / RANGES
        spot = F.least(F.lit(RANGES - 1), F.floor((F.col("x") - lo) / width).cast("int"))
        for _, count, first, last in within.groupBy(spot.alias("r")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).orderBy("r").collect():
            if k < count:
                lo, hi = first, last
                break
            k -= count
