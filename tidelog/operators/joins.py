"""Joins that match by order rather than by equality, without pairing everything with everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """left with the values of the latest row of right at or before it (column on), within the keys by; nulls if there is none.

    Both sides are one sorted run a key, so a row costs no more than its place in the sort. Of right
    rows with the same place the one with the greatest values counts.
    """
    mark = "_right"
    a = left.withColumn(mark, F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType)).withColumn("_side", F.lit(1))
    b = right.groupBy(*by, on).agg(F.max(F.struct(*values)).alias(mark)).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn(mark, F.last(mark, ignorenulls=True).over(upto)).where("_side = 1")
    return last.select(*left.columns, *(F.col(f"{mark}.{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, on: str, start: str, end: str, width: float) -> DataFrame:
    """points with each row of ranges that holds them, start <= on < end.

    Both sides are dealt into bins of a width, a range into every bin that it meets, and joined by
    bin: choose a width near that of usual ranges. A point is in one bin, so no pair comes twice.
    """
    bin_ = "_bin"
    p = points.withColumn(bin_, F.floor(F.col(on) / width))
    r = ranges.where(F.col(start) < F.col(end)).withColumn(bin_, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(r, bin_).where((F.col(on) >= F.col(start)) & (F.col(on) < F.col(end))).drop(bin_)
