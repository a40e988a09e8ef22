"""Joins on a distance in time, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_hours(left: DataFrame, right: DataFrame, at: str, ref: str, hours: int) -> DataFrame:
    """Pairs of rows whose times are at most so many hours apart, both ways. Null times match nothing.

    The right side falls into buckets as wide as the window (a second at least); a left row looks into its bucket and both neighbours.
    """
    width = hours * 3_600_000_000
    wide = max(width, 1_000_000)
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(wide)).cast("bigint")
    a = left.withColumn("_b", F.explode(F.array(*[bucket(F.col(at)) + i for i in (-1, 0, 1)])))
    b = right.withColumn("_b", bucket(F.col(ref)))
    made = a.join(b, "_b").filter(F.abs(F.unix_micros(at) - F.unix_micros(ref)) <= width)
    return made.drop("_b")
