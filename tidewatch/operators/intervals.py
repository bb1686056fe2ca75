"""Points in intervals of the same key, by slices of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str, days: int = 7) -> DataFrame:
    """The pairs of a point and an interval of equal ``key`` with low <= at <= high, each once.

    An interval goes to every slice of ``days`` days that it touches, a point to its own: the join is on key and slice, so a busy key's
    points are many groups and meet only intervals near in time; the edges are compared exactly. Rows with a null in any of
    these columns have no pair.
    """
    n = lambda c: F.floor(F.unix_micros(c) / F.lit(days * 86_400_000_000)).cast("long")
    spans = intervals.where(F.col(low) <= F.col(high)).withColumn("_slice", F.explode(F.sequence(n(F.col(low)), n(F.col(high)))))
    return points.withColumn("_slice", n(F.col(at))).join(spans, [key, "_slice"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_slice")
