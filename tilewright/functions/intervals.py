"""Predicates and joins of integer intervals [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near(s1: Column, e1: Column, s2: Column, e2: Column, min_gap: int) -> Column:
    """Overlap, touch, or lie less than min_gap apart."""
    g = max(min_gap, 1)
    return (s2 - e1 < g) & (s1 - e2 < g)


def shared_fraction(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length over the shorter one's length; 0 where nothing is shared."""
    shared, shorter = F.least(e1, e2) - F.greatest(s1, s2), F.least(e1 - s1, e2 - s2)
    return F.when((shared > 0) & (shorter > 0), shared / shorter).otherwise(0.0)


def _cells(d: DataFrame, extra: int, width: int) -> DataFrame:
    """d with a row for each cell (_cell) of a grid of `width` that an interval and `extra` places beside it touch."""
    return d.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("start") - extra) / width), F.floor((F.greatest(F.col("end") - 1, F.col("start")) + extra) / width))))


def crowding(intervals: DataFrame, group: str, reach: int, width: int) -> int:
    """At most so many pairs meet where `neighbours` joins the intervals with themselves."""
    met = _cells(intervals.select(group, "start", "end"), reach, width).groupBy(group, "_cell").agg(F.count("*").cast("double").alias("n"))
    return int(met.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)


def neighbours(left: DataFrame, right: DataFrame, group: str, reach: int, width: int) -> DataFrame:
    """Pairs (l, r) of intervals of one group that may lie less than `reach` apart, each once, without comparing whole groups.

    Both sides have group, start, end. Intervals are dealt to the cells of a grid of `width` that they touch; a pair meets in the
    first cell that both touch, so the equi-join's keys are (group, cell) and a long group is split over many keys.
    """
    first = lambda s, extra: F.floor((F.col(s) - extra) / width)
    l, r = _cells(left, reach, width).alias("l"), _cells(right, 0, width).alias("r")
    return l.join(r, (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col("l._cell") == F.col("r._cell")) & (F.col("l._cell") == F.greatest(first("l.start", reach), first("r.start", 0))))
