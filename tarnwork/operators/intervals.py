"""Interval joins: points in intervals, overlapping intervals, innermost and coverage.

Spark has no strategy for them, so both sides are dealt to buckets of the
line number and joined on key and bucket, with the exact test as residual. An
interval goes to the finest of the level widths in which it spans few buckets, a
point probes every level that has an interval: none is copied more than SPAN + 1
times however long it is, and a hot key is spread over its buckets. Both sides
grow with the input, so the joins ask for a merge: the size of a compact Parquet
file says little about that of its rows in a broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the levels, and the buckets that an interval spans at most at its own.
WIDTHS, SPAN = (16, 256, 4_096, 65_536, 2**24, 2**40), 16


def _level(start: Column, end: Column) -> Column:
    """The finest level at which an interval spans few buckets."""
    found = F.lit(len(WIDTHS) - 1)
    for level in reversed(range(len(WIDTHS) - 1)):
        found = F.when(end - start <= WIDTHS[level] * SPAN, F.lit(level)).otherwise(found)
    return found


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in WIDTHS]), level + 1)


def _bucket(at: Column, width: Column) -> Column:
    return F.floor(at.cast("long") / width)


def _dealt(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """intervals with __level, once for each bucket that they span."""
    width = _width(F.col("__level"))
    return intervals.withColumn("__bucket", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width))))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in zip(left, right, strict=True)])


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: Sequence[str], point: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """points joined to the intervals (closed) of the same key that hold them; how: inner, left, left_semi or left_anti.

    Null keys, points and ends join nothing. Columns of both sides stay, the keys once.
    """
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("__level", _level(F.col(start).cast("long"), F.col(end).cast("long")))
    used = i.select("__level").distinct()
    if how in ("left_semi", "left_anti"):
        # six values at most; with one level a point has one bucket, and the rows themselves are looked up
        levels = [r[0] for r in used.collect()]
        if len(levels) < 2:
            p = points.withColumn("__bucket", _bucket(F.col(point), F.lit(WIDTHS[levels[0] if levels else 0])))
            inside = _dealt(i.select(*on, start, end, "__level"), start, end).toDF(*[f"__r_{k}" for k in on], "__start", "__end", "__l", "__b").hint("merge")
            holds = _same(on, [f"__r_{k}" for k in on]) & (F.col("__bucket") == F.col("__b")) & F.col(point).between(F.col("__start"), F.col("__end"))
            return p.join(inside, holds, how).drop("__bucket")
    if how != "inner":
        # key and point decide: they are looked up once each, and no row needs a number
        keys = points.select(*on, point).distinct()
        found = points_in_intervals(keys, intervals, on, point, start, end)
        return points.join(found if how == "left" else found.select(*on, point).distinct(), [*on, point], how)
    p = points.crossJoin(F.broadcast(used)).withColumn("__bucket", _bucket(F.col(point), _width(F.col("__level"))))
    i = _dealt(i, start, end)
    keys = [*on, "__level", "__bucket"]
    rest = [f"__r_{k}" for k in keys]
    inside = i.withColumnsRenamed(dict(zip(keys, rest, strict=True))).hint("merge")
    return p.join(inside, _same(keys, rest) & F.col(point).between(F.col(start), F.col(end))).drop("__level", "__bucket", *rest)


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of closed intervals of the same key that overlap, each once.

    Of two that do, one starts inside the other: the right one, or else the
    left one behind the right one's start. Both are searches of points.
    """
    (ls, le), (rs, re_) = left_range, right_range
    left, right = left.where(F.col(ls) <= F.col(le)), right.where(F.col(rs) <= F.col(re_))
    starts_inside = points_in_intervals(right, left, on, rs, ls, le)
    return starts_inside.unionByName(points_in_intervals(left, right, on, ls, rs, re_).where(F.col(ls) > F.col(rs)))


def innermost(points: DataFrame, intervals: DataFrame, on: Sequence[str], point: str, start: str, end: str, point_id: str, interval_id: str) -> DataFrame:
    """point_id, interval_id of the shortest interval around each point, then the smallest id; points in none are left out."""
    found = points_in_intervals(points.select(point_id, *on, point), intervals.select(*on, start, end, interval_id), on, point, start, end)
    return found.groupBy(point_id).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("span"), F.col(interval_id).alias(interval_id))).alias("best")).select(point_id, F.col(f"best.{interval_id}").alias(interval_id))


def covered(points: DataFrame, intervals: DataFrame, on: Sequence[str], point: str, start: str, end: str) -> DataFrame:
    """The points that lie in any interval of their key."""
    return points_in_intervals(points, intervals, on, point, start, end, how="left_semi")
