"""Joins of points and intervals on a line, by pages.

Both sides get the numbers of the pages they touch; rows meet on equal pages, then on the
exact condition.  An interval of the 16-bit line touches 256 pages at most; on longer lines
the page grows with ``bits``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_BITS = 8


def _pages(rows: DataFrame, start: str, end: str, bits: int) -> DataFrame:
    return rows.where(F.col(end) >= F.col(start)).withColumn("_page", F.explode(F.sequence(F.shiftright(start, bits), F.shiftright(end, bits))))


def points_in(points: DataFrame, intervals: DataFrame, point: str = "addr", keys: tuple[str, ...] = (), bits: int = PAGE_BITS) -> DataFrame:
    """All (point, interval) pairs with ``start <= point <= end`` and equal ``keys``."""
    p = points.withColumn("_page", F.shiftright(point, bits))
    return p.join(_pages(intervals, "start", "end", bits), ["_page", *keys]).where(F.col(point).between(F.col("start"), F.col("end"))).drop("_page")


def smallest_containing(points: DataFrame, intervals: DataFrame, point: str = "addr", keys: tuple[str, ...] = (), exact_first: bool = True, bits: int = PAGE_BITS) -> DataFrame:
    """Every point with its smallest interval, if any; an interval that starts there comes first if ``exact_first``."""
    rest = [c for c in intervals.columns if c not in keys]
    p = points.select(point, *keys).distinct()
    hits = points_in(p, intervals, point, keys, bits)
    # the smallest rank, so one pre-aggregated minimum and no sort
    exact = F.when(F.col("start") == F.col(point), 0).otherwise(1) if exact_first else F.lit(0)
    best = hits.groupBy(point, *keys).agg(F.min_by(F.struct(*rest), F.struct(exact, F.col("end") - F.col("start"), F.col("start"))).alias("_x"))
    return points.join(best, [point, *keys], "left").select(*points.columns, *[F.col(f"_x.{c}").alias(c) for c in rest])


def containing_intervals(inner: DataFrame, outer: DataFrame, keys: tuple[str, ...] = (), bits: int = PAGE_BITS) -> DataFrame:
    """``inner`` rows with the outer intervals that hold them whole, as ``outer_start, outer_end``."""
    o = _pages(outer.select(*keys, F.col("start").alias("outer_start"), F.col("end").alias("outer_end")), "outer_start", "outer_end", bits)
    i = inner.withColumn("_page", F.shiftright("start", bits))
    return i.join(o, ["_page", *keys]).where("outer_start <= start and end <= outer_end").drop("_page")


def count_callers(routines: DataFrame, edges: DataFrame, keys: tuple[str, ...] = (), bits: int = PAGE_BITS) -> DataFrame:
    """Every routine with its distinct sources of edges into its range; inner ones count too."""
    hits = points_in(edges.select(*keys, "src", "dst"), routines.select(*keys, "start", "end"), "dst", keys, bits)
    n = hits.groupBy(*keys, "start", "end").agg(F.count_distinct("src").alias("callers"))
    return routines.join(n, [*keys, "start", "end"], "left").withColumn("callers", F.coalesce("callers", F.lit(0).cast("long")))


def routine_edges(routines: DataFrame, edges: DataFrame, keys: tuple[str, ...] = (), bits: int = PAGE_BITS) -> DataFrame:
    """``caller, callee``: edges between routines by their starts, distinct, none to itself."""
    r = routines.select(*keys, "start", "end")
    a = smallest_containing(edges.select(*keys, "src", "dst"), r, "src", keys, False, bits).withColumnRenamed("start", "caller").drop("end")
    b = smallest_containing(a.where("caller is not null"), r, "dst", keys, False, bits).withColumnRenamed("start", "callee")
    return b.where("callee is not null and caller <> callee").select(*keys, "caller", "callee").distinct()
