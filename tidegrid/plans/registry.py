"""Partition registries and the plans made from them.

A registry is a DataFrame (lo, hi) of half-open ranges in native space, one row a partition, plus whatever else the
caller keeps there. Plans are DataFrames too: cells to add, partitions past a horizon, pieces of a coarse one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid


def transmute_bounds(rows: DataFrame, native: Column, grid: Grid, now: int | None = None, headroom: int = 0) -> DataFrame:
    """(lo, hi, n_rows) of the single partition that a table becomes: floor of the least value to the first grid point
    above the frontier, ``headroom`` steps on. The frontier of a time grid is the later of the greatest value and now."""
    least = rows.agg(F.min(native).alias("least"), F.max(native).alias("most"), F.count(F.lit(1)).alias("n_rows"))
    top = F.greatest("most", F.lit(now)) if now is not None else F.col("most")
    return least.select(grid.floor(F.col("least")).alias("lo"), grid.next(grid.floor(top), 1 + headroom).alias("hi"), "n_rows")


def frontier(rows: DataFrame, native: Column, now: int | None = None) -> DataFrame:
    """(frontier): the greatest value; with a clock, the later of the two; the clock alone for an empty table."""
    most = F.max(native)
    return rows.agg((most if now is None else F.greatest(most, F.lit(now))).alias("frontier"))


def skewed(rows: DataFrame, native: Column, grid: Grid, now: int, hour: int = 3_600_000_000) -> DataFrame:
    """(newest, refused): whether the newest value lies more than one step and an hour past the clock."""
    newest = rows.agg(F.max(native).alias("newest"))
    return newest.select("newest", (F.col("newest") > grid.next(F.lit(now)) + hour if not grid.months else F.col("newest") > grid.next(grid.floor(F.lit(now))) + hour).alias("refused"))


def cells(top: DataFrame, grid: Grid, count: int) -> DataFrame:
    """(lo, hi) of the cell of ``top``, a frame of one frontier, and the ``count`` after it; none for a null frontier."""
    start = grid.floor(F.col("frontier"))
    steps = top.where(F.col("frontier").isNotNull()).select("frontier", F.explode(F.sequence(F.lit(0), F.lit(count))).alias("k"))
    return steps.select(grid.next(start, F.col("k")).alias("lo"), grid.next(start, F.col("k") + 1).alias("hi"))


def overlapping(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join of ranges that share a point: half-open, so ranges that touch don't. ``right`` has columns lo2, hi2."""
    return left.join(right, (F.col("lo") < F.col("hi2")) & (F.col("lo2") < F.col("hi")), how)


def obtain(registry: DataFrame, grid: Grid, top: DataFrame | Column, ahead: int) -> DataFrame:
    """Cells to add so that ``ahead`` steps past the frontier exist: those that overlap no attached range.

    The frontier is a frame of one, as frontier() gives, or a literal.
    """
    if isinstance(top, Column):
        top = registry.sparkSession.range(1).select(top.alias("frontier"))
    held = registry.select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return overlapping(cells(top, grid, ahead), held, "left_anti")


def extend_to(registry: DataFrame, grid: Grid, value: int, most: int = 10_000) -> DataFrame:
    """Cells from the registry's top up to the value's own; refused if they are more than ``most``.

    No more than ``most`` + 1 cells are tried. An empty registry, or a value below its top, gives none.
    """
    tried = registry.agg(F.max("hi").alias("top")).where(F.col("top").isNotNull()).select("top", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"))
    found = tried.select("k", grid.next(F.col("top"), F.col("k")).alias("lo"), grid.next(F.col("top"), F.col("k") + 1).alias("hi"))
    found = found.where(F.col("lo") <= grid.floor(F.lit(value)))
    many = F.when(F.col("k") >= most, F.raise_error(F.lit("more cells than allowed")).cast("long")).otherwise(F.col("lo"))
    return found.select(many.alias("lo"), "hi")


def marked(registry: DataFrame, grid: Grid, frontier_value: Column) -> DataFrame:
    """The registry with ``coarse`` (wider than a step) and ``frozen`` (wholly below the frontier)."""
    return registry.withColumn("coarse", F.col("hi") > grid.next(F.col("lo"))).withColumn("frozen", F.col("hi") <= frontier_value)


def retain_boundary(grid: Grid, frontier_value: Column, keep: int = 0, keep_days: int = 0, keep_months: int = 0) -> Column:
    """Grid floor of the retention horizon. Months and days move the wall clock of the grid's zone, ``keep`` (a number,
    or microseconds) is taken off the value itself; the horizon never lies past the frontier less ``keep``."""
    at = frontier_value
    if keep_days or keep_months:
        local = F.from_utc_timestamp(F.timestamp_micros(at), grid.tz)
        back = local - F.make_interval(months=F.lit(keep_months), days=F.lit(keep_days))
        at = F.least(F.unix_micros(F.to_utc_timestamp(back, grid.tz)), at)
    return grid.floor(at - F.lit(keep))


def retain_plan(registry: DataFrame, boundary: Column, batch: int | None = None) -> DataFrame:
    """Partitions that retention may drop, oldest first: the whole range lies at or below the boundary."""
    due = registry.where(F.col("hi") <= boundary)
    return due if batch is None else due.orderBy("lo").limit(batch)


def straddling(registry: DataFrame, boundary: Column) -> DataFrame:
    """Partitions that the boundary cuts: they stay, whole."""
    return registry.where((F.col("lo") < boundary) & (F.col("hi") > boundary))


def pieces(registry: DataFrame, grid: Grid) -> DataFrame:
    """A coarse partition's cells at the grid's step, the first and last cut at its own bounds: registry columns plus
    piece_lo, piece_hi."""
    start = grid.floor(F.col("lo"))
    if grid.months:
        span = F.ceil((F.col("hi") - start) / F.lit(28 * 86_400_000_000 * grid.months))
    else:
        span = F.ceil((F.col("hi") - start) / F.lit(grid.step))
    each = registry.withColumn("k", F.explode(F.sequence(F.lit(0), (span - 1).cast("int"))))
    low, high = grid.next(start, F.col("k")), grid.next(start, F.col("k") + 1)
    cut = each.withColumn("piece_lo", F.greatest("lo", low)).withColumn("piece_hi", F.least("hi", high)).drop("k")
    return cut.where("piece_lo < piece_hi")


def check_adoption(registry: DataFrame, grid: Grid, lo: int, hi: int) -> DataFrame:
    """(reason): why a range may not be taken into the registry; no rows if it may."""
    one = registry.sparkSession.range(1).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    off = one.where((grid.floor(F.col("lo")) != F.col("lo")) | (grid.floor(F.col("hi")) != F.col("hi"))).select(F.lit("off grid").alias("reason"))
    empty = one.where("lo >= hi").select(F.lit("empty range").alias("reason"))
    held = overlapping(one, registry.select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))).select(F.lit("overlaps").alias("reason")).limit(1)
    return off.union(empty).union(held)
