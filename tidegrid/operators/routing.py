"""Where rows belong. On a grid it is an expression; in an irregular registry a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid


def with_cell(rows: DataFrame, native: Column, grid: Grid) -> DataFrame:
    """Rows with part_lo, their cell's lower bound: a projection, no join and no shuffle."""
    return rows.withColumn("part_lo", grid.floor(native))


def route(rows: DataFrame, native: Column, registry: DataFrame, bucket: int) -> DataFrame:
    """Rows with the (part_lo, part_hi) of the registry range that holds them; rows that none holds have nulls.

    Ranges are spread over buckets of ``bucket`` native units and rows are joined on theirs, an equi-join whose sides
    Spark sizes itself: a small registry is broadcast, a large one is shuffled.
    """
    spread = registry.select(
        F.col("lo").alias("part_lo"), F.col("hi").alias("part_hi"),
        F.explode(F.sequence(_bucket(F.col("lo"), bucket), _bucket(F.col("hi") - 1, bucket))).alias("part_bucket"),
    )
    keyed = rows.withColumn("native_", native).withColumn("part_bucket", _bucket(F.col("native_"), bucket))
    inside = (F.col("native_") >= F.col("part_lo")) & (F.col("native_") < F.col("part_hi"))
    joined = keyed.alias("r").join(spread.alias("p"), (F.col("r.part_bucket") == F.col("p.part_bucket")) & inside, "left")
    return joined.select(*[F.col(f"r.`{c}`") for c in rows.columns], "part_lo", "part_hi")


def _bucket(value: Column, width: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width)).cast("long")


def range_scan(rows: DataFrame, column: str, lo, hi) -> DataFrame:
    """Half-open range of the raw column: the predicate reaches the Parquet reader."""
    return rows.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))


def refused_writes(rows: DataFrame, native: Column, registry: DataFrame, bucket: int) -> DataFrame:
    """Rows that no partition covers: there is no default partition, so they may not be written."""
    return route(rows, native, registry, bucket).where("part_lo IS NULL").drop("part_lo", "part_hi")
