"""Copies that run while their source changes: splits, change drains, appends, and the equality that ends them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import multiset_fingerprint
from ..functions.grid import Grid


def regrain(rows: DataFrame, native: Column, lo: int, hi: int, grid: Grid, boundary: int | None = None) -> DataFrame:
    """Rows of a coarse range with part_lo at the finer step, the first cell cut at ``lo``. Below ``boundary`` cells are
    aged: with nothing to archive they are left out instead of being written to be dropped."""
    inside = rows.where((native >= F.lit(lo)) & (native < F.lit(hi)))
    out = inside.withColumn("part_lo", F.greatest(grid.floor(native), F.lit(lo)))
    return out if boundary is None else out.where(grid.next(grid.floor(native)) > F.lit(boundary))


def reconcile(dest: DataFrame, source: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """What ``dest`` becomes once the changed keys are taken from ``source``, which is the authority: changed keys leave
    dest and come back as they are in source now. Running it twice changes nothing."""
    touched = changed.select(*keys).distinct()
    return dest.join(touched, keys, "left_anti").unionByName(source.join(touched, keys, "left_semi"))


def drain_batch(changes: DataFrame, sequence: str, n: int, keys: list[str]) -> DataFrame:
    """Distinct keys of the n oldest changes, with the last sequence number of each."""
    return changes.orderBy(sequence).limit(n).groupBy(*keys).agg(F.max(sequence).alias(sequence))


def purge_changes(changes: DataFrame, native: Column, lo: int, hi: int) -> DataFrame:
    """Changes that can never apply, outside the copy's range, are dropped."""
    return changes.where((native >= F.lit(lo)) & (native < F.lit(hi)))


def past(rows: DataFrame, column: str, watermark, inclusive: bool = False) -> DataFrame:
    """Rows past a watermark; null means everything. The literal reaches the Parquet reader."""
    if watermark is None:
        return rows
    return rows.where(F.col(column) >= F.lit(watermark) if inclusive else F.col(column) > F.lit(watermark))


def append_batch(source: DataFrame, column: str, watermark, n: int) -> DataFrame:
    """The next n rows past the watermark with all ties of the last one's value."""
    ahead = past(source, column, watermark)
    bound = ahead.select(column).orderBy(column).limit(n).agg(F.max(column).alias("bound_"))
    return ahead.join(F.broadcast(bound), F.col(column) <= F.col("bound_"), "inner").drop("bound_")


def catch_up(source: DataFrame, dest: DataFrame, column: str, watermark, keys: list[str]) -> DataFrame:
    """The last, inclusive pass over appends: rows at or past the watermark that dest doesn't have by key."""
    return past(source, column, watermark, inclusive=True).join(dest.select(*keys), keys, "left_anti")


def late_rows(source: DataFrame, dest: DataFrame, column: str, watermark, keys: list[str]) -> DataFrame:
    """Rows that arrived below the watermark after it was read: an append copy has missed them."""
    return source.where(F.col(column) <= F.lit(watermark)).join(dest.select(*keys), keys, "left_anti")


def conserved(source: DataFrame, dest: DataFrame) -> DataFrame:
    """(source_rows, dest_rows, equal): counts and order-free fingerprints agree."""
    a = multiset_fingerprint(source).select(F.col("n").alias("source_rows"), F.col("fingerprint").alias("a"))
    b = multiset_fingerprint(dest.select(*source.columns)).select(F.col("n").alias("dest_rows"), F.col("fingerprint").alias("b"))
    both = a.crossJoin(b)  # one row each
    return both.select("source_rows", "dest_rows", ((F.col("source_rows") == F.col("dest_rows")) & (F.col("a") == F.col("b"))).alias("equal"))


def unmatched(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Source rows, as often as they are missing, that dest doesn't have: whole rows, for tables without a key."""
    return source.exceptAll(dest.select(*source.columns))


def shape_diff(source: T.StructType, dest: T.StructType) -> list[str]:
    """Columns that one schema lacks or types differently, in words."""
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (source, dest))
    found = [f"{c}: missing in the copy" for c in a if c not in b] + [f"{c}: not in the source" for c in b if c not in a]
    return found + [f"{c}: {a[c]} became {b[c]}" for c in a if c in b and a[c] != b[c]]


def preflight(rows: DataFrame, control: str, keys: list[str]) -> list[str]:
    """Why a table can't be copied: a missing control or key column, a float or null control value."""
    names = {f.name: f.dataType for f in rows.schema.fields}
    found = [f"no column {c}" for c in [control, *keys] if c not in names]
    if control in names and isinstance(names[control], (T.FloatType, T.DoubleType)):
        found.append(f"{control}: a float can't order partitions")
    if control in names and not rows.where(F.col(control).isNull()).limit(1).isEmpty():
        found.append(f"{control}: has nulls")
    return found


def time_estimate(n_bytes: int, cached: bool) -> float:
    """Seconds a copy takes at 40 MiB a second from memory, 16 from disk."""
    return n_bytes / ((40 if cached else 16) * (1 << 20))
