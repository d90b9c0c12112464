"""Invariants over rows: none lost, none twice, nothing dropped that isn't covered, nothing overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archive import coverage


def lost_rows(expected: DataFrame, live: DataFrame, archived: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that are neither live nor archived."""
    return expected.join(live.select(*keys).union(archived.select(*keys)), keys, "left_anti")


def duplicated_rows(live: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held more than once, with their count."""
    return live.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def multiset(rows: DataFrame) -> DataFrame:
    """How often each whole row occurs: the identity of tables without a key."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def uncovered_drops(dropped: DataFrame, ledger: DataFrame) -> DataFrame:
    """Dropped partitions (lo, hi) that the ledger's chunks don't cover from lo to hi without a hole.

    Retired chunks count: they are what the drop itself has marked.
    """
    return coverage(dropped, ledger.withColumn("retired", F.lit(False))).where("NOT covered").select("lo", "hi")


def clobbered_keys(ledger: DataFrame) -> DataFrame:
    """Object keys written for more than one chunk."""
    return ledger.groupBy("object_key").agg(F.count_distinct("part", "lo").alias("n")).where("n > 1")


def row_states(live: DataFrame, archived: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_live, in_archive) of every row seen anywhere."""
    a = live.select(*keys).distinct().withColumn("in_live", F.lit(True))
    b = archived.select(*keys).distinct().withColumn("in_archive", F.lit(True))
    return a.join(b, keys, "full").na.fill(False, ["in_live", "in_archive"])
