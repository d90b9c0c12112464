"""Turns of a managed table, and functions that no query covers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.grid import DAY, Grid
from tidegrid.operators import archive, copying, integrity, lifecycle
from tidegrid.plans import registry as plans
from tidegrid.sources import archive_files

GRID = Grid("id", 10)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def table(spark, rows=100):
    return spark.range(rows).select(F.col("id").alias("k"), F.lit("x" * 10).alias("v"))


def registry(spark, *ranges):
    return spark.createDataFrame([(lo, hi, True) for lo, hi in ranges], "lo long, hi long, blocked boolean")


def test_archive_turns_cover_a_partition(spark):
    parts, led = registry(spark, (0, 40), (40, 100)), spark.createDataFrame([], lifecycle.LEDGER)
    keep = lambda chunk, lo, hi: (hi, chunk.count(), f"k{lo}")
    for _ in range(4):
        new = lifecycle.archive_step(table(spark), F.col("k"), parts, led, keep, 150, F.length("v"), 8)
        led = spark.createDataFrame(led.union(new).collect(), lifecycle.LEDGER)
    assert pairs(led, "part", "lo", "hi", "rows_archived") == [(0, 0, 15, 15), (0, 15, 30, 15), (0, 30, 40, 10), (40, 40, 55, 15)]
    assert pairs(lifecycle.retire(parts, led, F.lit(100)), "lo", "hi") == [(0, 40)]
    gone = lifecycle.retire(parts, led, F.lit(100))
    marked = lifecycle.mark_retired(led, gone)
    assert pairs(marked.where("retired"), "lo") == [(0,), (15,), (30,)] and integrity.uncovered_drops(gone, marked).isEmpty()
    assert pairs(integrity.uncovered_drops(parts.select("lo", "hi"), marked), "lo") == [(40,)]
    holed = marked.where("lo <> 15")
    assert pairs(integrity.uncovered_drops(gone, holed), "lo") == [(0,)]
    assert pairs(lifecycle.retire(parts, led, F.lit(100), archived=False, batch=1), "lo", "hi") == [(0, 40)]
    assert pairs(archive.orphaned_coverage(led, parts.where("lo > 0")), "lo") == [(0,), (15,), (30,)]
    with pytest.raises(lifecycle.ContractBreach):
        lifecycle.archive_step(table(spark), F.col("k"), parts, led, lambda c, lo, hi: (hi + 1, 0, None), 150, F.length("v"), 8)
    assert lifecycle.archive_step(table(spark), F.col("k"), parts.withColumn("blocked", F.lit(False)), led, keep, 150, F.length("v"), 8).isEmpty()


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_chunks_do_not_depend_on_cells(spark, cell):
    rows = table(spark).withColumn("k", F.call_function("div", F.col("k"), F.lit(3)))
    plan = archive.chunk_plan(rows, F.col("k"), F.lit(1), 50, F.length("v"), cell)
    assert plan.collect()[0].n_rows == 6 and plan.agg(F.sum("n_rows")).first()[0] == 100 and plan.count() == 20  # bytes before: 30 a value, cut at 50
    assert pairs(archive.next_chunk(rows, F.col("k"), 2, 30, 7, cell), "lo", "hi", "n_rows") == [(2, 5, 9)]
    assert pairs(archive.next_chunk(rows, F.col("k"), 2, 30, 9, cell), "lo", "hi", "n_rows") == [(2, 5, 9)]
    assert pairs(archive.next_chunk(rows, F.col("k"), 29, 30, 9, cell), "lo", "hi", "n_rows") == [(29, 30, 3)]
    assert pairs(archive.next_chunk(rows, F.col("k"), 90, 95, 9, cell), "lo", "hi", "n_rows") == [(90, 95, 0)]


def test_split_turns(spark):
    steps = lifecycle.regrain_steps(table(spark), F.col("k"), GRID, 5, 35, boundary=12)
    assert pairs(steps, "piece_lo", "piece_hi", "action", "n_rows") == [
        (5, 10, "regrain_aged", 0), (10, 20, "regrain_copy", 10), (20, 30, "regrain_copy", 10), (30, 35, "regrain_copy", 5), (35, 35, "regrain_swap", 25),
    ]
    seen, cursor = [], None
    while True:
        step = lifecycle.regrain_step(steps, cursor).first()
        seen.append(step.action)
        cursor = step.piece_hi
        if step.action == "regrain_swap":
            break
    assert seen == ["regrain_aged", "regrain_copy", "regrain_copy", "regrain_copy", "regrain_swap"]
    assert lifecycle.refuse_swap(steps, 12).isEmpty() and pairs(lifecycle.refuse_swap(steps, 8), "piece_lo") == [(5,)]


def test_cells_on_disk(spark, tmp_path):
    path = str(tmp_path / "cells")
    lifecycle.write_cells(table(spark), F.col("k"), GRID, path)
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.where("part_lo = 20").count() == 10
    assert "PartitionFilters: [isnotnull(part_lo" in back.where("part_lo >= 90")._jdf.queryExecution().executedPlan().toString()


def test_extend_by_months(spark):
    months = Grid("time", months=1)
    jan = 1_704_067_200_000_000
    held = spark.createDataFrame([(jan, jan + 31 * DAY)], "lo long, hi long")
    got = pairs(plans.extend_to(held, months, jan + 70 * DAY), "lo", "hi")
    assert got == [(jan + 31 * DAY, jan + 60 * DAY), (jan + 60 * DAY, jan + 91 * DAY)]
    assert plans.extend_to(held, months, jan).count() == 0 and plans.extend_to(held.limit(0), months, jan).count() == 0


def test_refusals(spark):
    recorded = spark.createDataFrame([("k1", "d1")], "object_key string, digest string")
    archive_files.refuse_overwrite(recorded, "k1", "d1")
    archive_files.refuse_overwrite(recorded, "k2", "d9")
    with pytest.raises(archive_files.NotWritten):
        archive_files.refuse_overwrite(recorded, "k1", "d2")
    for lo, hi in ((5, 5), (6, 5)):
        with pytest.raises(archive_files.NotWritten):
            archive_files.refuse_empty(lo, hi)


def test_clock_skew_and_purge(spark):
    rows = spark.createDataFrame([(1,), (25,)], "k long")
    assert plans.skewed(rows, F.col("k"), GRID, now=10, hour=3).first().refused and not plans.skewed(rows, F.col("k"), GRID, now=12, hour=3).first().refused
    assert pairs(copying.purge_changes(rows, F.col("k"), 0, 20), "k") == [(1,)]
