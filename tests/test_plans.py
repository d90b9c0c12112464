"""Lifecycle rules, files and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.grid import DAY, Grid
from tidegrid.operators import copying, reports
from tidegrid.plans import registry as plans
from tidegrid.plans.config import Refused, TableConfig, control_kind
from tidegrid.sources import archive_files
from tidegrid.streaming import drains


def ranges(df):
    return sorted((r.lo, r.hi) for r in df.collect())


def registry(spark, *rows):
    return spark.createDataFrame(list(rows), "lo long, hi long")


def test_transmute_bounds_and_obtain(spark):
    ids = spark.range(1, 50_001)
    grid = Grid("id", 10_000)
    assert ranges(plans.transmute_bounds(ids, F.col("id"), grid)) == [(0, 60_000)]
    held = registry(spark, (0, 60_000))
    assert ranges(plans.obtain(held, grid, F.lit(50_000), 3)) == [(60_000, 70_000), (70_000, 80_000), (80_000, 90_000)]
    assert ranges(plans.extend_to(held, grid, 75_000)) == [(60_000, 70_000), (70_000, 80_000)]
    with pytest.raises(Exception, match="more cells"):
        plans.extend_to(held, grid, 10_000_000, most=5).collect()


def test_retention(spark):
    grid = Grid("id", 10_000)
    held = registry(spark, *[(k * 10_000, (k + 1) * 10_000) for k in range(11)], (-50_000, 85_000))
    due = plans.retain_plan(held, plans.retain_boundary(grid, F.lit(110_000), 30_000))
    assert [hi for _, hi in ranges(due)] == [10_000 * k for k in range(1, 9)]
    assert ranges(plans.straddling(held, F.lit(80_000))) == [(-50_000, 85_000)]
    config = TableConfig("t", "id", grid)
    with pytest.raises(Refused):
        config.set_retain(30_000, held, 110_000)
    assert config.set_retain(30_000, held, 110_000, force=True).retain == 30_000


def test_pieces_are_cut_at_the_range(spark):
    cut = plans.pieces(registry(spark, (2500, 7250)), Grid("id", 1000)).collect()
    assert [(r.piece_lo, r.piece_hi) for r in cut] == [(2500, 3000), (3000, 4000), (4000, 5000), (5000, 6000), (6000, 7000), (7000, 7250)]
    year = registry(spark, (1_704_067_200_000_000, 1_704_067_200_000_000 + 366 * DAY))
    assert plans.pieces(year, Grid("time", months=1)).count() == 12
    assert [r.reason for r in plans.check_adoption(registry(spark, (0, 1000)), Grid("id", 1000), 500, 1500).collect()] == ["off grid", "overlaps"]


def test_kinds_and_shapes():
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    assert control_kind(schema, "a") == "id" and control_kind(schema, "c") == "uuidv7"
    with pytest.raises(Refused):
        control_kind(schema, "b")
    other = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("c", T.StringType())])
    assert copying.shape_diff(schema, other) == ["b: missing in the copy", "a: bigint became int"]


def test_monotonic_and_orphans(spark):
    rows = spark.createDataFrame([(k, k if k % 10 else -k) for k in range(100)], "id long, at long")
    got = reports.monotonic(rows, "id", "at", 7).first()
    assert (got.pairs, got.in_order) == (99, 90)
    assert reports.monotonic(rows.limit(0), "id", "at", 7).first().fraction is None
    parent = spark.createDataFrame([(1, 1)], "t int, i int")
    child = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (None, None)], "a int, b int")
    on = [("a", "t"), ("b", "i")]
    assert reports.fk_orphans(child, parent, on).count() == 1
    assert reports.fk_orphans(child, parent, on, full=True).count() == 2


def test_archive_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k % 3 else "x", [k]) for k in range(50)], "id long, text string, list array<long>")
    assert archive_files.write_ndjson(rows, str(tmp_path / "a"), ["id"], compress=True) == 50
    assert archive_files.write_parquet(rows, str(tmp_path / "b"), ["id"]) == 50
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        archive_files.write_parquet(rows, str(tmp_path / "b"), ["id"])
    with pytest.raises(archive_files.NotWritten):
        archive_files.write_parquet(rows.select(F.struct("id").alias("s")), str(tmp_path / "c"), ["s"])


def test_drains(spark, tmp_path):
    source = spark.createDataFrame([(k, f"new{k}") for k in range(10) if k != 3], "id long, v string")
    spark.createDataFrame([(k, f"old{k}") for k in range(10)], "id long, v string").write.parquet(str(tmp_path / "copy/v0"))
    spark.createDataFrame([(3, 1), (5, 2), (5, 3)], "id long, seq long").write.parquet(str(tmp_path / "changes"))
    changes = drains.stream(spark, str(tmp_path / "changes"), T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.LongType())]))
    drains.drain_changes(changes, lambda: source, str(tmp_path / "copy"), ["id"], str(tmp_path / "check"))
    last = sorted((tmp_path / "copy").iterdir())[-1]
    got = {r.id: r.v for r in spark.read.parquet(str(last)).collect()}
    assert got == {k: "new5" if k == 5 else f"old{k}" for k in range(10) if k != 3}


def test_appends_and_late_rows(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    rows = drains.stream(spark, str(tmp_path / "in"), T.StructType([T.StructField("id", T.LongType())]))
    drains.drain_appends(rows, str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "late"), 14, "id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and spark.read.parquet(str(tmp_path / "late")).count() == 15


def test_conservation(spark):
    rows = spark.range(100).withColumn("at", F.lit(dt.date(2024, 1, 1)))
    assert copying.conserved(rows, rows.repartition(3)).first().equal
    assert not copying.conserved(rows, rows.where("id <> 7")).first().equal
