"""A managed table's turns: archive a chunk, retire what is covered, split a coarse partition piece by piece.

What is decided is a DataFrame; only the few partitions of one turn, bounded by ``batch``, come to the driver, since each
of them is a write of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..plans.registry import pieces
from .archive import chunk_plan, contract_breaches, coverage

LEDGER = "part long, lo long, hi long, rows_archived long, object_key string, retired boolean"
#: (rows of the chunk, its lo, its hi) to (covered_hi, rows_archived, object_key)
Strategy = Callable[[DataFrame, int, int], tuple[int, int, str | None]]


class ContractBreach(RuntimeError):
    """An archive strategy returned coverage outside its chunk; nothing is recorded."""


def archive_step(rows: DataFrame, native: Column, registry: DataFrame, ledger: DataFrame, run: Strategy, budget: int, width: Column, cell: int, batch: int = 1) -> DataFrame:
    """Ledger rows of one turn: the next chunk of up to ``batch`` partitions, oldest first.

    Only partitions (lo, hi, blocked) that no writer reaches any more are taken, and of these the ones that the ledger
    doesn't cover. A chunk goes on where coverage ends, holds about ``budget`` bytes and all ties of its last value; the
    last one of a partition reaches the partition's end, and an empty one is a chunk of no rows.
    """
    due = coverage(registry.where("blocked"), ledger).where("NOT covered").orderBy("lo").limit(batch)
    found = []
    for part in due.select("lo", "hi", F.coalesce("covered_hi", "lo").alias("start")).collect():
        left = rows.where((native >= F.lit(part.start)) & (native < F.lit(part.hi)))
        ahead = chunk_plan(left, native, F.lit(0), budget, width, cell).where("chunk <= 2").orderBy("chunk").collect()
        hi = ahead[1].lo if len(ahead) > 1 else part.hi
        found.append((part, hi, run(left.where(native < F.lit(hi)), part.start, hi)))
    results = registry.sparkSession.createDataFrame([(p.lo, p.start, hi, *result, False) for p, hi, result in found], LEDGER.replace("hi long", "hi long, covered_hi long"))
    bad: Row | None = contract_breaches(results).first()
    if bad is not None:
        raise ContractBreach(f"covered_hi {bad.covered_hi} for the chunk [{bad.lo}, {bad.hi})")
    return results.drop("hi").withColumnRenamed("covered_hi", "hi").select("part", "lo", "hi", "rows_archived", "object_key", "retired")


def retire(registry: DataFrame, ledger: DataFrame, boundary: Column, archived: bool = True, batch: int | None = None) -> DataFrame:
    """(lo, hi) of partitions to drop, oldest first: wholly at or below the boundary and, where the table archives,
    covered by the ledger without a hole."""
    due = registry.where(F.col("hi") <= boundary)
    if archived:
        due = coverage(due, ledger).where("covered")
    due = due.select("lo", "hi")
    return due if batch is None else due.orderBy("lo").limit(batch)


def mark_retired(ledger: DataFrame, dropped: DataFrame) -> DataFrame:
    """The ledger with the chunks of dropped partitions marked: they stay as the record of where the rows went."""
    gone = dropped.select(F.col("lo").alias("part"), F.lit(True).alias("gone"))
    return ledger.join(gone, "part", "left").withColumn("retired", F.col("retired") | F.coalesce("gone", F.lit(False))).drop("gone").select(*ledger.columns)


def regrain_steps(rows: DataFrame, native: Column, grid: Grid, lo: int, hi: int, boundary: int | None = None) -> DataFrame:
    """(piece_lo, piece_hi, action, n_rows) of all steps that split [lo, hi): a copy for each piece, regrain_aged for
    those wholly below ``boundary``, whose rows are not copied, and the swap at ``hi``, with all copied rows."""
    whole = rows.sparkSession.range(1).select(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    inside = rows.where((native >= F.lit(lo)) & (native < F.lit(hi)))
    held = inside.groupBy(F.greatest(grid.floor(native), F.lit(lo)).alias("piece_lo")).agg(F.count(F.lit(1)).alias("n"))
    aged = F.lit(False) if boundary is None else F.col("piece_hi") <= F.lit(boundary)
    steps = pieces(whole, grid).join(held, "piece_lo", "left").select(
        "piece_lo", "piece_hi", F.when(aged, "regrain_aged").otherwise("regrain_copy").alias("action"), F.when(aged, 0).otherwise(F.coalesce("n", F.lit(0))).alias("n_rows")
    )
    swap = steps.agg(F.sum("n_rows").alias("n_rows")).select(F.lit(hi).cast("long").alias("piece_lo"), F.lit(hi).cast("long").alias("piece_hi"), F.lit("regrain_swap").alias("action"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    return steps.union(swap)


def regrain_step(steps: DataFrame, cursor: int | None) -> DataFrame:
    """The one step that a run does next: the first at or past the cursor, which is the piece_hi of the step before."""
    left = steps if cursor is None else steps.where(F.col("piece_lo") >= F.lit(cursor))
    return left.orderBy("piece_lo", "piece_hi").limit(1)


def refuse_swap(steps: DataFrame, boundary: int | None) -> DataFrame:
    """Aged steps that a looser retention has since taken back: the swap would lose their rows."""
    skipped = steps.where("action = 'regrain_aged'")
    return skipped if boundary is None else skipped.where(F.col("piece_hi") > F.lit(boundary))


def write_cells(rows: DataFrame, native: Column, grid: Grid, path: str, mode: str = "errorifexists") -> None:
    """Rows as one folder a cell, part_lo=<lo>: a reader's range on part_lo opens only the cells it meets. Rows are
    dealt by cell and by a hash of the value, so that a cell of any size is many tasks and files."""
    out = rows.withColumn("part_lo", grid.floor(native))
    out.repartition("part_lo", F.pmod(F.xxhash64(native), F.lit(8))).write.mode(mode).partitionBy("part_lo").parquet(path)


FAILURES = (
    "fail_retain_drop", "fail_retain_crossing", "fail_retain_detach", "fail_retain_identity", "fail_archive_identity",
    "fail_write_block_identity", "fail_archive_contract", "fail_retain_reattach", "fail_retain_recall",
)


def status(settings: DataFrame, registry: DataFrame, log: DataFrame, keys: DataFrame) -> DataFrame:
    """One row a managed table.

    ``settings``: parent, control_kind, partition_step, obtain, retain, paused, regrain_to, parent_missing, boundary (of
    retention, null without one). ``registry``: parent, lo, hi, coarse, state (attached, copying, detaching). ``log``:
    parent, ts, action, lo. ``keys``: parent, suspended, validated. Every part is a group-by on parent; failures
    count since the last drop, skips are the most that one partition has had since its last chunk.
    """
    on, attached = F.count_if, F.col("state") == "attached"
    parts = registry.groupBy("parent").agg(
        on(attached).alias("n_partitions"), on(attached & F.col("coarse")).alias("coarse_partitions"), on(F.col("state") == "copying").alias("inflight_partitions"),
        F.max(F.when(attached, F.col("hi"))).alias("newest_bound"), on(F.col("state") == "detaching").alias("retain_detaching"),
    )
    due = registry.where(attached).join(settings.select("parent", "boundary"), "parent").groupBy("parent").agg(on(F.col("hi") <= F.col("boundary")).alias("retain_backlog"))
    dropped = log.groupBy("parent").agg(F.max(F.when(F.col("action") == "retain_drop", F.col("ts"))).alias("dropped"))
    failed = log.where(F.col("action").isin(*FAILURES)).join(dropped, "parent").where(F.col("dropped").isNull() | (F.col("ts") > F.col("dropped")))
    failed = failed.groupBy("parent").agg(F.count(F.lit(1)).alias("retain_drop_failures"))
    done = log.groupBy("parent", "lo").agg(F.max(F.when(F.col("action") == "archive_chunk", F.col("ts"))).alias("done"))
    skips = log.where("action = 'skip_archive'").join(done.withColumnRenamed("lo", "lo2"), [log["parent"] == done["parent"], F.col("lo").eqNullSafe(F.col("lo2"))]).drop(done["parent"])
    skips = skips.where(F.col("done").isNull() | (F.col("ts") > F.col("done"))).groupBy("parent", "lo").agg(F.count(F.lit(1)).alias("n"))
    skips = skips.groupBy("parent").agg(F.max("n").alias("archive_skips"))
    refs = keys.groupBy("parent").agg(on(F.col("suspended")).alias("fks_suspended"), on(~F.col("suspended") & ~F.col("validated")).alias("fks_unvalidated"))
    out = settings
    for each in (parts, due, failed, skips, refs):
        out = out.join(each, "parent", "left")
    counts = ("n_partitions", "coarse_partitions", "inflight_partitions", "fks_suspended", "fks_unvalidated", "retain_drop_failures", "retain_detaching", "archive_skips")
    gone = F.col("parent_missing")
    return out.na.fill(0, list(counts)).select(
        "parent", "control_kind", "partition_step", "obtain", "retain", "paused",
        *[F.when(gone, 0).otherwise(F.col(c)).alias(c) for c in ("n_partitions", "coarse_partitions")], "inflight_partitions",
        F.when(~gone, F.col("newest_bound")).alias("newest_bound"), "fks_suspended", "fks_unvalidated",
        (~gone & (F.col("coarse_partitions") > 0)).alias("history_unregrained"), "retain_drop_failures",
        F.when(~gone & F.col("boundary").isNotNull(), F.coalesce("retain_backlog", F.lit(0))).alias("retain_backlog"), "retain_detaching", "parent_missing", "regrain_to", "archive_skips",
    )


def progress(settings: DataFrame, registry: DataFrame, copied: DataFrame, now: int) -> DataFrame:
    """One row a managed table: when its write partition freezes, and how far its split has come.

    ``settings``: parent, control_kind, frontier, regrain_to, regrain_lo (of the partition being split, or null),
    regrain_cursor, regrain_started (microseconds). ``registry``: parent, lo, hi, coarse of attached partitions.
    ``copied``: parent, rows of the copies made so far. The clock kinds get freeze_in, ids don't: their frontier has no
    rate. eta is what is left of the range at the speed so far.
    """
    parts = registry.join(settings.select("parent", "frontier", "regrain_lo"), "parent")
    here = (F.col("lo") <= F.col("frontier")) & (F.col("frontier") < F.col("hi"))
    split = F.col("lo") == F.col("regrain_lo")
    each = parts.groupBy("parent").agg(
        F.min(F.when(here, F.col("lo"))).alias("write_child"), F.min(F.when(here, F.col("hi"))).alias("write_ceiling"),
        F.count_if(F.col("coarse") & (F.col("hi") <= F.col("frontier"))).alias("coarse_frozen"), F.min(F.when(split, F.col("hi"))).alias("regrain_hi"),
    )
    rows = copied.groupBy("parent").agg(F.sum("rows").alias("regrain_rows_copied"))
    margin, elapsed = F.col("write_ceiling") - F.col("frontier"), F.lit(now) - F.col("regrain_started")
    share = (F.col("regrain_cursor") - F.col("regrain_lo")) / F.nullif(F.col("regrain_hi") - F.col("regrain_lo"), F.lit(0))
    out = settings.join(each, "parent", "left").join(rows, "parent", "left").withColumn("share", share)
    busy = F.col("regrain_cursor").isNotNull()
    return out.select(
        "parent", "control_kind", "frontier", "write_child", "write_ceiling", margin.alias("freeze_margin"), F.when(F.col("control_kind") != "id", margin).alias("freeze_in"),
        F.coalesce("coarse_frozen", F.lit(0)).alias("coarse_frozen"), "regrain_to", F.when(busy, F.col("regrain_lo")).alias("regrain_child"), "regrain_cursor", F.col("share").alias("regrain_pct_range"),
        F.when(busy, F.coalesce("regrain_rows_copied", F.lit(0))).alias("regrain_rows_copied"), F.when(busy, elapsed).alias("regrain_elapsed"),
        F.when(busy & (F.col("share") > 0), F.floor(elapsed * (1 - F.col("share")) / F.col("share"))).alias("regrain_eta"),
    )
