"""Reports on keys, tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Plausible ids decode to 2015-01-01 or later, and not past the clock; in the future is an hour past it.
OLDEST, LATE = 1_420_070_400_000_000, 3_600_000_000


def plausibility(rows: DataFrame, native: Column, now: int, oldest: int = OLDEST, sample: int | None = None) -> DataFrame:
    """(sampled, plausible, fraction, oldest, newest, newest_in_future) of a decoded key; undecodable ones count as
    implausible. ``sample`` reads that many rows, all without it."""
    few = rows.select(native.alias("native"))
    few = few if sample is None else few.limit(sample)
    good = F.col("native").between(oldest, now)
    return few.agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(good).alias("plausible"),
        (F.count_if(good) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("fraction"),
        F.min("native").alias("oldest"), F.max("native").alias("newest"),
        F.coalesce(F.max("native") > now + LATE, F.lit(False)).alias("newest_in_future"),
    )


def monotonic(rows: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """(pairs, in_order, fraction): neighbours by key whose time doesn't fall.

    Keys are cut into ranges of ``width``; neighbours inside one are a window of its own, and each range's first and
    last rows (a few numbers a range) give the pairs across ranges. No window runs over the whole table.
    """
    part = F.call_function("div", F.col(key) - F.pmod(F.col(key), F.lit(width)), F.lit(width))
    cut = rows.select(F.col(key).alias("k"), F.col(time).alias("t"), part.alias("part"))
    before = F.lag("t").over(Window.partitionBy("part").orderBy("k", "t"))
    inside = cut.withColumn("before", before).groupBy("part").agg(
        F.count("before").alias("pairs"), F.count_if(F.col("t") >= F.col("before")).alias("in_order"),
        F.min_by("t", F.struct("k", "t")).alias("first"), F.max_by("t", F.struct("k", "t")).alias("last"),
    )
    each = inside
    for _ in range(2):  # ranges of ranges, so that the last window has one row for width ** 3 keys
        wider = F.call_function("div", F.col("part") - F.pmod(F.col("part"), F.lit(width)), F.lit(width))
        each = _joined(each.withColumn("wider", wider), Window.partitionBy("wider").orderBy("part")).groupBy("wider").agg(
            F.sum("pairs").alias("pairs"), F.sum("in_order").alias("in_order"), F.min_by("first", "part").alias("first"), F.max_by("last", "part").alias("last")
        ).withColumnRenamed("wider", "part")
    total = _joined(each, Window.orderBy("part")).agg(F.sum("pairs").alias("pairs"), F.sum("in_order").alias("in_order"))
    return total.select(F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("in_order", F.lit(0)).alias("in_order"), (F.col("in_order") / F.nullif(F.col("pairs"), F.lit(0))).alias("fraction"))


def _joined(ranges: DataFrame, window) -> DataFrame:
    """Ranges whose counts also hold the pair of their first row and the last row of the range before."""
    ahead = ranges.withColumn("ahead", F.lag("last").over(window))
    more = F.col("pairs") + F.when(F.col("first").isNotNull() & F.col("ahead").isNotNull(), 1).otherwise(0)
    right = F.col("in_order") + F.coalesce((F.col("first") >= F.col("ahead")).cast("long"), F.lit(0))
    return ahead.withColumn("pairs", more).withColumn("in_order", right)


def fk_orphans(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]], full: bool = False) -> DataFrame:
    """Child rows that refer to no parent. SIMPLE: a null in the key refers to nothing and is no orphan. FULL: all null
    is none, partly null is one."""
    nulls = [F.col(c).isNull() for c, _ in on]
    any_null, all_null = nulls[0], nulls[0]
    for n in nulls[1:]:
        any_null, all_null = any_null | n, all_null & n
    keys = parent.select(*[F.col(p).alias(f"_{k}") for k, (_, p) in enumerate(on)]).distinct()
    match = F.lit(True)
    for k, (c, _) in enumerate(on):
        match = match & (F.col(c) == F.col(f"_{k}"))
    whole = child.where(~any_null).join(keys, match, "left_anti")
    return whole.union(child.where(any_null & ~all_null)) if full else whole


def crossing(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]], doomed: Column) -> DataFrame:
    """Child rows that refer to parents in a range about to go."""
    keys = parent.where(doomed).select(*[F.col(p).alias(c) for c, p in on])
    return child.join(keys, [c for c, _ in on], "left_semi")


def status(registry: DataFrame, log: DataFrame) -> DataFrame:
    """(parent, n_partitions, n_coarse, newest_bound, n_failures, n_skips): failures and skips since the last success."""
    parts = registry.groupBy("parent").agg(F.count(F.lit(1)).alias("n_partitions"), F.count_if("coarse").alias("n_coarse"), F.max("hi").alias("newest_bound"))
    bad = F.col("action").startswith("fail_") | F.col("action").startswith("skip_")
    good = log.groupBy("parent").agg(F.max(F.when(~bad, F.col("ts"))).alias("good"))
    since = log.join(good, "parent").where(F.col("good").isNull() | (F.col("ts") > F.col("good")))
    counts = since.groupBy("parent").agg(F.count_if(F.col("action").startswith("fail_")).alias("n_failures"), F.count_if(F.col("action").startswith("skip_")).alias("n_skips"))
    return parts.join(counts, "parent", "left").na.fill(0, ["n_failures", "n_skips"])


def progress(registry: DataFrame, frontier: Column) -> DataFrame:
    """(n_partitions, n_frozen, n_coarse_frozen, ceiling, margin): how far the grid is ahead and what is left to split."""
    return registry.agg(
        F.count(F.lit(1)).alias("n_partitions"), F.count_if(F.col("hi") <= frontier).alias("n_frozen"),
        F.count_if((F.col("hi") <= frontier) & F.col("coarse")).alias("n_coarse_frozen"), F.max("hi").alias("ceiling"),
        (F.max("hi") - frontier).alias("margin"),
    )


def observe_window(log: DataFrame, since) -> DataFrame:
    """(parent, window_start, window_end, rows_copied, n_regrains, n_retains) of the log from an instant on."""
    return log.where(F.col("ts") >= F.lit(since)).groupBy("parent").agg(
        F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.sum("rows").alias("rows_copied"),
        F.count_if(F.col("action").startswith("regrain")).alias("n_regrains"), F.count_if(F.col("action").startswith("retain")).alias("n_retains"),
    )


def skip_streaks(log: DataFrame, skip: str, done: str) -> DataFrame:
    """(parent, longest): the longest run of ``skip`` actions with no ``done`` between them."""
    run = F.count_if(F.col("action") == done).over(Window.partitionBy("parent").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = log.withColumn("run", run).where(F.col("action") == skip).groupBy("parent", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("parent").agg(F.max("n").alias("longest"))


def holes(registry: DataFrame) -> DataFrame:
    """(hi, next_lo): where a range ends and the next doesn't start."""
    following = F.lead("lo").over(Window.orderBy("lo"))
    return registry.select("hi", following.alias("next_lo")).where("next_lo > hi")
