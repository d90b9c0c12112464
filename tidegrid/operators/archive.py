"""Archive chunks: planned by bytes without splitting ties, recorded in a ledger, judged before anything is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(native: Column, width: int) -> Column:
    return F.call_function("div", native - F.pmod(native, F.lit(width)), F.lit(width))


def chunk_plan(rows: DataFrame, native: Column, part: Column, budget: int, width: Column, cell: int) -> DataFrame:
    """(part, chunk, lo, hi, n_rows, n_bytes): chunks of about ``budget`` bytes, ties of a native value never split.

    Bytes are summed for each distinct value first, in tasks that combine before they shuffle; value v belongs to the
    chunk of the bytes before it. Those are the bytes of earlier cells of ``cell`` native units, one row each, and of
    the values before v in its own cell, so a partition of any size is many windows. One pass, no walk from chunk to
    chunk, and the same cut on every run and for any ``cell``.
    """
    values = rows.select(part.alias("part"), native.alias("native"), width.alias("width"))
    values = values.groupBy("part", "native").agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("bytes"))
    values = values.withColumn("cell", _cell(F.col("native"), cell))
    cells = values.groupBy("part", "cell").agg(F.sum("bytes").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("part", "cell").orderBy("native").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = values.withColumn("inside", inside).join(cells.select("part", "cell", ahead.alias("ahead")), ["part", "cell"])
    cut = own.withColumn("chunk", F.call_function("div", F.col("ahead") + F.col("inside"), F.lit(budget)))
    chunks = cut.groupBy("part", "chunk").agg(F.min("native").alias("lo"), F.max("native").alias("last"), F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"))
    following = F.lead("lo").over(Window.partitionBy("part").orderBy("lo"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("lo"))
    return chunks.select("part", number.alias("chunk"), "lo", F.coalesce(following, F.col("last") + 1).alias("hi"), "n_rows", "n_bytes")


def next_chunk(rows: DataFrame, native: Column, covered_hi: int, hi: int, n: int, cell: int = 1 << 20) -> DataFrame:
    """(lo, hi, n_rows) of the next chunk past what the ledger covers: the n-th row's value and all its ties.

    Rows are counted by cell of ``cell`` native units first; only the cell that holds the n-th row is opened.
    """
    left = rows.where((native >= F.lit(covered_hi)) & (native < F.lit(hi))).select(native.alias("native")).withColumn("cell", _cell(F.col("native"), cell))
    cells = left.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.min("native").alias("least"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before)  # one row a cell
    early, late = F.col("before") < n, F.col("before") >= n
    edge = cells.agg(F.max(F.when(early, F.col("cell"))).alias("edge"), F.max(F.when(early, F.col("before"))).alias("before"), F.min(F.when(late, F.col("least"))).alias("following"))
    values = left.join(edge, F.col("cell") == F.col("edge")).groupBy("edge", "native").agg(F.count(F.lit(1)).alias("c"), F.first("before").alias("before"))
    upto = F.col("before") + F.coalesce(F.sum("c").over(Window.partitionBy("edge").orderBy("native").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("ahead", upto)
    taken = values.agg(F.sum(F.when(F.col("ahead") < n, F.col("c"))).alias("taken"), F.min(F.when(F.col("ahead") >= n, F.col("native"))).alias("after"))
    return edge.crossJoin(taken).select(  # one row each
        F.lit(covered_hi).cast("long").alias("lo"), F.coalesce("after", "following", F.lit(hi).cast("long")).alias("hi"),
        (F.coalesce("before", F.lit(0)) + F.coalesce("taken", F.lit(0))).alias("n_rows"),
    )


def coverage(registry: DataFrame, ledger: DataFrame) -> DataFrame:
    """registry with covered_hi and covered: chunks of a partition reach its upper bound without a hole."""
    chunks = ledger.where("NOT retired").select(F.col("part").alias("p"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    before = F.max("c_hi").over(Window.partitionBy("p").orderBy("c_lo").rowsBetween(Window.unboundedPreceding, -1))
    walked = chunks.withColumn("hole", F.col("c_lo") > F.coalesce(before, F.col("p")))
    each = walked.groupBy("p").agg(F.max("c_hi").alias("covered_hi"), F.max("hole").alias("hole"))
    joined = registry.join(each, F.col("lo") == F.col("p"), "left").drop("p")
    return joined.withColumn("covered", F.coalesce((F.col("covered_hi") >= F.col("hi")) & ~F.col("hole"), F.lit(False))).drop("hole")


def contract_breaches(results: DataFrame) -> DataFrame:
    """Results (lo, hi, covered_hi, rows_archived) that break the archive contract: lo < covered_hi <= hi, rows >= 0."""
    good = (F.col("covered_hi") > F.col("lo")) & (F.col("covered_hi") <= F.col("hi")) & (F.col("rows_archived") >= 0)
    return results.where(~F.coalesce(good, F.lit(False)))


def held_over_retired(registry: DataFrame, ledger: DataFrame) -> DataFrame:
    """Partitions whose range meets a retired chunk: archiving them would repeat what was dropped."""
    gone = ledger.where("retired").select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return registry.join(gone, (F.col("lo") < F.col("hi2")) & (F.col("lo2") < F.col("hi")), "left_semi")


def orphaned_coverage(ledger: DataFrame, registry: DataFrame) -> DataFrame:
    """Live chunks of partitions that no longer exist."""
    return ledger.where("NOT retired").join(registry.select(F.col("lo").alias("part")), "part", "left_anti")


def contiguity(ledger: DataFrame) -> DataFrame:
    """Chunks with gap: whether they don't start where the one before ends."""
    before = F.lag("hi").over(Window.partitionBy("part").orderBy("lo"))
    return ledger.withColumn("gap", F.coalesce(before != F.col("lo"), F.lit(False)))
