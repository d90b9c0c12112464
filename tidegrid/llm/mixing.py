"""Mixing sources to target weights with hash-threshold histograms.

Tokens are summed by source and hash bucket; a running sum over the buckets finds where the source's budget ends; only
the bucket on that edge is summed again at finer buckets, three levels deep; the outcome is one hash threshold a source,
and documents are taken by comparing their hash with it. No document is ever sorted, and raising a budget only ever adds
documents: the selections nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, word_count

#: Bits of the hash that one level of the histogram resolves, and the number of levels.
LEVEL_BITS, LEVELS = 12, 3


def capped_targets(totals: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size) with one row a source, to (source, source_size, target, n_rank).

    Sources in code-point order, null last, take ``weights`` in turn. The targets share the sum of all sizes by weight;
    none exceeds ``cap`` times its source's size, and what that cuts off goes to the others by weight until none is
    above. That fixed point is a water level: with sources in order of cap * size / weight, those whose cap lies below
    the level that the rest would get are capped, the others get level * weight. The windows run over one row a source.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ladder = Window.orderBy("limit", "n_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = F.pmod(F.col("n_rank") - 1, F.lit(len(weights))).cast("int")
    return (
        totals.withColumn("n_rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), order + 1))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("limit", F.col("most") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(every).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("level", (F.col("all_size") - F.sum("most").over(ladder) + F.col("most")) / (F.col("all_weight") - F.sum("weight").over(ladder) + F.col("weight")))
        .withColumn("capped", F.col("limit") <= F.col("level"))
        .withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
        .select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("final")).alias("target"), "n_rank")
    )


def _part(level: int) -> Column:
    """The level's bits of the hash, highest level first."""
    return F.shiftrightunsigned("h", 64 - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each source's budget ends: (n_rank, copies, cut).

    Every document of the source is taken ``copies`` times, and once more if the top LEVEL_BITS * LEVELS bits of its
    hash lie below ``cut``. The last bucket, which holds documents with equal leading bits, is taken whole if that
    brings the sum nearer to the target.
    """
    edge = (
        targets.where("source_size > 0")
        .withColumn("copies", F.floor(F.col("target") / F.col("source_size")).cast("long"))
        .select("n_rank", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("cut"))
    )
    for level in range(LEVELS):
        last = level == LEVELS - 1
        lead = F.shiftrightunsigned("h", 64 - LEVEL_BITS * level) if level else F.lit(0).cast("long")
        rows = slim.select("n_rank", lead.alias("lead"), _part(level).alias("bucket"), "size")
        held = rows.groupBy("n_rank", "lead", "bucket").agg(F.sum("size").alias("size")) if level == 0 else (
            rows.join(edge.select("n_rank", F.col("cut").alias("lead")), ["n_rank", "lead"], "left_semi").groupBy("n_rank", "lead", "bucket").agg(F.sum("size").alias("size"))
        )
        run = Window.partitionBy("n_rank").orderBy("bucket")
        upto = held.withColumn("upto", F.sum("size").over(run)).join(edge, "n_rank")
        # the first bucket whose running sum passes the budget holds the edge; beyond the last bucket all are taken
        over = F.col("upto") > F.col("budget")
        found = upto.groupBy("n_rank").agg(
            F.first("copies").alias("copies"), F.first("budget").alias("budget"), F.first("cut").alias("cut"),
            F.min(F.when(over, F.col("bucket"))).alias("at"),
            F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("below"),
            F.min(F.when(over, F.col("upto"))).alias("through"),
        )
        bucket = F.coalesce("at", F.lit(1 << LEVEL_BITS))
        if last:
            nearer = F.coalesce((F.col("through") - F.col("budget")) < (F.col("budget") - F.col("below")), F.lit(False))
            bucket = bucket + nearer.cast("long")
        edge = found.select(
            "n_rank", "copies", (F.col("budget") - F.col("below")).alias("budget"),
            (F.col("cut") * (1 << LEVEL_BITS) + bucket).alias("cut"),
        )
        edge = materialize(edge, "mix-edge")
    return edge.select("n_rank", "copies", "cut")


def _ends(docs: DataFrame, weights: tuple[float, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of all rows, written once, and a row a source: own, source_size, target, copies, cut."""
    slim = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"),
            row_hash("").alias("h"),
        ),
        "mix-sizes",
    )
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(capped_targets(totals, weights, cap), "mix-targets").withColumnRenamed("source", "own")
    ranked = slim.join(targets.select("own", "n_rank"), F.col("source").eqNullSafe(F.col("own")))
    ends = thresholds(ranked.select("n_rank", "h", "size"), targets)
    return slim, targets.join(ends, "n_rank", "left")


def row_hash(prefix: str) -> Column:
    """The hash that orders rows: of doc_id, text and source, so that only equal rows go together."""
    return F.xxhash64(F.col(f"{prefix}doc_id").cast("long"), f"{prefix}text", f"{prefix}source")


def _copies(h: Column, copies: Column, cut: Column, cap: int) -> Column:
    """How often a document is taken."""
    lead = F.shiftrightunsigned(h, 64 - LEVEL_BITS * LEVELS)
    return F.least(F.coalesce(copies, F.lit(0)) + F.coalesce((lead < cut).cast("long"), F.lit(0)), F.lit(cap)).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = 3) -> DataFrame:
    """Rows (doc_id, text, source, ...) to (doc_id, size, source_size, target, taken), one row for each input row.

    size is the number of words, source_size and target are those of the row's source, taken is size times the number
    of copies the mix takes, 0 to ``cap``. Null text has size 0; a null source is a source of its own, last in order;
    the hash is of doc_id, text and source, so a rerun on any partitioning agrees and only rows that are equal in all
    three go together. A source of size 0 has target 0. Other columns are ignored; an empty table gives no rows.

    One pass counts words and writes (doc_id, source, size, h); histograms and the final filter read that narrow table.
    """
    slim, ends = _ends(docs, weights, cap)
    return slim.join(ends, F.col("source").eqNullSafe(F.col("own"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("h"), F.col("copies"), F.col("cut"), cap)).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = 3) -> DataFrame:
    """The documents that the mix takes, each row as often as it takes it, with the columns of ``docs``.

    The thresholds are joined to the rows by source; the texts are not otherwise moved. Rows as in mix().
    """
    with scratch():
        ends = materialize(_ends(docs, weights, cap)[1].select("own", "copies", "cut"), "mix-ends", keep=True).toDF("mix_source", "mix_copies", "mix_cut")
    joined = docs.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.mix_source")))
    times = _copies(row_hash("d."), F.col("e.mix_copies"), F.col("e.mix_cut"), cap)
    row = F.struct(*[F.col(f"d.`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    taken = joined.where(times > 0).select(row, F.explode(F.sequence(F.lit(1), times)))
    return taken.select("row.*").toDF(*docs.columns)
