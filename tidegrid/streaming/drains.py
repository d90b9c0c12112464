"""Change and append drains over file streams: micro-batches, a checkpoint, and nothing applied twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.copying import reconcile

GRID_DAY = "1 day"


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain_changes(
    changes: DataFrame, source: Callable[[], DataFrame], root: str, keys: list[str], checkpoint: str
) -> StreamingQuery:
    """Apply each batch of changed keys to the copy under ``root``, one version a batch; returns when all are applied.

    Version n + 1 is version n without the batch's keys, with the source's rows of them. A batch that is run again
    after a failure writes its own version again, so it is applied once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dest = spark.read.parquet(f"{root}/v{number}")
        reconcile(dest, source(), batch, keys).write.mode("overwrite").parquet(f"{root}/v{number + 1}")

    query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def cell_counts(rows: DataFrame, time: str, lateness: str, width: str = GRID_DAY) -> DataFrame:
    """Rows by fixed cell of event time, kept open for ``lateness``. Cells of whole days start at midnight UTC, which is
    the grid's own lattice."""
    return rows.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("w.start").alias("part_lo"), "n_rows")


def drain_appends(rows: DataFrame, path: str, checkpoint: str, late: str, bound, column: str) -> StreamingQuery:
    """Appends past the copy's watermark go to ``path``, rows below it to ``late``: they are counted, never lost."""

    def split(batch: DataFrame, number: int) -> None:
        batch.where(F.col(column) > F.lit(bound)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where(F.col(column) <= F.lit(bound)).write.mode("overwrite").parquet(f"{late}/batch={number}")

    query = rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
