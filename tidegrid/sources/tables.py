"""Reading tables, and rows made from a rule for demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; the session's clock is UTC from here on, as the grid needs."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo_messages(spark: SparkSession, count: int, months: int, now_us: int, tenants: int = 5) -> DataFrame:
    """Rows (id, tenant_id, created_at, body) spread by hash over the months before ``now_us``; equal on every run."""
    span = months * 30 * 86_400 * 1_000_000
    at = F.lit(now_us) - F.pmod(F.xxhash64("id"), F.lit(span))
    return spark.range(1, count + 1).select(
        "id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(tenants)).alias("tenant_id"), F.timestamp_micros(at).alias("created_at"),
        F.concat(F.lit("message "), F.col("id").cast("string")).alias("body"),
    )


def file_bytes(df: DataFrame) -> int:
    """Size of a plan's input by the optimizer's statistics."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())
