"""Shared pieces: tables in the cluster's shared folder, and connected components.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``, the folder that driver and executors share, so a lost
executor costs a re-read and never a recomputation of everything before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Spark's setting for shuffle files that go when the query ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each open scratch(), the tables that go with it.
_SCOPES: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where the setting is missing on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with the same schema.

    Inside scratch() the table goes when that ends, or, with ``keep``, when the one around it does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegrid/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidegrid_path = path  # for discard()
    scopes = _SCOPES.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more; once more does nothing."""
    path = getattr(df, "tidegrid_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """At the end, deletes the tables that materialize() makes inside and doesn't keep."""
    mine: list[DataFrame] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for df in mine:
            discard(df)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space, \\t, \\n, \\x0B, \\f and \\r; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of an undirected graph given as long columns (u, v).

    Returns (node, component) for every node that has an edge; component is the smallest node reachable. Large-star and
    small-star steps alternate until nothing changes, O(log^2 n) rounds, each a group-by and a join. The joins use a
    re-derived key so that both sides are exchanged and adaptive execution can split a hub's rows over many tasks; the
    group-bys combine before they shuffle. No component is ever gathered in one place. Self-loops and repeated or
    reversed edges are harmless; rows with a null end are ignored; no edges give no rows.
    """
    far = F.bitwise_not("u")
    edges = materialize(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        name,
    )
    now = _signature(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(far.alias("far"), F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).withColumn("far", far).join(low, "far")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.union(edges.groupBy("u").agg(F.min("v").alias("v")))  # each node keeps its way down
        large = materialize(large.where(F.col("u") != F.col("v")).distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(far.alias("far"), "m")
        small = (
            large.withColumn("far", far).join(low, "far")
            .select(F.explode(F.array("u", F.col("v"))).alias("u"), F.col("m").alias("v"))
        )
        small = materialize(small.where(F.col("u") != F.col("v")).distinct(), name)
        discard(edges)
        discard(large)
        edges, before, now = small, now, _signature(small)
        if before == now:
            break
    top = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return top.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
