"""Archive objects: NDJSON and Parquet, verified after they are written, never written over another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import multiset_fingerprint, row_json


class NotWritten(RuntimeError):
    """An export that doesn't hold what it should, or would write over a recorded one."""


# What an archive's Parquet may hold.
PARQUET_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.BooleanType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.ArrayType)


def refused_columns(schema: T.StructType) -> list[str]:
    """Columns that a Parquet archive doesn't take: structs, bytes, dates and the narrow numbers."""
    return [f.name for f in schema.fields if not isinstance(f.dataType, PARQUET_TYPES)]


def encode_parquet(df: DataFrame) -> DataFrame:
    """Columns as the archive stores them: arrays as JSON text, NaN in doubles kept."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_ndjson(df: DataFrame, path: str, order: list[str], compress: bool = False) -> int:
    """One JSON object a line, nulls kept, rows in key order inside each file; returns the verified number of rows.

    Reads the files back and compares count and fingerprint of the lines. Files stay as parallel as the rows are:
    an archive object is a folder of parts, so no single task gathers it.
    """
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order).select(row_json(df).alias("value"))
    lines.write.mode("errorifexists").option("compression", "gzip" if compress else "none").text(path)
    return _verified(lines, df.sparkSession.read.text(path), path)


def write_parquet(df: DataFrame, path: str, order: list[str], compress: bool = True) -> int:
    """The same as Parquet, times as microseconds."""
    if bad := refused_columns(df.schema):
        raise NotWritten(f"not archivable: {', '.join(bad)}")
    rows = encode_parquet(df).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("errorifexists").option("compression", "gzip" if compress else "none").option("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS").parquet(path)
    return _verified(rows, df.sparkSession.read.parquet(path), path)


def _verified(wanted: DataFrame, written: DataFrame, path: str) -> int:
    a, b = multiset_fingerprint(wanted).first(), multiset_fingerprint(written.select(*wanted.columns)).first()
    if tuple(a) != tuple(b):
        raise NotWritten(f"{path} holds {b.n} rows, not the {a.n} that were meant")
    return a.n


def refuse_overwrite(recorded: DataFrame, key: str, digest: str) -> None:
    """A recorded chunk may be written again only with the rows it had."""
    for row in recorded.where(F.col("object_key") == key).limit(1).collect():
        if row.digest != digest:
            raise NotWritten(f"{key} is recorded with other rows")


def refuse_empty(lo, hi) -> None:
    if not lo < hi:
        raise NotWritten("an empty or inverted range")
