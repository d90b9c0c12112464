"""Row text, digests and object keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON with its null fields kept, columns in the table's order."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]), {"ignoreNullFields": "false"})


def multiset_fingerprint(df: DataFrame) -> DataFrame:
    """(n, fingerprint): rows and the sum of their 64-bit hashes, order-free and counting duplicates. One pass, combined
    before anything is shuffled, at any size."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).alias("fingerprint"))


def rows_digest(df: DataFrame, keys: list[Column]) -> DataFrame:
    """An md5 for each key: of its rows' md5s, sorted and joined. For groups of bounded size, such as archive chunks."""
    line = F.md5(row_json(df))
    return df.select(*keys, line.alias("row_md5")).groupBy(*[k for k in df.select(*keys).columns]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.md5(F.array_join(F.array_sort(F.collect_list("row_md5")), "")).alias("digest")
    )


def object_stem(kind: str, lo: Column) -> Column:
    """The part of an object's key that names its chunk: an id's digits, or the instant's digits in UTC with the offset,
    keeping the point of a fraction."""
    if kind == "id":
        return lo.cast("string")
    ts = F.timestamp_micros(lo)
    part = F.pmod(lo, F.lit(1_000_000))
    tail = F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(part.cast("string"), 6, "0"), F.lit("0"))))
    year = F.year(ts)
    shown = F.lpad(F.when(year > 0, year).otherwise(1 - year).cast("string"), 4, "0")
    return F.concat(shown, F.date_format(ts, "MMddHHmmss"), tail, F.lit("00"), F.when(year <= 0, "BC").otherwise(""))


def object_key(prefix: str, schema: str, table: str, stem: Column, extension: str) -> Column:
    """``<prefix><schema>.<table>_<stem>.<extension>``."""
    return F.concat(F.lit(f"{prefix}{schema}.{table}_"), stem, F.lit(f".{extension}"))
