"""Queries over the test tables, one an operator, each beside its DuckDB SQL.

Times are shown as text in UTC. ``NOW`` pins the clock, so that every run plans the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, digest
from ..functions.grid import DAY, HOUR, WEEK, Grid, fraction, label, micros
from ..operators import archive, copying, integrity, lifecycle, reports, routing
from ..sources.tables import table
from . import registry as plans

#: 2024-01-31 12:00 UTC
NOW = 1_706_702_400_000_000
DAYS, WEEKS, HOURS, MONTHS = Grid("time", DAY), Grid("time", WEEK), Grid("time", HOUR), Grid("time", months=1)
QUARTERS_NY = Grid("time", months=3, tz="America/New_York")
THOUSANDS, TENS = Grid("id", 1000), Grid("id", 10, anchor=3)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def stamp(native: Column) -> Column:
    return F.date_format(F.timestamp_micros(native), "yyyy-MM-dd HH:mm:ss")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def event_time() -> Column:
    return micros(F.col("ts"))


def order_time() -> Column:
    return micros(F.col("o_orderdate"))


DAY_SQL = "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')"


def counted(rows: DataFrame, native: Column, grid: Grid) -> DataFrame:
    return routing.with_cell(rows, native, grid).groupBy("part_lo").agg(F.count(F.lit(1)).alias("n_rows"))


# --- grid ---


@query(f"SELECT {DAY_SQL} AS part_lo, 'events_p' || strftime(ts, '%Y_%m_%d') AS label, count(*) AS n_rows, sum(value) AS sum_value FROM events GROUP BY 1, 2")
def grid_time_day(spark: SparkSession, d: str) -> DataFrame:
    cells = routing.with_cell(events(spark, d), event_time(), DAYS).groupBy("part_lo").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("sum_value"))
    return cells.select(stamp(F.col("part_lo")).alias("part_lo"), label(DAYS, "events", F.col("part_lo")).alias("label"), "n_rows", "sum_value")


@query("SELECT strftime(TIMESTAMP '2000-01-01' + INTERVAL (7 * CAST(floor(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER)) DAY, '%Y-%m-%d %H:%M:%S') AS part_lo, count(*) AS n_rows FROM events GROUP BY 1")
def grid_time_week(spark: SparkSession, d: str) -> DataFrame:
    return counted(events(spark, d), event_time(), WEEKS).select(stamp(F.col("part_lo")).alias("part_lo"), "n_rows")


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS part_lo, count(*) AS n_rows FROM orders GROUP BY 1")
def grid_time_month(spark: SparkSession, d: str) -> DataFrame:
    return counted(orders(spark, d), order_time(), MONTHS).select(stamp(F.col("part_lo")).alias("part_lo"), "n_rows")


@query("""SELECT strftime((date_trunc('quarter', (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' + INTERVAL 1 MONTH) - INTERVAL 1 MONTH) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS part_lo, count(*) AS n_rows FROM orders GROUP BY 1""")
def grid_quarter_new_york(spark: SparkSession, d: str) -> DataFrame:
    return counted(orders(spark, d), order_time(), QUARTERS_NY).select(stamp(F.col("part_lo")).alias("part_lo"), "n_rows")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS part_lo, count(*) AS n_rows, min(event_id) AS first_id FROM events GROUP BY 1")
def grid_time_hour(spark: SparkSession, d: str) -> DataFrame:
    cells = routing.with_cell(events(spark, d), event_time(), HOURS).groupBy("part_lo").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_id"))
    return cells.select(stamp(F.col("part_lo")).alias("part_lo"), "n_rows", "first_id")


@query("SELECT event_id // 1000 * 1000 AS part_lo, 'events_p' || lpad(CAST(event_id // 1000 * 1000 AS VARCHAR), 19, '0') AS label, count(*) AS n_rows FROM events GROUP BY 1, 2")
def grid_id(spark: SparkSession, d: str) -> DataFrame:
    return counted(events(spark, d), F.col("event_id"), THOUSANDS).select("part_lo", label(THOUSANDS, "events", F.col("part_lo")).alias("label"), "n_rows")


@query("SELECT CAST(floor((500 - event_id - 3) / 10.0) * 10 + 3 AS BIGINT) AS part_lo, count(*) AS n_rows FROM events GROUP BY 1")
def grid_floor_negative(spark: SparkSession, d: str) -> DataFrame:
    return counted(events(spark, d), 500 - F.col("event_id"), TENS)


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS next_lo FROM orders")
def grid_next_month(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("o_orderkey", stamp(MONTHS.next(MONTHS.floor(order_time()))).alias("next_lo"))


@query("SELECT 'orders_p' || strftime(min(o_orderdate), '%Y_%m') || '_to_' || strftime(date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH, '%Y_%m') AS label, count(*) AS n_rows FROM orders")
def label_coarse(spark: SparkSession, d: str) -> DataFrame:
    bounds = plans.transmute_bounds(orders(spark, d), order_time(), MONTHS)
    return bounds.select(label(MONTHS, "orders", F.col("lo"), F.col("hi")).alias("label"), "n_rows")


@query("SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400000000.0 AS part_fraction FROM events")
def native_fraction(spark: SparkSession, d: str) -> DataFrame:
    lo = DAYS.floor(event_time())
    return events(spark, d).select("event_id", fraction(lo, DAYS.next(lo), event_time()).alias("part_fraction"))


# --- registry ---


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Registry of the months that orders fall in."""
    cells = orders(spark, d).select(MONTHS.floor(order_time()).alias("lo")).distinct()
    return cells.select("lo", MONTHS.next(F.col("lo")).alias("hi"))


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Event registry: a coarse partition up to the 8th day, then days."""
    bounds = events(spark, d).agg(F.min(DAYS.floor(event_time())).alias("a"), F.max(DAYS.floor(event_time())).alias("b"))
    coarse = bounds.select(F.col("a").alias("lo"), (F.col("a") + 7 * DAY).alias("hi"))
    each = bounds.select(F.explode(F.sequence(F.col("a") + 7 * DAY, F.col("b"), F.lit(DAY))).alias("lo"))
    return coarse.union(each.select("lo", (F.col("lo") + DAY).alias("hi")))


MIXED_SQL = """WITH b AS (SELECT min(date_trunc('day', ts)) AS a, max(date_trunc('day', ts)) AS z FROM events),
reg AS (SELECT a AS lo, a + INTERVAL 7 DAY AS hi FROM b UNION ALL
  SELECT lo, lo + INTERVAL 1 DAY FROM (SELECT unnest(generate_series(a + INTERVAL 7 DAY, z, INTERVAL 1 DAY)) AS lo FROM b)) """
SHOW = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query("SELECT CAST(max(o_orderkey) AS BIGINT) AS frontier, strftime(greatest(max(o_orderdate), make_timestamp(1706702400000000)), '%Y-%m-%d %H:%M:%S') AS clock_frontier FROM orders")
def frontier_id(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d)
    return plans.frontier(rows, F.col("o_orderkey")).crossJoin(plans.frontier(rows, order_time(), NOW).select(stamp(F.col("frontier")).alias("clock_frontier")))  # one row each


@query("SELECT max(event_id) // 1000 * 1000 + 1000 * (k + 1) AS lo, max(event_id) // 1000 * 1000 + 1000 * (k + 2) AS hi FROM events, range(30) t(k) GROUP BY k")
def obtain_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    registry = counted(rows, F.col("event_id"), THOUSANDS).select(F.col("part_lo").alias("lo"), (F.col("part_lo") + 1000).alias("hi"))
    return plans.obtain(registry, THOUSANDS, plans.frontier(rows, F.col("event_id")), 30)


@query("""SELECT strftime(top + INTERVAL (k) MONTH, '%Y-%m-%d %H:%M:%S') AS lo, strftime(top + INTERVAL (k + 1) MONTH, '%Y-%m-%d %H:%M:%S') AS hi
FROM (SELECT max(date_trunc('month', o_orderdate)) + INTERVAL 1 MONTH AS top FROM orders) t, range(1200) r(k) WHERE top + INTERVAL (k) MONTH <= TIMESTAMP '2031-03-12 00:00:00'""")
def extend_plan_months(spark: SparkSession, d: str) -> DataFrame:
    cells = plans.extend_to(monthly(spark, d), MONTHS, 1_931_040_000_000_000)  # 2031-03-12
    return cells.select(stamp(F.col("lo")).alias("lo"), stamp(F.col("hi")).alias("hi"))


@query("SELECT top + 1000 * k AS lo, top + 1000 * (k + 1) AS hi FROM (SELECT max(event_id) // 1000 * 1000 + 1000 AS top FROM events) t, range(2000) r(k) WHERE top + 1000 * k <= 1000000")
def extend_plan(spark: SparkSession, d: str) -> DataFrame:
    registry = counted(events(spark, d), F.col("event_id"), THOUSANDS).select(F.col("part_lo").alias("lo"), (F.col("part_lo") + 1000).alias("hi"))
    return plans.extend_to(registry, THOUSANDS, 1_000_000)


@query(MIXED_SQL + f"SELECT {SHOW.format('lo')}, {SHOW.format('hi')} FROM reg WHERE hi > lo + INTERVAL 1 DAY")
def coarse_children(spark: SparkSession, d: str) -> DataFrame:
    found = plans.marked(mixed(spark, d), DAYS, F.lit(NOW)).where("coarse")
    return found.select(stamp(F.col("lo")).alias("lo"), stamp(F.col("hi")).alias("hi"))


@query(MIXED_SQL + f"SELECT {SHOW.format('lo')}, {SHOW.format('hi')} FROM reg WHERE hi <= TIMESTAMP '2024-01-20 12:00:00'")
def frozen_children(spark: SparkSession, d: str) -> DataFrame:
    found = plans.marked(mixed(spark, d), DAYS, F.lit(NOW - 11 * DAY)).where("frozen")
    return found.select(stamp(F.col("lo")).alias("lo"), stamp(F.col("hi")).alias("hi"))


@query(MIXED_SQL + "SELECT strftime(date_trunc('day', TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 18 DAY), '%Y-%m-%d %H:%M:%S') AS boundary, count(*) AS n_due FROM reg WHERE hi <= date_trunc('day', TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 18 DAY)")
def retention_boundary(spark: SparkSession, d: str) -> DataFrame:
    edge = plans.retain_boundary(DAYS, F.lit(NOW), keep_days=18)
    return plans.retain_plan(mixed(spark, d), edge).agg(F.count(F.lit(1)).alias("n_due")).select(stamp(edge).alias("boundary"), "n_due")


@query(MIXED_SQL + f"SELECT {SHOW.format('lo')}, {SHOW.format('hi')} FROM reg WHERE hi <= TIMESTAMP '2024-01-21' ORDER BY reg.lo LIMIT 3")
def retain_backlog(spark: SparkSession, d: str) -> DataFrame:
    due = plans.retain_plan(mixed(spark, d), plans.retain_boundary(DAYS, F.lit(NOW), keep_days=10), batch=3)
    return due.select(stamp(F.col("lo")).alias("lo"), stamp(F.col("hi")).alias("hi"))


@query(MIXED_SQL + f"SELECT {SHOW.format('lo')}, {SHOW.format('hi')} FROM reg WHERE reg.lo < TIMESTAMP '2024-01-05' AND reg.hi > TIMESTAMP '2024-01-05'")
def straddling_partitions(spark: SparkSession, d: str) -> DataFrame:
    cut = plans.straddling(mixed(spark, d), F.lit(NOW - 26 * DAY - 12 * HOUR))
    return cut.select(stamp(F.col("lo")).alias("lo"), stamp(F.col("hi")).alias("hi"))


@query(MIXED_SQL + f"SELECT {SHOW.format('lo')}, count(e.event_id) AS n_rows, sum(e.value) AS sum_value FROM reg LEFT JOIN events e ON e.ts >= reg.lo AND e.ts < reg.hi GROUP BY reg.lo")
def route_counts(spark: SparkSession, d: str) -> DataFrame:
    registry = mixed(spark, d)
    rows = routing.route(events(spark, d), event_time(), registry, WEEK).groupBy("part_lo").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("sum_value"))
    every = registry.select(F.col("lo").alias("part_lo")).join(rows, "part_lo", "left")
    return every.select(stamp(F.col("part_lo")).alias("lo"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "sum_value")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    return routing.range_scan(events(spark, d), "ts", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)).select("event_id", "event_type")


@query(MIXED_SQL + "SELECT event_id FROM events WHERE ts + INTERVAL 25 DAY NOT BETWEEN (SELECT min(lo) FROM reg) AND (SELECT max(hi) FROM reg) - INTERVAL 1 MICROSECOND")
def refused_writes(spark: SparkSession, d: str) -> DataFrame:
    return routing.refused_writes(events(spark, d), event_time() + 25 * DAY, mixed(spark, d), WEEK).select("event_id")


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS lo FROM orders)
SELECT strftime(a.lo, '%Y-%m-%d %H:%M:%S') AS lo, count(*) AS n_meet FROM m a JOIN m b ON a.lo < b.lo + INTERVAL 45 DAY AND b.lo < a.lo + INTERVAL 1 MONTH GROUP BY 1""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    registry = monthly(spark, d)
    wide = registry.select(F.col("lo").alias("lo2"), (F.col("lo") + 45 * DAY).alias("hi2"))
    return plans.overlapping(registry, wide).groupBy("lo").agg(F.count(F.lit(1)).alias("n_meet")).select(stamp(F.col("lo")).alias("lo"), "n_meet")


# --- splitting and copying ---


def event_span(spark: SparkSession, d: str, native: Column, grid: Grid) -> tuple[int, int]:
    """Bounds of the one partition that events become."""
    row = plans.transmute_bounds(events(spark, d), native, grid).first()
    return row.lo, row.hi


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS part_lo, count(*) AS n_rows FROM events GROUP BY 1")
def regrain_counts(spark: SparkSession, d: str) -> DataFrame:
    fine = copying.regrain(events(spark, d), event_time(), *event_span(spark, d, event_time(), WEEKS), DAYS)
    return fine.groupBy("part_lo").agg(F.count(F.lit(1)).alias("n_rows")).select(stamp(F.col("part_lo")).alias("part_lo"), "n_rows")


CLAMP_SQL = "WITH b AS (SELECT min(event_id) + (max(event_id) - min(event_id)) // 7 AS lo, max(event_id) AS hi FROM events) "


def clamped(spark: SparkSession, d: str) -> tuple[int, int]:
    """A coarse range that starts and ends off the grid, over six sevenths of the ids."""
    row = events(spark, d).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    return row.a + (row.b - row.a) // 7, row.b


@query(CLAMP_SQL + "SELECT greatest(event_id // 1000 * 1000, lo) AS part_lo, count(*) AS n_rows FROM events, b WHERE event_id >= lo AND event_id < hi GROUP BY 1")
def regrain_clamped(spark: SparkSession, d: str) -> DataFrame:
    fine = copying.regrain(events(spark, d), F.col("event_id"), *clamped(spark, d), THOUSANDS)
    return fine.groupBy("part_lo").agg(F.count(F.lit(1)).alias("n_rows"))


@query(CLAMP_SQL + """, p AS (SELECT greatest(lo, 1000 * k) AS piece_lo, least(hi, 1000 * (k + 1)) AS piece_hi FROM b, range(100000) t(k) WHERE 1000 * (k + 1) > lo AND 1000 * k < hi)
SELECT piece_lo, piece_hi, count(event_id) AS n_rows FROM p LEFT JOIN events ON event_id >= piece_lo AND event_id < piece_hi GROUP BY 1, 2""")
def regrain_pieces(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = clamped(spark, d)
    cut = plans.pieces(spark.range(1).select(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")), THOUSANDS)
    rows = copying.regrain(events(spark, d), F.col("event_id"), lo, hi, THOUSANDS).groupBy("part_lo").agg(F.count(F.lit(1)).alias("n"))
    return cut.join(rows, F.col("piece_lo") == F.col("part_lo"), "left").select("piece_lo", "piece_hi", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS part_lo, count(*) AS n_rows FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 3 DAY FROM events) GROUP BY 1")
def regrain_aged_skip(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = event_span(spark, d, event_time(), DAYS)
    fine = copying.regrain(events(spark, d), event_time(), lo, hi, DAYS, boundary=lo + 3 * DAY)
    return fine.groupBy("part_lo").agg(F.count(F.lit(1)).alias("n_rows")).select(stamp(F.col("part_lo")).alias("part_lo"), "n_rows")


@query("SELECT count(*) AS source_rows, count(*) AS dest_rows, true AS equal FROM events")
def regrain_conservation(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return copying.conserved(rows, copying.regrain(rows, F.col("event_id"), *event_span(spark, d, F.col("event_id"), THOUSANDS), TENS).drop("part_lo"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE event_id % 11 <> 0 OR event_id % 7 <> 0")
def reconcile_upsert(spark: SparkSession, d: str) -> DataFrame:
    dest = events(spark, d).select("event_id", "value")
    source = dest.where("event_id % 11 <> 0 OR event_id % 7 <> 0").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") * 2).otherwise(F.col("value")))
    return copying.reconcile(dest, source, dest.where("event_id % 7 = 0"), ["event_id"])


@query("SELECT user_id, max(event_id) AS event_id FROM (SELECT * FROM events ORDER BY event_id LIMIT 1000) GROUP BY user_id")
def drain_batch(spark: SparkSession, d: str) -> DataFrame:
    return copying.drain_batch(events(spark, d).select("event_id", "user_id"), "event_id", 1000, ["user_id"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= (SELECT max(o_orderdate) FROM (SELECT o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' ORDER BY o_orderdate LIMIT 500))")
def append_drain(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    batch = copying.append_batch(orders(spark, d), "o_orderdate", dt.datetime(1998, 1, 1), 500)
    return batch.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 5000 AND o_orderkey % 3 <> 0")
def catch_up(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d)
    return copying.catch_up(rows, rows.where("o_orderkey % 3 = 0"), "o_orderkey", 5000, ["o_orderkey"]).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id <= 5000 AND event_id % 97 = 0")
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return copying.late_rows(rows, rows.where("event_id % 97 <> 0"), "event_id", 5000, ["event_id"]).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 50 = 0")
def unmatched_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return copying.unmatched(rows, rows.where("l_orderkey % 50 <> 0"))


@query("SELECT event_id FROM events WHERE epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-15')")
def backdated_rows(spark: SparkSession, d: str) -> DataFrame:
    edge = plans.retain_boundary(DAYS, F.lit(NOW), keep_days=16)
    return events(spark, d).where(event_time() < edge).select("event_id")


# --- archive ---


def chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d)
    return archive.chunk_plan(rows, order_time(), F.year("o_orderdate"), 4000, F.length("o_orderstatus") + F.length("o_orderpriority") + 24, 30 * DAY)


CHUNK_SQL = """WITH v AS (SELECT year(o_orderdate) AS part, epoch_us(o_orderdate) AS native, count(*) AS n, sum(length(o_orderstatus) + length(o_orderpriority) + 24) AS bytes FROM orders GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY part ORDER BY native ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000 AS k FROM v),
g AS (SELECT part, k, min(native) AS lo, max(native) AS last, sum(n) AS n_rows, sum(bytes) AS n_bytes FROM c GROUP BY 1, 2),
plan AS (SELECT part, row_number() OVER w AS chunk, lo, coalesce(lead(lo) OVER w, last + 1) AS hi, n_rows, n_bytes FROM g WINDOW w AS (PARTITION BY part ORDER BY lo)) """


@query(CHUNK_SQL + "SELECT part::INTEGER AS part, chunk::INTEGER AS chunk, lo::BIGINT AS lo, hi::BIGINT AS hi, n_rows::BIGINT AS n_rows, n_bytes::BIGINT AS n_bytes FROM plan")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d)


@query(CHUNK_SQL + "SELECT part::INTEGER AS part, count(*) AS n_chunks, 0::BIGINT AS n_gaps FROM plan GROUP BY part")
def chunk_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return archive.contiguity(chunks(spark, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("gap").alias("n_gaps"))


@query("""WITH c AS (SELECT event_id // 10 AS native, count(*) AS n FROM events WHERE event_id >= 1000 GROUP BY 1), u AS (SELECT *, sum(n) OVER (ORDER BY native) AS upto FROM c)
SELECT 100::BIGINT AS lo, coalesce((SELECT min(native) FROM u WHERE upto - n >= 205), 1099511627776) AS hi, coalesce(sum(n), 0)::BIGINT AS n_rows FROM u WHERE upto - n < 205""")
def next_chunk(spark: SparkSession, d: str) -> DataFrame:
    return archive.next_chunk(events(spark, d), F.call_function("div", F.col("event_id"), F.lit(10)), 100, 1 << 40, 205)


@query("SELECT event_id, json_object('event_id', event_id, 'user_id', user_id, 'event_type', event_type)::VARCHAR AS line FROM events")
def ndjson_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return rows.select("event_id", digest.row_json(rows, ["event_id", "user_id", "event_type"]).alias("line"))


@query("""SELECT event_id // 1000 * 1000 AS part_lo, count(*) AS n_rows, md5(string_agg(h, '' ORDER BY h)) AS digest FROM
(SELECT event_id, md5(json_object('event_id', event_id, 'user_id', user_id, 'event_type', event_type)::VARCHAR) AS h FROM events) GROUP BY 1""")
def rows_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", "user_id", "event_type")
    return digest.rows_digest(rows, [THOUSANDS.floor(F.col("event_id")).alias("part_lo")])


@query("SELECT 'backup/public.events_' || strftime(date_trunc('hour', ts), '%Y%m%d%H%M%S') || '00.ndjson' AS object_key, count(*) AS n_rows FROM events GROUP BY 1")
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    cells = counted(events(spark, d), event_time(), HOURS)
    return cells.select(digest.object_key("backup/", "public", "events", digest.object_stem("time", F.col("part_lo")), "ndjson").alias("object_key"), "n_rows")


@query("SELECT count(*) AS n FROM lineitem")
def fingerprint_count(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    whole = digest.multiset_fingerprint(rows)
    split = digest.multiset_fingerprint(rows.where("l_orderkey % 2 = 0")).union(digest.multiset_fingerprint(rows.where("l_orderkey % 2 <> 0")))
    added = split.agg(F.sum("n").alias("n2"), F.sum("fingerprint").alias("f2"))
    return whole.join(added, F.col("fingerprint") == F.col("f2")).select("n")  # a row only if the halves add up


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger of the chunks of even years; chunk 2 of each is retired."""
    return chunks(spark, d).where("part % 2 = 0").withColumn("retired", F.col("chunk") == 2)


def years(spark: SparkSession, d: str) -> DataFrame:
    cells = orders(spark, d).groupBy(F.year("o_orderdate").alias("part")).agg(F.min(order_time()).alias("lo"), (F.max(order_time()) + 1).alias("hi"))
    return cells


@query(CHUNK_SQL + "SELECT y.part::INTEGER AS part FROM (SELECT part, min(lo) AS lo, max(hi) AS hi FROM plan GROUP BY part) y WHERE EXISTS (SELECT 1 FROM plan p WHERE p.part % 2 = 0 AND p.chunk = 2 AND y.lo < p.hi AND p.lo < y.hi)")
def over_retired_chunks(spark: SparkSession, d: str) -> DataFrame:
    return archive.held_over_retired(years(spark, d), ledger(spark, d).select("lo", "hi", "retired")).select("part")


@query(CHUNK_SQL + "SELECT y.part::INTEGER AS part, (y.part % 2 = 0 AND y.n = 1) OR (y.part % 2 = 0 AND false) AS covered FROM (SELECT part, count(*) AS n FROM plan GROUP BY part) y")
def archive_covered(spark: SparkSession, d: str) -> DataFrame:
    registry = years(spark, d)
    starts = registry.select("part", F.col("lo").alias("start"))
    live = ledger(spark, d).join(starts, "part").select(F.col("start").alias("part"), "lo", "hi", "retired")
    return archive.coverage(registry, live).select("part", "covered")


@query(CHUNK_SQL + "SELECT part::INTEGER AS part, chunk::INTEGER AS chunk FROM plan WHERE chunk % 3 = 0 OR hi <= lo")
def archive_contract(spark: SparkSession, d: str) -> DataFrame:
    results = chunks(spark, d).select("part", "chunk", "lo", "hi", F.when(F.col("chunk") % 3 == 0, F.col("lo")).otherwise(F.col("hi")).alias("covered_hi"), F.col("n_rows").alias("rows_archived"))
    return archive.contract_breaches(results).select("part", "chunk")


# --- key codecs ---


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S') AS at, left(printf('%012x', epoch_us(ts) // 1000), 8) AS head FROM events")
def uuidv7_decode(spark: SparkSession, d: str) -> DataFrame:
    ids = events(spark, d).withColumn("u", codec.uuid_bound(event_time()))
    return ids.select("event_id", stamp(codec.uuid_decode(F.col("u"))).alias("at"), F.substring("u", 1, 8).alias("head"))


def _text_ids(spark: SparkSession, d: str, spec: codec.TextTime) -> DataFrame:
    return events(spark, d).withColumn("key", codec.text_time_encode(event_time(), spec)).withColumn("native", codec.text_time_decode(F.col("key"), spec))


@query("SELECT event_id, epoch_us(ts) // 1000 * 1000 AS native, 9 AS width FROM events")
def text_time_decode_b36(spark: SparkSession, d: str) -> DataFrame:
    return _text_ids(spark, d, codec.CUID).select("event_id", "native", F.length("key").alias("width"))


@query("SELECT event_id, epoch_us(ts) // 1000 * 1000 AS native, 10 AS width FROM events")
def text_time_decode_crockford(spark: SparkSession, d: str) -> DataFrame:
    return _text_ids(spark, d, codec.ULID).select("event_id", "native", F.length("key").alias("width"))


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS native, 27 AS width FROM events")
def text_time_decode_ksuid(spark: SparkSession, d: str) -> DataFrame:
    return _text_ids(spark, d, codec.KSUID).select("event_id", "native", F.length("key").alias("width"))


@query("SELECT event_id, printf('%08x', epoch_us(ts) // 1000000) AS key FROM events")
def text_time_objectid(spark: SparkSession, d: str) -> DataFrame:
    return _text_ids(spark, d, codec.OBJECT_ID).select("event_id", "key")


@query("SELECT count(*) AS sampled, count(*) FILTER (event_id % 5 <> 0) AS plausible, count(*) FILTER (event_id % 5 <> 0) / count(*) AS fraction, false AS newest_in_future FROM events")
def uuidv7_plausible(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("event_id") % 5 == 0, F.lit("00000000-0000-4000-8000-000000000000")).otherwise(codec.uuid_bound(event_time()))
    return reports.plausibility(events(spark, d), codec.uuid_decode(key), NOW).select("sampled", "plausible", "fraction", "newest_in_future")


@query("SELECT count(*) AS sampled, count(*) FILTER (event_id % 4 <> 0) AS plausible, count(*) FILTER (event_id % 4 <> 0) / count(*) AS fraction FROM events")
def text_time_plausible(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("event_id") % 4 == 0, F.lit("not an id!")).otherwise(codec.text_time_encode(event_time(), codec.CUID))
    return reports.plausibility(events(spark, d), codec.text_time_decode(key, codec.CUID), NOW).select("sampled", "plausible", "fraction")


# --- reports ---


@query("""WITH p AS (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS was FROM events)
SELECT count(was) AS pairs, count(*) FILTER (value >= was) AS in_order, count(*) FILTER (value >= was) / count(was) AS fraction FROM p""")
def check_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return reports.monotonic(events(spark, d), "event_id", "value", 1000)


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 20 = 0")
def fk_orphans_simple(spark: SparkSession, d: str) -> DataFrame:
    return reports.fk_orphans(orders(spark, d), table(spark, d, "customer").where("c_custkey % 20 <> 0"), [("o_custkey", "c_custkey")]).select("o_orderkey")


FK_CHILD = "nullif(o_custkey, o_custkey // 7 * 7)"


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {FK_CHILD} AS a, o_orderkey % 3 AS b FROM orders) WHERE a IS NULL OR (a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = a AND c_nationkey % 3 = b))")
def fk_orphans_full(spark: SparkSession, d: str) -> DataFrame:
    child = orders(spark, d).select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("a"), (F.col("o_orderkey") % 3).alias("b"))
    parent = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).cast("long").alias("n"))
    return reports.fk_orphans(child, parent, [("a", "c_custkey"), ("b", "n")], full=True).select("o_orderkey")


@query("SELECT l_orderkey, count(*) AS n_rows FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') GROUP BY 1")
def crossing_keys(spark: SparkSession, d: str) -> DataFrame:
    hit = reports.crossing(table(spark, d, "lineitem"), orders(spark, d), [("l_orderkey", "o_orderkey")], F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return hit.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT event_id, user_id FROM events WHERE user_id % 10 = 3 AND event_id >= 2000 ORDER BY event_id DESC LIMIT 20")
def recent_top20(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("user_id % 10 = 3 AND event_id >= 2000").orderBy(F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("SELECT count(*) AS n FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 1000")
def recent_count(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    top = rows.agg(F.max("event_id").alias("top"))
    return rows.join(F.broadcast(top), F.col("event_id") > F.col("top") - 1000).agg(F.count(F.lit(1)).alias("n"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """An action log read from events: the type of each names what was done."""
    e = events(spark, d)
    kind = F.col("user_id") % 4
    action = F.when(kind == 0, "skip_archive").when(kind == 1, "fail_retain").when(kind == 2, "archived").otherwise("regrain_step")
    return e.select((F.col("user_id") % 8).alias("parent"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), action.alias("action"), F.col("event_id").alias("rows"))


LOG_SQL = "WITH l AS (SELECT user_id % 8 AS parent, ts, event_id AS seq, ['skip_archive', 'fail_retain', 'archived', 'regrain_step'][user_id % 4 + 1] AS action FROM events) "


@query(LOG_SQL + "SELECT parent, count(*) AS rows_n, sum(seq)::BIGINT AS rows_copied, count(*) FILTER (action LIKE 'regrain%') AS n_regrains, 0::BIGINT AS n_retains FROM l WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def observe_window(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    actions = log(spark, d)
    since = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)
    n = actions.where(F.col("ts") >= F.lit(since)).groupBy("parent").agg(F.count(F.lit(1)).alias("rows_n"))
    return reports.observe_window(actions, since).join(n, "parent").select("parent", "rows_n", "rows_copied", "n_regrains", "n_retains")


@query("""WITH l AS (SELECT user_id % 2 AS parent, ts, event_id AS seq, ['skip_archive', 'fail_retain', 'archived', 'regrain_step'][user_id % 4 + 1] AS action FROM events),
r AS (SELECT *, count(*) FILTER (action IN ('archived', 'fail_retain')) OVER (PARTITION BY parent ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM l),
c AS (SELECT parent, run, count(*) AS n FROM r WHERE action = 'skip_archive' GROUP BY 1, 2) SELECT parent, max(n) AS longest FROM c GROUP BY 1""")
def skip_streaks(spark: SparkSession, d: str) -> DataFrame:
    actions = log(spark, d).withColumn("parent", F.col("parent") % 2)
    actions = actions.withColumn("action", F.when(F.col("action") == "fail_retain", "archived").otherwise(F.col("action")))
    return reports.skip_streaks(actions, "skip_archive", "archived")


@query(MIXED_SQL + ", " + LOG_SQL[5:].strip() + """, g AS (SELECT parent, max(ts) FILTER (action NOT LIKE 'fail%' AND action NOT LIKE 'skip%') AS good FROM l GROUP BY 1)
SELECT p.parent, (SELECT count(*) FROM reg) AS n_partitions, 1::BIGINT AS n_coarse,
  (SELECT count(*) FROM l JOIN g USING (parent) WHERE l.parent = p.parent AND action LIKE 'fail%' AND (good IS NULL OR ts > good)) AS n_failures,
  (SELECT count(*) FROM l JOIN g USING (parent) WHERE l.parent = p.parent AND action LIKE 'skip%' AND (good IS NULL OR ts > good)) AS n_skips FROM range(8) p(parent)""")
def status_rows(spark: SparkSession, d: str) -> DataFrame:
    registry = plans.marked(mixed(spark, d), DAYS, F.lit(NOW)).withColumn("parent", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    return reports.status(registry, log(spark, d)).select("parent", "n_partitions", "n_coarse", "n_failures", "n_skips")


@query(MIXED_SQL + "SELECT count(*) AS n_partitions, count(*) FILTER (hi <= TIMESTAMP '2024-01-20 12:00:00') AS n_frozen, count(*) FILTER (hi <= TIMESTAMP '2024-01-20 12:00:00' AND hi > lo + INTERVAL 1 DAY) AS n_coarse_frozen, epoch_us(max(hi)) - epoch_us(TIMESTAMP '2024-01-20 12:00:00') AS margin FROM reg")
def progress_rows(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit(NOW - 11 * DAY)
    return reports.progress(plans.marked(mixed(spark, d), DAYS, at), at).drop("ceiling")


@query(MIXED_SQL + ", keep AS (SELECT * FROM reg WHERE day(lo) % 4 <> 3) SELECT strftime(hi, '%Y-%m-%d %H:%M:%S') AS hi, strftime(n, '%Y-%m-%d %H:%M:%S') AS next_lo FROM (SELECT hi, lead(lo) OVER (ORDER BY lo) AS n FROM keep) WHERE n > hi")
def registry_holes(spark: SparkSession, d: str) -> DataFrame:
    keep = mixed(spark, d).where(F.dayofmonth(F.timestamp_micros("lo")) % 4 != 3)
    return reports.holes(keep).select(stamp(F.col("hi")).alias("hi"), stamp(F.col("next_lo")).alias("next_lo"))


# --- integrity ---


@query("SELECT event_id FROM events WHERE event_id % 13 = 5")
def no_lost_row(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id")
    return integrity.lost_rows(rows, rows.where("event_id % 13 > 5"), rows.where("event_id % 13 < 5"), ["event_id"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def no_duplicate_row(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicated_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def row_multiset(spark: SparkSession, d: str) -> DataFrame:
    return integrity.multiset(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("SELECT in_live, in_archive, count(*) AS n FROM (SELECT event_id % 3 <> 0 AS in_live, event_id % 2 = 0 AS in_archive FROM events) WHERE in_live OR in_archive GROUP BY 1, 2")
def row_states(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id")
    states = integrity.row_states(rows.where("event_id % 3 <> 0"), rows.where("event_id % 2 = 0"), ["event_id"])
    return states.groupBy("in_live", "in_archive").agg(F.count(F.lit(1)).alias("n"))


@query(CHUNK_SQL + "SELECT part::INTEGER AS part FROM plan GROUP BY part HAVING part % 2 = 1")
def drop_only_covered(spark: SparkSession, d: str) -> DataFrame:
    registry = years(spark, d)
    starts = registry.select("part", F.col("lo").alias("start"))
    done = ledger(spark, d).join(starts, "part").select(F.col("start").alias("part"), "lo", "hi")
    return integrity.uncovered_drops(registry.select("lo", "hi"), done).join(registry.select("part", "lo"), "lo").select("part")


@query(CHUNK_SQL + "SELECT part::VARCHAR AS object_key, count(*) AS n FROM plan GROUP BY part HAVING count(*) > 1")
def archive_no_clobber(spark: SparkSession, d: str) -> DataFrame:
    return integrity.clobbered_keys(chunks(spark, d).withColumn("object_key", F.col("part").cast("string")))


# --- turns ---

WIDTH = "length(o_orderstatus) + length(o_orderpriority) + 24"


@query(CHUNK_SQL.replace("4000 AS k", "200000 AS k") + """, y AS (SELECT year(o_orderdate) AS part, epoch_us(min(o_orderdate)) AS start, epoch_us(max(o_orderdate)) + 1 AS stop FROM orders GROUP BY 1)
SELECT start AS part, start AS lo, CASE WHEN (SELECT count(*) FROM plan q WHERE q.part = y.part) > 1 THEN hi ELSE stop END::BIGINT AS hi, n_rows::BIGINT AS rows_archived, 'orders_' || start AS object_key, false AS retired
FROM plan p JOIN y USING (part) WHERE chunk = 1 AND part <> 1995""")
def archive_turn(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of every year but the one that still takes writes."""
    registry = years(spark, d).withColumn("blocked", F.col("part") != 1995)
    empty = spark.createDataFrame([], lifecycle.LEDGER)
    keep = lambda chunk, lo, hi: (hi, chunk.count(), f"orders_{lo}")
    return lifecycle.archive_step(orders(spark, d), order_time(), registry, empty, keep, 200_000, F.expr(WIDTH), 30 * DAY, batch=20)


@query("""WITH y AS (SELECT year(o_orderdate) AS part, epoch_us(min(o_orderdate)) AS lo, epoch_us(max(o_orderdate)) + 1 AS hi FROM orders GROUP BY 1)
SELECT lo, hi FROM y WHERE part % 2 = 0 AND hi <= (SELECT max(hi) FROM y) - 86400000000""")
def retire_covered(spark: SparkSession, d: str) -> DataFrame:
    """Years that retention and whole coverage allow to drop: chunks of even years only are in the ledger."""
    registry = years(spark, d)
    done = chunks(spark, d).where("part % 2 = 0").join(registry.select("part", F.col("lo").alias("start")), "part")
    done = done.select(F.col("start").alias("part"), "lo", "hi", F.lit(False).alias("retired"))
    top = registry.agg(F.max("hi").alias("top")).first().top
    return lifecycle.retire(registry, done, F.lit(top - DAY))


@query("""WITH b AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS z FROM events),
p AS (SELECT unnest(generate_series(a, z - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS lo FROM b), s AS (SELECT epoch_us(lo) AS piece_lo, epoch_us(lo) + 86400000000 AS piece_hi,
CASE WHEN lo < (SELECT a + INTERVAL 5 DAY FROM b) THEN 'regrain_aged' ELSE 'regrain_copy' END AS action, CASE WHEN lo < (SELECT a + INTERVAL 5 DAY FROM b) THEN 0 ELSE (SELECT count(*) FROM events WHERE date_trunc('day', ts) = lo) END AS n_rows FROM p)
SELECT * FROM s UNION ALL SELECT epoch_us(z), epoch_us(z), 'regrain_swap', (SELECT sum(n_rows) FROM s)::BIGINT FROM b""")
def regrain_turns(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = event_span(spark, d, event_time(), DAYS)
    return lifecycle.regrain_steps(events(spark, d), event_time(), DAYS, lo, hi, lo + 5 * DAY)


def parents(spark: SparkSession) -> DataFrame:
    """Settings of eight tables that share the event registry; the last one is gone."""
    p = F.col("id")
    return spark.range(8).select(
        p.alias("parent"), F.lit("time").alias("control_kind"), F.lit("1 day").alias("partition_step"), F.lit(30).alias("obtain"), F.when(p % 2 == 0, "16 days").alias("retain"), (p % 3 == 0).alias("paused"),
        F.when(p % 2 == 1, "1 day").alias("regrain_to"), (p == 7).alias("parent_missing"), F.when(p % 2 == 0, F.lit(NOW - 16 * DAY)).alias("boundary"),
    )


TURN_LOG = "SELECT user_id % 8 AS parent, ts, user_id // 8 % 5 AS lo, ['skip_archive', 'fail_retain_drop', 'archive_chunk', 'retain_drop', 'regrain_copy', 'skip_archive', 'skip_archive'][event_id % 7 + 1] AS action FROM events"


@query(MIXED_SQL + ", l AS (" + TURN_LOG + """), d AS (SELECT parent, max(ts) FILTER (action = 'retain_drop') AS was FROM l GROUP BY 1), a AS (SELECT parent, lo, max(ts) FILTER (action = 'archive_chunk') AS was FROM l GROUP BY 1, 2),
k AS (SELECT l.parent, l.lo, count(*) AS n FROM l JOIN a ON a.parent = l.parent AND a.lo = l.lo WHERE action = 'skip_archive' AND (a.was IS NULL OR ts > a.was) GROUP BY 1, 2)
SELECT * REPLACE (coalesce(retain, 'none') AS retain, coalesce(regrain_to, 'none') AS regrain_to, coalesce(newest_bound, -1) AS newest_bound, coalesce(retain_backlog, -1) AS retain_backlog) FROM (SELECT p.parent, 'time' AS control_kind, '1 day' AS partition_step, 30 AS obtain, CASE WHEN p.parent % 2 = 0 THEN '16 days' END AS retain, p.parent % 3 = 0 AS paused,
  CASE WHEN p.parent = 7 THEN 0 ELSE (SELECT count(*) FROM reg) END AS n_partitions, CASE WHEN p.parent = 7 THEN 0 ELSE 1 END::BIGINT AS coarse_partitions, 0::BIGINT AS inflight_partitions,
  CASE WHEN p.parent <> 7 THEN (SELECT epoch_us(max(hi)) FROM reg) END AS newest_bound, CASE WHEN p.parent = 2 THEN 1 ELSE 0 END::BIGINT AS fks_suspended, CASE WHEN p.parent = 4 THEN 1 ELSE 0 END::BIGINT AS fks_unvalidated,
  p.parent <> 7 AS history_unregrained, (SELECT count(*) FROM l JOIN d USING (parent) WHERE l.parent = p.parent AND action = 'fail_retain_drop' AND (was IS NULL OR ts > was)) AS retain_drop_failures,
  CASE WHEN p.parent % 2 = 0 THEN (SELECT count(*) FROM reg WHERE epoch_us(hi) <= 1706702400000000 - 16 * 86400000000) END AS retain_backlog, 0::BIGINT AS retain_detaching, p.parent = 7 AS parent_missing,
  CASE WHEN p.parent % 2 = 1 THEN '1 day' END AS regrain_to, coalesce((SELECT max(n) FROM k WHERE k.parent = p.parent), 0) AS archive_skips FROM range(8) p(parent))""")
def status_full(spark: SparkSession, d: str) -> DataFrame:
    registry = plans.marked(mixed(spark, d), DAYS, F.lit(NOW)).withColumn("parent", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).withColumn("state", F.lit("attached"))
    names = F.array(*map(F.lit, ("skip_archive", "fail_retain_drop", "archive_chunk", "retain_drop", "regrain_copy", "skip_archive", "skip_archive")))
    turns = events(spark, d).select((F.col("user_id") % 8).alias("parent"), "ts", F.call_function("div", F.col("user_id"), F.lit(8)).alias("u"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("action"))
    keys = spark.range(8).select(F.col("id").alias("parent"), (F.col("id") == 2).alias("suspended"), (F.col("id") != 4).alias("validated"))
    return lifecycle.status(parents(spark), registry, turns.withColumn("lo", F.col("u") % 5).drop("u"), keys).na.fill("none", ["retain", "regrain_to"]).na.fill(-1, ["newest_bound", "retain_backlog"])


SPLIT = ("regrain_child", "regrain_cursor", "regrain_pct_range", "regrain_rows_copied", "regrain_elapsed", "regrain_eta")


@query(MIXED_SQL + """, tip AS (SELECT epoch_us(max(ts)) AS f FROM events), c AS (SELECT epoch_us(lo) AS lo, epoch_us(hi) AS hi FROM reg WHERE hi > lo + INTERVAL 1 DAY)
SELECT * REPLACE (coalesce(regrain_to, 'none') AS regrain_to, """ + ", ".join(f"coalesce({c}, -1) AS {c}" for c in SPLIT) + """) FROM (SELECT p.parent, 'time' AS control_kind, f AS frontier, (SELECT epoch_us(lo) FROM reg WHERE epoch_us(lo) <= f AND f < epoch_us(hi)) AS write_child, (SELECT epoch_us(hi) FROM reg WHERE epoch_us(lo) <= f AND f < epoch_us(hi)) AS write_ceiling,
  (SELECT epoch_us(hi) FROM reg WHERE epoch_us(lo) <= f AND f < epoch_us(hi)) - f AS freeze_margin, (SELECT epoch_us(hi) FROM reg WHERE epoch_us(lo) <= f AND f < epoch_us(hi)) - f AS freeze_in, 1::BIGINT AS coarse_frozen,
  CASE WHEN p.parent % 2 = 1 THEN '1 day' END AS regrain_to, CASE WHEN p.parent % 2 = 1 THEN c.lo END AS regrain_child, CASE WHEN p.parent % 2 = 1 THEN c.lo + 2 * 86400000000 END AS regrain_cursor, CASE WHEN p.parent % 2 = 1 THEN 2.0::DOUBLE / 7 END AS regrain_pct_range,
  CASE WHEN p.parent % 2 = 1 THEN (SELECT coalesce(sum(event_id), 0)::BIGINT FROM events WHERE user_id % 8 = p.parent) END AS regrain_rows_copied, CASE WHEN p.parent % 2 = 1 THEN 7200000000 END AS regrain_elapsed,
  CASE WHEN p.parent % 2 = 1 THEN 18000000000 END AS regrain_eta FROM range(8) p(parent), tip, c)""")
def progress_full(spark: SparkSession, d: str) -> DataFrame:
    registry = plans.marked(mixed(spark, d), DAYS, F.lit(NOW))
    one = registry.where("coarse").select(F.col("lo").alias("coarse_lo")).crossJoin(plans.frontier(events(spark, d), event_time()))  # one row each
    busy = F.col("parent") % 2 == 1
    settings = parents(spark).select("parent", "control_kind", "regrain_to").crossJoin(one).select(  # a row a table
        "parent", "control_kind", "regrain_to", "frontier", F.when(busy, F.col("coarse_lo")).alias("regrain_lo"), F.when(busy, F.col("coarse_lo") + 2 * DAY).alias("regrain_cursor"),
        F.when(busy, F.lit(NOW - 2 * HOUR)).alias("regrain_started"),
    )
    every = registry.withColumn("parent", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    copied = events(spark, d).select((F.col("user_id") % 8).alias("parent"), F.col("event_id").alias("rows"))
    return lifecycle.progress(settings, every, copied, NOW).na.fill("none", ["regrain_to"]).na.fill(-1, list(SPLIT))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_time_day(spark, sf_dir)
