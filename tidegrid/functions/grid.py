"""The partition grid as column expressions.

Values live in a native space: numbers for ``id`` keys, microseconds since 1970 UTC for every time kind, both as long or
decimal columns, so that a bound is compared and stored typed. The session's time zone must be UTC. Steps are a number,
a fixed length of time, or whole months; months are counted on the wall clock of the grid's zone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY, WEEK = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND, 7 * 86_400 * SECOND
#: 2000-01-01 00:00 UTC, a Saturday: weeks start on Saturdays.
DEFAULT_ANCHOR = 946_684_800 * SECOND


@dataclass(frozen=True)
class Grid:
    """kind is id or time (uuidv7 and text ids use time after decoding). One of step (number or microseconds) and
    months is positive; a mixed step is refused."""

    kind: str
    step: int = 0
    months: int = 0
    anchor: int | None = None
    tz: str = "UTC"

    def __post_init__(self):
        if self.kind not in ("id", "time"):
            raise ValueError(f"unknown kind {self.kind}")
        if (self.step > 0) == (self.months > 0) or self.step < 0 or self.months < 0 or (self.kind == "id" and self.months):
            raise ValueError("a step is a positive number or length of time, or whole months on a time grid, not a mix")

    @property
    def origin(self) -> int:
        return self.anchor if self.anchor is not None else (DEFAULT_ANCHOR if self.kind == "time" else 0)

    def floor(self, value: Column) -> Column:
        """The greatest grid point not above the value."""
        if self.months:
            origin = _month_of(F.lit(self.origin), self.tz)
            cell = let(_month_of(value, self.tz) - origin, lambda k: k - F.pmod(k, F.lit(self.months))) + origin
            at = let(cell, lambda k: F.array(month_edge(k, self.tz), month_edge(k - self.months, self.tz)))
            return let(at, lambda e: F.when(e[0] > value, e[1]).otherwise(e[0]))
        return value - F.pmod(value - F.lit(self.origin), F.lit(self.step))

    def next(self, point: Column, cells: int | Column = 1) -> Column:
        """The grid point ``cells`` steps above a grid point."""
        n = F.lit(cells) if isinstance(cells, int) else cells
        if self.months:
            return month_edge(_month_of(point, self.tz) + n * self.months, self.tz)
        return point + n * F.lit(self.step)


def floor_div(a: Column, b: Column) -> Column:
    """Exact quotient, floored toward minus infinity; fractions are allowed."""
    return F.call_function("div", a - F.pmod(a, b), b)


def micros(ts: Column) -> Column:
    """Native value of a timestamp; a naive one is read on its own wall clock."""
    return F.unix_micros(ts.cast("timestamp"))


def instant(native: Column) -> Column:
    """Native value to a timestamp without zone, the UTC wall clock."""
    return F.timestamp_micros(native).cast("timestamp_ntz")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, where an expression needs it in several places."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _month_of(value: Column, tz: str) -> Column:
    local = F.from_utc_timestamp(F.timestamp_micros(value), tz)
    return let(local, lambda x: F.year(x) * 12 + F.month(x) - 1).cast("long")


def month_edge(index: Column, tz: str) -> Column:
    """Local midnight of a month's first day, as microseconds. Where midnight is skipped it is the day's first instant;
    where it comes twice, the second one."""
    date = let(index, lambda k: F.make_date(floor_div(k, F.lit(12)).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1)))

    def edge(wall: Column) -> Column:
        first = F.unix_micros(F.to_utc_timestamp(wall, tz))
        again = lambda x, later: F.from_utc_timestamp(F.timestamp_micros(x + later), tz) == wall
        return let(first, lambda x: F.when(again(x, HOUR), x + HOUR).when(again(x, HOUR // 2), x + HOUR // 2).otherwise(x))

    return let(date.cast("timestamp"), edge)


def fraction(lo: Column, hi: Column, value: Column) -> Column:
    """Where a value lies in a range, 0 to 1; null for an empty range."""
    return (value - lo) / F.nullif(hi - lo, F.lit(0))


# --- labels ---

# The pattern of a label at each grain, coarsest first.
GRAINS = [("year", "yyyy"), ("month", "yyyy_MM"), ("day", "yyyy_MM_dd"), ("hour", "yyyy_MM_dd_HH"), ("minute", "yyyy_MM_dd_HHmm"), ("second", "yyyy_MM_dd_HHmmss"), ("microsecond", "yyyy_MM_dd_HHmmss_SSSSSS")]


def grain(grid: Grid) -> int:
    """The grain, by its place in GRAINS, at which no two cells share a label."""
    if grid.months:
        return 0 if grid.months % 12 == 0 else 1
    for place, least in ((2, DAY), (3, HOUR), (4, MINUTE), (5, SECOND)):
        if grid.step >= least:
            return place
    return 6


def bound_label(grid: Grid, value: Column, place: int | None = None) -> Column:
    """One bound's label: 19 digits for an id, never cut; years and months on the zone's wall clock, the rest in UTC."""
    if grid.kind == "id":
        digits = F.abs(value).cast("string")
        padded = F.when(F.length(digits) < 19, F.lpad(digits, 19, "0")).otherwise(digits)
        return F.concat(F.when(value < 0, "-").otherwise(""), F.replace(padded, F.lit("."), F.lit("_")))
    place = grain(grid) if place is None else place
    ts = F.timestamp_micros(value)
    local = F.from_utc_timestamp(ts, grid.tz) if place <= 1 else ts
    text = F.date_format(local, GRAINS[place][1])
    return F.when(F.year(local) <= 0, F.concat(F.lpad((1 - F.year(local)).cast("string"), 4, "0"), F.substring(F.date_format(local, GRAINS[place][1]), 5, 99), F.lit("_bc"))).otherwise(text)


def label(grid: Grid, relation: str, lo: Column, hi: Column | None = None) -> Column:
    """``<relation>_p<lo>`` for one step, ``<relation>_p<lo>_to_<hi>`` for more."""
    fine = F.concat(F.lit(f"{relation}_p"), bound_label(grid, lo))
    if hi is None:
        return fine
    return F.when(hi.isNull() | (hi <= grid.next(lo)), fine).otherwise(F.concat(fine, F.lit("_to_"), bound_label(grid, hi)))


def clamped_label(grid: Grid, relation: str, lo: Column, hi: Column) -> Column:
    """The label of a cell that a coarser range cut: the coarsest grain, from the step's on, that reads both bounds
    exactly; a cell on the grid keeps its plain name."""
    out = None
    for place in range(grain(grid), len(GRAINS)):
        zone = grid.tz if place <= 1 else "UTC"
        unit = GRAINS[place][0]
        exact = F.lit(True)
        for bound in (lo, hi):
            wall = F.from_utc_timestamp(F.timestamp_micros(bound), zone)
            exact = exact & (F.date_trunc(unit, wall) == wall)
        name = F.concat(F.lit(f"{relation}_p"), bound_label(grid, lo, place))
        out = F.when(exact, name) if out is None else out.when(exact, name)
    on_grid = (grid.floor(lo) == lo) & (hi == grid.next(lo))
    return F.when(on_grid, label(grid, relation, lo)).otherwise(out.otherwise(F.concat(F.lit(f"{relation}_p"), bound_label(grid, lo, 6))))
