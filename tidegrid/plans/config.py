"""A managed table's settings, with the refusals that protect them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import TextTime
from ..functions.grid import Grid
from . import registry as plans


class Refused(ValueError):
    """A request that would lose or misplace rows."""


def control_kind(schema: T.StructType, column: str, encoding: TextTime | None = None) -> str:
    """id, time, uuidv7 or text_time, from the column's type; floats are refused."""
    kind = schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return "id"
    if isinstance(kind, T.StringType):
        return "text_time" if encoding else "uuidv7"
    raise Refused(f"a {kind.simpleString()} column can't order partitions")


@dataclass(frozen=True)
class TableConfig:
    name: str
    control: str
    grid: Grid
    encoding: TextTime | None = None
    obtain: int = 30
    retain: int | None = None
    retain_batch: int | None = None
    archive: str | None = None
    archive_bytes: int = 8 << 20
    paused: bool = True

    def pause(self) -> TableConfig:
        return replace(self, paused=True)

    def resume(self) -> TableConfig:
        return replace(self, paused=False)

    def set_obtain(self, ahead: int) -> TableConfig:
        if ahead < 0:
            raise Refused("a count of cells can't be negative")
        return replace(self, obtain=ahead)

    def set_retain(self, keep: int | None, registry: DataFrame, frontier: int, force: bool = False) -> TableConfig:
        """Refused if partitions that the old setting kept would be dropped, unless forced."""
        if keep is not None and keep < 0:
            raise Refused("retention can't be negative")
        if keep is not None and not force:
            at = F.lit(frontier)
            new = plans.retain_plan(registry, plans.retain_boundary(self.grid, at, keep))
            if self.retain is not None:
                new = new.where(F.col("hi") > plans.retain_boundary(self.grid, at, self.retain))
            if not new.isEmpty():
                raise Refused("partitions would be dropped at once")
        return replace(self, retain=keep)

    def native(self) -> Column:
        """The control column as a native value."""
        from ..functions import codec, grid

        if self.encoding:
            return codec.text_time_decode(F.col(self.control), self.encoding)
        return grid.micros(F.col(self.control)) if self.grid.kind == "time" else F.col(self.control)


@dataclass
class ArchiveStrategies:
    """Archive functions by name: (rows, lo, hi) -> result with covered_hi and rows_archived."""

    known: dict[str, Callable] = field(default_factory=lambda: {"none": None})

    def register(self, name: str, run: Callable) -> None:
        self.known[name] = run

    def get(self, name: str) -> Callable | None:
        if name not in self.known:
            raise Refused(f"no archive strategy {name}")
        return self.known[name]
