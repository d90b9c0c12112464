"""Hand-derived vectors of grids, labels and codecs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import codec, digest
from tidegrid.functions.grid import DAY, HOUR, WEEK, Grid, clamped_label, floor_div, fraction, label

L = F.lit


def us(text: str) -> int:
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_id_floor(spark):
    wide = Grid("id", 30_000_000_000_000_000)
    assert values(
        spark, wide.floor(L(1799999999999999999)), wide.floor(L(1800000000000000000)), Grid("id", 10).floor(L(-5)),
        Grid("id", 10).floor(L(-10)), Grid("id", 10, anchor=3).floor(L(17)), floor_div(L(-5), L(10)),
    ) == [1770000000000000000, 1800000000000000000, -10, -10, 13, -1]


def test_months_where_midnight_repeats_or_is_skipped(spark):
    havana = Grid("time", months=1, tz="America/Havana")
    quarter = Grid("time", months=3, tz="America/Havana", anchor=us("2000-02-01T05:00:00"))
    asuncion = Grid("time", months=1, tz="America/Asuncion")
    assert values(
        spark, havana.next(havana.floor(L(us("2020-10-15T12:00:00")))), havana.floor(L(us("2020-11-01T04:30:00"))),
        havana.floor(L(us("2020-11-01T05:00:00"))), quarter.floor(L(us("2020-11-01T04:30:00"))), asuncion.floor(L(us("2023-10-15T12:00:00"))),
    ) == [us("2020-11-01T05:00:00"), us("2020-10-01T04:00:00"), us("2020-11-01T05:00:00"), us("2020-08-01T04:00:00"), us("2023-10-01T04:00:00")]


def test_weeks_start_on_saturday_and_labels(spark):
    assert values(
        spark, Grid("time", WEEK).floor(L(us("2026-11-01T05:30:00"))),
        label(Grid("time", months=1), "events", L(us("2015-03-01T00:00:00")), L(us("2015-04-01T00:00:00"))),
        label(Grid("time", months=1), "events", L(us("2015-03-01T00:00:00")), L(us("2026-07-01T00:00:00"))),
        label(Grid("id", 1000), "m", L(0), L(5000)), label(Grid("time", HOUR, tz="America/New_York"), "ev", L(us("2026-11-01T05:00:00"))),
        clamped_label(Grid("time", DAY, tz="America/New_York"), "events", L(us("2024-02-01T05:00:00")), L(us("2024-02-02T00:00:00"))),
        clamped_label(Grid("time", months=12, tz="America/New_York"), "events", L(us("2023-03-01T05:00:00")), L(us("2023-12-01T05:00:00"))),
    ) == [us("2026-10-31T00:00:00"), "events_p2015_03", "events_p2015_03_to_2026_07", f"m_p{0:019d}_to_{5000:019d}", "ev_p2026_11_01_05", "events_p2024_02_01_05", "events_p2023_03"]


def test_steps_are_refused():
    for bad in ({"kind": "time"}, {"kind": "time", "step": 1, "months": 1}, {"kind": "id", "months": 1}, {"kind": "float", "step": 1}):
        with pytest.raises(ValueError):
            Grid(**bad)


def test_radix_and_text_time(spark):
    two = codec.TextTime("c", 2, 36, 1000)
    low = codec.TextTime("", 4, 16, 1_000_000, discard_bits=8, epoch_us=us("2000-01-01T00:00:00"))
    assert values(
        spark, codec.radix_decode(L("z"), 36), codec.radix_decode(L("10"), 36), codec.radix_encode(L(36), 36, 2), codec.radix_encode(L(1296), 36, 2),
        codec.radix_decode(L("g"), 16), codec.text_time_encode(L(1_295_000), two), codec.text_time_decode(L("czz"), two),
        codec.text_time_encode(L(1_296_000), two), codec.text_time_decode(L("xzz"), two),
        codec.text_time_decode(L("0105"), low), codec.text_time_encode(L(us("2000-01-01T00:00:01")), low),
    ) == [35, 36, "10", None, None, "czz", 1_295_000, None, None, us("2000-01-01T00:00:01"), "0100"]


def test_round_trips(spark):
    at = us("2026-01-01T00:00:00")
    specs = (codec.CUID, codec.ULID, codec.KSUID, codec.OBJECT_ID)
    assert values(spark, *[codec.text_time_decode(codec.text_time_encode(L(at), s), s) for s in specs], codec.uuid_decode(codec.uuid_bound(L(at)))) == [at] * 5
    with pytest.raises(ValueError):
        codec.TextTime("", 4, 62, 1, "0123")


def test_stems_and_fraction(spark):
    at = us("2024-01-01T00:00:00")
    assert values(spark, digest.object_stem("time", L(at)), digest.object_stem("time", L(at + 100_000)), fraction(L(0), L(250), L(50)), fraction(L(1), L(1), L(1))) == ["2024010100000000", "20240101000000.100", 0.2, None]
