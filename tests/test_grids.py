from datetime import datetime

import pytest
from panel_helpers import numbered, values
from pyspark.sql import functions as F

from panelweave.operators.blocks import with_grid_slot
from panelweave.operators.resample import drop_incomplete_starts, interpolate, resample


def test_fixtures_have_gaps(daily, hourly):
    assert daily.select("ts").distinct().count() == 3
    assert hourly.select("ts").distinct().count() == 3
    assert hourly.filter(F.hour("ts") == 2).count() == 0


def test_daily(daily):
    out = resample(daily, "D")
    assert values(out, "PM10") == [12, 19, 31, 43]
    assert values(out, "PM2.5") == [8, 13, 22.5, 32]
    assert values(out, "PM10", "ts") == [datetime(2013, 1, d) for d in (11, 12, 13, 14)]


def test_hourly(hourly):
    out = resample(hourly, "H")
    assert values(out, "NO") == pytest.approx([36.848, 42.785, 29.825, 16.865])
    assert values(out, "PM10")[2] == pytest.approx(116.482)
    assert values(out, "SO2")[2] == pytest.approx(7.731)


def test_mixed_rates_in_one_call(daily, hourly):
    assert resample(daily.unionByName(hourly)).count() == 8 + 12


def test_daily_backfill_takes_exact_label_too(panel):
    df = panel({"a": [("2020-01-01 00:00:00", 1), ("2020-01-04 00:00:00", 4), ("2020-01-06 23:00:00", 6)]}, "D")
    assert values(resample(df, "D")) == [1, 2.5, 4, 4, 5, 6]


def test_daily_backfill_works_on_rows(panel):
    df = panel({
        "a": [("2020-01-01 23:00:00", 1), ("2020-01-02 10:00:00", 7), ("2020-01-02 23:00:00", 9), ("2020-01-03 23:00:00", 5)],
        "b": [("2020-01-01 23:00:00", 1), ("2020-01-02 23:00:00", 3), ("2020-01-03 23:00:00", 5)]}, "D")
    out = resample(df, "D")
    assert values(out, "a") == [1, 7, 5]
    assert values(out, "b") == [1, 3, 5]
    assert values(resample(df, "D", interpolate=False), "b") == [1, None, 5]


def test_off_grid_hours_drop_out_but_span_the_grid(panel):
    df = panel({"a": [("2020-01-01 00:30:00", 9), ("2020-01-01 01:00:00", 1), ("2020-01-01 03:00:00", 3), ("2020-01-01 04:30:00", 9)]})
    assert values(resample(df, "H")) == [1, 2, 3, 3]
    assert values(resample(df, "H", align=False)) == [None, 1, 2, 3, 3]


def test_start_alignment(panel):
    df = panel({"a": [("2020-01-01 00:00:00", 1), ("2020-01-01 04:00:00", 5)],
                "b": [("2020-01-01 02:00:00", 7), ("2020-01-01 03:00:00", 8)]})
    out = resample(df, "H")
    assert values(out, "a") == [3, 4, 5]
    assert values(out, "b") == [7, 8, 8]
    loose = resample(df, "H", align=False)
    assert values(loose, "b") == [None, None, 7, 8, 8]
    assert values(drop_incomplete_starts(loose), "a") == [3, 4, 5]


def test_series_without_any_cell_empties_its_station(panel):
    df = panel({"a": [("2020-01-01 00:00:00", 1), ("2020-01-01 01:00:00", 2)], "b": [("2020-01-01 00:30:00", 2)]})
    assert resample(df, "H").count() == 0


@pytest.mark.parametrize("block", [2, 3, 8760])
def test_long_gap_spans_blocks(panel, block):
    df = panel({"a": [("2020-01-01 00:00:00", 0), ("2020-01-01 10:00:00", 10), ("2020-01-01 12:00:00", 0)]})
    assert values(resample(df, "H", block_slots=block)) == pytest.approx([*range(11), 5, 0])


@pytest.mark.parametrize("block", [2, 8760])
@pytest.mark.parametrize("by", ["time", "position"])
def test_interpolation_edges(panel, block, by):
    df = with_grid_slot(panel({"a": [(f"2020-01-01 0{i}:00:00", v) for i, v in enumerate([None, 1, None, 3, None])]}))
    assert values(interpolate(df, by, block_slots=block)) == [None, 1, 2, 3, 3]


def test_interpolation_by_time_and_position_differ_on_irregular_rows(panel):
    df = numbered(panel({"a": [("2020-01-01 00:00:00", 0), ("2020-01-01 01:00:00", None), ("2020-01-01 04:00:00", 4)]}))
    assert values(interpolate(df, "time")) == [0, 1, 4]
    assert values(interpolate(df, "position")) == [0, 2, 4]
