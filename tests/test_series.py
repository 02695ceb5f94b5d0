import pytest
from panel_helpers import numbered, values
from pyspark.sql import functions as F

from panelweave.functions import params as p
from panelweave.operators import scaling, series
from panelweave.operators.blocks import BLOCK_SLOTS, with_grid_slot, with_row_slot

BLOCKS = pytest.mark.parametrize("block", [2, BLOCK_SLOTS])


@BLOCKS
def test_lags_and_statistics(short, block):
    rows = series.artificial_features(short, 3, block_slots=block).orderBy("ts").collect()
    assert [(r.lag_1, r.lag_2, r.lag_3) for r in rows] == [(1, None, None), (2, 1, None), (4, 2, 1), (8, 4, 2)]
    assert [(r["sum"], r["mean"], r["median"]) for r in rows] == [(1, 1, 1), (3, 2, 2), (7, 3.5, 3.5), (14, 7, 7)]


def test_statistics_of_lags_only(short):
    rows = series.artificial_features(short, 3, stat_mode="lags_only").orderBy("ts").collect()
    assert [(r["sum"], r["mean"], r["median"]) for r in rows][2] == (7, pytest.approx(7 / 3), 2)


def test_calendar_flags(short):
    row = series.artificial_features(short, 1, weekdays=True, months=True, statistical=False).first()
    assert row.Wednesday and not row.Monday and row.Jan and not row.Feb


@BLOCKS
def test_targets(short, block):
    out = series.target_shift(short, 1, block)
    assert [(r.value, r.target) for r in out.orderBy("ts").collect()] == [(1, 2), (2, 4), (4, 8)]
    assert series.horizon_explode(short, [1, 3], block).count() == 4


@BLOCKS
def test_rotate(short, block):
    assert values(series.rotate_left(short, block)) == [2, 4, 8, 1]


@pytest.mark.parametrize("pollutant, diffs, start, restored", [("PM10", [7, 24], 12, [19, 43]), ("PM2.5", [5, 19], 8, [13, 32])])
def test_difference_and_inverse(daily, pollutant, diffs, start, restored):
    rows = numbered(daily)
    diff = series.difference(rows)
    assert values(diff, pollutant) == diffs
    first = series.first_values(rows)
    assert first.filter(F.col("pollutant") == pollutant).first().start == start
    assert values(series.dedifference(diff, first), pollutant) == restored


@BLOCKS
def test_difference_round_trip(panel, block):
    data = [(f"2020-01-0{1 + i // 24} {i % 24:02d}:00:00", (i * 7) % 11) for i in range(60)]
    df = with_grid_slot(panel({"a": data}))
    back = series.dedifference(series.difference(df, 1, block), series.first_values(df), block)
    assert values(back) == [v for _, v in data][1:]
    assert values(series.difference(df, 3, block)) == [data[i][1] - data[i - 3][1] for i in range(3, 60)]


@BLOCKS
def test_row_ranges(short, block):
    assert values(series.head(short, 3)) == [1, 2, 4]
    assert values(series.skip(short, 1, block)) == [2, 4, 8]
    assert values(series.tail(short, 2, block)) == [4, 8]
    assert values(series.tail(short, 3, block)) == [2, 4, 8]
    assert values(series.holdout_split(short, 1, block_slots=block), column="is_holdout") == [False, False, False, True]
    assert all(values(series.holdout_split(short, block_slots=block), column="is_holdout"))


def test_row_numbers_of_irregular_rows(daily):
    for block in (1, 2, BLOCK_SLOTS):
        assert values(with_row_slot(daily, block_slots=block), "PM10", "slot") == [0, 1, 2]


def test_time_series_split(panel):
    df = with_grid_slot(panel({"a": [(f"2020-01-01 0{i}:00:00", i) for i in range(10)]}))
    out = series.time_series_split(df, 3)
    for fold, (train, test) in enumerate([(4, [4, 5]), (6, [6, 7]), (8, [8, 9])]):
        part = out.filter(F.col("fold") == fold)
        assert values(part.filter("in_train")) == list(range(train))
        assert values(part.filter("in_test")) == test


def test_scale(daily):
    scaler = scaling.fit_scaler(daily)
    out = scaling.scale(daily, scaler)
    assert values(out, "PM10") == pytest.approx([-1, -0.548387, 1], abs=1e-6)
    assert values(out, "PM2.5") == pytest.approx([-1, -0.583333, 1], abs=1e-6)
    assert values(scaling.rescale(out, scaler), "PM10") == [12, 19, 43]


def test_scale_constant(panel):
    df = panel({"a": [("2020-01-01 00:00:00", 5), ("2020-01-01 01:00:00", 5)]})
    scaler = scaling.fit_scaler(df)
    assert values(scaling.scale(df, scaler)) == [-1, -1]
    assert values(scaling.rescale(scaling.scale(df, scaler), scaler)) == [5, 5]


def test_scale_inputs_round_trip(spark):
    rows = [("S", "H", "a", [float(i), float(i * i)], float(3 * i)) for i in range(5)]
    df = spark.createDataFrame(rows, "station string, rate string, pollutant string, features array<double>, label double")
    df = df.withColumn("ts", F.current_timestamp())
    scaler = scaling.fit_array_scaler(df)
    scaled = scaling.scale_inputs(df, scaler)
    flat = [v for r in scaled.collect() for v in (*r.features, r.label)]
    assert min(flat) == -1 and max(flat) == 1
    back = sorted((r.label, list(r.features)) for r in scaling.scale_inputs(scaled, scaler, inverse=True).collect())
    assert [b[0] for b in back] == pytest.approx([0, 3, 6, 9, 12])
    assert back[3][1] == pytest.approx([3, 9])
    assert scaled.select(scaling.as_sequence("features").alias("s")).first().s[0] == [scaled.first().features[0]]


def test_other_series(hourly):
    rows = series.other_series_features(hourly).filter("pollutant = 'PM10'").orderBy("ts").collect()
    assert list(rows[0].features) == [36.848, 27.458]
    assert series.feature_gate(hourly, 3).count() == 9
    assert series.feature_gate(hourly, 4).count() == 0


def test_parameter_ranges(spark):
    row = spark.range(1).select(p.linspace(1, 100, 20, as_int=True).alias("w"), p.int_range(2, 50, 2).alias("k"),
                                p.linspace(0.1, 0.3, 3).alias("d")).first()
    assert row.w[0] == 1 and row.w[-1] == 100 and len(row.w) == 20 and row.w[1] == 6
    assert len(row.k) == 25 and row.d == pytest.approx([0.1, 0.2, 0.3])
