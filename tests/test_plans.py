"""Shape of the physical plans."""

import re

from pyspark.sql import functions as F

from panelweave.models import regression, supervised
from panelweave.operators import ingest, resample, series
from panelweave.operators.blocks import over_series, with_grid_slot
from panelweave.schemas import SERIES
from panelweave.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, hourly, tmp_path):
    path = str(tmp_path / "m")
    tables.write_measurements(hourly, path)
    return tables.read_measurements(spark, path)


def test_series_chain_has_one_exchange_and_one_sort(spark, hourly, tmp_path):
    df = with_grid_slot(stored(spark, hourly, tmp_path))
    text = plan(series.artificial_features(df, 24))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Sort") == 1
    text = plan(supervised.artificial_rows(df, "H", [1, 2, 24], differenced=True))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Sort") == 1


def test_block_factor_needs_no_further_exchange(spark, hourly, tmp_path):
    df = with_grid_slot(stored(spark, hourly, tmp_path))
    rows = supervised.artificial_rows(df, "H", [1])
    text = plan(regression.factors(rows, SERIES))
    # one for the windows, one to bring together the factors of a series
    assert text.count("Exchange hashpartitioning") == 2


def test_windows_never_run_over_a_whole_series(spark, hourly, tmp_path):
    df = with_grid_slot(stored(spark, hourly, tmp_path))
    chains = [series.difference(df), series.lag_features(df, 24), series.horizon_explode(df, [1, 24]),
              over_series(df, lambda w: [F.lag("value", 2).over(w).alias("x")], before=2)]
    for df in chains:
        for spec in re.findall(r"\+- Window \[.*?\], \[(.*?)\], \[", plan(df)):
            assert "block" in spec, spec


def test_filters_and_columns_reach_the_scan(spark, hourly, tmp_path):
    df = stored(spark, hourly, tmp_path)
    text = plan(resample.resample(df, "H"))
    assert "PartitionFilters: [isnotnull(rate" in text
    text = plan(ingest.coverage(df))
    assert "ReadSchema: struct<ts:timestamp,pollutant:string,value:double>" in text


def test_duplicates_collapse_before_the_exchange(spark, hourly):
    text = plan(resample.daily_points(hourly))
    first = text[text.rindex("Exchange"):]
    assert "partial_min" in first
