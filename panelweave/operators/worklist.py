"""Work lists: what is to be computed and what is already done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.blocks import spread_join
from panelweave.operators.series import HORIZONS, SEASON
from panelweave.schemas import RUN, SERIES, STATION


def without_finished(todo: DataFrame, done: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Leave out work that already has stored results."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def with_results(df: DataFrame, results: DataFrame) -> DataFrame:
    """Keep the rows of stations that have stored results."""
    return spread_join(df, results.select(*STATION).distinct(), STATION, "left_semi")


def run_setups(spark: SparkSession, horizons: dict[str, list[int]] | None = None) -> DataFrame:
    """All forecast setups of one series by rate: time-based, and direct per horizon and feature set."""
    horizons = HORIZONS if horizons is None else horizons
    rows = []
    for rate, steps in horizons.items():
        for differenced in (False, True):
            rows.append((rate, SEASON[rate], differenced, False, False))
            rows += [(rate, h, differenced, True, artificial) for h in steps for artificial in (True, False)]
    return spark.createDataFrame(
        rows, "rate string, distance int, differenced boolean, direct boolean, artificial boolean")


def work_list(frame: DataFrame, done: DataFrame | None = None,
              horizons: dict[str, list[int]] | None = None) -> DataFrame:
    """One row per series and setup, without finished ones.

    Forecasting from the other pollutants needs two of them, so those setups exist only for such stations. The
    list of setups is a fixed table of about sixty rows, hence the broadcast.
    """
    setups = run_setups(frame.sparkSession, horizons)
    series = frame.select(*SERIES).distinct()
    rich = series.groupBy(*STATION).agg((F.count("pollutant") >= 3).alias("_rich"))
    todo = (series.join(rich, STATION).join(F.broadcast(setups), "rate")
            .filter(~F.col("direct") | F.col("artificial") | F.col("_rich")).select(*RUN))
    return todo if done is None else without_finished(todo, done)
