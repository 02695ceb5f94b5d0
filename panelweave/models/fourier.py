"""Trend and seasonality as a linear model of time and Fourier terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.models.regression import least_squares, linear_value
from panelweave.operators.blocks import spread_join

# Fixed values: (period in days, number of harmonics). Hourly series add the day.
PERIODS = {"D": [(7.0, 3)], "H": [(7.0, 3), (1.0, 4)]}


def time_features(ts: Column, rate: str) -> Column:
    days = F.unix_seconds(ts) / 86400.0
    terms = [days / 365.25]
    for period, harmonics in PERIODS[rate]:
        for k in range(1, harmonics + 1):
            angle = days * (2 * math.pi * k / period)
            terms += [F.sin(angle), F.cos(angle)]
    return F.array(*terms)


def forecast(rows: DataFrame, rate: str, keys: list[str]) -> DataFrame:
    """Holdout rows with ``predicted`` and ``fit_time``; ``rows`` has ``ts, slot, block, value, is_holdout``."""
    design = rows.filter(F.col("rate") == rate).withColumn("features", time_features(F.col("ts"), rate))
    fitted = least_squares(design.filter(~F.col("is_holdout")), keys, label="value")
    held = spread_join(design.filter("is_holdout"), fitted.select(*keys, "intercept", "coef", "fit_time"), keys, spread=("slot",))
    return held.withColumn("predicted", linear_value()).drop("features", "intercept", "coef")
