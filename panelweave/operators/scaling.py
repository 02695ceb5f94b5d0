"""Min-max scaling to a fixed range and its inverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.blocks import spread_join
from panelweave.schemas import SERIES

FEATURE_RANGE = (-1.0, 1.0)


def fit_scaler(df: DataFrame, columns: Sequence[str] = ("value",), keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per series with ``min_<column>`` and ``max_<column>``."""
    aggs = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*aggs)


def scaled(value: Column, low: Column, high: Column, feature_range=FEATURE_RANGE) -> Column:
    """A constant column maps to the lower bound."""
    lo, hi = feature_range
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - low) / width * (hi - lo) + lo


def rescaled(value: Column, low: Column, high: Column, feature_range=FEATURE_RANGE) -> Column:
    lo, hi = feature_range
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - lo) / (hi - lo) * width + low


def _apply(df: DataFrame, scaler: DataFrame, columns, keys, formula, feature_range) -> DataFrame:
    out = spread_join(df, scaler, keys)
    for c in columns:
        out = out.withColumn(c, formula(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}"), feature_range))
    return out.select(*df.columns)


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str] = ("value",), keys: Sequence[str] = SERIES,
          feature_range=FEATURE_RANGE) -> DataFrame:
    return _apply(df, scaler, columns, keys, scaled, feature_range)


def rescale(df: DataFrame, scaler: DataFrame, columns: Sequence[str] = ("value",), keys: Sequence[str] = SERIES,
            feature_range=FEATURE_RANGE) -> DataFrame:
    return _apply(df, scaler, columns, keys, rescaled, feature_range)


def fit_array_scaler(df: DataFrame, features: str = "features", label: str = "label",
                     keys: Sequence[str] = SERIES) -> DataFrame:
    """Scaler of a feature array (per position) and its label: ``x_min, x_max`` arrays, ``y_min, y_max``."""
    per_position = (df.select(*keys, F.posexplode(features).alias("i", "v"))
                    .groupBy(*keys, "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    ordered = F.array_sort(F.collect_list(F.struct("i", "lo", "hi")))  # one entry per feature
    x = per_position.groupBy(*keys).agg(ordered.alias("_c")).select(
        *keys, F.transform("_c", lambda c: c["lo"]).alias("x_min"), F.transform("_c", lambda c: c["hi"]).alias("x_max"))
    y = df.groupBy(*keys).agg(F.min(label).alias("y_min"), F.max(label).alias("y_max"))
    return x.join(y, list(keys))


def scale_inputs(df: DataFrame, scaler: DataFrame, keys: Sequence[str] = SERIES, inverse: bool = False) -> DataFrame:
    """Scale (or restore) ``features`` and ``label`` of supervised rows with :func:`fit_array_scaler`."""
    formula = rescaled if inverse else scaled
    cells = F.arrays_zip(F.col("features").alias("v"), F.col("x_min").alias("lo"), F.col("x_max").alias("hi"))
    return (spread_join(df, scaler, keys)
            .withColumn("features", F.transform(cells, lambda c: formula(c["v"], c["lo"], c["hi"])))
            .withColumn("label", formula(F.col("label"), F.col("y_min"), F.col("y_max")))
            .select(*df.columns))


def as_sequence(features: Column | str) -> Column:
    """Feature vector as a one-channel sequence ``[[x1], [x2], …]`` for recurrent models."""
    return F.transform(features, lambda v: F.array(v))
