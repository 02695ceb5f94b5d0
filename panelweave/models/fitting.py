"""Hook for models that need a whole series at once, such as recursions or user-supplied trainers."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.models.regression import _schema_of

FORECAST = "params map<string,string>, step int, predicted double, fit_time double, prediction_time double, error string"


def fit_predict_per_series(df: DataFrame, fn: Callable[[pd.DataFrame], tuple[dict, Sequence[float], float, float]],
                           keys: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Run ``fn`` on every series: it gets the rows in time order and returns parameters, forecasts and two times.

    ``fn`` sees a whole series, so its task holds one: with ``max_rows`` a longer series is skipped like one on which
    ``fn`` raises ``ValueError``. The only row of a skipped series has ``error`` set and no forecast.
    """
    keys = list(keys)
    schema = _schema_of(df, keys, FORECAST)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[keys].head(1)
        try:
            if max_rows is not None and len(pdf) > max_rows:
                raise ValueError(f"series of {len(pdf)} rows exceeds the limit of {max_rows}")
            params, values, fit_time, prediction_time = fn(pdf.sort_values("slot"))
        except ValueError as problem:
            return head.assign(params=None, step=None, predicted=None, fit_time=None, prediction_time=None,
                               error=str(problem))[schema.names]
        out = pd.concat([head] * len(values), ignore_index=True)
        out["params"] = [{k: str(v) for k, v in params.items()}] * len(values)
        out["step"], out["predicted"] = range(len(values)), [float(v) for v in values]
        out["fit_time"], out["prediction_time"], out["error"] = fit_time, prediction_time, None
        return out[schema.names]

    return df.groupBy(*keys).applyInPandas(run, schema)


def forecasts(fitted: DataFrame) -> DataFrame:
    return fitted.filter(F.col("error").isNull()).drop("error")


def failures(fitted: DataFrame) -> DataFrame:
    """Series that a model could not be fitted to, with the reason."""
    return fitted.filter(F.col("error").isNotNull()).drop(
        "params", "step", "predicted", "fit_time", "prediction_time")


def cpu_clock() -> float:
    return time.process_time()
