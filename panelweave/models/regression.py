"""Least squares for many series: per-block QR factors, combined per series.

A block of rows is reduced to the triangular factor of ``[1, features, label]``, a few hundred numbers. Factors
of the blocks of a series stack into another such problem, so the result does not depend on the cut, no task sees
more than one block of a series, and the condition of the problem is not squared as with normal equations.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RCOND = 1e-10


def _schema_of(df: DataFrame, keys: Sequence[str], extra: str) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType(fields + T._parse_datatype_string(extra).fields)


def triangle(design: np.ndarray) -> np.ndarray:
    """Square triangular factor of a design matrix, padded when it has few rows."""
    width = design.shape[1]
    r = np.linalg.qr(design, mode="r")
    if r.shape[0] < width:
        r = np.vstack([r, np.zeros((width - r.shape[0], width))])
    return r


def solve_triangle(r: np.ndarray, use: Sequence[int] | None = None) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of least norm from a factor of ``[1, features, label]``.

    Below its first row the factor describes the centred problem. ``use`` restricts it to some features.
    """
    width = r.shape[1] - 2
    use = list(range(width)) if use is None else list(use)
    coef = np.zeros(width)
    if use:
        cols = [1 + i for i in use]
        coef[use] = np.linalg.lstsq(r[1:, cols], r[1:, -1], rcond=_RCOND)[0]
    intercept = (r[0, -1] - r[0, 1:-1] @ coef) / r[0, 0]
    return float(intercept), coef


def factors(rows: DataFrame, keys: Sequence[str], features: str = "features", label: str = "label") -> DataFrame:
    """One row per key: the combined ``factor`` (flattened), its ``width``, row count ``n`` and CPU ``fit_time``."""
    keys = list(keys)
    schema = _schema_of(rows, keys, "factor array<double>, width int, n long, fit_time double")

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        start = time.process_time()
        x = np.vstack(pdf[features].to_numpy()).astype(float)
        y = pdf[label].to_numpy(dtype=float)
        r = triangle(np.column_stack([np.ones(len(y)), x, y]))
        out = pdf[keys].head(1).copy()
        out["factor"], out["width"], out["n"] = [r.ravel()], r.shape[1], len(y)
        out["fit_time"] = time.process_time() - start
        return out

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        start = time.process_time()
        width = int(pdf["width"].iloc[0])
        r = np.vstack([np.asarray(f).reshape(width, width) for f in pdf["factor"]])
        out = pdf[keys].head(1).copy()
        out["factor"], out["width"], out["n"] = [triangle(r).ravel()], width, int(pdf["n"].sum())
        out["fit_time"] = float(pdf["fit_time"].sum()) + time.process_time() - start
        return out

    per_block = (rows.select(*keys, "block", features, label).groupBy(*keys, "block").applyInPandas(reduce_block, schema))
    return per_block.groupBy(*keys).applyInPandas(combine, schema)


def least_squares(rows: DataFrame, keys: Sequence[str], features: str = "features", label: str = "label") -> DataFrame:
    """Linear regression per key: ``intercept``, ``coef``, ``n``, ``fit_time``."""
    keys = list(keys)
    out = factors(rows, keys, features, label)
    schema = _schema_of(out, keys, "intercept double, coef array<double>, n long, fit_time double")

    def solve(batches):
        for pdf in batches:
            solved = [solve_triangle(np.asarray(f).reshape(w, w)) for f, w in zip(pdf["factor"], pdf["width"])]
            res = pdf[[*keys, "n", "fit_time"]].copy()
            res["intercept"] = [s[0] for s in solved]
            res["coef"] = [s[1] for s in solved]
            yield res[[*keys, "intercept", "coef", "n", "fit_time"]]

    return out.mapInPandas(solve, schema)


def linear_value(features: Column | str = "features", coef: Column | str = "coef",
                 intercept: Column | str = "intercept") -> Column:
    """Value of the linear model at a feature array."""
    terms = F.zip_with(features, coef, lambda x, c: x * c)
    intercept = F.col(intercept) if isinstance(intercept, str) else intercept
    return intercept + F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
