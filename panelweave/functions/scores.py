"""Regression scores as aggregates over ``actual`` and ``predicted``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.schemas import SCORES


def _explained(unexplained: Column, total: Column) -> Column:
    """``1 - unexplained / total``; without any variation 1 for a perfect forecast and 0 otherwise."""
    return (F.when(total == 0, F.when(unexplained == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(1 - F.try_divide(unexplained, total)))


def score_aggregates(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """The five scores. The exact median is fine here: one group is one forecast run of a season's length."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    return [
        F.avg(error * error).alias("mean_squared_error"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.median(F.abs(error)).alias("median_absolute_error"),
        _explained(F.sum(error * error), F.var_pop(y) * F.count(y)).alias("r2"),
        _explained(F.var_pop(error), F.var_pop(y)).alias("explained_variance"),
    ]


def score(df: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted",
          extra: Sequence[Column] = ()) -> DataFrame:
    """Scores per group; rows without a finite forecast are left out."""
    finite = df.filter(F.col(predicted).isNotNull() & ~F.isnan(predicted))
    return finite.groupBy(*keys).agg(*score_aggregates(actual, predicted), *extra)


def norm_factor(y: Column | str) -> Column:
    """``1 / (max - min)`` over the whole series; NULL for a constant one."""
    return F.try_divide(F.lit(1.0), F.max(y) - F.min(y))


def with_norm_scores(scores: DataFrame, factor: str = "norm_factor") -> DataFrame:
    """Every score times the normalisation factor."""
    return scores.select("*", *[(F.col(s) * F.col(factor)).alias(f"norm_{s}") for s in SCORES])
