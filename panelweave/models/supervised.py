"""Supervised rows: one row per series, time and forecast setup, with ``features`` and ``label``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.blocks import BLOCK_SLOTS, over_series
from panelweave.operators.series import HORIZONS, SEASON, difference, lag_columns, other_series_features, row_statistics
from panelweave.schemas import SERIES
from panelweave.session import cut_lineage


def _targets(w, horizons: Sequence[int], season: int, value: str = "value"):
    """Per horizon the target, whether it exists, and whether the row belongs to the last season of rows."""
    return F.array(*[F.struct(
        F.lit(h).alias("distance"), F.lead(value, h).over(w).alias("label"),
        F.lead("slot", h).over(w).isNotNull().alias("has_label"),
        F.lead("slot", h + season).over(w).isNull().alias("is_holdout")) for h in horizons]).alias("_targets")


def per_horizon(frame: DataFrame) -> DataFrame:
    """Explode feature frames into one row per horizon that still has a target."""
    return (frame.withColumn("_t", F.explode("_targets")).filter("_t.has_label")
            .select(*SERIES, F.col("_t.distance").alias("distance"), "differenced", F.lit(True).alias("direct"),
                    "artificial", "ts", "slot", "block", "features", F.col("_t.label").alias("label"),
                    F.col("_t.is_holdout").alias("is_holdout")))


def _frame(df: DataFrame, differenced: bool, artificial: bool) -> DataFrame:
    return df.select(*SERIES, F.lit(differenced).alias("differenced"), F.lit(artificial).alias("artificial"), "ts", "slot",
                     "block", "features", "_targets")


def artificial_frame(grid: DataFrame, rate: str, horizons: Sequence[int] | None = None, differenced: bool = False,
                     stat_mode: str = "inclusive", block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Lags of one season with their sum, mean and median as features; the first season of rows is dropped.

    Differences, lags, targets and the holdout flag come out of one exchange: whether a row lies in the last
    season is read off a lead, so no row has to be numbered.
    """
    season = SEASON[rate]
    horizons = HORIZONS[rate] if horizons is None else horizons
    first = season + (1 if differenced else 0)

    def prepare(w):
        return [(F.col("value") - F.lag("value", 1).over(w) if differenced else F.col("value")).alias("_v")]

    def columns(w):
        return [*lag_columns(w, season, "_v"), _targets(w, horizons, season, "_v"),
                F.lag("slot", first).over(w).isNotNull().alias("_keep")]

    out = over_series(grid.filter(F.col("rate") == rate), columns, before=first, after=max(horizons) + season,
                      block_slots=block_slots, prepare=prepare, keep_block=True).filter("_keep")
    lags = [F.col(f"lag_{i}") for i in range(1, season + 1)]
    features = F.array(*lags, *row_statistics(lags, stat_mode))
    return _frame(out.withColumn("features", features), differenced, True)


def direct_frame(grid: DataFrame, rate: str, horizons: Sequence[int] | None = None, differenced: bool = False,
                 block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Current values of the station's other pollutants as features, where there are at least two of them."""
    season = SEASON[rate]
    horizons = HORIZONS[rate] if horizons is None else horizons
    frame = grid.filter(F.col("rate") == rate)
    if differenced:
        frame = difference(frame, block_slots=block_slots)
    others = other_series_features(frame).filter(F.size("features") >= 2)

    def columns(w):
        return [_targets(w, horizons, season), F.lag("slot", season).over(w).isNotNull().alias("_keep")]

    out = over_series(others, columns, before=season, after=max(horizons) + season, block_slots=block_slots,
                      keep_block=True).filter("_keep")
    return _frame(out, differenced, False)


def artificial_rows(grid: DataFrame, rate: str, horizons: Sequence[int] | None = None, differenced: bool = False,
                    stat_mode: str = "inclusive", block_slots: int = BLOCK_SLOTS) -> DataFrame:
    return per_horizon(artificial_frame(grid, rate, horizons, differenced, stat_mode, block_slots))


def direct_rows(grid: DataFrame, rate: str, horizons: Sequence[int] | None = None, differenced: bool = False,
                block_slots: int = BLOCK_SLOTS) -> DataFrame:
    return per_horizon(direct_frame(grid, rate, horizons, differenced, block_slots))


def all_rows(grid: DataFrame, rate: str, horizons: Sequence[int] | None = None, direct_set: bool = True,
             differenced: Sequence[bool] = (False, True)) -> DataFrame:
    """Rows of every direct setup of one rate.

    All models and folds read these rows, so the features are written to the shared folder once, before horizons
    multiply them.
    """
    parts = [artificial_frame(grid, rate, horizons, d) for d in differenced]
    if direct_set:
        parts += [direct_frame(grid, rate, horizons, d) for d in differenced]
    return per_horizon(cut_lineage(reduce(DataFrame.unionByName, parts)))
