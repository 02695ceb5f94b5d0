"""Lags, differences, shifts and row ranges of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.calendar import month_flags, weekday_flags
from panelweave.operators.blocks import BLOCK_SLOTS, over_series, series_bounds, spread_join, with_block_summary
from panelweave.schemas import SERIES, STATION

# Season length, forecast horizons and row limits per rate.
SEASON = {"H": 24, "D": 7}
HORIZONS = {"H": [1, 2, 3, 5, 10, 12, 24], "D": [1, 2, 3, 4, 5, 6, 7]}
DEBUG_ROWS = 200


def lag_columns(w, steps: int, value: str = "value") -> list[Column]:
    """``lag_1`` is the current value, ``lag_i`` the value i-1 rows earlier."""
    return [F.lag(value, i - 1).over(w).alias(f"lag_{i}") for i in range(1, steps + 1)]


def lag_features(df: DataFrame, steps: int, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Add ``lag_1 … lag_steps``; leading cells stay NULL."""
    return over_series(df, lambda w: lag_columns(w, steps), before=steps - 1, block_slots=block_slots)


def row_statistics(cells: Sequence[Column], stat_mode: str = "inclusive") -> tuple[Column, Column, Column]:
    """Sum, mean and median over lag columns, NULL cells left out.

    ``inclusive`` widens the base step by step: the mean also covers the sum, the median also covers sum and
    mean. ``lags_only`` uses the lag values alone for all three. Plain arithmetic and one sort per row, all inside
    generated code: array lambdas are several times slower.
    """
    total, known = F.lit(0.0), F.lit(0)
    for c in cells:
        total = total + F.coalesce(c, F.lit(0.0))
        known = known + F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    if stat_mode == "inclusive":
        mean = total * 2 / (known + 1)
        base, extra = [*cells, total, mean], 2
    elif stat_mode == "lags_only":
        mean = F.try_divide(total, known)
        base, extra = list(cells), 0
    else:
        raise ValueError(f"unknown stat_mode {stat_mode}")
    ordered = F.sort_array(F.array(*base))  # NULL cells come first
    missing, n = F.lit(len(cells)) - known, known + extra
    lower = F.try_element_at(ordered, (missing + F.floor((n + 1) / 2)).cast("int"))
    upper = F.try_element_at(ordered, (missing + F.floor(n / 2) + 1).cast("int"))
    return total, mean, (lower + upper) / 2


def stat_features(df: DataFrame, steps: int, stat_mode: str = "inclusive") -> DataFrame:
    """Add ``sum``, ``mean`` and ``median`` of the lag columns of each row."""
    total, mean, median = row_statistics([F.col(f"lag_{i}") for i in range(1, steps + 1)], stat_mode)
    return df.select("*", total.alias("sum"), mean.alias("mean"), median.alias("median"))


def artificial_features(df: DataFrame, steps: int, weekdays: bool = False, months: bool = False,
                        statistical: bool = True, stat_mode: str = "inclusive",
                        block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Lag features, optionally with row statistics and calendar one-hots."""
    out = lag_features(df, steps, block_slots)
    if statistical:
        out = stat_features(out, steps, stat_mode)
    if weekdays:
        out = out.select("*", *weekday_flags(F.col("ts")))
    if months:
        out = out.select("*", *month_flags(F.col("ts")))
    return out


def difference(df: DataFrame, stepsize: int = 1, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Value minus the value ``stepsize`` rows earlier; the first rows of a series have none and are dropped."""
    return (over_series(df, lambda w: [F.lag("slot", stepsize).over(w).alias("_from"),
                                       (F.col("value") - F.lag("value", stepsize).over(w)).alias("_diff")],
                        before=stepsize, block_slots=block_slots)
            .filter(F.col("_from").isNotNull()).drop("_from")
            .withColumn("value", F.col("_diff")).drop("_diff"))


def dedifference(df: DataFrame, start: DataFrame, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Undo :func:`difference` of step 1: start level plus running sum.

    ``start`` holds one row ``(series, start)``. Sums run inside a block; the blocks before contribute their
    total through the block summary.
    """
    carried = with_block_summary(
        df, [F.sum("value").alias("_total")],
        lambda w: [F.coalesce(F.sum("_total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
                   .alias("before")], block_slots=block_slots)
    w = Window.partitionBy(*SERIES, "block").orderBy(F.col("slot").asc_nulls_first())
    running = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    summed = carried.select(*df.columns, (F.col("carry.before") + running).alias("_run"))
    return (spread_join(summed, start.select(*SERIES, "start"), SERIES, spread=("slot",))
            .withColumn("value", F.col("start") + F.col("_run")).select(*df.columns))


def first_values(df: DataFrame) -> DataFrame:
    """First value of each series as ``(series, start)``, the level :func:`dedifference` needs."""
    return df.groupBy(*SERIES).agg(F.min_by("value", "slot").alias("start"))


def rotate_left(df: DataFrame, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Each row takes the next value; the last row takes the first one of the series."""
    cell = F.struct("slot", "value")
    carried = with_block_summary(
        df, [F.min(cell).alias("_head")],
        lambda w: [F.coalesce(F.lead("_head").over(w),
                              F.first("_head").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("after")],
        block_slots=block_slots)
    w = Window.partitionBy(*SERIES, "block").orderBy(F.col("slot").asc_nulls_first())
    nxt = F.coalesce(F.lead(cell).over(w), F.col("carry.after"))
    return carried.withColumn("_next", nxt["value"]).withColumn("value", F.col("_next")).select(*df.columns)


def target_shift(df: DataFrame, horizon: int, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Add ``target``, the value ``horizon`` rows later; rows without one are dropped."""
    return horizon_explode(df, [horizon], block_slots).drop("horizon")


def horizon_explode(df: DataFrame, horizons: Sequence[int], block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """One row per (row, horizon) with its ``target``; all horizons come out of one window pass."""
    def leads(w):
        pairs = [F.struct(F.lit(h).alias("horizon"), F.lead("slot", h).over(w).alias("at"),
                          F.lead("value", h).over(w).alias("target")) for h in horizons]
        return [F.array(*pairs).alias("_targets")]

    out = over_series(df, leads, after=max(horizons), block_slots=block_slots)
    return (out.withColumn("_t", F.explode("_targets")).filter("_t.at is not null")
            .select(*df.columns, F.col("_t.horizon").alias("horizon"), F.col("_t.target").alias("target")))


def with_position(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add ``pos`` (0-based from the start), ``rev`` (0-based from the end) and ``n`` to gap-free series.

    Slots are consecutive, so both follow from the bounds of the series and no row is ranked.
    """
    out = spread_join(df, series_bounds(df, keys), keys, spread=("slot",))
    return (out.withColumn("pos", F.col("slot") - F.col("first_slot"))
            .withColumn("rev", F.col("last_slot") - F.col("slot")).drop("first_slot", "last_slot"))


def head(df: DataFrame, rows: int = DEBUG_ROWS) -> DataFrame:
    """First ``rows`` rows of every series."""
    return with_position(df).filter(F.col("pos") < rows).select(*df.columns)


def skip(df: DataFrame, rows: int, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """All but the first ``rows`` rows of every series."""
    return (over_series(df, lambda w: [F.lag("slot", rows).over(w).isNotNull().alias("_keep")], before=rows,
                        block_slots=block_slots).filter("_keep").drop("_keep"))


def holdout_flag(w, size: int | None = None) -> Column:
    """Whether a row is among the last ``size`` rows of its series, by default its last season.

    Read off a lead: no row has to be counted.
    """
    if size is not None:
        return F.lead("slot", size).over(w).isNull()
    return (F.when(F.col("rate") == "H", F.lead("slot", SEASON["H"]).over(w).isNull())
            .otherwise(F.lead("slot", SEASON["D"]).over(w).isNull()))


def tail(df: DataFrame, rows: int, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Last ``rows`` rows of every series."""
    return holdout_split(df, rows, block_slots=block_slots).filter("is_holdout").drop("is_holdout")


def holdout_split(df: DataFrame, size: int | None = None, keys: Sequence[str] = SERIES,
                  block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Flag the last season (or ``size`` rows) of every series as ``is_holdout``."""
    return over_series(df, lambda w: [holdout_flag(w, size).alias("is_holdout")], after=size or max(SEASON.values()),
                       keys=keys, block_slots=block_slots)


def time_series_split(df: DataFrame, folds: int = 3, keys: Sequence[str] = SERIES) -> DataFrame:
    """Expanding splits: one row per (row, fold) with ``in_train`` and ``in_test``.

    The test part of each fold has ``n // (folds + 1)`` rows, everything before it is training data. Rows behind
    the test part of a fold are left out of that fold.
    """
    size = F.floor(F.col("n") / (folds + 1))
    start = F.col("n") - size * (folds - F.col("fold"))
    return (with_position(df, keys)
            .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
            .withColumn("in_train", F.col("pos") < start)
            .withColumn("in_test", (F.col("pos") >= start) & (F.col("pos") < start + size))
            .filter(F.col("in_train") | F.col("in_test"))
            .select(*df.columns, "fold", "in_train", "in_test"))


def other_series_features(df: DataFrame) -> DataFrame:
    """For each row the values of the station's other series at that time, as ``features`` in pollutant order.

    One group is one station and time: as many rows as the station has pollutants, and the output has as many.
    """
    cells = F.array_sort(F.collect_list(F.struct("pollutant", "value")))
    carry = [c for c in df.columns if c not in (*SERIES, "ts", "value")]
    frame = df.groupBy(*STATION, "ts", *carry).agg(cells.alias("_cells"))
    others = F.transform(F.filter("_cells", lambda c: c["pollutant"] != F.col("pollutant")), lambda c: c["value"])
    return (frame.withColumn("_own", F.explode("_cells"))
            .select(*STATION, F.col("_own.pollutant").alias("pollutant"), "ts", F.col("_own.value").alias("value"),
                    *carry, "_cells")
            .withColumn("features", others).drop("_cells"))


def stations_with_pollutants(df: DataFrame, at_least: int = 3) -> DataFrame:
    """Stations that have enough pollutants to forecast one from the others (two besides the target)."""
    inventory = df.select(*SERIES).distinct()
    return inventory.groupBy(*STATION).agg(F.count("pollutant").alias("pollutants")).filter(
        F.col("pollutants") >= at_least)


def feature_gate(df: DataFrame, at_least: int = 3) -> DataFrame:
    """Keep only the rows of such stations."""
    return spread_join(df, stations_with_pollutants(df, at_least).select(*STATION), STATION, "left_semi")
