"""Time blocks: the unit of parallel work inside a series.

One series may hold a large share of all rows, so no operator puts a whole series into one task. A series is
cut into blocks of at most ``BLOCK_SLOTS`` consecutive rows, and two patterns cover all series operators:

* *halo*: a window of bounded reach (lag, lead, difference) needs a few rows of the neighbouring block only.
  :func:`over_series` copies those rows over and evaluates all windows in one exchange and one sort.
* *block summary*: what must cross many blocks (running sums, next observation, row numbers) is first reduced
  to one row per block; :func:`with_block_summary` runs windows over these few rows and hands the outcome to
  the rows of each block.

``slot`` is the integer position of a row in its series. On a gap-free grid it follows from the timestamp
(:func:`with_grid_slot`, no shuffle); for irregular rows it is counted (:func:`with_row_slot`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelweave.schemas import SERIES

#: One year of hours; window tasks never hold more rows of one series than this (plus the halo).
BLOCK_SLOTS = 8760
#: Spread of a join key whose big side may be dominated by one value.
SALTS = 32


def step_seconds(rate: Column | None = None) -> Column:
    rate = F.col("rate") if rate is None else rate
    return F.when(rate == "D", F.lit(86400)).otherwise(F.lit(3600))


def slot_of(ts: Column, rate: Column | None = None) -> Column:
    """Index of the grid cell that contains ``ts``, counted from the epoch."""
    return F.floor(F.unix_seconds(ts) / step_seconds(rate)).cast("long")


def time_of(slot: Column, rate: Column | None = None) -> Column:
    """Timestamp of a grid slot."""
    return F.timestamp_seconds(slot * step_seconds(rate))


def block_of(slot: Column, block_slots: int = BLOCK_SLOTS) -> Column:
    return F.floor(slot / F.lit(block_slots)).cast("long")


def with_grid_slot(df: DataFrame) -> DataFrame:
    """Add ``slot`` to a frame whose series are gap-free on the hourly or daily grid."""
    return df.withColumn("slot", slot_of(F.col("ts")))


def with_block_summary(df: DataFrame, summary: Sequence[Column],
                       across: Callable[[WindowSpec], Sequence[Column]],
                       keys: Sequence[str] = SERIES, order: str = "slot", block: Column | None = None,
                       block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Add ``block`` and a struct ``carry`` computed from per-block summaries.

    ``summary`` are aggregates per (series, block), combined before their exchange. ``across`` gets the window of
    a series' blocks in order and returns the named columns to carry into each block. They travel as one extra row
    per block, first in order, so the rows of ``df`` are exchanged once and not joined. Windows by
    ``(keys, block)`` and ``order`` that follow need no further exchange or sort.
    """
    block = block_of(F.col("slot"), block_slots) if block is None else block
    rows = df.withColumn("block", block)
    blocks = Window.partitionBy(*keys).orderBy("block")
    carried = rows.groupBy(*keys, "block").agg(*summary).select(*keys, "block", F.struct(*across(blocks)).alias("carry"))
    both = rows.unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "block").orderBy(F.col(order).asc_nulls_first())
    known = F.first("carry", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_known", known).filter(F.col(order).isNotNull()).drop("carry").withColumnRenamed(
        "_known", "carry")


def with_row_slot(df: DataFrame, keys: Sequence[str] = SERIES, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Add ``slot``, the 0-based row number by time, to series with irregular timestamps."""
    block = F.floor(F.unix_seconds("ts") / (step_seconds() * block_slots)).cast("long")
    counted = with_block_summary(
        df, [F.count(F.lit(1)).alias("_n")],
        lambda w: [F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")],
        keys, order="ts", block=block)
    local = Window.partitionBy(*keys, "block").orderBy(F.col("ts").asc_nulls_first())
    slot = F.col("carry.before") + F.row_number().over(local) - 1
    return counted.select(*df.columns, slot.alias("slot"))


def over_series(df: DataFrame, columns: Callable[[WindowSpec], Sequence[Column]], before: int = 0, after: int = 0,
                keys: Sequence[str] = SERIES, block_slots: int = BLOCK_SLOTS,
                prepare: Callable[[WindowSpec], Sequence[Column]] | None = None, keep_block: bool = False) -> DataFrame:
    """Add window columns that look back at most ``before`` rows and ahead at most ``after`` rows.

    Needs ``slot`` without gaps. Rows near a block edge are copied into the neighbouring block, windows run per
    block, and the copies are dropped. ``prepare`` adds columns first that ``columns`` may refer to; both share
    the exchange and the sort. With ``keep_block`` the block stays as a column, so a grouping by series and block
    that follows needs no exchange.
    """
    slot = F.col("slot")
    home = block_of(slot, block_slots)
    reach = F.sequence(block_of(slot - after, block_slots), block_of(slot + before, block_slots))
    halo = df.withColumn("block", F.explode(reach) if before or after else home)
    halo = halo.withColumn("_core", F.col("block") == home)
    w = Window.partitionBy(*keys, "block").orderBy("slot")
    if prepare is not None:
        halo = halo.select("*", *prepare(w))
    out = halo.select("*", *columns(w))
    return out.filter("_core").drop("_core", *([] if keep_block else ["block"]))


def spread_join(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner",
                spread: Sequence[str] = ("ts",), salts: int = SALTS) -> DataFrame:
    """Join a large frame with per-key facts without trusting the key to be evenly spread.

    The facts are repeated ``salts`` times and the large side is salted by a hash of ``spread``, so rows of one
    hot key meet their facts in many tasks. No size is assumed: when the facts turn out small at run time,
    adaptive execution broadcasts them instead.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    facts = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(facts, [*keys, "_salt"], how).drop("_salt")


def series_bounds(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """First slot, last slot and row count of every series."""
    return df.groupBy(*keys).agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
                                 F.count(F.lit(1)).alias("n"))
