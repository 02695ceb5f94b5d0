"""Regular grids: hourly and daily resampling, interpolation and start alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.blocks import (BLOCK_SLOTS, block_of, slot_of, spread_join, time_of, with_block_summary)
from panelweave.schemas import SERIES, STATION


def _on_hour():
    return F.pmod(F.unix_micros("ts"), F.lit(3_600_000_000)) == 0


def hourly_points(measurements: DataFrame) -> DataFrame:
    """Values that lie exactly on the hourly grid; rows off the grid drop out."""
    return (measurements.filter((F.col("rate") == "H") & _on_hour() & F.col("value").isNotNull())
            .select(*SERIES, slot_of(F.col("ts")).alias("slot"), "value"))


def daily_points(measurements: DataFrame) -> DataFrame:
    """Daily cells with a backfill of one step.

    A midnight label takes the first station row in the closed day that starts at the label, so a row at exactly
    midnight serves its own label and, where no earlier row exists, the one before. The choice is made per
    station row, not per cell: when the chosen row lacks a pollutant, that cell stays empty. As "first row" is an
    aggregate, no window over the raw rows is needed and duplicates collapse before the exchange.
    """
    day = slot_of(F.col("ts"), F.lit("D"))
    at_midnight = F.pmod(F.unix_micros("ts"), F.lit(86_400_000_000)) == 0
    labels = F.when(at_midnight, F.array(day, day - 1)).otherwise(F.array(day))
    first = (measurements.filter(F.col("rate") == "D")
             .select(*SERIES, "ts", "value", F.explode(labels).alias("slot"))
             .groupBy(*SERIES, "slot")
             .agg(F.min("ts").alias("_ts"), F.min_by("value", "ts").alias("value")))
    # One group is one station and day: as many rows as the station has pollutants.
    per_label = Window.partitionBy(*STATION, "slot")
    return (first.withColumn("_chosen", F.min("_ts").over(per_label))
            .filter((F.col("_ts") == F.col("_chosen")) & F.col("value").isNotNull())
            .select(*SERIES, "slot", "value"))


def _block_heads(measurements: DataFrame, points: DataFrame, rate: str, block_slots: int) -> DataFrame:
    """Per series and block the time range of its rows and its first known cell, ``(_lo, _hi, block, _head)``."""
    if rate == "H":
        slot = slot_of(F.col("ts"), F.lit("H"))
        cell = F.when(_on_hour() & F.col("value").isNotNull(), slot)
        return (measurements.groupBy(*SERIES, block_of(slot, block_slots).alias("block"))
                .agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"), F.min(cell).alias("_at"),
                     F.min_by("value", cell).alias("_v"))
                .select(*SERIES, "block", "_lo", "_hi",
                        F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("slot"), F.col("_v").alias("value"))).alias("_head")))
    seen = measurements.groupBy(*SERIES).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    heads = (points.groupBy(*SERIES, "block").agg(F.min("slot").alias("_at"), F.min_by("value", "slot").alias("_v"))
             .select(*SERIES, "block", F.struct(F.col("_at").alias("slot"), F.col("_v").alias("value")).alias("_head")))
    return seen.join(heads, SERIES, "left")


def _block_facts(heads: DataFrame) -> DataFrame:
    """Per series and block with known cells: range facts of the station and the first cell of the next block.

    ``start_slot`` is where all pollutants of the station have begun. It is NULL when one of them has no cell at
    all; dropping incomplete rows then leaves nothing of the station.
    """
    # All windows run over block summaries: pollutants times blocks of one station.
    series, station = Window.partitionBy(*SERIES), Window.partitionBy(*STATION)
    later = series.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    joined = (heads.withColumn("first_slot", F.min("_head.slot").over(series))
              .withColumn("_later", F.first("_head", ignorenulls=True).over(later))
              .withColumn("grid_first", slot_of(F.min("_lo").over(station)))
              .withColumn("grid_last", slot_of(F.max("_hi").over(station)))
              .withColumn("start_slot", F.when(F.count("first_slot").over(station) == F.count(F.lit(1)).over(station),
                                               F.max("first_slot").over(station))))
    return joined.filter(F.col("_head").isNotNull()).select(
        *SERIES, "block", F.struct("grid_first", "grid_last", "start_slot", "first_slot").alias("_facts"), "_later")


def resample(measurements: DataFrame, rate: str | None = None, align: bool = True, interpolate: bool = True,
             block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Put every series on its gap-free grid: ``station, rate, pollutant, ts, value, slot``.

    Gaps are filled linearly in elapsed time; after its last value a series carries that value on to the end
    of the station's grid. ``align`` starts all series of a station where the latest of them begins, which is
    what dropping rows with any missing value comes to; without it leading cells are NULL. With
    ``interpolate=False`` the gaps stay NULL.

    Each known cell emits the grid rows up to the next one, so there is no join of a grid with its values. Two
    extra rows per block carry what lies outside it, the first cell of the next block and the range facts; the
    known cells are exchanged once.
    """
    if rate is None:  # each rate reads only its own partitions
        return resample(measurements, "H", align, interpolate, block_slots).unionByName(
            resample(measurements, "D", align, interpolate, block_slots))
    measurements = measurements.filter(F.col("rate") == rate)
    points = (hourly_points if rate == "H" else daily_points)(measurements).withColumn(
        "block", block_of(F.col("slot"), block_slots))
    facts = _block_facts(_block_heads(measurements, points, rate, block_slots))
    extra = facts.select(*SERIES, "block", F.inline(F.array(
        F.struct(F.lit(None).cast("long").alias("slot"), F.lit(None).cast("double").alias("value"), "_facts"),
        F.struct(F.col("_later.slot").alias("slot"), F.col("_later.value").alias("value"),
                 F.lit(None).cast(facts.schema["_facts"].dataType).alias("_facts")))))
    extra = extra.filter(F.col("slot").isNotNull() | F.col("_facts").isNotNull())
    known = points.unionByName(extra, allowMissingColumns=True)
    w = Window.partitionBy(*SERIES, "block").orderBy(F.col("slot").asc_nulls_first())
    known = known.select(
        *SERIES, "slot", "value", "block",
        F.first("_facts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"),
        F.lead("slot").over(w).alias("_next_slot"), F.lead("value").over(w).alias("_next_value"))
    known = known.filter(F.col("slot").isNotNull() & (block_of(F.col("slot"), block_slots) == F.col("block")))
    slot, value, nxt = F.col("slot"), F.col("value"), F.col("_next_slot")
    until = F.coalesce(nxt - 1, F.col("f.grid_last"))
    if align:
        known = known.filter(F.col("f.start_slot").isNotNull())
        since = F.greatest(slot, F.col("f.start_slot"), F.col("f.grid_first"))
    else:
        since = F.when(slot == F.col("f.first_slot"), F.col("f.grid_first")).otherwise(
            F.greatest(slot, F.col("f.grid_first")))
    # A long gap is unrolled block by block, so no array grows with the length of a gap.
    emitted = (known.withColumn("_since", since).withColumn("_until", until)
               .filter(F.col("_since") <= F.col("_until"))
               .withColumn("_b", F.explode(F.sequence(block_of(F.col("_since"), block_slots),
                                                      block_of(F.col("_until"), block_slots))))
               .withColumn("_s", F.explode(F.sequence(
                   F.greatest(F.col("_since"), F.col("_b") * block_slots),
                   F.least(F.col("_until"), F.col("_b") * block_slots + (block_slots - 1))))))
    s = F.col("_s")
    if interpolate:
        filled = (F.when(s < slot, F.lit(None)).when(nxt.isNull(), value)
                  .otherwise(value + (F.col("_next_value") - value) * ((s - slot) / (nxt - slot))))
    else:
        filled = F.when(s == slot, value)
    return emitted.select(*SERIES, time_of(s).alias("ts"), filled.alias("value"), s.alias("slot"))


def interpolate(df: DataFrame, by: str = "time", keys: list[str] = SERIES, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Fill NULL values of existing rows linearly, by elapsed ``time`` or by ``position``.

    Needs ``slot``. Leading NULLs stay, trailing ones take the last known value.
    """
    x = F.unix_micros("ts") if by == "time" else F.col("slot")
    cell = F.when(F.col("value").isNotNull(), F.struct("slot", F.col("_x").alias("x"), F.col("value").alias("v")))
    carried = with_block_summary(
        df.withColumn("_x", x), [F.min(cell).alias("_head"), F.max(cell).alias("_tail")],
        lambda w: [F.last("_tail", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
                   F.first("_head", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("later")],
        keys, block_slots=block_slots)
    w = Window.partitionBy(*keys, "block").orderBy(F.col("slot").asc_nulls_first())
    prev = F.coalesce(F.last(cell, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("carry.earlier"))
    nxt = F.coalesce(F.first(cell, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("carry.later"))
    out = carried.withColumn("_p", prev).withColumn("_n", nxt)
    p, n = F.col("_p"), F.col("_n")
    filled = (F.when(F.col("value").isNotNull(), F.col("value")).when(p.isNull(), F.lit(None)).when(n.isNull(), p["v"])
              .otherwise(p["v"] + (n["v"] - p["v"]) * (F.col("_x") - p["x"]) / (n["x"] - p["x"])))
    return out.withColumn("value", filled).select(*df.columns)


def drop_incomplete_starts(df: DataFrame) -> DataFrame:
    """Start all series of a station where the latest of them has its first value."""
    begun = df.groupBy(*SERIES).agg(F.min(F.when(F.col("value").isNotNull(), F.col("ts"))).alias("_first"))
    station = Window.partitionBy(*STATION)
    start = begun.select(*SERIES, F.when(F.count("_first").over(station) == F.count(F.lit(1)).over(station),
                                         F.max("_first").over(station)).alias("_start"))
    return spread_join(df, start, SERIES).filter(F.col("ts") >= F.col("_start")).drop("_start")
