"""From raw observations to the measurements table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.names import rate_code
from panelweave.operators.blocks import spread_join
from panelweave.schemas import SERIES, STATION, nan_to_null

KEEP_THRESHOLD = 0.95
MEASUREMENT_KEY = [*SERIES, "ts"]


def without_word(df: DataFrame, column: str, word: str) -> DataFrame:
    """Drop rows whose text contains ``word`` in any case; rows without a text stay."""
    return df.filter(~F.coalesce(F.lower(F.col(column)).contains(word.lower()), F.lit(False)))


def drop_bulk_samples(raw: DataFrame) -> DataFrame:
    """Bulk samples do not match the averaging time."""
    return without_word(raw, "SamplingPoint", "bulk")


def _timestamp(col: Column) -> Column:
    return F.try_to_timestamp(col) if hasattr(F, "try_to_timestamp") else F.to_timestamp(col)


def to_measurements(raw: DataFrame) -> DataFrame:
    """Keep the five columns in use, under their short names; other columns are not even parsed."""
    keep = [c for c in raw.columns if c.startswith("_file")]
    return raw.select(
        F.col("AirQualityStationEoICode").alias("station"),
        rate_code(F.col("AveragingTime")).alias("rate"),
        _timestamp(F.col("DatetimeEnd")).alias("ts"),
        F.col("AirPollutant").alias("pollutant"),
        nan_to_null("Concentration").alias("value"),
        *keep)


def mean_of_duplicates(df: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """One row per key: the mean of its values; keys without any value vanish."""
    return (df.filter(F.col("value").isNotNull())
            .groupBy(*MEASUREMENT_KEY, *(extra_keys or [])).agg(F.avg("value").alias("value")))


def merge_newest_wins(df: DataFrame, order: Column) -> DataFrame:
    """Merge overlapping parts cell by cell: the newest part with a value wins, NULL never overwrites."""
    known = F.col("value").isNotNull()
    return df.groupBy(*MEASUREMENT_KEY).agg(F.max_by(F.when(known, F.col("value")), F.when(known, order)).alias("value"))


def upsert(new: DataFrame, old: DataFrame) -> DataFrame:
    """Merge ``new`` over ``old``; either may lack rows of the other."""
    parts = new.withColumn("_age", F.lit(1)).unionByName(old.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    return merge_newest_wins(parts, F.col("_age"))


def pivot_wide(df: DataFrame, pollutants: list[str] | None = None) -> DataFrame:
    """Wide view with one column per pollutant; naming the pollutants saves a pass over the data."""
    grouped = df.filter(F.col("value").isNotNull()).groupBy(*STATION, "ts").pivot("pollutant", pollutants)
    return grouped.agg(F.avg("value"))


def unpivot_long(wide: DataFrame) -> DataFrame:
    """Back to one row per pollutant; empty cells vanish."""
    keys = [*STATION, "ts"]
    values = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, values, "pollutant", "value").filter(F.col("value").isNotNull())


def coverage(df: DataFrame) -> DataFrame:
    """Per series: its number of values, and the whole days between first and last row of its station."""
    per_series = df.groupBy(*SERIES).agg(F.count("value").alias("n_values"), F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    station = Window.partitionBy(*STATION)  # as many rows as the station has pollutants
    span = F.unix_seconds(F.max("_hi").over(station)) - F.unix_seconds(F.min("_lo").over(station))
    return per_series.select(*SERIES, "n_values", F.floor(span / 86400).cast("long").alias("days"))


def dense_series(df: DataFrame, threshold: float = KEEP_THRESHOLD) -> DataFrame:
    """Keys of the series that reach the sampling density; averaging times other than day and hour never do."""
    per_day = F.when(F.col("rate") == "H", F.lit(24)).when(F.col("rate") == "D", F.lit(1))
    return coverage(df).filter(F.col("n_values") >= F.lit(float(threshold)) * F.col("days") * per_day).select(*SERIES)


def density_filter(df: DataFrame, threshold: float = KEEP_THRESHOLD) -> DataFrame:
    """Remove series whose sampling density is too low, and with them stations left without any series."""
    return spread_join(df, dense_series(df, threshold), SERIES, "left_semi")


def ingest(raw: DataFrame) -> DataFrame:
    """Raw files to measurements: filter, prune, mean per file, then newest file first.

    ``raw`` carries ``_file_time`` and ``_file_path``; both aggregations combine before their exchange, so a key
    that repeats very often costs no more than any other.
    """
    parts = mean_of_duplicates(to_measurements(drop_bulk_samples(raw)).filter(F.col("ts").isNotNull()),
                               ["_file_time", "_file_path"])
    return merge_newest_wins(parts, F.struct("_file_time", "_file_path"))


def rejected(raw: DataFrame) -> DataFrame:
    """The rows that ``ingest`` leaves out because their time cannot be read, with the reason."""
    kept = to_measurements(drop_bulk_samples(raw))
    return kept.filter(F.col("ts").isNull()).withColumn("reason", F.lit("unreadable time"))


def with_station_info(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Attach coordinates from a station table; of several entries the first counts (by latitude, longitude)."""
    place = F.struct("latitude", "longitude")
    first = stations.groupBy("station").agg(F.min(place).alias("_p")).select(
        "station", F.col("_p.latitude").alias("latitude"), F.col("_p.longitude").alias("longitude"))
    return spread_join(df, first, ["station"], "left")
