"""File-name codecs and the rate vocabulary, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Averaging times in raw data and file names, and the rate codes used afterwards.
RATE_CODES = {"day": "D", "hour": "H"}


def rate_code(averaging: Column) -> Column:
    """``day`` -> ``D``, ``hour`` -> ``H``; any other averaging time stays as it is."""
    out = F.when(averaging == "day", F.lit("D")).when(averaging == "hour", F.lit("H"))
    return out.otherwise(averaging)


def rate_name(rate: Column) -> Column:
    return F.when(rate == "D", F.lit("day")).when(rate == "H", F.lit("hour")).otherwise(rate)


def _flag(col: Column) -> Column:
    return F.initcap(col.cast("string"))


def run_name(station, rate, pollutant, distance, differenced, direct, artificial) -> Column:
    """Name of one parameter-search run; the ``artificial`` part appears for direct models only."""
    parts = [
        station, rate, pollutant,
        F.concat(F.lit("distance="), distance.cast("string")),
        F.concat(F.lit("differenced="), _flag(differenced)),
        F.concat(F.lit("direct="), _flag(direct)),
        F.when(direct, F.concat(F.lit("artificial="), _flag(artificial))),
    ]
    return F.concat(F.concat_ws("-", *parts), F.lit(".csv"))


def base_name(path: Column) -> Column:
    """Last path segment without the csv extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.csv$", "")


def parse_run_name(path: Column) -> Column:
    """Struct with the seven fields of a run name; names of six parts have ``artificial`` false.

    The key parts are anchored on their labels, so a ``-`` inside the pollutant does no harm.
    """
    name = base_name(path)
    pattern = (r"^([^-]+)-([^-]+)-(.+)-distance=([^-]+)-differenced=([^-]+)-direct=([^-]+)"
               r"(?:-artificial=([^-]+))?$")

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))

    return F.struct(
        part(1).alias("station"),
        part(2).alias("rate"),
        part(3).alias("pollutant"),
        part(4).cast("int").alias("distance"),
        part(5).cast("boolean").alias("differenced"),
        part(6).cast("boolean").alias("direct"),
        F.coalesce(part(7).cast("boolean"), F.lit(False)).alias("artificial"),
    )


def parse_series_name(path: Column) -> Column:
    """Struct (station, rate) from names such as ``S1-day.csv`` or ``S1-ignored-hour.csv``."""
    parts = F.split(base_name(path), "-")
    return F.struct(
        F.element_at(parts, 1).alias("station"),
        rate_code(F.element_at(parts, -1)).alias("rate"),
    )


def report_name(timebased: Column, differenced: Column | None = None, artificial: Column | None = None,
                rate: Column | None = None) -> Column:
    """Slice name of a report; parts that are absent or NULL are left out."""
    parts = [F.concat(F.lit("timebased="), _flag(timebased))]
    if differenced is not None:
        parts.append(F.concat(F.lit("differenced="), _flag(differenced)))
    if artificial is not None:
        parts.append(F.concat(F.lit("artificial="), _flag(artificial)))
    if rate is not None:
        parts.append(F.concat(F.lit("rate="), rate))
    return F.concat_ws("-", *parts)
