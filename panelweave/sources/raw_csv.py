"""Raw observation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.schemas import RAW_SCHEMA


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All raw files under ``path`` with ``_file_time`` and ``_file_path`` for the merge order.

    UTF-16 cannot be split at byte positions, hence ``multiLine``: one file is one unit of work. Header-only files
    give no rows.
    """
    raw = (spark.read.schema(RAW_SCHEMA).option("header", True).option("encoding", "UTF-16")
           .option("multiLine", True).csv(path))
    return raw.select("*", F.col("_metadata.file_modification_time").alias("_file_time"),
                      F.col("_metadata.file_path").alias("_file_path"))
