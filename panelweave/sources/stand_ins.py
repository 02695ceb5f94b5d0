"""Panels derived from general business tables, for tests and benchmarks.

Means are taken over whole cents: integer sums do not depend on the order of rows, so every engine agrees on the
last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.session import use_utc


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cents_mean(col: str, scale: float = 100.0) -> Column:
    return F.sum(F.round(F.col(col) * 100).cast("long")) / F.lit(scale) / F.count(col)


def hourly(spark: SparkSession, sf_dir: str, stations: int = 2, files: int = 0) -> DataFrame:
    """Events as hourly measurements, one pollutant per event type.

    ``files`` splits the events into that many overlapping parts, with the part number in ``file_seq``.
    """
    return hourly_of(read_table(spark, sf_dir, "events"), stations, files)


def hourly_of(events: DataFrame, stations: int = 2, files: int = 0) -> DataFrame:
    station = F.concat(F.lit("ST"), (F.col("user_id") % stations).cast("string"))
    parts = [(F.col("user_id") % files).cast("int").alias("file_seq")] if files else []
    names = ["file_seq"] if files else []
    return (events.select(station.alias("station"), F.lit("H").alias("rate"), F.col("event_type").alias("pollutant"),
                          F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), *parts, "value")
            .groupBy("station", "rate", "pollutant", "ts", *names).agg(cents_mean("value").alias("value")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily measurements taken at 23:00, one pollutant per priority."""
    orders = read_table(spark, sf_dir, "orders")
    return (orders.select(F.lit("ST0").alias("station"), F.lit("D").alias("rate"),
                          F.col("o_orderpriority").alias("pollutant"),
                          (F.col("o_orderdate").cast("timestamp") + F.expr("interval 23 hours")).alias("ts"),
                          F.col("o_totalprice").alias("value"))
            .groupBy("station", "rate", "pollutant", "ts").agg(cents_mean("value").alias("value")))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an evaluation table: one row per run key and model."""
    items = read_table(spark, sf_dir, "lineitem")
    direct = F.col("l_orderkey") % 2 == 0
    keyed = items.select(
        F.concat(F.lit("ST"), (F.col("l_suppkey") % 10).cast("string")).alias("station"),
        F.when(F.col("l_linestatus") == "O", F.lit("H")).otherwise(F.lit("D")).alias("rate"),
        F.col("l_returnflag").alias("pollutant"),
        ((F.col("l_quantity").cast("int") % 7) + 1).alias("distance"),
        (F.col("l_orderkey") % 3 == 0).alias("differenced"),
        direct.alias("direct"),
        (direct & (F.col("l_partkey") % 2 == 0)).alias("artificial"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    keys = ["station", "rate", "pollutant", "distance", "differenced", "direct", "artificial", "model"]
    return keyed.groupBy(*keys).agg(
        cents_mean("l_quantity").alias("fit_time"),
        cents_mean("l_tax").alias("prediction_time"),
        cents_mean("l_extendedprice").alias("mean_squared_error"),
        cents_mean("l_extendedprice", 69_997.0).alias("norm_mean_squared_error"),
        cents_mean("l_quantity", 2_999.0).alias("norm_mean_absolute_error"),
        cents_mean("l_discount", 71.0).alias("norm_median_absolute_error"))
