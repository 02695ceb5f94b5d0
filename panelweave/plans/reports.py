"""The comparison reports over the evaluation table.

Each report is one DataFrame for all slices: the slice (time-based or not, differenced, artificial, rate) is
part of the group key. :func:`slice_of` picks one slice afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.stats import best_rows, describe, exact_mean
from panelweave.schemas import NORM_MEASURES, TIMES

SETUP = ["timebased", "differenced", "artificial"]


def prepare(evaluation: DataFrame) -> DataFrame:
    """Evaluation table with ``timebased`` as the opposite of ``direct``."""
    return evaluation.withColumn("timebased", ~F.col("direct"))


def slice_of(report: DataFrame, **values) -> DataFrame:
    """Rows of one slice without its slice columns."""
    for column, value in values.items():
        report = report.filter(F.col(column) == value)
    return report.drop(*values)


def _time_stats(ev: DataFrame, keys: list[str], order: str) -> DataFrame:
    return describe(prepare(ev), keys, TIMES).orderBy(*keys[:-1], f"{order}_mean")


def general_prediction_times_overall(ev: DataFrame) -> DataFrame:
    return _time_stats(ev, ["timebased", "model"], "prediction_time")


def general_fit_times_overall(ev: DataFrame) -> DataFrame:
    return _time_stats(ev, ["timebased", "model"], "fit_time")


def general_prediction_times(ev: DataFrame) -> DataFrame:
    return _time_stats(ev, [*SETUP, "rate", "model"], "prediction_time")


def general_fit_times(ev: DataFrame) -> DataFrame:
    return _time_stats(ev, [*SETUP, "rate", "model"], "fit_time")


def winners(ev: DataFrame) -> DataFrame:
    """Model with the smallest mean squared error per setup, rate, distance, station and pollutant."""
    return best_rows(prepare(ev), [*SETUP, "rate", "distance", "station", "pollutant"], "mean_squared_error", "model")


def best_by_dist_and_poll(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "rate", "pollutant", "distance"]
    return (winners(ev).groupBy(*keys, "model").agg(F.count("mean_squared_error").alias("best_mse_count"))
            .orderBy(*keys, F.desc("best_mse_count"), "model"))


def best_by_dist(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "rate", "distance"]
    return (winners(ev).groupBy(*keys, "model").agg(F.count("mean_squared_error").alias("best_mse_count"))
            .orderBy(*keys, F.desc("best_mse_count"), "model"))


def best_by_poll(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "rate", "pollutant"]
    return (winners(ev).groupBy(*keys, "model").agg(F.count("mean_squared_error").alias("best_mse_count"))
            .orderBy(*keys, F.desc("best_mse_count"), "model"))


def best_by_artificial(ev: DataFrame) -> DataFrame:
    keys = ["timebased", "differenced", "rate", "model"]
    best = best_rows(prepare(ev), [*keys, "station", "pollutant", "distance"], "mean_squared_error", "artificial")
    return (best.groupBy(*keys, "artificial").agg(F.count("mean_squared_error").alias("best_mse_count"))
            .orderBy(*keys, F.desc("best_mse_count"), "artificial"))


def best_by_differenced(ev: DataFrame) -> DataFrame:
    keys = ["timebased", "artificial", "rate", "model"]
    best = best_rows(prepare(ev), [*keys, "station", "pollutant", "distance"], "norm_mean_absolute_error", "differenced")
    return (best.groupBy(*keys, "differenced").agg(F.count("norm_mean_absolute_error").alias("count_best_nmae"))
            .orderBy(*keys, F.desc("count_best_nmae"), "differenced"))


def general_norm_measures(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "rate"]
    return describe(prepare(ev), [*keys, "model"], NORM_MEASURES).orderBy(*keys, "norm_mean_absolute_error_mean")


def distance_norm_measures(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "rate", "distance"]
    return describe(prepare(ev), [*keys, "model"], NORM_MEASURES).orderBy(*keys, "norm_mean_absolute_error_mean")


def pollutant_norm_measures(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "rate", "pollutant"]
    return describe(prepare(ev), [*keys, "model"], NORM_MEASURES).orderBy(*keys, "norm_median_absolute_error_mean")


def best_by_poll_over_distances(ev: DataFrame) -> DataFrame:
    """Winner counts over the mean error of all distances."""
    keys = [*SETUP, "rate"]
    averaged = (prepare(ev).groupBy(*keys, "station", "pollutant", "model")
                .agg(exact_mean("mean_squared_error").alias("mean_squared_error")))
    best = best_rows(averaged, [*keys, "station", "pollutant"], "mean_squared_error", "model")
    return (best.groupBy(*keys, "pollutant", "model")
            .agg(F.count("mean_squared_error").alias("best_mse_by_distance_avg"))
            .orderBy(*keys, "pollutant", F.desc("best_mse_by_distance_avg"), "model"))


def all_norm_measures(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "rate", "pollutant", "model", "distance"]
    return describe(prepare(ev), keys, NORM_MEASURES).orderBy(*keys)


def best_by_mean_nmae(ev: DataFrame) -> DataFrame:
    """Best model per rate, pollutant and distance by its mean normalised absolute error."""
    keys = [*SETUP, "rate", "pollutant", "distance"]
    means = (prepare(ev).groupBy(*keys, "model")
             .agg(exact_mean("norm_mean_absolute_error").alias("norm_mean_absolute_error_mean")))
    return best_rows(means, keys, "norm_mean_absolute_error_mean", "model").orderBy(*keys)


def best_by_mean_nmae_per_pollutant(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "pollutant"]
    return (best_by_mean_nmae(ev).groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("best_count"))
            .orderBy(*keys, F.desc("best_count"), "model"))


def best_by_mean_nmae_per_distance(ev: DataFrame) -> DataFrame:
    keys = [*SETUP, "distance"]
    return (best_by_mean_nmae(ev).groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("best_count"))
            .orderBy(*keys, F.desc("best_count"), "model"))


#: Report name -> builder, in the order of the reports; the last five are informative extras.
REPORTS = {f.__name__: f for f in (
    general_prediction_times_overall, general_fit_times_overall, best_by_dist_and_poll, best_by_dist, best_by_poll,
    best_by_artificial, best_by_differenced, general_norm_measures, distance_norm_measures, pollutant_norm_measures,
    general_prediction_times, general_fit_times, best_by_poll_over_distances, all_norm_measures, best_by_mean_nmae,
    best_by_mean_nmae_per_pollutant, best_by_mean_nmae_per_distance)}
