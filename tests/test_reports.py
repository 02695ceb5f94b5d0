import statistics

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from panelweave.functions import scores
from panelweave.operators import stats
from panelweave.plans import reports
from panelweave.schemas import NORM_SCORES, SCORES
from panelweave.sources import tables


@pytest.fixture(scope="module")
def evaluation(spark):
    data = [("S1", "knn", 4.0), ("S1", "linear_regression", 2.0), ("S2", "knn", 1.0), ("S2", "linear_regression", 3.0),
            ("S3", "knn", 5.0), ("S3", "linear_regression", None)]
    base = spark.createDataFrame(data, "station string, model string, mean_squared_error double")
    extra = {c: F.col("mean_squared_error") / 10 for c in NORM_SCORES}
    return base.select("*", F.lit("H").alias("rate"), F.lit("NO").alias("pollutant"), F.lit(1).alias("distance"),
                       F.lit(False).alias("differenced"), F.lit(True).alias("direct"), F.lit(True).alias("artificial"),
                       F.lit(0.5).alias("fit_time"), F.col("mean_squared_error").alias("prediction_time"),
                       *[v.alias(k) for k, v in extra.items()])


def test_winner_counts(evaluation):
    rows = reports.slice_of(reports.best_by_dist_and_poll(evaluation), timebased=False, differenced=False, artificial=True)
    assert [tuple(r) for r in rows.collect()] == [("H", "NO", 1, "knn", 2), ("H", "NO", 1, "linear_regression", 1)]
    for report in (reports.best_by_dist, reports.best_by_poll):
        assert {r.model: r.best_mse_count for r in report(evaluation).collect()} == {"knn": 2, "linear_regression": 1}


def test_group_without_scores_counts_zero(evaluation):
    only = evaluation.filter("station = 'S3' and model = 'linear_regression'")
    assert [(r.model, r.best_mse_count) for r in reports.best_by_dist(only).collect()] == [("linear_regression", 0)]


def test_statistics_skip_missing_scores(evaluation):
    row = reports.general_norm_measures(evaluation).filter("model = 'linear_regression'").first()
    assert row.norm_mean_squared_error_mean == pytest.approx(0.25) and row.norm_mean_squared_error_max == pytest.approx(0.3)


def test_every_report_runs_and_is_written(spark, evaluation, tmp_path):
    paths = tables.write_reports(evaluation, str(tmp_path), names=["best_by_poll", "general_fit_times"])
    read = spark.read.option("header", True).csv(paths[0])
    assert read.count() == 2 and "best_mse_count" in read.columns
    for name, report in reports.REPORTS.items():
        assert report(evaluation).count() > 0, name


@pytest.mark.parametrize("accuracy, margins", [(20_000, stats.MARGINS), (200, [0.05, 0.1, 0.5])])
def test_exact_median_of_skewed_groups(spark, monkeypatch, accuracy, margins):
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    monkeypatch.setattr(stats, "MARGINS", margins)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.when(F.col("id") % 3 == 1, F.lit(0.25)).otherwise(F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0).alias("x"))
    found = {r.k: r for r in stats.describe(df, ["k"], ["x"]).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r.x)
    assert set(found) == set(groups)
    for k, v in groups.items():
        assert found[k].x_median == statistics.median(v)
        assert (found[k].x_min, found[k].x_max) == (min(v), max(v))
        assert found[k].x_mean == pytest.approx(statistics.fmean(v))


def test_tied_means_do_not_depend_on_row_order(spark):
    """Two models with the same mean, summed in orders that give different doubles: the smaller label wins each time."""
    cells = [0.1, 0.2, 0.3, 0.7, 1e-3, 5.5]
    for order in (cells, cells[::-1], sorted(cells, key=lambda v: -v % 0.4)):
        rows = [("a", v) for v in cells] + [("b", v) for v in order]
        for data in (rows, rows[::-1]):
            df = spark.createDataFrame(data, "model string, x double").coalesce(1).withColumn("k", F.lit(1))
            means = df.groupBy("k", "model").agg(stats.exact_mean("x").alias("x"))
            assert stats.best_rows(means, ["k"], "x", "model").first().model == "a"


def test_scores(spark):
    df = spark.createDataFrame([Row(k=1, actual=a, predicted=p) for a, p in zip([3.0, -0.5, 2.0, 7.0], [2.5, 0.0, 2.0, 8.0])])
    row = scores.with_norm_scores(scores.score(df, ["k"]).withColumn("norm_factor", F.lit(2.0))).first()
    assert [row[s] for s in SCORES] == pytest.approx([0.375, 0.5, 0.5, 0.948608, 0.957173], abs=1e-6)
    assert [row[s] for s in NORM_SCORES] == pytest.approx([2 * row[s] for s in SCORES])
    assert df.agg(scores.norm_factor("actual")).first()[0] == pytest.approx(0.133333, abs=1e-6)


def test_scores_without_variation(spark):
    df = spark.createDataFrame([Row(k=k, actual=5.0, predicted=p) for k, p in [(1, 5.0), (1, 5.0), (2, 4.0), (2, 6.0), (2, float("nan"))]])
    rows = {r.k: r for r in scores.score(df, ["k"]).collect()}
    assert rows[1].r2 == 1 and rows[1].explained_variance == 1
    assert rows[2].r2 == 0 and rows[2].mean_squared_error == 1
    assert df.agg(scores.norm_factor("actual")).first()[0] is None
