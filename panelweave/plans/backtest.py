"""Parameter search and back-test of all models over all series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.params import typed_params
from panelweave.functions.scores import norm_factor, score, with_norm_scores
from panelweave.models import autoregression, fourier, search, smoothing, trees
from panelweave.models.fitting import forecasts
from panelweave.models.neighbours import MAX_NEIGHBOURS, nearest_rows, neighbour_value
from panelweave.models.regression import least_squares, linear_value
from panelweave.models.supervised import all_rows
from panelweave.operators.blocks import over_series, spread_join
from panelweave.operators.series import SEASON, head
from panelweave.operators.worklist import without_finished, work_list
from panelweave.schemas import EVAL_COLUMNS, PREDICTIONS_COLUMNS, RUN, SERIES
from panelweave.session import cut_lineage

DIRECT_MODELS = ["knn", "decision_tree", "random_forest", "linear_regression"]
TIMEBASED_MODELS = ["ets", "arima", "prophet"]
MODELS = [*DIRECT_MODELS, *TIMEBASED_MODELS]
_FORECAST = [*RUN, "model", "params", "slot", "actual", "predicted", "fit_time", "prediction_time"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def timebased_rows(grid: DataFrame, rate: str, differenced: Sequence[bool] = (False, True)) -> DataFrame:
    """Rows of the time-based setups: the series itself, its last season flagged."""
    season, parts = SEASON[rate], []
    for d in differenced:
        def columns(w, d=d):
            value = F.col("value") - F.lag("value", 1).over(w) if d else F.col("value")
            return [value.alias("_v"), F.lag("slot", 1).over(w).isNotNull().alias("_later"),
                    F.lead("slot", season).over(w).isNull().alias("is_holdout")]

        part = over_series(grid.filter(F.col("rate") == rate), columns, before=1, after=season, keep_block=True)
        if d:
            part = part.filter("_later")
        parts.append(part.select(*SERIES, F.lit(season).alias("distance"), F.lit(d).alias("differenced"),
                                 F.lit(False).alias("direct"), F.lit(False).alias("artificial"), "ts", "slot", "block",
                                 F.col("_v").alias("value"), "is_holdout"))
    return cut_lineage(_union(parts))


def _to_do(rows: DataFrame, todo: DataFrame | None) -> DataFrame:
    return rows if todo is None else spread_join(rows, todo, RUN, "left_semi", spread=("slot",))


def estimate(grid: DataFrame, models: Sequence[str] = MODELS, horizons: dict[str, list[int]] | None = None,
             done: DataFrame | None = None, rates: Sequence[str] = ("D", "H"), max_rows: int | None = None,
             direct_set: bool = True, draws: int | None = search.DRAWS,
             tree_candidates: dict[str, list[dict]] | None = None, seed: int = 0) -> DataFrame:
    """Best parameters and score per run and model, in the results layout.

    Runs that ``done`` already holds are left out. Direct models are scored by their mean negative squared error
    over the folds, time-based ones by their squared error on the last season. ``max_rows`` keeps only the first rows of
    every series; without it whole series take part.
    """
    grid = grid if max_rows is None else head(grid, max_rows)
    todo = None if done is None else work_list(grid, done, horizons)
    tree_candidates = tree_candidates or {}
    parts = []
    for rate in rates:
        if set(models) & set(DIRECT_MODELS):
            rows = _to_do(all_rows(grid, rate, None if horizons is None else horizons[rate], direct_set), todo)
            for model in models:
                if model == "knn":
                    parts.append(search.knn_search(rows, draws, seed=seed).withColumn("model", F.lit(model)))
                elif model == "linear_regression":
                    parts.append(search.linear_search(rows).withColumn("model", F.lit(model)))
                elif model in ("decision_tree", "random_forest"):
                    found = trees.tree_search(rows, model, tree_candidates.get(model), seed=seed)
                    parts.append(found.withColumn("model", F.lit(model)))
        if set(models) & set(TIMEBASED_MODELS):
            rows = _to_do(timebased_rows(grid, rate), todo)
            parts += [_timebased_score(_timebased_forecast(rows, rate, m), m) for m in models if m in TIMEBASED_MODELS]
    return _union(parts).select(*RUN, "model", "params", "score")


def _timebased_score(forecast: DataFrame, model: str) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    scored = forecast.groupBy(*RUN).agg(F.avg(error * error).alias("score"), F.any_value("params").alias("params"))
    return scored.withColumn("model", F.lit(model))


def _timebased_forecast(rows: DataFrame, rate: str, model: str, results: DataFrame | None = None) -> DataFrame:
    """Forecast rows of one time-based model; with ``results`` by the stored parameters."""
    chosen = None if results is None else results.filter((F.col("model") == model) & (F.col("rate") == rate)).select(*RUN, "params")
    actual = rows.filter("is_holdout").select(*RUN, "slot", F.col("value").alias("actual"))
    if model == "prophet":
        held = fourier.forecast(rows if chosen is None else _to_do(rows, chosen.select(*RUN)), rate, RUN)
        return held.select(*RUN, "slot", F.col("value").alias("actual"), "predicted", "fit_time",
                           F.create_map().cast("map<string,string>").alias("params"),
                           F.lit(None).cast("double").alias("prediction_time"), F.lit(model).alias("model"))
    if model == "ets":
        used = rows if chosen is None else spread_join(rows, chosen, RUN, spread=("slot",))
        fitted = forecasts(smoothing.forecast(used.drop("block"), RUN))
        ahead = fitted.select(*RUN, "params", "step", "predicted", "fit_time", "prediction_time")
    else:
        orders = None if chosen is None else chosen.select(*RUN, F.try_element_at("params", F.lit("order")).alias("order"))
        fitted = autoregression.forecast(rows, RUN, orders)
        ahead = fitted.select(*RUN, "params", F.posexplode("ahead").alias("step", "predicted"), "fit_time",
                              F.lit(None).cast("double").alias("prediction_time"))
    start = actual.groupBy(*RUN).agg(F.min("slot").alias("_first"))
    placed = ahead.join(start, RUN).withColumn("slot", F.col("_first") + F.col("step")).drop("_first", "step")
    return placed.join(actual, [*RUN, "slot"]).withColumn("model", F.lit(model))


def direct_forecast(rows: DataFrame, model: str, results: DataFrame) -> DataFrame:
    """Forecast rows of one direct model with the stored parameters of each run."""
    chosen = results.filter(F.col("model") == model)
    rows = _to_do(rows, chosen.select(*RUN))
    train, held = rows.filter(~F.col("is_holdout")), rows.filter("is_holdout")
    none = F.lit(None).cast("double")
    if model == "knn":
        near = nearest_rows(train, held.drop("block", "is_holdout"), RUN, MAX_NEIGHBOURS)
        p = typed_params("knn", F.col("params"))
        out = near.join(chosen.select(*RUN, "params"), RUN).withColumn(
            "predicted", neighbour_value("near", p["n_neighbors"], p["weights"])).withColumn("fit_time", F.lit(0.0))
    elif model == "linear_regression":
        coef = least_squares(train, RUN).select(*RUN, "intercept", "coef", "fit_time")
        out = (spread_join(held, coef, RUN, spread=("slot",)).join(chosen.select(*RUN, "params"), RUN)
               .withColumn("predicted", linear_value()).withColumn("prediction_time", none))
    else:
        out = trees.tree_forecast(rows, model, chosen).withColumn("prediction_time", none)
    return out.select(*RUN, F.lit(model).alias("model"), "params", "slot", F.col("label").alias("actual"), "predicted",
                      "fit_time", "prediction_time")


def forecast_all(grid: DataFrame, results: DataFrame, models: Sequence[str] = MODELS,
                 horizons: dict[str, list[int]] | None = None, rates: Sequence[str] = ("D", "H"),
                 max_rows: int | None = None, direct_set: bool = True) -> tuple[DataFrame, DataFrame]:
    """Forecast rows of all models, and the normalisation factor of every run."""
    grid = grid if max_rows is None else head(grid, max_rows)
    parts, factors = [], []
    for rate in rates:
        if set(models) & set(DIRECT_MODELS):
            rows = all_rows(grid, rate, None if horizons is None else horizons[rate], direct_set)
            factors.append(rows.groupBy(*RUN).agg(norm_factor("label").alias("norm_factor")))
            parts += [direct_forecast(rows, m, results) for m in models if m in DIRECT_MODELS]
        if set(models) & set(TIMEBASED_MODELS):
            rows = timebased_rows(grid, rate)
            factors.append(rows.groupBy(*RUN).agg(norm_factor("value").alias("norm_factor")))
            parts += [_timebased_forecast(rows, rate, m, results) for m in models if m in TIMEBASED_MODELS]
    return _union([p.select(*_FORECAST) for p in parts]), _union(factors)


def evaluate(grid: DataFrame, results: DataFrame, models: Sequence[str] = MODELS,
             horizons: dict[str, list[int]] | None = None, done: DataFrame | None = None,
             rates: Sequence[str] = ("D", "H"), max_rows: int | None = None,
             direct_set: bool = True) -> tuple[DataFrame, DataFrame]:
    """Evaluation and predictions tables: every stored run refitted, forecast over the last season and scored.

    Stations that ``done`` already holds are left out; stations without results never enter.
    """
    if done is not None:
        results = without_finished(results, done, ["station", "rate"])
    forecast, factors = forecast_all(grid, results, models, horizons, rates, max_rows, direct_set)
    forecast = cut_lineage(forecast)
    return evaluation_table(forecast, factors), predictions_table(forecast)


def failed_runs(results: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Stored runs that the evaluation has no row for, as no forecast could be made."""
    return results.join(evaluation.select(*RUN, "model"), [*RUN, "model"], "left_anti").select(*RUN, "model", "params")


def evaluation_table(forecast: DataFrame, factors: DataFrame) -> DataFrame:
    extra = [F.any_value("params").alias("params"), F.max("fit_time").alias("fit_time"),
             F.sum("prediction_time").alias("prediction_time")]
    scored = score(forecast, [*RUN, "model"], extra=extra).join(factors, RUN, "left")
    return with_norm_scores(scored).select(*EVAL_COLUMNS)


def predictions_table(forecast: DataFrame) -> DataFrame:
    """Forecasts numbered from 0 in time order within each run of one season's length."""
    first = forecast.groupBy(*RUN, "model").agg(F.min("slot").alias("_first"))
    return (forecast.join(first, [*RUN, "model"])
            .withColumn("step", (F.col("slot") - F.col("_first")).cast("int"))
            .withColumn("value", F.col("predicted")).select(*PREDICTIONS_COLUMNS))
