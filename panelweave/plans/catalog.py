"""Query catalogue over the driver's tables: one entry per operator, each reading whole tables."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions import names, params, scores
from panelweave.operators import ingest, resample, scaling, series, worklist
from panelweave.models import neighbours, regression, search, smoothing, supervised, trees
from panelweave.operators.asof import asof_join
from panelweave.operators.blocks import over_series, spread_join, with_row_slot
from panelweave.operators.stats import describe
from panelweave.plans import backtest, reports
from panelweave.schemas import RUN, SERIES, STATION
from panelweave.session import cut_lineage, shared_dir
from panelweave.sources import stand_ins as src
from panelweave.sources import tables
from panelweave.streaming import incremental

KEY = [*SERIES, "ts"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums depend on row order in their last bits; results are compared at a fixed number of digits."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def hourly_grid(spark: SparkSession, sf_dir: str, stations: int = 2) -> DataFrame:
    return resample.resample(src.hourly(spark, sf_dir, stations), "H")


# --- projections, filters, ingest ---------------------------------------------------------------------------

def bulk_filter(spark, sf_dir):
    part = src.read_table(spark, sf_dir, "part")
    return ingest.without_word(part, "p_name", "Widget").select("p_partkey", "p_name")


def column_prune(spark, sf_dir):
    return src.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


def raw_like(spark, sf_dir) -> DataFrame:
    """Events in the layout of a raw observation file; one sixth of them are bulk samples."""
    events = src.read_table(spark, sf_dir, "events")
    part = F.col("user_id") % 4
    return events.select(
        F.concat(F.lit("ST"), (F.col("user_id") % 2).cast("string")).alias("AirQualityStationEoICode"),
        F.when(F.col("event_id") % 6 == 0, F.lit("X_Bulk_1")).when(F.col("event_id") % 6 != 1, F.lit("SPO-1"))
        .alias("SamplingPoint"),
        F.col("event_type").alias("AirPollutant"), F.lit("hour").alias("AveragingTime"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("Concentration"),
        F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("DatetimeEnd"),
        F.timestamp_seconds(part).alias("_file_time"), part.cast("string").alias("_file_path"))


def ingest_raw(spark, sf_dir):
    return rounded(ingest.ingest(raw_like(spark, sf_dir)))


def pivot_mean(spark, sf_dir):
    wide = ingest.pivot_wide(src.hourly(spark, sf_dir), ["click", "error", "purchase", "signup", "view"])
    return rounded(wide)


def unpivot_long(spark, sf_dir):
    wide = ingest.pivot_wide(src.hourly(spark, sf_dir), ["click", "error", "purchase", "signup", "view"])
    return rounded(ingest.unpivot_long(wide))


def merge_newest_wins(spark, sf_dir):
    return rounded(ingest.merge_newest_wins(src.hourly(spark, sf_dir, files=4), F.col("file_seq")))


def upsert(spark, sf_dir):
    """All four parts, each merged over the ones before."""
    files = src.hourly(spark, sf_dir, files=4)
    old, *later = [files.filter(F.col("file_seq") == part).drop("file_seq") for part in range(4)]
    for new in later:
        old = ingest.upsert(new, old)
    return rounded(old)


def coverage(spark, sf_dir):
    return ingest.coverage(src.hourly(spark, sf_dir, stations=1))


def density_filter(spark, sf_dir):
    return rounded(ingest.density_filter(src.hourly(spark, sf_dir, stations=1), 0.98).select(*KEY, "value"))


def station_enrich(spark, sf_dir):
    nation = src.read_table(spark, sf_dir, "nation")
    stations = nation.select(F.concat(F.lit("ST"), (F.col("n_nationkey") % 3).cast("string")).alias("station"),
                             (F.col("n_nationkey") * 1.5).alias("latitude"),
                             (F.col("n_regionkey") * -2.5).alias("longitude"))
    return rounded(ingest.with_station_info(src.hourly(spark, sf_dir), stations))


def rate_vocab(spark, sf_dir):
    flag = F.col("o_orderstatus")
    text = F.when(flag == "O", F.lit("day")).when(flag == "F", F.lit("hour")).otherwise(F.lit("other"))
    orders = src.read_table(spark, sf_dir, "orders").withColumn("averaging", text)
    out = orders.groupBy("averaging").agg(F.count(F.lit(1)).alias("n"))
    code = names.rate_code(F.col("averaging"))
    return out.select("averaging", code.alias("rate"), names.rate_name(code).alias("restored"), "n")


def asof_last_order(spark, sf_dir):
    """Every event with the last order day of its user up to then."""
    days = (src.read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"))
            .agg(F.max("o_orderkey").alias("orderkey")))
    events = src.read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = asof_join(events, days, ["user_id"], "ts", "day")
    return found.select("event_id", F.col("match.orderkey").alias("orderkey"), F.col("match.day").cast("string").alias("day"))


def asof_next_purchase(spark, sf_dir):
    """Every view with its user's next purchase within a day."""
    events = src.read_table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("purchase"))
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    found = asof_join(views, bought, ["user_id"], forward=True, within=86400)
    return found.select("event_id", F.col("match.purchase").alias("purchase"))


# --- grids -----------------------------------------------------------------------------------------------------

def resample_hourly(spark, sf_dir):
    grid = resample.resample(src.hourly(spark, sf_dir), "H", align=False, interpolate=False)
    return rounded(grid.select(*KEY, "value"))


def resample_daily_bfill(spark, sf_dir):
    grid = resample.resample(src.daily(spark, sf_dir), "D", align=False, interpolate=False)
    return grid.select(*KEY, "value")


def interpolate_time(spark, sf_dir):
    grid = resample.resample(src.hourly(spark, sf_dir), "H", align=False)
    return rounded(grid.select(*KEY, "value"))


def interpolate_position(spark, sf_dir):
    numbered = with_row_slot(src.hourly(spark, sf_dir))
    holes = numbered.withColumn("value", F.when(F.col("slot") % 3 != 1, F.col("value")))
    return rounded(resample.interpolate(holes, by="position").select(*KEY, "value"))


def align_start(spark, sf_dir):
    return rounded(hourly_grid(spark, sf_dir).select(*KEY, "value"))


def resample_daily(spark, sf_dir):
    return resample.resample(src.daily(spark, sf_dir), "D").select(*KEY, "value")


# --- row ranges ------------------------------------------------------------------------------------------------

def head_n_per_series(spark, sf_dir):
    return rounded(series.head(hourly_grid(spark, sf_dir), 200).select(*KEY, "value"))


def skip_n_per_series(spark, sf_dir):
    return rounded(series.skip(hourly_grid(spark, sf_dir), 24).select(*KEY, "value"))


def tail_n_per_series(spark, sf_dir):
    return rounded(series.tail(hourly_grid(spark, sf_dir), 24).select(*KEY, "value"))


def holdout_split(spark, sf_dir):
    return rounded(series.holdout_split(hourly_grid(spark, sf_dir)).select(*KEY, "value", "is_holdout"))


def ts_split(spark, sf_dir):
    split = series.time_series_split(hourly_grid(spark, sf_dir))
    return split.groupBy(*SERIES, "fold").agg(
        F.count_if("in_train").alias("n_train"), F.count_if("in_test").alias("n_test"),
        F.max(F.when(F.col("in_train"), F.col("ts"))).alias("train_end"),
        F.min(F.when(F.col("in_test"), F.col("ts"))).alias("test_start"),
        F.max(F.when(F.col("in_test"), F.col("ts"))).alias("test_end"))


# --- features --------------------------------------------------------------------------------------------------

def lag_features(spark, sf_dir):
    return rounded(series.lag_features(hourly_grid(spark, sf_dir), 24).drop("slot"))


def stat_features(spark, sf_dir):
    out = series.artificial_features(hourly_grid(spark, sf_dir), 24)
    return rounded(out.select(*KEY, "value", "sum", "mean", "median"))


def stat_features_lags_only(spark, sf_dir):
    out = series.artificial_features(hourly_grid(spark, sf_dir), 7, stat_mode="lags_only")
    return rounded(out.select(*KEY, "value", "sum", "mean", "median"))


def weekday_onehot(spark, sf_dir):
    return src.daily(spark, sf_dir).select("station", "pollutant", "ts", *series.weekday_flags(F.col("ts")))


def month_onehot(spark, sf_dir):
    return src.daily(spark, sf_dir).select("station", "pollutant", "ts", *series.month_flags(F.col("ts")))


def difference(spark, sf_dir):
    return rounded(series.difference(hourly_grid(spark, sf_dir)).select(*KEY, "value"))


def difference_irregular(spark, sf_dir):
    rows = with_row_slot(src.hourly(spark, sf_dir))
    return rounded(series.difference(rows, 2).select(*KEY, "value"))


def dedifference(spark, sf_dir):
    grid = hourly_grid(spark, sf_dir)
    return rounded(series.dedifference(series.difference(grid), series.first_values(grid)).select(*KEY, "value"))


def rotate_left(spark, sf_dir):
    return rounded(series.rotate_left(hourly_grid(spark, sf_dir)).select(*KEY, "value"))


def target_shift(spark, sf_dir):
    return rounded(series.target_shift(hourly_grid(spark, sf_dir), 3).select(*KEY, "value", "target"))


def horizon_explode(spark, sf_dir):
    out = series.horizon_explode(hourly_grid(spark, sf_dir), series.HORIZONS["H"])
    return rounded(out.select(*KEY, "value", "horizon", "target"))


def minmax_scale(spark, sf_dir):
    grid = hourly_grid(spark, sf_dir)
    return rounded(scaling.scale(grid, scaling.fit_scaler(grid)).select(*KEY, "value"))


def minmax_rescale(spark, sf_dir):
    grid = hourly_grid(spark, sf_dir)
    scaler = scaling.fit_scaler(grid)
    return rounded(scaling.rescale(scaling.scale(grid, scaler), scaler).select(*KEY, "value"))


def scaled_sequences(spark, sf_dir):
    """Scaled feature sequences with their restored label: the data side of a recurrent model."""
    grid = hourly_grid(spark, sf_dir)
    rows = over_series(grid, lambda w: [
        F.array(*series.lag_columns(w, 3)).alias("features"), F.lead("value", 1).over(w).alias("label")],
        before=2, after=1)
    rows = series.skip(rows, 2).filter(F.col("label").isNotNull())
    scaler = scaling.fit_array_scaler(rows)
    scaled = scaling.scale_inputs(rows, scaler)
    restored = scaling.scale_inputs(scaled, scaler, inverse=True)
    seq = scaled.select(*KEY, scaling.as_sequence("features").alias("seq"), F.col("label").alias("scaled_label"))
    return rounded(seq.join(restored.select(*KEY, F.col("label").alias("restored_label")), KEY).select(
        *KEY, *[F.col("seq")[i][0].alias(f"x{i}") for i in range(3)], "scaled_label", "restored_label"))


def other_series_features(spark, sf_dir):
    out = series.other_series_features(hourly_grid(spark, sf_dir))
    return rounded(out.select(*KEY, "value", *[F.col("features")[i].alias(f"x{i}") for i in range(4)]))


def feature_gate(spark, sf_dir):
    nation = F.concat(F.lit("ST"), F.col("o_custkey").cast("string"))
    orders = src.read_table(spark, sf_dir, "orders")
    panel = orders.select(nation.alias("station"), F.lit("D").alias("rate"), F.col("o_orderdate").alias("ts"),
                          F.col("o_orderpriority").alias("pollutant"), F.col("o_totalprice").alias("value"))
    return (series.feature_gate(panel, 5).groupBy(*STATION, "pollutant")
            .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")))


# --- work lists and names --------------------------------------------------------------------------------------

def todo_anti_join(spark, sf_dir):
    done = src.evaluation(spark, sf_dir).filter("fit_time > 40").select(*RUN)
    return worklist.without_finished(src.evaluation(spark, sf_dir).select(*RUN).distinct(), done)


def with_results_semi_join(spark, sf_dir):
    late = src.read_table(spark, sf_dir, "events").filter("value > 480").select(
        F.concat(F.lit("ST"), (F.col("user_id") % 50).cast("string")).alias("station"), F.lit("H").alias("rate"))
    return rounded(worklist.with_results(src.hourly(spark, sf_dir, stations=50), late).select(*KEY, "value"))


def run_setups(spark, sf_dir):
    todo = worklist.work_list(src.hourly(spark, sf_dir))
    return todo.groupBy(*STATION, "differenced", "direct", "artificial").agg(
        F.count(F.lit(1)).alias("n"), F.sum("distance").alias("distances"))


def run_name_build(spark, sf_dir):
    ev = src.evaluation(spark, sf_dir)
    name = names.run_name(*[F.col(c) for c in ("station", "rate", "pollutant", "distance", "differenced", "direct",
                                               "artificial")])
    return ev.select(name.alias("run_name")).groupBy("run_name").agg(F.count(F.lit(1)).alias("n"))


def run_name_parse(spark, sf_dir):
    return run_name_build(spark, sf_dir).select(
        names.parse_run_name(F.concat(F.lit("results/"), F.col("run_name"))).alias("r"), "n").select("r.*", "n")


def report_name_build(spark, sf_dir):
    ev = reports.prepare(src.evaluation(spark, sf_dir))
    slice_ = names.report_name(F.col("timebased"), F.col("differenced"),
                               F.when(~F.col("timebased"), F.col("artificial")), F.col("rate"))
    return ev.groupBy(slice_.alias("name")).agg(F.count(F.lit(1)).alias("n"))


def params_roundtrip(spark, sf_dir):
    part = src.read_table(spark, sf_dir, "part")
    stored = part.select("p_partkey", params.params_map(
        n_neighbors=F.col("p_size").cast("double"), weights=F.lower("p_brand"),
        max_depth=F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("params"))
    knn, forest = params.typed_params("knn", F.col("params")), params.typed_params("random_forest", F.col("params"))
    return stored.select("p_partkey", knn["n_neighbors"].alias("n_neighbors"), knn["weights"].alias("weights"),
                         forest["max_depth"].alias("max_depth"), forest["n_estimators"].alias("n_estimators"))


# --- scores of baseline forecasts -------------------------------------------------------------------------------

def naive_forecast(grid: DataFrame, horizon: int) -> DataFrame:
    """Persistence: the value ``horizon`` rows earlier, for the rows of the last season."""
    shifted = over_series(grid, lambda w: [F.lag("value", horizon).over(w).alias("predicted"),
                                           series.holdout_flag(w).alias("is_holdout")], before=horizon, after=24)
    return shifted.withColumnRenamed("value", "actual")


def score_baseline(grid: DataFrame, horizon: int) -> DataFrame:
    forecast = naive_forecast(grid, horizon)
    whole = grid.groupBy(*SERIES).agg(scores.norm_factor("value").alias("norm_factor"))
    raw = scores.score(forecast.filter("is_holdout"), SERIES)
    return scores.with_norm_scores(raw.join(whole, SERIES))


def score_naive(spark, sf_dir):
    return rounded(scores.score(naive_forecast(hourly_grid(spark, sf_dir), 1).filter("is_holdout"), SERIES))


def score_seasonal_naive(spark, sf_dir):
    return rounded(scores.score(naive_forecast(hourly_grid(spark, sf_dir), 24).filter("is_holdout"), SERIES))


def norm_scores(spark, sf_dir):
    return rounded(score_baseline(hourly_grid(spark, sf_dir), 24))


def baseline_report(spark, sf_dir):
    """End to end: grid, seasonal-naive forecast, scores, statistics per rate."""
    scored = cut_lineage(score_baseline(hourly_grid(spark, sf_dir), 24))  # the evaluation table of a pipeline
    return rounded(describe(scored, ["rate"], ["norm_mean_absolute_error"]))


# --- models ---------------------------------------------------------------------------------------------------

def knn_forecast(spark, sf_dir, weights: str) -> DataFrame:
    """Forecast one hour ahead over the last day from the five nearest hours of each series."""
    rows = supervised.all_rows(hourly_grid(spark, sf_dir, 1), "H", [1], direct_set=False, differenced=[False])
    near = neighbours.nearest_rows(rows.filter("not is_holdout"), rows.filter("is_holdout"), RUN, 5)
    return rounded(near.select(*KEY, F.col("label").alias("actual"), neighbours.neighbour_value(
        "near", F.lit(5), F.lit(weights)).alias("predicted")))


def knn_uniform(spark, sf_dir):
    return knn_forecast(spark, sf_dir, "uniform")


def knn_distance(spark, sf_dir):
    return knn_forecast(spark, sf_dir, "distance")


def knn_cv_best(spark, sf_dir):
    """Best of all fifty candidates over three time-ordered folds, from the values of the other series."""
    rows = supervised.direct_rows(cut_lineage(hourly_grid(spark, sf_dir, 1)), "H", [1])
    found = search.knn_search(cut_lineage(rows), draws=None)
    best = params.typed_params("knn", F.col("params"))
    return rounded(found.select(*SERIES, best["n_neighbors"].alias("n_neighbors"), best["weights"].alias("weights"), "score"))


def knn_cv_best_absolute(spark, sf_dir):
    """The same search scored by the mean absolute error."""
    rows = supervised.direct_rows(cut_lineage(hourly_grid(spark, sf_dir, 1)), "H", [1])
    found = search.knn_search(cut_lineage(rows), draws=None, loss=search.absolute_error)
    best = params.typed_params("knn", F.col("params"))
    return rounded(found.select(*SERIES, best["n_neighbors"].alias("n_neighbors"), best["weights"].alias("weights"), "score"))


def _linear(spark, sf_dir, n: int) -> DataFrame:
    grid = hourly_grid(spark, sf_dir)
    rows = over_series(grid, lambda w: [F.array(*series.lag_columns(w, n)).alias("features"),
                                        F.lead("value", 1).over(w).alias("label")], before=n - 1, after=1, keep_block=True)
    rows = rows.filter(F.col("label").isNotNull() & F.forall("features", lambda v: v.isNotNull()))
    fit = regression.least_squares(rows, SERIES)
    return rounded(fit.select(*SERIES, "intercept", *[F.col("coef")[i].alias(f"coef_{i + 1}") for i in range(n)], "n"))


def linreg_one_feature(spark, sf_dir):
    return _linear(spark, sf_dir, 1)


def linreg_two_features(spark, sf_dir):
    return _linear(spark, sf_dir, 2)


def linreg_multi(spark, sf_dir):
    """Linear regression on a day of lags and their statistics, which are combinations of the lags."""
    rows = supervised.all_rows(hourly_grid(spark, sf_dir), "H", None, direct_set=False)
    coef = regression.least_squares(rows.filter("not is_holdout"), RUN).select(*RUN, "intercept", "coef")
    held = spread_join(rows.filter("is_holdout"), coef, RUN, spread=("slot",))
    return rounded(scores.score(held.withColumn("predicted", regression.linear_value()), RUN, actual="label"))


def _forecast_scores(forecast: DataFrame) -> DataFrame:
    return rounded(scores.score(forecast, [*RUN, "model"]))


def _timebased(spark, sf_dir, model: str) -> DataFrame:
    grid = resample.resample(src.daily(spark, sf_dir), "D")
    rows = backtest.timebased_rows(grid, "D")
    return _forecast_scores(backtest._timebased_forecast(rows, "D", model))


def holt_winters(spark, sf_dir):
    return _timebased(spark, sf_dir, "ets")


#: Parameters of a query with a counterpart in SQL.
SMOOTHING = {"smoothing_level": "0.5", "smoothing_slope": "0.05", "smoothing_seasonal": "0.2", "damping_slope": "0.97", "use_boxcox": "false"}


def holt_winters_stored(spark, sf_dir):
    """Forecast of the last week of every daily series with stored parameters, in short blocks."""
    rows = backtest.timebased_rows(resample.resample(src.daily(spark, sf_dir), "D"), "D", [False])
    rows = rows.drop("block").withColumn("params", F.create_map(*[F.lit(x) for pair in SMOOTHING.items() for x in pair]))
    ahead = smoothing.forecast(rows, RUN, block_slots=180, fanout=4)
    return rounded(ahead.select(*SERIES, "step", "predicted"))


def ar_forecast(spark, sf_dir):
    return _timebased(spark, sf_dir, "arima")


def fourier_forecast(spark, sf_dir):
    return _timebased(spark, sf_dir, "prophet")


def _tree(spark, sf_dir, model: str, values: dict) -> DataFrame:
    rows = supervised.artificial_rows(hourly_grid(spark, sf_dir), "H", [1])
    out = trees.tree_forecast(rows, model, params=values).withColumn("model", F.lit(model))
    return rounded(scores.score(out, [*RUN, "model"], actual="label"))


def tree(spark, sf_dir):
    return _tree(spark, sf_dir, "decision_tree", {"max_depth": 5})


def forest(spark, sf_dir):
    return _tree(spark, sf_dir, "random_forest", {"max_depth": 5, "n_estimators": 10})


def param_grid_search(spark, sf_dir):
    """Search of linear regression and kNN (twenty draws) for one horizon, in the results layout."""
    return rounded(backtest.estimate(hourly_grid(spark, sf_dir), ["knn", "linear_regression"], {"H": [1]}, rates=["H"],
                                     direct_set=False))


def backtest_evaluate(spark, sf_dir):
    """Back-test of the time-based models and linear regression with given parameters, in the evaluation layout."""
    grid = hourly_grid(spark, sf_dir, 1)
    runs = worklist.work_list(grid, horizons={"H": [1]})
    results = (runs.filter("direct").withColumn("model", F.lit("linear_regression"))
               .unionByName(runs.filter("not direct").withColumn("model", F.lit("prophet")))
               .withColumn("params", F.create_map().cast("map<string,string>")))
    table, _ = backtest.evaluate(grid, results, ["linear_regression", "prophet"], {"H": [1]}, rates=["H"])
    return rounded(table.drop("fit_time", "prediction_time", "params"))


def backtest_predictions(spark, sf_dir):
    grid = hourly_grid(spark, sf_dir, 1)
    results = (worklist.work_list(grid, horizons={"H": [1]}).filter("not direct").withColumn("model", F.lit("prophet"))
               .withColumn("params", F.create_map().cast("map<string,string>")))
    return rounded(backtest.evaluate(grid, results, ["prophet"], {"H": [1]}, rates=["H"])[1])


# --- stored tables and incremental ingest -------------------------------------------------------------------------

def _fresh_dir(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def merge_stored(spark, sf_dir):
    """Four overlapping parts merged one after the other into a stored table."""
    path = f"{_fresh_dir(spark)}/measurements"
    files = src.hourly(spark, sf_dir, files=4)
    for part in range(4):
        tables.merge_measurements(files.filter(F.col("file_seq") == part).drop("file_seq"), path)
    return rounded(tables.read_measurements(spark, path))


def stored_evaluation(spark, sf_dir):
    """The evaluation table written by station and rate, and read back."""
    path = f"{_fresh_dir(spark)}/evaluation"
    tables.write_evaluation(src.evaluation(spark, sf_dir), path)
    return rounded(tables.read_evaluation(spark, path))


def stored_results(spark, sf_dir):
    """Runs and parameters written as search results, and the typed parameters of the runs read back."""
    path = f"{_fresh_dir(spark)}/results"
    ev = src.evaluation(spark, sf_dir)
    tables.write_results(ev.select(*RUN, "model", params.params_map(n_neighbors=F.floor("fit_time").cast("double")).alias("params"),
                                   F.col("mean_squared_error").alias("score")), path)
    stored = tables.read_results(spark, path)
    return rounded(stored.select(*RUN, "model", params.typed_params("knn", F.col("params"))["n_neighbors"].alias("n_neighbors"), "score"))


def incremental_ingest(spark, sf_dir):
    """Events that arrive in three parts, each ingested as it comes; of parts with the same cell the newest wins."""
    folder = _fresh_dir(spark)
    events = src.read_table(spark, sf_dir, "events")
    for part in range(3):
        events.filter(F.col("user_id") % 3 == part).write.mode("append").parquet(f"{folder}/arrived")
        incremental.ingest_new_files(spark, f"{folder}/arrived", f"{folder}/measurements", f"{folder}/checkpoint",
                                     schema=events.schema, prepare=src.hourly_of)
    return rounded(tables.read_measurements(spark, f"{folder}/measurements"))


def stored_dense(spark, sf_dir):
    """The density pass over a stored table, run twice: what a second, stricter pass rejects is gone from the target."""
    folder = _fresh_dir(spark)
    tables.merge_measurements(src.hourly(spark, sf_dir, stations=1), f"{folder}/measurements")
    for threshold in (0.0, 0.94):
        tables.write_dense(spark, f"{folder}/measurements", f"{folder}/dense", threshold)
    return rounded(tables.read_measurements(spark, f"{folder}/dense"))


def _write_lines(lines: DataFrame, folder: str, header: str) -> None:
    """Write ``name`` and ``line`` rows as one headed text file per name, in the order of the lines."""
    spark = lines.sparkSession
    rows = lines.select("name", F.lit(1).alias("place"), F.col("line").alias("value"))
    heads = lines.select("name").distinct().select("name", F.lit(0).alias("place"), F.lit(header).alias("value"))
    (rows.unionByName(heads).repartition("name").sortWithinPartitions("name", "place", "value").select("name", "value")
     .write.partitionBy("name").text(f"{folder}/parts"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop(f"{folder}/files"))
    for found in files.globStatus(hadoop(f"{folder}/parts/name=*/part-*")):  # a folder per file; Spark names the files in it
        name = unquote(found.getPath().getParent().getName().removeprefix("name="))
        files.rename(found.getPath(), hadoop(f"{folder}/files", name))


def station_files(spark, sf_dir):
    """Measurements written as station files of one column per pollutant and read back."""
    folder = f"{_fresh_dir(spark)}/stations"
    pollutants = ["click", "error", "purchase", "signup", "view"]
    wide = ingest.pivot_wide(src.hourly(spark, sf_dir), pollutants)
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in pollutants])
    _write_lines(wide.select(F.concat("station", F.lit("-hour.csv")).alias("name"), line.alias("line")), folder, ",".join(["DatetimeEnd", *pollutants]))
    return rounded(tables.read_station_files(spark, f"{folder}/files").select(*KEY, "value"))


def evaluation_files(spark, sf_dir):
    """The evaluation table written as files per station and rate and read back."""
    folder = f"{_fresh_dir(spark)}/evaluation"
    cells = [*RUN[2:], "model", "fit_time", "prediction_time", "mean_squared_error"]
    rate = F.when(F.col("rate") == "H", "hour").otherwise("day")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in cells])
    named = src.evaluation(spark, sf_dir).select(F.concat("station", F.lit("-"), rate, F.lit(".csv")).alias("name"), line.alias("line"))
    _write_lines(named, folder, ",".join(cells))
    return rounded(tables.read_evaluation_files(spark, f"{folder}/files").select(*RUN[:2], *cells))


def _report(name):
    def run(spark, sf_dir):
        return rounded(reports.REPORTS[name](src.evaluation(spark, sf_dir)))
    return run


QUERIES = {f.__name__: f for f in (
    bulk_filter, column_prune, ingest_raw, pivot_mean, unpivot_long, merge_newest_wins, upsert, coverage,
    density_filter, station_enrich, rate_vocab, resample_hourly, resample_daily_bfill, interpolate_time,
    interpolate_position, align_start, resample_daily, head_n_per_series, skip_n_per_series, tail_n_per_series,
    holdout_split, ts_split, lag_features, stat_features, stat_features_lags_only, weekday_onehot, month_onehot,
    difference, difference_irregular, dedifference, rotate_left, target_shift, horizon_explode, minmax_scale,
    minmax_rescale, scaled_sequences, other_series_features, feature_gate, todo_anti_join, with_results_semi_join,
    run_setups, run_name_build, run_name_parse, report_name_build, params_roundtrip, score_naive,
    score_seasonal_naive, norm_scores, baseline_report, knn_uniform, knn_distance, knn_cv_best, knn_cv_best_absolute,
    linreg_one_feature,
    linreg_two_features, linreg_multi, tree, forest, holt_winters, holt_winters_stored, ar_forecast, fourier_forecast, param_grid_search,
    backtest_evaluate, backtest_predictions, asof_last_order, asof_next_purchase, merge_stored, stored_evaluation, stored_results, incremental_ingest, stored_dense,
    station_files, evaluation_files)}
QUERIES |= {f"report_q{i}_{name}": _report(name) for i, name in enumerate(reports.REPORTS, start=1)}
