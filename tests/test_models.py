import math
from datetime import datetime, timedelta

import numpy as np
import plain_models
import pytest
from pyspark.sql import functions as F

from panelweave.models import autoregression, fitting, fourier, neighbours, regression, search, smoothing, supervised, trees
from panelweave.operators.blocks import with_grid_slot
from panelweave.operators.series import SEASON
from panelweave.plans import backtest
from panelweave.schemas import EVAL_COLUMNS, RUN, SERIES

N = 120


def signal(n, seed):
    rng = np.random.default_rng(seed)
    return [50 + 10 * math.sin(2 * math.pi * i / 24) + 0.05 * i + v for i, v in enumerate(rng.normal(0, 2, n))]


@pytest.fixture(scope="module")
def grid(spark):
    rows = [("S1", "H", p, datetime(2020, 1, 1) + timedelta(hours=i), float(v))
            for seed, p in enumerate("abc") for i, v in enumerate(signal(N, seed))]
    df = spark.createDataFrame(rows, "station string, rate string, pollutant string, ts timestamp, value double")
    return with_grid_slot(df).cache()


def expected_rows(values, horizon, differenced=False):
    """Features, label and holdout flag by plain arithmetic."""
    v = np.diff(values) if differenced else np.asarray(values)
    out = []
    for i in range(24, len(v) - horizon):
        lags = v[i - 23:i + 1][::-1]
        total = lags.sum()
        mean = 2 * total / 25
        out.append(([*lags, total, mean, float(np.median([*lags, total, mean]))], v[i + horizon]))
    return out


@pytest.mark.parametrize("differenced", [False, True])
@pytest.mark.parametrize("block", [30, 8760])
def test_artificial_rows(grid, differenced, block):
    out = supervised.artificial_rows(grid, "H", [1, 3], differenced, block_slots=block).filter("pollutant = 'b' and distance = 3")
    rows = out.orderBy("slot").collect()
    expected = expected_rows(signal(N, 1), 3, differenced)
    assert len(rows) == len(expected)
    assert np.allclose([r.features for r in rows], [e[0] for e in expected])
    assert np.allclose([r.label for r in rows], [e[1] for e in expected])
    assert [r.is_holdout for r in rows] == [False] * (len(rows) - 24) + [True] * 24


def test_direct_rows_need_two_others(grid):
    rows = supervised.direct_rows(grid, "H", [2]).filter("pollutant = 'a'").orderBy("slot").collect()
    assert len(rows) == N - 24 - 2 and len(rows[0].features) == 2
    assert rows[0].features[0] == pytest.approx(signal(N, 1)[24]) and rows[0].label == pytest.approx(signal(N, 0)[26])
    assert supervised.direct_rows(grid.filter("pollutant <> 'a'"), "H", [2]).count() == 0


@pytest.mark.parametrize("block", [20, 8760])
def test_least_squares_has_minimal_norm(grid, block):
    rows = supervised.artificial_rows(grid, "H", [1], block_slots=block).filter("pollutant = 'a' and not is_holdout")
    fit = regression.least_squares(rows, RUN).first()
    local = rows.orderBy("slot").collect()
    x, y = np.array([r.features for r in local]), np.array([r.label for r in local])
    centred = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
    assert np.allclose(fit.coef, centred, atol=1e-6)
    assert fit.intercept == pytest.approx(y.mean() - x.mean(0) @ centred, abs=1e-5)
    assert fit.n == len(y)


@pytest.mark.parametrize("block", [25, 8760])
def test_neighbours_match_brute_force(grid, block):
    rows = supervised.artificial_rows(grid, "H", [1], block_slots=block).filter("pollutant = 'c'")
    near = neighbours.nearest_rows(rows.filter("not is_holdout"), rows.filter("is_holdout"), RUN, 7)
    out = near.select("slot", *[neighbours.neighbour_value("near", F.lit(7), F.lit(w)).alias(w) for w in ("uniform", "distance")])
    found = {r.slot: r for r in out.collect()}
    local = rows.orderBy("slot").collect()
    train = [r for r in local if not r.is_holdout]
    for q in (r for r in local if r.is_holdout):
        ranked = sorted((math.dist(q.features, r.features), r.slot, r.label) for r in train)[:7]
        assert found[q.slot].uniform == pytest.approx(np.mean([r[2] for r in ranked]))
        weights = [1 / r[0] for r in ranked]
        assert found[q.slot].distance == pytest.approx(np.average([r[2] for r in ranked], weights=weights))


def test_exact_hits_count_alone(spark):
    df = spark.createDataFrame([([(0.0, 1, 4.0), (0.0, 2, 6.0), (1.0, 3, 90.0)],)], "near array<struct<d:double,s:long,y:double>>")
    row = df.select(neighbours.neighbour_value("near", F.lit(3), F.lit("distance")).alias("d"),
                    neighbours.neighbour_value("near", F.lit(2), F.lit("uniform")).alias("u")).first()
    assert (row.d, row.u) == (5.0, 5.0)


def test_candidates():
    assert len(search.candidates("knn")) == 50 and len(search.candidates("knn", 20)) == 20
    assert search.candidates("knn", 20, 1) == search.candidates("knn", 20, 1)
    assert len(search.candidates("random_forest")) == 100 and len(search.candidates("decision_tree")) == 12


def test_smoothing_recursion_against_plain_loop():
    y, m, w, phi = np.array(signal(72, 5)), 24, (0.3, 0.1, 0.2), 0.97
    sse, ahead = plain_models.smooth(y, m, 5, np.array([w]), phi)
    a, b, g = w
    level, slope = y[:m].mean(), (y[m:2 * m].mean() - y[:m].mean()) / m
    season, total = list(y[:m] - y[:m].mean()), 0.0
    for i in range(m, len(y)):
        base, s = level + phi * slope, season[i % m]
        total += (y[i] - base - s) ** 2
        new = a * (y[i] - s) + (1 - a) * base
        slope = b * (new - level) + (1 - b) * phi * slope
        season[i % m] = g * (y[i] - new) + (1 - g) * s
        level = new
    assert sse[0] == pytest.approx(total)
    assert ahead[0][1] == pytest.approx(level + (phi + phi ** 2) * slope + season[(len(y) + 1) % m])


def test_smoothing_beats_the_mean_and_boxcox_inverts():
    y = np.array(signal(144, 3))
    params, forecast, mse = plain_models.holt_winters(y[:-24], y[-24:], 24)
    assert mse < np.var(y[-24:])
    assert np.allclose(plain_models.with_params(y[:-24], 24, 24, params | {"use_boxcox": params["use_boxcox"]}), forecast)
    for power in smoothing.POWERS:
        assert np.allclose(smoothing.inverse_boxcox(smoothing.boxcox(y, power), power), y)


RUN_SCHEMA = ("station string, rate string, pollutant string, distance int, differenced boolean, direct boolean, artificial boolean, "
              "slot long, value double, is_holdout boolean")


def runs(spark, series):
    """Rows of runs from ``{name: (rate, first slot, values)}``; the last season is held out."""
    rows = [("S", rate, name, SEASON[rate], False, False, False, first + i, float(v), i >= len(values) - SEASON[rate])
            for name, (rate, first, values) in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RUN_SCHEMA)


@pytest.mark.parametrize("block, fanout", [(10, 2), (37, 3), (8760, 64)])
def test_smoothing_over_blocks_equals_the_plain_loop(spark, block, fanout):
    """Any cut of a series, at any phase and also before the epoch, gives the loop's parameters and forecast."""
    series = {"a": ("H", 5, signal(200, 1)), "b": ("D", -31, signal(90, 2)), "c": ("D", 3, [v - 55 for v in signal(75, 3)]), "d": ("H", 100, signal(60, 4)),
              "e": ("D", 0, [40 + 3 * (i % 7) for i in range(60)])}
    out = smoothing.forecast(runs(spark, series), RUN, block_slots=block, fanout=fanout).collect()
    for name, (rate, _, values) in series.items():
        found, m = sorted((r for r in out if r.pollutant == name), key=lambda r: r.step or 0), SEASON[rate]
        if name == "d":
            assert [r.error for r in found] == ["needs two full seasons"] and found[0].step is None
            continue
        y = np.array(values)
        params, ahead, _ = plain_models.holt_winters(y[:-m], y[-m:], m)
        assert [r.step for r in found] == list(range(m)) and np.allclose([r.predicted for r in found], ahead, atol=1e-6)
        if name != "e":  # a series without noise is fitted exactly by many
            assert {k: float(v) if k != "use_boxcox" else v for k, v in found[0].params.items()} == pytest.approx(params)


def test_smoothing_with_stored_parameters_over_blocks(spark):
    series = {"a": ("D", 11, signal(100, 6)), "b": ("D", 4, [v - 55 for v in signal(80, 7)])}
    for scaled in ("true", "false"):
        params = {"smoothing_level": "0.2", "smoothing_slope": "0.05", "smoothing_seasonal": "0.5", "damping_slope": "0.97", "use_boxcox": scaled}
        params |= {"lamda": "0.25"} if scaled == "true" else {}
        rows = runs(spark, series).withColumn("params", F.create_map(*[F.lit(x) for pair in params.items() for x in pair]))
        out = smoothing.forecast(rows, RUN, block_slots=20, fanout=2).collect()
        for name, (_, _, values) in series.items():
            found = sorted((r for r in out if r.pollutant == name), key=lambda r: r.step or 0)
            if scaled == "true" and name == "b":
                assert [r.error for r in found] == ["Box-Cox needs positive values"]
            else:
                assert np.allclose([r.predicted for r in found], plain_models.with_params(np.array(values[:-7]), 7, 7, params), atol=1e-8) and found[0].params == params


def test_smoothing_without_rows(spark):
    assert smoothing.forecast(runs(spark, {"a": ("D", 0, signal(30, 1))}).filter(F.lit(False)), RUN).collect() == []


def test_maps_compose():
    """The matrix of a stretch is the product of the matrices of its parts, from any phase."""
    setup = smoothing.setup_of(None, 0.5)
    whole = smoothing.matrices(setup, 7, 45, 3)
    assert np.allclose(whole, smoothing.matrices(setup, 7, 26, 3 + 19) @ smoothing.matrices(setup, 7, 19, 3))


def test_autoregression_recovers_a_known_process(spark):
    v = [10.0, 12.0]
    rng = np.random.default_rng(1)
    for _ in range(300):
        v.append(2 + 0.5 * v[-1] + 0.3 * v[-2] + rng.normal(0, 0.01))
    rows = [("S", "D", "a", 7, False, False, False, datetime(2020, 1, 1) + timedelta(days=i), float(x), i >= len(v) - 7) for i, x in enumerate(v)]
    df = with_grid_slot(spark.createDataFrame(rows, "station string, rate string, pollutant string, distance int, differenced boolean,"
                                                    "direct boolean, artificial boolean, ts timestamp, value double, is_holdout boolean"))
    orders = df.select(*RUN).distinct().withColumn("order", F.lit("(2, 0, 0)"))
    for block in (50, 8760):
        out = autoregression.forecast(df, RUN, orders, block_slots=block).first()
        train = np.array(v[:-7])
        x = np.column_stack([np.ones(len(train) - 2 - 14), train[15:-1], train[14:-2]])
        c = np.linalg.lstsq(x, train[16:], rcond=None)[0]
        past = list(train)
        for _ in range(7):
            past.append(c @ [1, past[-1], past[-2]])
        assert out.params == {"order": "(2, 0, 0)"}
        assert np.allclose(out.ahead, past[-7:], atol=1e-9)
    best = autoregression.forecast(df, RUN).first()
    assert np.mean((np.array(best.ahead) - v[-7:]) ** 2) <= np.mean((np.array(out.ahead) - v[-7:]) ** 2) + 1e-12


def test_fourier_fits_its_own_curve(spark, grid):
    rows = backtest.timebased_rows(grid.withColumn("value", F.sin(F.unix_seconds("ts") * (2 * math.pi / 86400)) + F.unix_seconds("ts") / 1e6), "H", [False])
    out = fourier.forecast(rows, "H", RUN)
    assert out.agg(F.max(F.abs(F.col("predicted") - F.col("value")))).first()[0] < 1e-4


def test_hook_skips_failures_and_series_over_a_limit(grid):
    def fit(pdf):
        if pdf["pollutant"].iloc[0] == "b":
            raise ValueError("not stationary")
        return {"k": 1}, [pdf["value"].mean()], 0.1, 0.2

    out = fitting.fit_predict_per_series(grid, fit, SERIES).cache()
    assert {r.pollutant for r in fitting.forecasts(out).collect()} == {"a", "c"}
    assert [(r.pollutant, r.error) for r in fitting.failures(out).collect()] == [("b", "not stationary")]
    limited = fitting.failures(fitting.fit_predict_per_series(grid, fit, SERIES, max_rows=10)).collect()
    assert len(limited) == 3 and all("exceeds the limit" in r.error for r in limited)


def test_trees_learn(grid):
    rows = supervised.artificial_rows(grid, "H", [1])
    for model in ("decision_tree", "random_forest"):
        out = trees.tree_forecast(rows, model, params={"max_depth": 4, "n_estimators": 5})
        row = out.agg(F.count("predicted").alias("n"), F.avg((F.col("label") - F.col("predicted")) ** 2).alias("mse"),
                      F.var_pop("label").alias("var")).first()
        assert row.n == 3 * SEASON["H"] and row.mse < row["var"]


@pytest.mark.parametrize("cell_rows", [8760, 40, 7])
def test_pruned_neighbours_equal_all_pairs(spark, cell_rows):
    """Clusters, ties, repeated rows, fewer rows than neighbours, one crowded cell; far fewer pairs than all of them."""
    rng = np.random.default_rng(2)
    sizes, k = {"a": 600, "b": 130, "c": 3}, 5
    train, asked, data = [], [], {}
    for name, n in sizes.items():
        x = np.round(rng.normal(0, 1, (n, 2)) + 30 * rng.integers(0, 6, (n, 1)), 1)
        x[: n // 3] = x[0]  # one point holds a third of the rows
        data[name] = x
        train += [("S", name, i // 50, i, x[i].tolist(), float(i)) for i in range(n)]
        q = np.vstack([x[rng.integers(0, n, 60)] + np.round(rng.normal(0, 0.3, (60, 2)), 1), [[1000.0, -5.0]]])
        asked += [("S", name, 10_000 + i, q[i].tolist()) for i in range(len(q))]
    rows = spark.createDataFrame(train, "station string, pollutant string, block long, slot long, features array<double>, label double")
    queries = spark.createDataFrame(asked, "station string, pollutant string, slot long, features array<double>")
    found = {(r.pollutant, r.slot): r for r in neighbours.nearest_rows(rows, queries, ["station", "pollutant"], k, cell_rows).collect()}
    assert len(found) == len(asked)
    for _, name, slot, q in asked:
        d = np.sqrt(((data[name] - np.array(q)) ** 2).sum(axis=1))
        best = sorted(zip(d, range(len(d))))[:k]
        got = found[name, slot].near
        assert [c.s for c in got] == [i for _, i in best] and np.allclose([c.d for c in got], [v for v, _ in best])
    compared, pairs = sum(r.compared for r in found.values()), sum(61 * n for n in sizes.values())
    assert compared == pairs if cell_rows == 8760 else compared < (0.5 if cell_rows == 7 else 0.7) * pairs


def tree_rows(spark):
    rng = np.random.default_rng(9)
    rows = []
    for name, n in (("a", 160), ("b", 70), ("c", 9)):
        x = np.round(rng.normal(0, 3, (n, 3)), 1)
        x[:, 2] = rng.integers(0, 2, n)
        y = np.where(x[:, 0] > 0, 5 + x[:, 1], -3.0) + x[:, 2] + rng.normal(0, 0.3, n)
        rows += [("S", "H", name, 1, False, True, False, datetime(2020, 1, 1) + timedelta(hours=i), i, x[i].tolist(), float(y[i]), i >= n - 5) for i in range(n)]
    return spark.createDataFrame(rows, "station string, rate string, pollutant string, distance int, differenced boolean, direct boolean, artificial boolean, "
                                       "ts timestamp, slot long, features array<double>, label double, is_holdout boolean")


def plain_tree_forecasts(df, depth, tree=None):
    """The plain tree of each run on the same bins."""
    out = {}
    ready = trees.prepared(df, ~F.col("is_holdout"), RUN, None if tree is None else F.lit(tree), 0).collect()
    for name in {r.pollutant for r in ready}:
        for t in range(tree or 1):
            mine = [r for r in ready if r.pollutant == name and (tree is None or r.tree == t)]
            learn = [r for r in mine if r.train]
            model = plain_models.tree([r.bins for r in learn], [r.label for r in learn], [r.w for r in learn], depth)
            for r in mine:
                if not r.train:
                    out.setdefault((name, r.slot), []).append(model(r.bins))
    return {k: np.mean(v) for k, v in out.items()}


def test_trees_of_all_runs_equal_plain_trees(spark):
    df = tree_rows(spark)
    for depth in (0, 1, 4, 30):
        found = {(r.pollutant, r.slot): r.predicted for r in trees.tree_forecast(df, "decision_tree", params={"max_depth": str(depth)} if depth else {"max_depth": "0"}).collect()}
        assert found == pytest.approx(plain_tree_forecasts(df, depth)) and len(found) == 15
    found = {(r.pollutant, r.slot): r.predicted for r in trees.tree_forecast(df, "random_forest", params={"max_depth": 3, "n_estimators": 4}).collect()}
    assert found == pytest.approx(plain_tree_forecasts(df, 3, 4))


def test_tree_search_scores_every_depth(spark):
    """One growth gives the scores that a tree of each depth would get, and each run keeps its own best."""
    df = tree_rows(spark).filter("pollutant <> 'c'")
    tried = [{"max_depth": d} for d in (1, 3, 6)]
    found = {r.pollutant: (r.params, r.score) for r in trees.tree_search(df, "decision_tree", tried).collect()}
    split = search.time_series_split(df, search.FOLDS, RUN).withColumn("is_holdout", F.col("in_test"))
    for name in ("a", "b"):
        scores = {}
        for p in tried:
            errors = []
            for fold in range(search.FOLDS):
                part = split.filter((F.col("fold") == fold) & (F.col("pollutant") == name) & (F.col("in_train") | F.col("in_test"))).drop("fold")
                actual = {(r.pollutant, r.slot): r.label for r in part.filter("in_test").collect()}
                errors.append(-np.mean([(actual[k] - v) ** 2 for k, v in plain_tree_forecasts(part, p["max_depth"]).items()]))
            scores[str(p["max_depth"])] = np.mean(errors)
        best = max(scores, key=scores.get)
        assert found[name][0] == {"max_depth": best} and found[name][1] == pytest.approx(scores[best])


def test_trees_without_rows(grid):
    rows = supervised.artificial_rows(grid, "D", [1])
    assert trees.tree_search(rows, "decision_tree").count() == 0
    assert trees.tree_forecast(rows, "random_forest").count() == 0


def test_search_and_evaluation_end_to_end(spark, grid):
    models = ["knn", "decision_tree", "ets", "prophet"]
    horizons = {"H": [1], "D": [1]}
    one = grid.filter("pollutant = 'a'")
    results = backtest.estimate(one, models, horizons, rates=["H"], direct_set=False,
                                tree_candidates={"decision_tree": [{"max_depth": 2}, {"max_depth": 3}]}).cache()
    assert results.count() == 2 * len(models)
    table, predictions = backtest.evaluate(one, results, models, horizons, rates=["H"], direct_set=False)
    assert table.columns == EVAL_COLUMNS and table.count() == 2 * len(models)
    assert predictions.groupBy(*RUN, "model").agg(F.count("*").alias("n"), F.max("step").alias("s")).filter(
        "n <> 24 or s <> 23").count() == 0
    scored = {(r.model, r.differenced): r for r in table.collect()}
    kept = {(r.model, r.differenced): r for r in results.collect()}
    for model in ("ets", "prophet"):
        assert scored[model, False].mean_squared_error == pytest.approx(kept[model, False].score)
    # Work that is done is not done again.
    left = backtest.estimate(one, ["prophet"], horizons, done=results, rates=["H"])
    assert left.count() == 0
    again, _ = backtest.evaluate(one, results, ["prophet"], horizons, done=table, rates=["H"])
    assert again.count() == 0
