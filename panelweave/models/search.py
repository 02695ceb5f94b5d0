"""Parameter search: candidate grids, cross-validation folds and the choice of the best candidate."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.models.neighbours import MAX_NEIGHBOURS, nearest_rows, neighbour_value
from panelweave.models.regression import least_squares, linear_value
from panelweave.operators.blocks import spread_join
from panelweave.operators.series import time_series_split
from panelweave.schemas import RUN

# Number of random draws, folds, and the candidate ranges of the searches. None is "model default".
DRAWS = 20
FOLDS = 3
GRIDS: dict[str, dict[str, list]] = {
    "knn": {"n_neighbors": list(range(2, 51, 2)), "weights": ["uniform", "distance"]},
    "decision_tree": {"max_depth": list(range(3, 26, 2))},
    "random_forest": {"n_estimators": list(range(5, 126, 5)), "max_depth": [None, 5, 10, 20]},
    "linear_regression": {"normalize": [True, False]},
}


def candidates(model: str, draws: int | None = None, seed: int = 0) -> list[dict]:
    """All combinations of a model's grid, or a reproducible random sample of them."""
    grid = GRIDS[model]
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    if draws is None or draws >= len(combos):
        return combos
    return random.Random(seed).sample(combos, draws)


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def params_literal(params: dict) -> Column:
    """Parameters as a string map; a parameter left at its default is absent."""
    pairs = [F.lit(x) for k, v in params.items() if v is not None for x in (k, _text(v))]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")


def best_params(scored: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """From ``params, fold, score`` the candidate with the largest mean score over the folds."""
    means = scored.withColumn("_p", F.to_json("params")).groupBy(*keys, "_p").agg(F.avg("score").alias("score"))
    best = means.groupBy(*keys).agg(F.max_by(F.struct("_p", "score"), F.struct("score", "_p")).alias("_b"))
    return best.select(*keys, F.from_json("_b._p", "map<string,string>").alias("params"), F.col("_b.score").alias("score"))


def squared_error(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) * (actual - predicted)


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def knn_search(rows: DataFrame, draws: int | None = DRAWS, folds: int = FOLDS, seed: int = 0,
               keys: Sequence[str] = RUN, loss: Callable[[Column, Column], Column] = squared_error) -> DataFrame:
    """Best neighbour count and weighting per run by the mean of ``loss``. One ranking up to the largest k scores every candidate."""
    keys = list(keys)
    split = time_series_split(rows, folds, keys)
    near = nearest_rows(split.filter("in_train"), split.filter("in_test").select(*keys, "fold", "slot", "features", "label"),
                        [*keys, "fold"], MAX_NEIGHBOURS)

    def missed(params: dict) -> Column:
        return loss(F.col("label"), neighbour_value("near", F.lit(params["n_neighbors"]), F.lit(params["weights"])))

    tried = candidates("knn", draws, seed)
    # One aggregate per candidate: rows are not multiplied by the candidates.
    means = near.groupBy(*keys, "fold").agg(*[(-F.avg(missed(p))).alias(f"c{i}") for i, p in enumerate(tried)])
    scored = means.select(*keys, "fold", F.inline(F.array(*[
        F.struct(params_literal(p).alias("params"), F.col(f"c{i}").alias("score")) for i, p in enumerate(tried)])))
    return best_params(scored, keys)


def linear_search(rows: DataFrame, folds: int = FOLDS, keys: Sequence[str] = RUN,
                  loss: Callable[[Column, Column], Column] = squared_error) -> DataFrame:
    """Cross-validated score of linear regression by the mean of ``loss``.

    Normalising inputs does not change its forecasts, so both candidates score alike and the first is taken.
    """
    keys = list(keys)
    fold_keys = [*keys, "fold"]
    split = time_series_split(rows, folds, keys)
    coef = least_squares(split.filter("in_train"), fold_keys).select(*fold_keys, "intercept", "coef")
    test = spread_join(split.filter("in_test"), coef, fold_keys, spread=("slot",))
    scored = test.groupBy(*fold_keys).agg((-F.avg(loss(F.col("label"), linear_value()))).alias("score"))
    return best_params(scored.withColumn("params", params_literal({"normalize": True})), keys)
