"""Decision trees and random forests, one model per run, all runs grown side by side.

Features are binned by the run's own quantiles once. Then every level of all trees is one aggregation: counts and sums of
the label per (run, node, feature, bin), combined before they are exchanged, whose running sums give the gain of every cut.
The best cut of each node is joined back to its rows, which move on to the children; rows to be forecast move along and
take the mean of the node in which they end. A run is never one task, and no tree is ever held by one.

A tree cut off at a depth is the same tree grown to that depth only, so the search grows the deepest candidate once and
scores every depth on the way. A forest grows its trees under one more key, on rows weighted by a hash.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.models.search import DRAWS, FOLDS, best_params, candidates, params_literal
from panelweave.operators.blocks import spread_join
from panelweave.operators.series import time_series_split
from panelweave.schemas import RUN
from panelweave.session import cut_lineage

#: Bins per feature; depth and trees where a model has no limit of its own; share of a node's squared error that a cut must take.
BINS, DEEPEST, TREES, LEAST_GAIN = 32, 30, 10, 1e-9


def cut_points(train: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """Per run and feature the distinct quantiles that part its values into bins: ``keys, cuts``."""
    width = train.agg(F.max(F.size("features"))).first()[0] or 0
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    return train.groupBy(*keys).agg(F.array(*[
        F.array_distinct(F.percentile_approx(F.get("features", F.lit(i)), shares, F.lit(10_000))) for i in range(width)]).cast("array<array<double>>").alias("cuts"))


def binned(rows: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace ``features`` by ``bins``: how many cuts of its feature each value passes."""
    cells = F.arrays_zip(F.col("features").alias("v"), F.slice("cuts", F.lit(1), F.size("features")).alias("c"))
    passed = F.transform(cells, lambda cell: F.size(F.filter(cell["c"], lambda x: x < cell["v"])))
    return spread_join(rows, cuts, keys, spread=("slot",)).withColumn("bins", passed).drop("features", "cuts")


def best_cuts(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per node its ``mean`` and best cut (``feature``, ``at``: bins up to it go left), NULL where no cut gains.

    Of equal gains the first feature, then the first cut is taken; gains are compared as shares of the node's squared
    error, rounded, so that the order of summation does not decide.
    """
    node = [*keys, "node"]
    cells = train.select(*node, "w", "label", F.posexplode("bins").alias("feature", "bin"))
    histogram = cells.groupBy(*node, "feature", "bin").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("s"), F.sum(F.col("w") * F.col("label") * F.col("label")).alias("q"))
    whole = Window.partitionBy(*node, "feature")
    left = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most the bins of a feature
    sums = histogram.select(*node, "feature", "bin", *[F.sum(c).over(w).alias(name) for c, w, name in (
        ("n", left, "nl"), ("s", left, "sl"), ("n", whole, "n"), ("s", whole, "s"), ("q", whole, "q"))])
    error = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    right = F.col("n") - F.col("nl")
    gain = F.when(right > 0, F.col("sl") * F.col("sl") / F.col("nl") + (F.col("s") - F.col("sl")) * (F.col("s") - F.col("sl")) / right - F.col("s") * F.col("s") / F.col("n"))
    share = F.when(error > 1e-12 * F.col("q"), F.round(gain / error, 9))
    cut = F.when(share >= LEAST_GAIN, F.struct(share.alias("share"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    best = sums.groupBy(*node).agg(F.max(cut).alias("_cut"), F.max(F.col("s") / F.col("n")).alias("mean"))
    return best.select(*node, "mean", (-F.col("_cut.f")).alias("feature"), (-F.col("_cut.b")).alias("at"))


def grow(rows: DataFrame, keys: Sequence[str], deepest: int):
    """Grow all trees level by level; yields (level, rows to forecast with ``mean`` of their node and whether they are ``done``).

    ``rows`` has ``keys, slot, label, bins, w, train, depth`` and any other columns. Rows to forecast have ``train`` false; those
    that are done at a level keep its mean.
    """
    keys = list(keys)
    active = cut_lineage(rows.withColumn("node", F.lit(1).cast("long")))
    for level in range(deepest + 1):
        cuts = best_cuts(active.filter("train"), keys)
        # All rows of a run are in one node at first, so the join does not trust its key.
        known = spread_join(active, cuts, [*keys, "node"], spread=("slot",))
        done = F.col("feature").isNull() | (F.col("depth") <= level)
        child = 2 * F.col("node") + (F.get("bins", F.col("feature")) > F.col("at")).cast("long")
        known = cut_lineage(known.withColumn("done", done).withColumn("node", F.when(~done, child).otherwise(F.col("node"))).drop("feature", "at"))
        yield level, known.filter(~F.col("train")).drop("bins", "w", "train")
        active = known.filter(~F.col("done")).drop("done", "mean")
        if level == deepest or active.isEmpty():
            return


def bag_weight(tree: Column, slot: Column, seed: int) -> Column:
    """How often a row is in a tree's sample: Poisson with mean 1, from a hash."""
    share = F.pmod(F.xxhash64(tree, slot, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    total, weight = 0.0, F.lit(8)
    bounds = []
    for k in range(8):
        total += exp(-1) / factorial(k)
        bounds.append(total)
    for k in reversed(range(8)):
        weight = F.when(share < bounds[k], k).otherwise(weight)
    return weight.cast("long")


def prepared(rows: DataFrame, train: Column, keys: Sequence[str], trees: Column | None, seed: int) -> DataFrame:
    """Binned rows with ``train`` and ``w``; for a forest once per tree that holds the row, under the key ``tree``."""
    cuts = cut_points(rows.filter(train), keys)
    out = binned(rows.withColumn("train", train), cuts, keys)
    if trees is None:
        return out.withColumn("w", F.lit(1).cast("long"))
    out = cut_lineage(out).withColumn("tree", F.explode(F.sequence(F.lit(0), trees - 1)))
    out = out.withColumn("w", F.when(F.col("train"), bag_weight(F.col("tree"), F.col("slot"), seed)).otherwise(F.lit(1).cast("long")))
    return out.filter("w > 0")


def _depth(params: Column) -> Column:
    return F.coalesce(F.try_element_at(params, F.lit("max_depth")).cast("int"), F.lit(DEEPEST))


def _trees(params: Column) -> Column:
    return F.coalesce(F.try_element_at(params, F.lit("n_estimators")).cast("int"), F.lit(TREES))


def tree_search(rows: DataFrame, model: str, tried: Sequence[dict] | None = None, folds: int = FOLDS, seed: int = 0,
                keys: Sequence[str] = RUN) -> DataFrame:
    """Best parameters per run by the mean negative squared error over time-ordered folds.

    One growth per fold serves all candidates: a shallower tree is the beginning of a deeper one, and a smaller forest the
    first trees of a larger one.
    """
    keys = list(keys)
    if tried is None:
        tried = candidates(model, DRAWS, seed) if model == "random_forest" else candidates(model)
    forest = model == "random_forest"
    depths = [int(p.get("max_depth") or DEEPEST) for p in tried]
    sizes = [int(p.get("n_estimators") or TREES) for p in tried]
    split = cut_lineage(time_series_split(rows, folds, keys).filter("in_train or in_test"))
    fold_keys = [*keys, "fold"]
    ready = prepared(split.select(*fold_keys, "slot", "features", "label", "in_train"), F.col("in_train"), fold_keys, F.lit(max(sizes)) if forest else None, seed)
    each = [*fold_keys, *(["tree"] if forest else [])]
    levels = []
    for level, part in grow(ready.drop("in_train").withColumn("depth", F.lit(max(depths))), each, max(depths)):
        levels.append(part.select(*each, "slot", "label", F.lit(level).alias("level"), "mean", "done"))
    if not levels:
        return best_params(split.select(*keys, "fold", params_literal({}).alias("params"), F.lit(0.0).alias("score")), keys)
    seen = cut_lineage(reduce(DataFrame.unionByName, levels))
    # The forecast at a depth: the mean at that level, or where the row was done before.
    wanted = sorted(set(depths))
    last = seen.groupBy(*each, "slot").agg(F.any_value("label").alias("label"), *[
        F.max_by("mean", F.when(F.col("level") <= d, F.col("level"))).alias(f"d{d}") for d in wanted])
    tree = F.col("tree") if forest else F.lit(0)
    rows_of = last.groupBy(*fold_keys, "slot").agg(F.any_value("label").alias("label"), *[
        F.avg(F.when(tree < n, F.col(f"d{d}"))).alias(f"p{i}") for i, (d, n) in enumerate(zip(depths, sizes))])
    means = rows_of.groupBy(*fold_keys).agg(*[(-F.avg((F.col("label") - F.col(f"p{i}")) ** 2)).alias(f"c{i}") for i in range(len(tried))])
    scored = means.select(*fold_keys, F.inline(F.array(*[F.struct(params_literal(p).alias("params"), F.col(f"c{i}").alias("score")) for i, p in enumerate(tried)])))
    return best_params(scored, keys)


def tree_forecast(rows: DataFrame, model: str, results: DataFrame | None = None, params: dict | None = None,
                  keys: Sequence[str] = RUN, seed: int = 0) -> DataFrame:
    """Holdout rows with ``predicted``, ``params`` and ``fit_time`` (wall time of the growth of all runs together).

    With ``results`` each run grows to its own depth and, in a forest, has its own number of trees.
    """
    keys, forest = list(keys), model == "random_forest"
    rows = rows.select(*keys, "ts", "slot", "features", "label", "is_holdout")
    if results is None:
        rows = rows.withColumn("params", params_literal(params or {}))
    else:
        rows = spread_join(rows, results.filter(F.col("model") == model).select(*keys, "params"), keys, spread=("slot",))
    rows = cut_lineage(rows.withColumn("depth", _depth(F.col("params"))))
    deepest = rows.agg(F.max("depth")).first()[0]
    nothing = rows.limit(0).select(*keys, "ts", "slot", "label", F.lit(0.0).alias("predicted"), F.lit(0.0).alias("fit_time"), "params")
    if deepest is None:
        return nothing
    start = time.perf_counter()
    ready = prepared(rows, ~F.col("is_holdout"), keys, _trees(F.col("params")) if forest else None, seed)
    parts = [part.filter("done") for _, part in grow(ready.drop("is_holdout"), [*keys, *(["tree"] if forest else [])], deepest)]
    found = reduce(DataFrame.unionByName, parts, parts.pop(0))
    out = found.groupBy(*keys, "ts", "slot").agg(F.any_value("label").alias("label"), F.avg("mean").alias("predicted"), F.any_value("params").alias("params"))
    return out.withColumn("fit_time", F.lit(time.perf_counter() - start)).select(nothing.columns)
