"""k-nearest-neighbours regression within each run, exact.

A part of the training rows ranks its own ``k`` best rows per query; only those travel on. Pairs of rows exist inside a
task's distance matrix alone. Long runs are partitioned by pivots, and the triangle inequality keeps queries away from
cells that cannot hold a nearer row.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.models.regression import _schema_of
from panelweave.operators.blocks import BLOCK_SLOTS, block_of, spread_join
from panelweave.session import cut_lineage

MAX_NEIGHBOURS = 50
#: Rows of a run that are ranked without cells, rows of a cell or queries that a task holds; most pivots of a run.
CELL_ROWS, MOST_PIVOTS = BLOCK_SLOTS, 256
_CHUNK = 256


def _nearest(train: pd.DataFrame, queries: pd.DataFrame, k: int):
    """Distances, slots and labels of the k nearest training rows of each query; ties go to the earlier row."""
    train = train.sort_values("slot")
    x = np.vstack(train["features"].to_numpy()).astype(float)
    y, slots = train["label"].to_numpy(dtype=float), train["slot"].to_numpy()
    q = np.vstack(queries["query"].to_numpy()).astype(float)
    k = min(k, len(y))
    for start in range(0, len(q), _CHUNK):
        part = q[start:start + _CHUNK]
        dist = np.zeros((len(part), len(x)))
        for f in range(x.shape[1]):
            dist += (part[:, f, None] - x[None, :, f]) ** 2
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
        for row, limit in zip(dist, kth):
            near = np.flatnonzero(row <= limit)
            near = near[np.argsort(row[near], kind="stable")][:k]
            yield np.sqrt(row[near]), slots[near], y[near]


def _ranked(left: pd.DataFrame, right: pd.DataFrame, keys: list[str], k: int, names: list[str]) -> pd.DataFrame:
    """The k nearest of the rows ``left`` for every query of ``right``; with a ``bound`` only those up to it."""
    if left.empty or right.empty:
        return pd.DataFrame(columns=names)
    start = time.process_time()
    out = right[[*keys, "query_slot"]].copy()
    d, s, y = zip(*_nearest(left, right, k))
    if "bound" in right:
        close = [np.asarray(x) <= b for x, b in zip(d, right["bound"])]
        d, s, y = ([x[c] for x, c in zip(part, close)] for part in (d, s, y))
    out["d"], out["s"], out["y"], out["compared"] = list(d), list(s), list(y), len(left)
    out["cpu"] = (time.process_time() - start) / len(out)
    return out[names]


_FOUND = "d array<double>, s array<long>, y array<double>, compared long, cpu double"


def _merged(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Per query the k best over all parts, the training rows held against it and CPU time."""
    cells = F.arrays_zip("d", "s", "y")
    return found.groupBy(*keys, "query_slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list(cells))), 1, k).alias("near"),
                                                  F.sum("compared").alias("compared"), F.sum("cpu").alias("prediction_time"))


def nearest_rows(train: DataFrame, queries: DataFrame, keys: Sequence[str], k: int = MAX_NEIGHBOURS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per query row its ``near`` rows, an array of (distance, slot, label) in order of distance; ``compared`` rows were looked at.

    ``train`` has ``block, slot, features, label``; ``queries`` has ``slot, features`` and any other columns, which are kept.
    Runs of at most ``cell_rows`` rows are ranked whole, larger ones through the cells of :func:`pruned`; both are exact.
    """
    keys = list(keys)
    train = train.select(*keys, "block", "slot", "features", "label")
    asked = queries.select(*keys, F.col("slot").alias("query_slot"), F.col("features").alias("query"))
    largest = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    if largest <= cell_rows:
        asked = asked.join(train.select(*keys, "block").distinct(), keys)
        asked = asked.toDF(*asked.columns)  # fresh columns: both sides may stem from the same frame
        schema = _schema_of(asked, [*keys, "query_slot"], _FOUND)
        found = (train.groupBy(*keys, "block").cogroup(asked.groupBy(*keys, "block"))
                 .applyInPandas(lambda left, right: _ranked(left, right, keys, k, schema.names), schema))
    else:
        found = pruned(train, asked.toDF(*asked.columns), keys, k, cell_rows)
    return queries.drop("features").join(_merged(found, keys, k).withColumnRenamed("query_slot", "slot"), [*keys, "slot"])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(pivots)))
    for f in range(x.shape[1]):
        out += (x[:, f, None] - pivots[None, :, f]) ** 2
    return np.sqrt(out)


def pivots_of(train: DataFrame, keys: Sequence[str], cell_rows: int) -> DataFrame:
    """Some rows of each run, about one for every ``cell_rows`` and ``MOST_PIVOTS`` at most, chosen by hash: ``keys, pivots``."""
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("_n") / cell_rows)).cast("int")
    place = F.pmod(F.xxhash64("slot", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    drawn = spread_join(train, sizes, keys, spread=("slot",)).filter((place < 4 * wanted / F.col("_n")) | (F.col("_n") <= 4 * MOST_PIVOTS))
    best = F.slice(F.array_sort(F.collect_list(F.struct(place.alias("p"), "slot", "features"))), F.lit(1), F.max(wanted))  # a few times the pivots
    return drawn.groupBy(*keys).agg(F.transform(best, lambda r: r["features"]).alias("pivots"))


def pruned(train: DataFrame, asked: DataFrame, keys: list[str], k: int, cell_rows: int) -> DataFrame:
    """Exact nearest rows through a metric partition: parts of the answer, to be merged per query.

    Every training row belongs to the cell of its nearest pivot; a cell knows its radius. A query is first ranked in the
    cells nearest to it that together hold k rows, which bounds its k-th distance. By the triangle inequality nothing in
    a cell is nearer than the pivot's distance less the radius, so only cells below the bound are looked at then. Cells of more
    than ``cell_rows`` rows and crowds of queries are parted further, so no task holds more than that of either.
    """
    pivots = cut_lineage(pivots_of(train, keys, cell_rows))

    def placed(rows: DataFrame, part, extra: DataFrame, fn, schema) -> DataFrame:
        """Run ``fn`` on every part of the rows of a run together with the run's row of ``extra``."""
        rows = rows.withColumn("_part", part)
        facts = rows.select(*keys, "_part").distinct().join(extra, keys)
        facts = facts.toDF(*facts.columns)
        return rows.groupBy(*keys, "_part").cogroup(facts.groupBy(*keys, "_part")).applyInPandas(fn, schema)

    cell_schema = _schema_of(train, [*keys, "slot", "features", "label"], "cell int, reach double")

    def assign(rows: pd.DataFrame, fact: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or fact.empty:
            return pd.DataFrame(columns=cell_schema.names)
        d = _distances(np.vstack(rows["features"].to_numpy()).astype(float), np.vstack(list(fact["pivots"].iloc[0])).astype(float))
        out = rows[[*keys, "slot", "features", "label"]].copy()
        out["cell"] = d.argmin(axis=1).astype(np.int32)
        out["reach"] = d.min(axis=1)
        return out[cell_schema.names]

    rows = cut_lineage(placed(train, F.col("block"), pivots, assign, cell_schema))
    cells = rows.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("size"), F.max("reach").alias("radius"))
    cells = cut_lineage(cells.withColumn("subs", F.ceil(F.col("size") / cell_rows).cast("int")))
    facts = cut_lineage(pivots.join(cells.groupBy(*keys).agg(F.collect_list(F.struct("cell", "size", "radius")).alias("cells")), keys))  # as many as pivots

    def table(fact: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = sorted(fact["cells"].iloc[0], key=lambda c: c["cell"])
        number = np.array([c["cell"] for c in found])
        return number, np.array([c["size"] for c in found]), np.array([c["radius"] for c in found]), np.vstack(list(fact["pivots"].iloc[0])).astype(float)[number]

    visit_schema = _schema_of(asked, [*keys, "query_slot", "query"], "cell int, bound double")

    def visits(first: bool):
        def run(part: pd.DataFrame, fact: pd.DataFrame) -> pd.DataFrame:
            if part.empty or fact.empty:
                return pd.DataFrame(columns=visit_schema.names)
            number, size, radius, pivot = table(fact)
            d = _distances(np.vstack(part["query"].to_numpy()).astype(float), pivot)
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            home = np.zeros(d.shape, bool)
            np.put_along_axis(home, order, before < k, axis=1)  # the nearest cells until k rows are in sight
            if first:
                wanted, bound = home, np.full(len(part), np.inf)
            else:
                bound = part["bound"].to_numpy(dtype=float)
                wanted = ~home & (d - radius <= bound[:, None] + 1e-9 * (d + radius))
            row, at = np.nonzero(wanted)
            out = part[[*keys, "query_slot", "query"]].iloc[row].copy()
            out["cell"], out["bound"] = number[at].astype(np.int32), bound[row]
            return out[visit_schema.names]

        return run

    found_schema = _schema_of(asked, [*keys, "query_slot"], _FOUND)

    def ranked(visit: DataFrame) -> DataFrame:
        visit = cut_lineage(visit)
        crowds = visit.groupBy(*keys, "cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("crowds"))
        known = cells.join(crowds, [*keys, "cell"]).select(*keys, "cell", "subs", "crowds")
        sub, crowd = F.pmod(F.xxhash64("slot"), F.col("subs")).cast("int"), F.pmod(F.xxhash64("query_slot"), F.col("crowds")).cast("int")
        left = (spread_join(rows, known, [*keys, "cell"], spread=("slot",)).withColumn("sub", sub)
                .withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("subs", "crowds", "reach"))
        right = (spread_join(visit, known, [*keys, "cell"], spread=("query_slot",)).withColumn("crowd", crowd)
                 .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs", "crowds"))
        right = right.toDF(*right.columns)
        group = [*keys, "cell", "sub", "crowd"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(lambda a, b: _ranked(a, b, keys, k, found_schema.names), found_schema)

    part = block_of(F.col("query_slot"), cell_rows)
    begun = cut_lineage(ranked(placed(asked, part, facts, visits(True), visit_schema)))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k)
    bounds = begun.groupBy(*keys, "query_slot").agg(best.alias("_d")).select(
        *keys, "query_slot", F.when(F.size("_d") < k, F.lit(float("inf"))).otherwise(F.element_at("_d", -1)).alias("bound"))
    more = asked.join(bounds, [*keys, "query_slot"])
    return begun.unionByName(ranked(placed(more.toDF(*more.columns), part, facts, visits(False), visit_schema)))


def neighbour_value(near: Column | str, k: Column, weights: Column) -> Column:
    """Mean of the k nearest labels, or weighted by inverse distance; exact hits then count alone."""
    near = F.col(near) if isinstance(near, str) else near
    top = F.slice(near, F.lit(1), k)

    def total(cells: Column, term) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + term(c))

    hits = F.filter(top, lambda c: c["d"] == 0)
    uniform = total(top, lambda c: c["y"]) / F.size(top)
    exact = total(hits, lambda c: c["y"]) / F.nullif(F.size(hits), F.lit(0))
    weighted = (total(top, lambda c: F.when(c["d"] > 0, c["y"] / F.nullif(c["d"], F.lit(0.0))).otherwise(0.0))
                / F.nullif(total(top, lambda c: F.when(c["d"] > 0, 1 / F.nullif(c["d"], F.lit(0.0))).otherwise(0.0)), F.lit(0.0)))
    return F.when(weights == "uniform", uniform).when(F.size(hits) > 0, exact).otherwise(weighted)
