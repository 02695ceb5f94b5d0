"""ARMA models of up to four lags by the two-stage regression of Hannan and Rissanen (1982).

Stage one fits a long autoregression and takes its residuals as estimates of the shocks. Stage two regresses on
lagged values and lagged residuals. Both run as least squares over lag columns; one triangular factor of the
largest model holds every smaller one, so the order search needs no further pass over the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.models.regression import _schema_of, factors, least_squares, linear_value, solve_triangle
from panelweave.operators.blocks import BLOCK_SLOTS, over_series, spread_join

# Largest orders of the search.
MAX_P = 4
MAX_Q = 4
#: Lags of the first stage.
LONG = 12


def _lags(w, column: str, n: int):
    return F.array(*[F.lag(column, i).over(w) for i in range(1, n + 1)])


def _known(field: str):
    """One field of the tail rows before the holdout."""
    return F.transform(F.filter("_tail", lambda c: ~c["is_holdout"]), lambda c: c[field])


def forecast_orders(factor: np.ndarray, y: np.ndarray, e: np.ndarray, steps: int):
    """Forecasts of every (p, q) from the last values ``y`` and shocks ``e`` (latest last)."""
    for p in range(MAX_P + 1):
        for q in range(MAX_Q + 1):
            if p + q == 0:
                continue
            use = [*range(p), *range(MAX_P, MAX_P + q)]
            intercept, coef = solve_triangle(factor, use)
            values, shocks, out = list(y), list(e), []
            for _ in range(steps):
                past = values[::-1][:MAX_P] + shocks[::-1][:MAX_Q]
                nxt = intercept + float(np.dot(coef, past))
                out.append(nxt)
                values.append(nxt)
                shocks.append(0.0)
            yield (p, q), np.array(out)


def forecast(rows: DataFrame, keys: list[str], orders: DataFrame | None = None, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Forecast of the last season of each series by its best order, chosen on that season.

    ``orders`` (keys and the text ``order``) fixes the order instead; other series are then left out.

    ``rows`` has ``rate, slot, value, is_holdout``. Integration of order 0 and 1 compete. The result has one row per
    series: ``params`` and the array ``ahead``.
    """
    both = None
    for d in (0, 1):
        def prepare(w, d=d):
            return [(F.col("value") - F.lag("value", 1).over(w) if d else F.col("value")).alias("y")]

        part = over_series(rows, lambda w: [_lags(w, "y", LONG).alias("_long"), _lags(w, "y", MAX_P).alias("_short")],
                           before=LONG + 1, keys=keys, block_slots=block_slots, prepare=prepare, keep_block=True)
        part = part.withColumn("d", F.lit(d))
        both = part if both is None else both.unionByName(part)
    run = [*keys, "d"]
    complete = both.withColumn("_full", F.forall("_long", lambda v: v.isNotNull()))
    coef = least_squares(complete.filter(F.col("_full") & ~F.col("is_holdout")), run, "_long", "y")
    shocks = (spread_join(complete, coef.select(*run, "intercept", "coef", F.col("fit_time").alias("_t1")), run, spread=("slot",))
              .withColumn("e", F.when(F.col("_full"), F.col("y") - linear_value("_long"))).drop("_long", "intercept", "coef", "block"))
    staged = over_series(shocks, lambda w: [_lags(w, "e", MAX_Q).alias("_e")], before=MAX_Q, keys=run,
                         block_slots=block_slots, keep_block=True)
    design = (staged.withColumn("x", F.concat("_short", "_e"))
              .filter(F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull() & ~F.col("is_holdout")))
    fitted = factors(design, run, "x", "y").select(*run, "factor", "width", "fit_time")
    # A season of holdout rows and the four rows before it: a fixed number per series.
    edge = staged.groupBy(*run).agg(F.min(F.when(F.col("is_holdout"), F.col("slot"))).alias("_cut"), F.max("_t1").alias("_t1"))
    near = (spread_join(staged, edge.drop("_t1"), run, spread=("slot",))
            .filter(F.col("slot") >= F.col("_cut") - max(MAX_P, MAX_Q)))
    cells = F.array_sort(F.collect_list(F.struct("slot", "is_holdout", "value", "y", "e")))
    tail = near.groupBy(*run).agg(cells.alias("_tail"))
    ready = (fitted.join(tail, run).join(edge.drop("_cut"), run)
             .select(*run, "factor", "width", (F.col("fit_time") + F.col("_t1")).alias("fit_time"),
                     *[_known(f).alias(f) for f in ("value", "y", "e")],
                     F.transform(F.filter("_tail", lambda c: c["is_holdout"]), lambda c: c["value"]).alias("actual")))
    if orders is None:
        ready = ready.withColumn("order", F.lit(None).cast("string"))
    else:
        ready = ready.join(orders.select(*keys, "order"), keys)
    schema = _schema_of(ready, run, "params map<string,string>, ahead array<double>, mse double, fit_time double")

    def choose(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = row._asdict()
                factor = np.asarray(r["factor"]).reshape(r["width"], r["width"])
                actual = np.asarray(r["actual"], dtype=float)
                best = None
                for (p, q), ahead in forecast_orders(factor, np.asarray(r["y"], float), np.asarray(r["e"], float), len(actual)):
                    if r["d"]:
                        ahead = r["value"][-1] + np.cumsum(ahead)
                    order = f"({p}, {r['d']}, {q})"
                    mse = float(np.mean((ahead - actual) ** 2))
                    if np.isfinite(mse) and (best is None or mse < best[0]) and r["order"] in (None, order):
                        best = (mse, ahead, order)
                if best is not None:
                    out.append({**{k: r[k] for k in run}, "params": {"order": best[2]}, "ahead": best[1],
                                "mse": best[0], "fit_time": r["fit_time"]})
            yield pd.DataFrame(out, columns=schema.names)

    tried = ready.mapInPandas(choose, schema)
    return tried.groupBy(*keys).agg(F.min_by(F.struct("params", "ahead", "fit_time"), F.struct("mse", "d")).alias("_b")).select(
        *keys, "_b.params", "_b.ahead", "_b.fit_time")
