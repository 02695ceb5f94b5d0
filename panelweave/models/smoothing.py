"""Additive exponential smoothing with trend and season, optionally damped and on a Box-Cox scale.

One step of the recursion is an affine map of the state (level, slope, one value per phase of the season), and its matrix
depends on the phase and the weights alone. So the steps of a block compose to one map: a matrix that follows from the
block's length and first phase, and an offset that the block's rows give. A prefix scan over these offsets carries the
state into every block; then all blocks run the recursion side by side, from their true states, for the squared error.
No task holds more than a block of a series, or ``FANOUT`` offsets of one.

The weights of all candidates run as one array, so that the search is one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.models.fitting import FORECAST, cpu_clock
from panelweave.models.regression import _schema_of
from panelweave.operators.blocks import BLOCK_SLOTS, block_of, spread_join
from panelweave.operators.series import SEASON
from panelweave.session import cut_lineage

# Smoothing weights tried, and the powers tried for the Box-Cox scale.
LEVELS = [0.05, 0.2, 0.5, 0.8]
SLOPES = [0.0, 0.05, 0.2]
SEASONALS = [0.05, 0.2, 0.5]
DAMPING = 0.97
POWERS = [-0.5, 0.0, 0.25, 0.5, 1.0]


def boxcox(y: np.ndarray, power: float) -> np.ndarray:
    return np.log(y) if power == 0 else (y ** power - 1) / power


def inverse_boxcox(z: np.ndarray, power: float) -> np.ndarray:
    if power == 0:
        return np.exp(z)
    return np.maximum(z * power + 1, 1e-12) ** (1 / power)


def best_power(y: np.ndarray) -> float:
    """Power with the largest profile log-likelihood."""
    logs = np.log(y)

    def likelihood(p: float) -> float:
        return -0.5 * len(y) * np.log(max(np.var(boxcox(y, p)), 1e-300)) + (p - 1) * logs.sum()

    return max(POWERS, key=likelihood)


# A candidate must be better by this share: what only rounding parts is a tie, and the earlier one stays.
TIE = 1e-9
# Offsets of one series that a task composes at a time.
FANOUT = 64
Setup = tuple[np.ndarray, np.ndarray, np.ndarray]


def setup_of(params: dict | None, power: float | None) -> Setup:
    """Weights (level, slope, seasonal), damping, and whether on the Box-Cox scale, of every candidate.

    With stored ``params`` that one; else the whole grid, damped and not, plain and, where the series has a power, scaled.
    """
    if params is not None:
        one = [[float(params[k]) for k in ("smoothing_level", "smoothing_slope", "smoothing_seasonal")]]
        return np.array(one), np.array([float(params["damping_slope"])]), np.array([params.get("use_boxcox") == "true"])
    grid = np.array(list(product(LEVELS, SLOPES, SEASONALS)))
    scales = [False] if power is None else [True, False]
    combos = [(damping, scaled) for damping in (DAMPING, 1.0) for scaled in scales]
    return (np.tile(grid, (len(combos), 1)), np.repeat([c[0] for c in combos], len(grid)), np.repeat([c[1] for c in combos], len(grid)))


def advance(state: np.ndarray, y: np.ndarray | None, steps: int, phase: int, weights: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """Run the recursion over ``y`` (candidates by steps; zeros if None) from ``phase``, changing ``state`` in place.

    ``state`` is (2 + season, candidates, columns): level, slope, then the season's values. Returns the squared error.
    """
    season = len(state) - 2
    alpha, beta, gamma = (w[:, None] for w in weights.T)
    phi = damping[:, None]
    level, slope, error = state[0].copy(), state[1].copy(), np.zeros(state.shape[1:])
    for t in range(steps):
        seasonal = state[2 + (phase + t) % season]
        now = 0.0 if y is None else y[:, t, None]
        base = level + phi * slope
        error += (now - base - seasonal) ** 2
        new = alpha * (now - seasonal) + (1 - alpha) * base
        slope = beta * (new - level) + (1 - beta) * phi * slope
        seasonal *= 1 - gamma
        seasonal += gamma * (now - new)
        level = new
    state[0], state[1] = level, slope
    return error


@lru_cache(maxsize=16)
def _matrices(setup: bytes, shape: int, season: int, steps: int, phase: int) -> np.ndarray:
    parts = np.frombuffer(setup).reshape(shape, 4)
    weights, damping, size = parts[:, :3], parts[:, 3], season + 2

    def run(n: int) -> np.ndarray:
        state = np.zeros((size, shape, size))
        state[np.arange(size), :, np.arange(size)] = 1.0
        advance(state, None, n, phase, weights, damping)
        return state.transpose(1, 0, 2)

    whole, rest = divmod(steps, season)
    return run(rest) @ np.linalg.matrix_power(run(season), whole)  # whole seasons come first and end in the phase they began with


def matrices(setup: Setup, season: int, steps: int, phase: int) -> np.ndarray:
    """The matrix of each candidate over so many steps from a phase: whole seasons by repeated squaring."""
    return _matrices(np.column_stack([setup[0], setup[1]]).tobytes(), len(setup[1]), season, steps, phase % season)


def apply_map(setup: Setup, season: int, steps: int, phase: int, offset: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state after a stretch with this offset; states and offsets are (candidates, 2 + season)."""
    return np.einsum("cij,cj->ci", matrices(setup, season, steps, phase), state) + offset


def series_values(y: np.ndarray, setup: Setup, power: float | None) -> np.ndarray:
    """The values that each candidate sees."""
    out = np.broadcast_to(y, (len(setup[1]), len(y))).copy()
    if setup[2].any():
        out[setup[2]] = boxcox(y, power)
    return out


def first_state(y: np.ndarray, slots: np.ndarray, season: int, setup: Setup, power: float | None) -> np.ndarray:
    """The state after the first season from the values of the first two."""
    values = series_values(y, setup, power)
    level = values[:, :season].mean(axis=1)
    state = np.empty((len(values), season + 2))
    state[:, 0], state[:, 1] = level, (values[:, season:2 * season].mean(axis=1) - level) / season
    state[:, 2 + slots[:season] % season] = values[:, :season] - level[:, None]
    return state


def _setup_row(pdf: pd.DataFrame) -> tuple[Setup, float | None, int]:
    row = pdf.iloc[0]
    power = None if row["power"] is None or np.isnan(row["power"]) else float(row["power"])
    return setup_of(None if row["params"] is None else dict(row["params"]), power), power, SEASON[row["rate"]]


def series_facts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: ``first_slot``, ``n`` rows to learn from, ``steps`` to forecast, ``power`` of the Box-Cox scale, ``params``, ``problem``.

    The power is the stored one, or that of the largest profile log-likelihood, from moments of the values on each scale.
    """
    stored, learn, value = "params" in rows.columns, ~F.col("is_holdout"), F.col("value")
    log = F.when(learn & (value > 0), F.log(F.when(value > 0, value)))

    def scaled(p: float):
        return log if p == 0 else (F.exp(log * p) - 1) / p

    spreads = [F.var_pop(scaled(p)).alias(f"_v{i}") for i, p in enumerate(POWERS)]
    facts = rows.groupBy(*keys).agg(
        F.min(F.when(learn, F.col("slot"))).alias("first_slot"), F.count_if(learn).alias("n"), F.count_if(~learn).alias("steps"),
        F.min(F.when(learn, value)).alias("_low"), F.sum(log).alias("_logs"), *spreads,
        (F.any_value("params") if stored else F.lit(None).cast("map<string,string>")).alias("params"))
    likelihood = [F.struct((-0.5 * F.col("n") * F.log(F.greatest(F.col(f"_v{i}"), F.lit(1e-300))) + (p - 1) * F.col("_logs")).alias("l"), F.lit(-i).alias("i"), F.lit(p).alias("p"))
                  for i, p in enumerate(POWERS)]
    positive, wanted = F.col("_low") > 0, F.try_element_at("params", F.lit("use_boxcox")) == "true"
    power = F.when(F.col("params").isNotNull(), F.when(wanted, F.try_element_at("params", F.lit("lamda")).cast("double"))).when(positive, F.array_max(F.array(*likelihood))["p"])
    season = F.when(F.col("rate") == "D", SEASON["D"]).otherwise(SEASON["H"])
    problem = F.when(F.col("n") < 2 * season, "needs two full seasons").when(F.col("params").isNotNull() & wanted & ~positive, "Box-Cox needs positive values")
    return facts.select(*keys, "first_slot", "n", "steps", power.alias("power"), "params", problem.alias("problem"))


def block_offsets(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series and block: its values in order, its first phase, and the offset of its map."""
    schema = _schema_of(rows, keys, "block long, power double, params map<string,string>, slot long, y array<double>, offset array<double>, cpu double")

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        start = cpu_clock()
        pdf = pdf.sort_values("slot")
        setup, power, season = _setup_row(pdf)
        y = pdf["value"].to_numpy(dtype=float)
        state = np.zeros((season + 2, len(setup[1]), 1))
        advance(state, series_values(y, setup, power), len(y), int(pdf["slot"].iloc[0]) % season, *setup[:2])
        out = pdf[[*keys, "block", "power", "params", "slot"]].head(1).copy()
        out["y"], out["offset"], out["cpu"] = [y], [state[:, :, 0].T.ravel()], cpu_clock() - start
        return out[schema.names]

    return rows.groupBy(*keys, "block").applyInPandas(reduce_block, schema)


def carried_states(elements: DataFrame, initial: DataFrame, keys: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """The state before every element of a series: ``keys, block, state``, by a prefix scan over the elements' maps.

    ``elements`` has ``rate, power, params, block, slot, size, offset``; ``initial`` has ``state``, the one before the first. Up to
    ``fanout`` elements are walked by one task; of more, stretches of ``fanout`` are composed to one element each, the scan
    runs over those, and every stretch goes on from the state carried into it.
    """
    keys, parent, columns = list(keys), F.floor(F.col("block") / fanout).cast("long"), elements.columns
    schema = _schema_of(elements, keys, "block long, state array<double>")

    def ordered(pdf: pd.DataFrame):
        setup, _, season = _setup_row(pdf)
        pdf = pdf.sort_values("block")
        for block, slot, size, offset in zip(pdf["block"], pdf["slot"], pdf["size"], pdf["offset"]):
            yield setup, season, int(block), int(slot), int(size), np.asarray(offset, dtype=float).reshape(len(setup[1]), season + 2)

    def walk(part: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        if part.empty or begin.empty:
            return pd.DataFrame(columns=schema.names)
        blocks, states, state = [], [], None
        for setup, season, block, slot, size, offset in ordered(part):
            state = np.asarray(begin["state"].iloc[0], dtype=float).reshape(offset.shape) if state is None else state
            blocks.append(block)
            states.append(state.ravel())
            state = apply_map(setup, season, size, slot, offset, state)
        out = pd.concat([part[keys].head(1)] * len(blocks), ignore_index=True)
        out["block"], out["state"] = blocks, states
        return out[schema.names]

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        total, length, first = None, 0, None
        for setup, season, _, slot, size, offset in ordered(part):
            first = slot if first is None else first
            total = offset if total is None else apply_map(setup, season, size, slot, offset, total)
            length += size
        out = part[[*keys, "parent", "power", "params"]].head(1).rename(columns={"parent": "block"})
        out["slot"], out["size"], out["offset"] = first, length, [total.ravel()]
        return out[columns]

    span = elements.groupBy(*keys).agg((F.max("block") - F.min("block") + 1).alias("n")).agg(F.max("n")).first()[0]  # one number
    if span is None or span <= fanout:
        return elements.groupBy(*keys).cogroup(initial.groupBy(*keys)).applyInPandas(walk, schema)
    grouped = elements.withColumn("parent", parent)
    composed = cut_lineage(grouped.groupBy(*keys, "parent").applyInPandas(compose, elements.schema))
    above = carried_states(composed, initial, keys, fanout).withColumnRenamed("block", "parent")
    return grouped.groupBy(*keys, "parent").cogroup(above.groupBy(*keys, "parent")).applyInPandas(walk, schema)


def block_errors(blocks: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series the squared ``error`` of every candidate, its ``state`` after the last row, and CPU time."""
    joined = blocks.join(states, [*keys, "block"])
    schema = _schema_of(joined, keys, "block long, error array<double>, state array<double>, cpu double")

    def run(batches):
        for pdf in batches:
            out = pdf[[*keys, "block"]].copy()
            errors, ends, times = [], [], []
            for i in range(len(pdf)):
                start = cpu_clock()
                setup, power, season = _setup_row(pdf.iloc[i:i + 1])
                y = np.asarray(pdf["y"].iloc[i], dtype=float)
                state = np.array(pdf["state"].iloc[i], dtype=float).reshape(len(setup[1]), -1).T[:, :, None].copy()
                errors.append(advance(state, series_values(y, setup, power), len(y), int(pdf["slot"].iloc[i]) % season, *setup[:2])[:, 0])
                ends.append(state[:, :, 0].T.ravel())
                times.append(cpu_clock() - start + float(pdf["cpu"].iloc[i]))
            out["error"], out["state"], out["cpu"] = errors, ends, times
            yield out[schema.names]

    each = joined.mapInPandas(run, schema)
    width = 4 * len(LEVELS) * len(SLOPES) * len(SEASONALS)
    total = F.array(*[F.sum(F.get("error", F.lit(i))) for i in range(width)])  # candidates that a series lacks stay NULL
    return each.groupBy(*keys).agg(total.alias("error"), F.max_by("state", "block").alias("state"), F.sum("cpu").alias("fit_time"))


def forecast(rows: DataFrame, keys: list[str], block_slots: int = BLOCK_SLOTS, fanout: int = FANOUT) -> DataFrame:
    """Forecast of the holdout of each series, with its parameters.

    ``rows`` has ``rate, slot, value, is_holdout``, the slots without gaps. With a column ``params`` the stored parameters
    are used, otherwise they are searched: the weights by squared error on the rows learned from, damping and scale by
    squared error on the holdout. A series that cannot be fitted has one row with ``error``.
    """
    rows = rows.select(*keys, *[c for c in ("rate", "slot", "value", "is_holdout", "params") if c in rows.columns and c not in keys])
    facts = cut_lineage(series_facts(rows, keys))
    fine = facts.filter("problem is null").drop("problem", "n", "steps")
    known = spread_join(rows.drop("params"), fine, keys, spread=("slot",))
    season = F.when(F.col("rate") == "D", SEASON["D"]).otherwise(SEASON["H"])
    learn = known.filter(~F.col("is_holdout")).withColumn("block", block_of(F.col("slot"), block_slots))
    blocks = cut_lineage(block_offsets(learn.filter(F.col("slot") >= F.col("first_slot") + season).drop("first_slot", "is_holdout"), keys))

    # The first two seasons and the holdout of a series, a few dozen values.
    few = F.struct("slot", "value")
    begins = (known.filter(~F.col("is_holdout") & (F.col("slot") < F.col("first_slot") + 2 * season)).groupBy(*keys)
              .agg(F.array_sort(F.collect_list(few)).alias("few"), F.any_value("power").alias("power"), F.any_value("params").alias("params")))
    initial_schema = _schema_of(begins, keys, "state array<double>")

    def begin(batches):
        for pdf in batches:
            states = []
            for i in range(len(pdf)):
                setup, power, m = _setup_row(pdf.iloc[i:i + 1])
                few = pdf["few"].iloc[i]
                states.append(first_state(np.array([c["value"] for c in few]), np.array([c["slot"] for c in few]), m, setup, power).ravel())
            out = pdf[keys].copy()
            out["state"] = states
            yield out

    elements = blocks.select(*keys, "block", "power", "params", "slot", F.size("y").cast("long").alias("size"), "offset")
    states = carried_states(elements, begins.mapInPandas(begin, initial_schema), keys, fanout)
    fitted = block_errors(blocks.drop("offset"), states, keys)
    actual = known.filter("is_holdout").groupBy(*keys).agg(F.array_sort(F.collect_list(few)).alias("actual"))
    joined = facts.join(fitted, keys, "left").join(actual, keys, "left")
    schema = _schema_of(joined, keys, FORECAST)

    def finish(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                yield _forecast_rows(pdf.iloc[i:i + 1], keys)[schema.names]

    return joined.mapInPandas(finish, schema)


def _forecast_rows(pdf: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """The forecast of one series by its best candidate."""
    row, head = pdf.iloc[0], pdf[list(keys)]
    nothing = {"params": None, "step": None, "predicted": None, "fit_time": None, "prediction_time": None}
    if row["problem"] is not None:
        return head.assign(**nothing, error=row["problem"])
    start = cpu_clock()
    setup, power, season = _setup_row(pdf)
    weights, damping, scaled = setup
    few = [] if row["actual"] is None else row["actual"]
    actual, steps = np.array([c["value"] for c in few], dtype=float), len(few)
    error = np.asarray(row["error"], dtype=float)[: len(damping)]
    state = np.asarray(row["state"], dtype=float).reshape(len(damping), season + 2)
    after = int(row["first_slot"]) + int(row["n"])
    best = None
    for damp, scale in dict.fromkeys(zip(damping.tolist(), scaled.tolist())):
        mine = np.flatnonzero((damping == damp) & (scaled == scale))
        finite = mine[np.isfinite(error[mine])]
        if not len(finite):
            continue
        pick = int(finite[np.argmin(error[finite])])
        ahead = state[pick, 0] + state[pick, 1] * np.cumsum(damp ** np.arange(1, steps + 1)) + state[pick, 2 + (after + np.arange(steps)) % season]
        values = inverse_boxcox(ahead, power) if scale else ahead
        mse = float(np.mean((values - actual) ** 2)) if steps else 0.0
        if np.isfinite(mse) and (best is None or mse < best[2] * (1 - TIE)):
            level, slope, seasonal = weights[pick]
            params = {"smoothing_level": level, "smoothing_slope": slope, "smoothing_seasonal": seasonal, "damping_slope": damp, "use_boxcox": str(scale).lower()}
            best = (params | ({"lamda": power} if scale else {}), values, mse)
    if best is None:
        return head.assign(**nothing, error="no candidate could be fitted")
    params = {k: str(v) for k, v in best[0].items()} if row["params"] is None else dict(row["params"])
    out = pd.concat([head] * steps, ignore_index=True) if steps else head.head(0)
    return out.assign(params=[params] * steps, step=range(steps), predicted=[float(v) for v in best[1]],
                      fit_time=float(row["fit_time"]) + cpu_clock() - start, prediction_time=0.0, error=None)
