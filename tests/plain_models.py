"""Plain versions of the models, one series at a time, for small tables."""

from itertools import product

import numpy as np

from panelweave.models.smoothing import DAMPING, LEVELS, SEASONALS, SLOPES, TIE, best_power, boxcox, inverse_boxcox


def smooth(y: np.ndarray, season: int, steps: int, weights: np.ndarray, damping: float):
    """Run the recursion for every row of ``weights`` (level, slope, seasonal) side by side.

    Returns the in-sample squared error and the forecasts of each.
    """
    if len(y) < 2 * season:
        raise ValueError("needs two full seasons")
    alpha, beta, gamma = weights.T
    first, second = y[:season].mean(), y[season:2 * season].mean()
    level = np.full(len(weights), first)
    slope = np.full(len(weights), (second - first) / season)
    seasonal = np.tile(y[:season] - first, (len(weights), 1))
    sse = np.zeros(len(weights))
    for t in range(season, len(y)):
        j = t % season
        base = level + damping * slope
        sse += (y[t] - base - seasonal[:, j]) ** 2
        new = alpha * (y[t] - seasonal[:, j]) + (1 - alpha) * base
        slope = beta * (new - level) + (1 - beta) * damping * slope
        seasonal[:, j] = gamma * (y[t] - new) + (1 - gamma) * seasonal[:, j]
        level = new
    reach = np.cumsum(damping ** np.arange(1, steps + 1))
    ahead = [(len(y) + h) % season for h in range(steps)]
    return sse, level[:, None] + slope[:, None] * reach + seasonal[:, ahead]


def holt_winters(y: np.ndarray, actual: np.ndarray, season: int) -> tuple[dict, np.ndarray, float]:
    """Best of the damped and Box-Cox candidates by squared error on ``actual``; weights by in-sample error."""
    grid = np.array(list(product(LEVELS, SLOPES, SEASONALS)))
    best = None
    for damped in (True, False):
        for scaled in (True, False):
            if scaled and y.min() <= 0:
                continue
            power = best_power(y) if scaled else None
            z = boxcox(y, power) if scaled else y
            damping = DAMPING if damped else 1.0
            sse, ahead = smooth(z, season, len(actual), grid, damping)
            pick = int(np.argmin(sse))
            forecast = inverse_boxcox(ahead[pick], power) if scaled else ahead[pick]
            mse = float(np.mean((forecast - actual) ** 2))
            if np.isfinite(mse) and (best is None or mse < best[2] * (1 - TIE)):
                level, slope, seasonal = grid[pick]
                params = {"smoothing_level": level, "smoothing_slope": slope, "smoothing_seasonal": seasonal,
                          "damping_slope": damping, "use_boxcox": str(scaled).lower()}
                if scaled:
                    params["lamda"] = power
                best = (params, forecast, mse)
    if best is None:
        raise ValueError("no candidate could be fitted")
    return best


def with_params(y: np.ndarray, steps: int, season: int, params: dict) -> np.ndarray:
    """Forecast with stored parameters."""
    weights = np.array([[float(params[k]) for k in ("smoothing_level", "smoothing_slope", "smoothing_seasonal")]])
    power = float(params["lamda"]) if params.get("use_boxcox") == "true" else None
    if power is not None and y.min() <= 0:
        raise ValueError("Box-Cox needs positive values")
    z = y if power is None else boxcox(y, power)
    ahead = smooth(z, season, steps, weights, float(params["damping_slope"]))[1][0]
    return ahead if power is None else inverse_boxcox(ahead, power)


def tree(bins, label, weight, depth):
    """A function from bins to a forecast: the best cut of every node by squared error, ties to the first feature and cut."""
    bins, label, weight = np.asarray(bins), np.asarray(label, float), np.asarray(weight, float)
    total, s = weight.sum(), (weight * label).sum()
    q, mean, best = (weight * label ** 2).sum(), s / total, None
    error = q - s * s / total
    if depth and error > 1e-12 * q:
        for f in range(bins.shape[1]):
            for at in np.unique(bins[:, f])[:-1]:
                left = bins[:, f] <= at
                nl, sl = weight[left].sum(), (weight * label)[left].sum()
                share = round((sl * sl / nl + (s - sl) ** 2 / (total - nl) - s * s / total) / error, 9)
                if share >= 1e-9 and (best is None or share > best[0]):
                    best = (share, f, at)
    if best is None:
        return lambda row: mean
    _, f, at = best
    left = bins[:, f] <= at
    parts = [tree(bins[side], label[side], weight[side], depth - 1) for side in (left, ~left)]
    return lambda row: parts[0](row) if row[f] <= at else parts[1](row)
