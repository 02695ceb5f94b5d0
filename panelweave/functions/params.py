"""Typed access to the ``params`` map of a results row.

Stored values may have passed through text and floating point (``"4.0"``), so integers are cast by way of
double. A missing or unreadable value gives NULL, which means "model default".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters kept per model, and their types.
MODEL_PARAMS: dict[str, dict[str, str]] = {
    "knn": {"n_neighbors": "int", "weights": "string"},
    "decision_tree": {"max_depth": "int"},
    "random_forest": {"n_estimators": "int", "max_depth": "int"},
    "linear_regression": {"normalize": "boolean"},
    "gru": {"weights": "int", "dropout_rate": "double", "input_shape": "array<int>", "epochs": "int",
            "batch_size": "int", "learning_rate": "double"},
    "ets": {"smoothing_level": "double", "smoothing_slope": "double", "smoothing_seasonal": "double",
            "damping_slope": "double", "use_boxcox": "boolean", "initial_level": "double",
            "initial_slope": "double", "lamda": "double", "remove_bias": "boolean"},
    "arima": {"order": "array<int>", "seasonal_order": "array<int>", "method": "string", "solver": "string",
              "maxiter": "int", "disp": "int", "trend": "string", "transparams": "boolean",
              "suppress_warnings": "boolean", "scoring": "string", "scoring_args": "string",
              "start_params": "string", "callback": "string"},
    "prophet": {},
}


def _typed(text: Column, type_: str) -> Column:
    if type_ == "int":
        return text.try_cast("double").cast("int")
    if type_ == "array<int>":
        digits = F.regexp_extract_all(text, F.lit(r"(-?\d+)"), 1)
        return F.transform(digits, lambda d: d.try_cast("int"))
    if type_ == "string":
        return text
    return text.try_cast(type_)


def typed_params(model: str, params: Column) -> Column:
    """Struct of the typed parameters of ``model`` out of its string map."""
    fields = MODEL_PARAMS[model]
    if not fields:
        return F.struct()
    return F.struct(*[_typed(F.try_element_at(params, F.lit(k)), t).alias(k) for k, t in fields.items()])


def params_map(**values: Column) -> Column:
    """String map from columns, the storage form of heterogeneous parameters."""
    pairs: list[Column] = []
    for key, col in values.items():
        pairs += [F.lit(key), col.cast("string")]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def int_range(start: int, stop: int, step: int = 1) -> Column:
    """Inclusive integer range as an array column."""
    return F.sequence(F.lit(start), F.lit(stop), F.lit(step))


def linspace(start: float, stop: float, num: int, as_int: bool = False) -> Column:
    """``num`` evenly spaced values with both ends, optionally truncated to integers."""
    width = (stop - start) / (num - 1)
    out = F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: F.lit(float(start)) + i * F.lit(float(width)))
    return F.transform(out, lambda v: v.cast("int")) if as_int else out
