"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identity of one time series.
SERIES = ["station", "rate", "pollutant"]
#: Identity of one station frame: all its series share one time grid.
STATION = ["station", "rate"]
#: Identity of one forecast setup; with ``model`` it identifies one model run.
RUN = [*SERIES, "distance", "differenced", "direct", "artificial"]

# Column layout of the raw observation file, in file order.
RAW_COLUMNS = [
    "Countrycode", "Namespace", "AirQualityNetwork", "AirQualityStation", "AirQualityStationEoICode",
    "SamplingPoint", "SamplingProcess", "Sample", "AirPollutant", "AirPollutantCode", "AveragingTime",
    "Concentration", "UnitOfMeasurement", "DatetimeBegin", "DatetimeEnd", "Validity", "Verification",
]
_RAW_TYPES = {"Concentration": T.DoubleType(), "Validity": T.IntegerType(), "Verification": T.IntegerType()}
# The two time columns are read as text because files may carry an offset such as "+01:00".
RAW_SCHEMA = T.StructType([T.StructField(c, _RAW_TYPES.get(c, T.StringType())) for c in RAW_COLUMNS])

MEASUREMENTS_SCHEMA = T.StructType([
    T.StructField("station", T.StringType()),
    T.StructField("rate", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("pollutant", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

RESULTS_SCHEMA = T.StructType([
    T.StructField("station", T.StringType()),
    T.StructField("rate", T.StringType()),
    T.StructField("pollutant", T.StringType()),
    T.StructField("distance", T.IntegerType()),
    T.StructField("differenced", T.BooleanType()),
    T.StructField("direct", T.BooleanType()),
    T.StructField("artificial", T.BooleanType()),
    T.StructField("model", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("score", T.DoubleType()),
])

# Names of the five scores, in report order.
SCORES = ["mean_squared_error", "mean_absolute_error", "median_absolute_error", "r2", "explained_variance"]
NORM_SCORES = [f"norm_{s}" for s in SCORES]
TIMES = ["fit_time", "prediction_time"]
NORM_MEASURES = ["norm_median_absolute_error", "norm_mean_squared_error", "norm_mean_absolute_error"]

PREDICTIONS_COLUMNS = [*RUN, "model", "step", "value"]
EVAL_COLUMNS = [*RUN, "model", "params", *TIMES, *SCORES, *NORM_SCORES, "norm_factor"]


def nan_to_null(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(col), col)


def clean_doubles(df: DataFrame) -> DataFrame:
    """Missing values are NULL everywhere; NaN in a double column becomes NULL."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[nan_to_null(c).alias(c) if c in doubles else F.col(c) for c in df.columns])
