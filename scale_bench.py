"""Throughput on a large panel, next to pandas on one series at a time.

``python scale_bench.py <folder> [series] [hours]`` writes a panel of hourly series with gaps to a new folder and
times the main steps over all of it. The first series is ten times as long as the others and in one station.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from panelweave.models.regression import least_squares  # noqa: E402
from panelweave.models.supervised import artificial_rows  # noqa: E402
from panelweave.operators.ingest import density_filter  # noqa: E402
from panelweave.operators.resample import resample  # noqa: E402
from panelweave.operators.series import artificial_features  # noqa: E402
from panelweave.schemas import RUN  # noqa: E402
from panelweave.session import build_session  # noqa: E402
from panelweave.sources.tables import read_measurements, write_measurements  # noqa: E402


def panel(spark, series: int, hours: int):
    ids = spark.range(series).withColumn("n", F.when(F.col("id") == 0, hours * 10).otherwise(hours))
    rows = ids.select("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).repartition(64)
    rows = rows.filter(F.pmod(F.xxhash64("id", "i"), F.lit(10)) > 0)
    noise = F.pmod(F.xxhash64("i", "id"), F.lit(1000)) / 50.0
    return rows.select(F.concat(F.lit("ST"), F.floor(F.col("id") / 5).cast("string")).alias("station"), F.lit("H").alias("rate"),
                       F.timestamp_seconds(F.lit(1_577_836_800) + F.col("i") * 3600).alias("ts"),
                       F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("pollutant"),
                       (50 + 10 * F.sin(F.col("i") * (6.283185 / 24)) + noise).alias("value"))


def pandas_series(values: pd.Series) -> pd.DataFrame:
    grid = values.resample("h").interpolate(method="time").dropna()
    lags = pd.DataFrame({f"lag_{i}": grid.shift(i - 1) for i in range(1, 25)})
    lags["sum"] = lags.sum(axis=1)
    lags["mean"] = lags.mean(axis=1)
    lags["median"] = lags.median(axis=1)
    return lags


def main() -> None:
    folder, series, hours = sys.argv[1], int((sys.argv + [0, 1000])[2]), int((sys.argv + [0, 0, 8760])[3])
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("scale", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": "64", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    path = f"{folder}/panel-{series}x{hours}"
    write_measurements(panel(spark, series, hours), path)
    stored = read_measurements(spark, path)
    out = {"rows": stored.count(), "series": series}

    def timed(name, df):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - start, 2)
        print(name, out[name], file=sys.stderr, flush=True)

    timed("density_filter", density_filter(stored, 0.5))
    timed("grid", resample(stored, "H"))
    timed("grid_and_features", artificial_features(resample(stored, "H"), 24))
    rows = artificial_rows(resample(stored, "H"), "H", [1])
    timed("grid_features_regression", least_squares(rows.filter(~F.col("is_holdout")), RUN))

    sample = stored.filter("station = 'ST1'").toPandas()
    start = time.perf_counter()
    done = sum(len(pandas_series(g.set_index("ts")["value"].sort_index())) for _, g in sample.groupby("pollutant"))
    out["pandas_rows_per_second_one_core"] = int(done / (time.perf_counter() - start))
    out["spark_rows_per_second"] = int(out["rows"] / out["grid_and_features"])
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
