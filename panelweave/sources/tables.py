"""Stored tables: measurements, results, evaluation, predictions and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.names import parse_run_name, parse_series_name
from panelweave.operators.blocks import block_of, slot_of, spread_join
from panelweave.operators.ingest import KEEP_THRESHOLD, density_filter, merge_newest_wins, upsert
from panelweave.plans.reports import REPORTS
from panelweave.schemas import EVAL_COLUMNS, MEASUREMENTS_SCHEMA, RESULTS_SCHEMA, RUN, STATION, clean_doubles

#: Names of touched stations up to which a merge prunes the folders it lists; more are matched by a join instead.
NAMED_STATIONS = 10_000
_COLUMNS = [f.name for f in MEASUREMENTS_SCHEMA.fields]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path`` (any file system Spark can reach)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _spread(df: DataFrame) -> DataFrame:
    """Place rows for writing: a station's files hold whole blocks, and a large station is written by many tasks."""
    block = block_of(slot_of(F.col("ts")))
    return df.select(*_COLUMNS).repartition(*STATION, "pollutant", block).sortWithinPartitions(*STATION, "pollutant", "ts")


def write_measurements(df: DataFrame, path: str) -> None:
    """Write measurements by station and rate; partitions that ``df`` does not touch stay as they are."""
    (_spread(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*STATION).parquet(path))


def read_measurements(spark: SparkSession, path: str, station: str | None = None, rate: str | None = None) -> DataFrame:
    """Stored measurements; ``station`` and ``rate`` prune partitions."""
    df = spark.read.schema(MEASUREMENTS_SCHEMA).parquet(path).select(*_COLUMNS)
    if station is not None:
        df = df.filter(F.col("station") == station)
    return df if rate is None else df.filter(F.col("rate") == rate)


def _of_stations(stored: DataFrame, stations: DataFrame) -> DataFrame:
    """The stored rows of ``stations`` (distinct names): by a filter that prunes folders, or a salted join where they are many."""
    names = [r.station for r in stations.limit(NAMED_STATIONS + 1).collect()]
    if len(names) <= NAMED_STATIONS:
        return stored.filter(F.col("station").isin(sorted(n for n in names if n is not None)))
    return spread_join(stored, stations, ["station"], "left_semi")


def merge_measurements(new: DataFrame, path: str) -> None:
    """Merge new measurements into the stored ones, cell by cell, newest value first.

    Only stations that ``new`` touches are read and rewritten; a first merge is one over an empty table. The merged rows
    go to a side folder first, as a folder cannot be read and replaced in one job, and the side folder goes when they are
    in place. A merge that is repeated after a failure gives the same table.
    """
    spark = new.sparkSession
    merged = merge_newest_wins(new.select(*_COLUMNS), F.lit(1))
    if exists(spark, path):
        merged = upsert(merged, _of_stations(read_measurements(spark, path), new.select("station").distinct()))
    staged = f"{path.rstrip('/')}_staged/{uuid.uuid4().hex}"
    _spread(merged.filter(F.col("value").isNotNull())).write.partitionBy(*STATION).parquet(staged)
    write_measurements(read_measurements(spark, staged), path)
    remove(spark, staged)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_dense(spark: SparkSession, path: str, target: str, threshold: float = KEEP_THRESHOLD) -> None:
    """Density pass: ``target`` holds the surviving series of ``path`` and nothing else; stations that have fallen below go."""
    dense = density_filter(read_measurements(spark, path), threshold)
    (_spread(dense).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*STATION).parquet(target))


def _lines_with_header(spark: SparkSession, path: str) -> DataFrame:
    """Lines of headed text files as ``file``, ``header`` and ``line`` (both split at commas outside quotes).

    Files stay splittable: a file's header is the first line of its first block, joined by file.
    """
    outside = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = F.transform(F.split(F.rtrim("value"), outside), lambda v: F.trim(v, F.lit('"')))
    lines = spark.read.text(path).filter("trim(value) <> ''").select(
        F.col("_metadata.file_path").alias("file"), "value", cells.alias("line"))
    first = (spark.read.text(path).filter("trim(value) <> ''")
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", cells.alias("header"),
                     F.monotonically_increasing_id().alias("place")).filter("block = 0"))
    headers = first.groupBy("file").agg(F.min_by(F.struct("header", F.col("value").alias("text")), "place").alias("h")).select("file", "h.*")
    return (spread_join(lines, headers, ["file"], spread=("value",)).filter("value <> text").select("file", "header", "line"))


def read_station_files(spark: SparkSession, path: str) -> DataFrame:
    """Converted station files (CSV, one column per pollutant, named ``<station>-<day|hour>.csv``) as measurements.

    Column sets differ per file, so each file's own header decides.
    """
    rows = _lines_with_header(spark, path).withColumn("k", parse_series_name(F.col("file")))
    cell = F.explode(F.slice(F.arrays_zip(F.col("header").alias("p"), F.col("line").alias("v")), F.lit(2), F.size("header")))
    long = rows.select("k.station", "k.rate", F.try_to_timestamp(F.col("line")[0]).alias("ts"), cell.alias("x"))
    return (long.filter(~F.col("x.p").isin("AirQualityStationEoICode", "AveragingTime"))
            .select("station", "rate", "ts", F.col("x.p").alias("pollutant"), F.col("x.v").try_cast("double").alias("value"))
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def write_results(df: DataFrame, path: str) -> None:
    """Append search results."""
    df.select(*[f.name for f in RESULTS_SCHEMA.fields]).write.mode("append").partitionBy(*STATION).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    names = [f.name for f in RESULTS_SCHEMA.fields]
    return spark.read.schema(RESULTS_SCHEMA).parquet(path).select(*names)


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """Search results in CSV files whose names hold the run key; parameter columns differ and become one map.

    A time-based run always includes the model without parameters, so its row is added.
    """
    rows = _lines_with_header(spark, path).withColumn("k", parse_run_name(F.col("file")))
    cells = rows.select("k", F.map_from_arrays("header", "line").alias("m"))
    known = F.map_filter("m", lambda k, v: ~k.isin("", "index", "score", "model") & (v != ""))
    found = cells.select("k.*", F.col("m")["model"].alias("model"), known.alias("params"),
                         F.try_element_at("m", F.lit("score")).try_cast("double").alias("score")).filter("model <> 'prophet'")
    plain = (found.filter(~F.col("direct")).select(*RUN).distinct()
             .select("*", F.lit("prophet").alias("model"), F.create_map().cast("map<string,string>").alias("params"),
                     F.lit(None).cast("double").alias("score")))
    return found.unionByName(plain)


def write_evaluation(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy(*STATION).parquet(path)


write_predictions = write_evaluation


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation table with missing values as NULL."""
    return clean_doubles(spark.read.parquet(path))


def read_evaluation_files(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation CSV files named ``<station>-<rate>.csv``, read by each file's own header; the key becomes columns."""
    rows = _lines_with_header(spark, path).select(parse_series_name(F.col("file")).alias("k"), F.map_from_arrays("header", "line").alias("m"))

    def cell(name: str) -> Column:
        text = F.try_element_at("m", F.lit(name))
        kind = {"pollutant": "string", "model": "string", "distance": "int"}.get(name, "boolean" if name in RUN else "double")
        return (text if kind == "string" else text.try_cast(kind)).alias(name)

    names = [c for c in EVAL_COLUMNS if c not in (*STATION, "params")]
    return clean_doubles(rows.select(F.col("k.station").alias("station"), F.col("k.rate").alias("rate"), *[cell(c) for c in names]))


def write_reports(evaluation: DataFrame, path: str, fmt: str = "csv", names: list[str] | None = None) -> list[str]:
    """Write each report to ``<path>/<name>``, in its order over the part files. Returns the paths."""
    out = []
    for name in names or list(REPORTS):
        target = f"{path.rstrip('/')}/{name}"
        writer = REPORTS[name](evaluation).write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else getattr(writer, fmt))(target)
        out.append(target)
    return out
