"""Incremental ingest: new files are merged into the stored measurements as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelweave.operators.ingest import ingest
from panelweave.schemas import MEASUREMENTS_SCHEMA, RAW_SCHEMA
from panelweave.sources.tables import merge_measurements


def ingest_new_files(spark: SparkSession, source: str, target: str, checkpoint: str,
                     schema: StructType = MEASUREMENTS_SCHEMA, fmt: str = "parquet",
                     prepare: Callable[[DataFrame], DataFrame] | None = None,
                     max_files: int | None = None, timeout: int | None = None) -> None:
    """Process everything that is new at ``source`` once, then stop.

    The checkpoint remembers the files already seen. Any timestamp may arrive at any time, as each batch is
    merged over the stored table; repeating a batch after a failure changes nothing.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def merge(batch: DataFrame, _: int) -> None:
        merge_measurements(prepare(batch) if prepare else batch, target)

    query = (reader.load(source).writeStream.foreachBatch(merge)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finished = query.awaitTermination(timeout) if timeout else query.awaitTermination() or True
    query.stop()
    if not finished:
        raise TimeoutError(f"new files at {source} were not all merged within {timeout} s; call again to go on")


def ingest_new_raw_files(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """The same for raw observation files."""
    stream = (spark.readStream.schema(RAW_SCHEMA).option("header", True).option("encoding", "UTF-16")
              .option("multiLine", True).csv(source)
              .select("*", F.col("_metadata.file_modification_time").alias("_file_time"),
                      F.col("_metadata.file_path").alias("_file_path")))
    query = (stream.writeStream.foreachBatch(lambda batch, _: merge_measurements(ingest(batch), target))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
