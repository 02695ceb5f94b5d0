"""What several operators share: staged tables, hold-out flags, byte-balanced slices, sampling."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.session import shared_dir

#: Bytes of text that an Arrow function works on and answers at a time, so that no answer waits for the rest of its batch; one
#: longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: The same where a slice becomes many arrays of eight bytes per word.
THIN_SLICE = 1 << 18
#: Bytes that Spark hands an Arrow function at a time, so that neither side holds the rows' whole batch of ten thousand texts.
BATCH_BYTES = 2 * SLICE_BYTES

_Held = TypeVar("_Held")
_held: dict[Hashable, object] = {}


def process_state(key: Hashable, build: Callable[[], _Held]) -> _Held:
    """What the tasks of one operator share in a worker process, such as a tokenizer and remembered words.

    A process keeps the state of one operator at a time: a task of another operator drops it and returns the memory.
    """
    if key not in _held:
        give_back()
        _held[key] = build()
    return _held[key]


def give_back() -> None:
    """Drop the state of earlier operators from this worker process and return freed memory to the system."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends Arrow functions batches of about ``BATCH_BYTES``, one longer text by itself; a limit that was
    set before stays. Without one a batch is 10,000 rows, however long, in Spark's memory outside the heap and in the worker's.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; one parent per application, so a job's leftovers can be removed together."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there: cut lineage that survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Rows of whole numbers as a table that goes to Spark as Arrow: a list of rows would start Python processes on every executor, which
    outlast the job.
    """
    columns = zip(*rows) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int64()) for name, values in zip(names, columns)}))


def kept_aside(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it on the executors' disks for a while: no file is made per task, and what an executor
    loses is computed again. The caller unpersists it once what follows is staged.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def held_out(doc_id: Column) -> Column:
    """One fifth of the documents, never learned from: crc32 of the id as text, modulo 5, is 0. A NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_share(key: Column, share: Column) -> Column:
    """Keep about ``share`` of the rows, the same ones on every run."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cut an Arrow column of texts into consecutive slices of about equal bytes; NULL becomes the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a ``large_utf8`` slice and where each text starts and ends in them."""
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if data is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]], bounds - bounds[0]


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str, slot_bits: int = 20) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``dropped``; texts move only where an id's hash slot is in doubt.

    Rows in a slot without dropped ids pass at once (2 ** slot_bits slots at most are broadcast); the others are joined.
    A NULL id in ``dropped`` drops the rows without an id.
    """
    dropped = stage(dropped.distinct(), "dropped-ids")
    slot = F.pmod(F.xxhash64(id_col), F.lit(1 << slot_bits))
    slots = F.broadcast(dropped.select(slot.alias("_slot")).distinct())
    gone = dropped.select(F.col(id_col).alias("_gone"))
    sure = docs.join(slots, slot == slots["_slot"], "left_anti")
    doubt = docs.join(slots, slot == slots["_slot"], "left_semi")
    return sure.unionByName(doubt.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti"))
