"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where bits of it that depend on the last 16 bytes alone fall
below a threshold. So the same passage is cut at the same places wherever it stands, and insertions move the chunks
after them without changing them. Chunks are deduplicated by 128-bit digest over the whole corpus; the smallest id with a
chunk has the original. Neighbouring repeated chunks make a repeated span; a chunk that occurs once, of any size, ends it.

Chunks travel as digests, never as text. A row is named by its id and its text, so rows that share an id stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import give_back, slices, stage, text_bytes

#: Expected and largest bytes of a chunk (a prime, so that the chunks of a short period come in all its phases), bytes of the shortest span reported.
EXPECTED, LARGEST, SPAN = 48, 61, 96
#: Bytes the gear hash looks back.
REACH = 16
#: A digest with more than one in so many of all chunks is hot; there are at most so many of them.
HOT = 4096
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: the sum of the last ``REACH`` gear values, each shifted by its age."""
    h = GEAR[data]
    step = 1
    while step < REACH:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of all chunks of a slice, ascending; every text ends a chunk, and none ends in a text's first bytes."""
    h = gear_hash(data.copy())
    cut = ((h >> np.uint32(4)) & np.uint32(0xFFF)) * np.uint32(EXPECTED) < 4096
    for start in bounds[:-1]:
        cut[start: start + REACH - 1] = False
    last = bounds[1:] - 1
    cut[last[last >= 0]] = True
    filled = np.diff(bounds) > 0
    cut[last[filled]] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends[:-1]])
    parts = (ends - starts + LARGEST - 1) // LARGEST  # bytes that never meet the condition, as a short period
    at = starts.repeat(parts) + LARGEST * (np.arange(parts.sum()) - (np.cumsum(parts) - parts).repeat(parts) + 1)
    return np.minimum(at, ends.repeat(parts))


_CHUNK = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_bytes", T.IntegerType()),
                       T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("again", T.BooleanType())])


@F.arrow_udf(T.ArrayType(_CHUNK))
def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The chunks of each text: number, start, bytes, digest, whether the text had it before."""
    give_back()
    for batch in batches:
        out = []
        for part in slices(batch):
            data, bounds = text_bytes(part)
            ends = chunk_ends(data, bounds) if len(data) else np.zeros(0, np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
            raw = data.tobytes()
            digests = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)
            first = np.searchsorted(starts, bounds)
            text = np.repeat(np.arange(len(part)), np.diff(first))
            again = np.zeros(len(starts), bool)
            order = np.lexsort((starts, digests[:, 1], digests[:, 0], text))
            same = (text[order][1:] == text[order][:-1]) & (digests[order][1:] == digests[order][:-1]).all(axis=1)
            again[order[1:][same]] = True
            fields = [pa.array(np.arange(len(starts)) - first[text], pa.int32()), pa.array(starts - bounds[text], pa.int64()), pa.array(ends - starts, pa.int32()),
                      pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(again)]
            out.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(fields, names=[f.name for f in _CHUNK])))
        yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("place", pa.int32())])))


def text_name(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per repeated span of a document, originals included.

    Columns: the id, ``text_hash`` (64-bit hash of the text, for rows that share an id), ``start_byte``, ``end_byte``
    (UTF-8, end exclusive), ``n_chunks``, ``n_repeats`` (chunks of it that occur earlier: under a smaller id, or before in the same
    text), ``copies`` (most occurrences of one of its chunks), ``first_doc_id`` (smallest id with a chunk of it, NULL if
    none has an id). Documents without repeated passages have no row, nor have NULL, empty and very short texts. Rows
    that share an id are judged each by its own text, and count as occurrences; rows without id come after all others.
    Rows equal in id and text are one answer. Other columns are not read. An empty table gives an empty result.
    """
    text = F.col(text_col)
    made = docs.select(F.col(id_col).alias("doc_id"), text_name(text).alias("text_hash"), chunks(F.coalesce(text, F.lit(""))).alias("chunks"))
    # The number of a row is fixed by this table; it stands for id and text in what travels.
    found = stage(made.withColumn("row", F.monotonically_increasing_id()), "chunks")
    each = found.select("row", "doc_id", F.explode("chunks").alias("c")).select("row", "doc_id", "c.*")
    known = stage(each.groupBy("high", "low").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id")).filter("copies > 1"), "repeated-chunks")
    total = found.agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0))).first()[0]
    hot = F.broadcast(known.filter(F.col("copies") > total / HOT))  # fewer than HOT rows, as their copies add up to total at most
    rare = known.filter(F.col("copies") <= total / HOT)
    repeated = each.join(hot, ["high", "low"]).unionByName(each.join(hot, ["high", "low"], "left_anti").join(rare, ["high", "low"]))
    earlier = F.col("again") | F.coalesce(F.col("doc_id") != F.col("first_doc_id"), F.col("doc_id").isNull() & F.col("first_doc_id").isNotNull())
    marked = repeated.select("row", "place", "start", "n_bytes", "copies", "first_doc_id", earlier.cast("int").alias("earlier"))
    run = F.col("place") - F.row_number().over(Window.partitionBy("row").orderBy("place"))  # at most the chunks of one text
    spans = (marked.withColumn("run", run).groupBy("row", "run")
             .agg(F.min("start").alias("start_byte"), F.max(F.col("start") + F.col("n_bytes")).alias("end_byte"), F.count(F.lit(1)).alias("n_chunks"),
                  F.sum("earlier").alias("n_repeats"), F.max("copies").alias("copies"), F.min("first_doc_id").alias("first_doc_id")))
    spans = spans.filter(F.col("end_byte") - F.col("start_byte") >= span).join(found.select("row", "doc_id", "text_hash"), "row")
    spans = spans.select("doc_id", "text_hash", "start_byte", "end_byte", "n_chunks", "n_repeats", "copies", "first_doc_id").distinct()  # equal rows are one
    return spans.withColumnRenamed("doc_id", id_col)


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if text is not None and cuts:
            raw, kept, at = text.encode(), [], 0
            for cut in sorted(cuts, key=lambda c: c["start_byte"]):
                kept.append(raw[at: cut["start_byte"]].decode(errors="ignore"))  # a character that a cut parts goes with the span
                at = max(at, cut["end_byte"])
            text = "".join([*kept, raw[at:].decode(errors="ignore")])
        out.append(text)
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out that hold nothing but earlier text (``n_repeats = n_chunks``); the originals stay."""
    cuts = (spans.filter("n_repeats = n_chunks").groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"))
            .agg(F.collect_list(F.struct("start_byte", "end_byte")).alias("_cuts")))  # bounded by the text
    joined = docs.join(cuts, F.col(id_col).eqNullSafe(F.col("_id")) & (text_name(F.col(text_col)) == F.col("_hash")), "left")
    return joined.withColumn(text_col, F.when(F.col("_cuts").isNotNull(), _without(F.col(text_col), F.col("_cuts"))).otherwise(F.col(text_col))).drop("_id", "_hash", "_cuts")
