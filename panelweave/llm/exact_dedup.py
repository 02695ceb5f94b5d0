"""Exact duplicates by an extendible-hash index on shared files: DataFrame operations only.

A text's *normal form* is the text without the characters of ``[\\x20\\x09-\\x0D]``. Keys are 64-bit hashes of normal
forms. The directory of the index doubles until no bucket holds more distinct keys than its capacity. Owner tasks
process key ranges: each gets whole buckets, hash aggregation chains the keys of a bucket and compares the bytes of
normal forms, so equal keys of different texts stay apart.

Only texts whose key slot occurs more than once travel: a first pass reads every text and keeps the numbers alone, and a
filter over at most ``2 ** slot_bits`` slots lets through what may have a copy. Copies collapse in the reading task before
the exchange, so a group of any size costs its owner one row per reading task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import stage

#: Distinct keys that a bucket holds before it splits.
CAPACITY = 50_000
#: Directory depth up to which the histogram of key prefixes is kept (2 ** 16 counts at most reach the driver).
MAX_DEPTH = 16
#: Slots of the filter before the byte comparison; at most 2 ** 20 numbers are broadcast.
SLOT_BITS = 20


def normal_form(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def split_directory(prefix_counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int]]:
    """Buckets as (local depth, prefix), splitting every overfull one and doubling the directory when needed."""
    buckets, todo = [], [(0, 0)]
    totals = [dict(prefix_counts)]
    for _ in range(max_depth):  # counts of shorter prefixes, from the deepest up
        shorter: dict[int, int] = {}
        for prefix, n in totals[-1].items():
            shorter[prefix >> 1] = shorter.get(prefix >> 1, 0) + n
        totals.append(shorter)
    while todo:
        depth, prefix = todo.pop()
        if totals[max_depth - depth].get(prefix, 0) > capacity and depth < max_depth:
            todo += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
        else:
            buckets.append((depth, prefix))
    return sorted(buckets, key=lambda b: b[1] << (max_depth - b[0]))


def key_prefix(key: Column) -> Column:
    """The first ``MAX_DEPTH`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def bucket_of(key: Column, buckets: list[tuple[int, int]]) -> Column:
    """Number of the bucket that owns a key: the directory is an array with one entry per prefix."""
    if len(buckets) == 1:
        return F.lit(0)
    deepest = max(depth for depth, _ in buckets)
    entries = [str(number) for number, (depth, _) in enumerate(buckets) for _ in range(1 << (deepest - depth))]
    prefix = F.shiftrightunsigned(key, 64 - deepest).cast("int")
    return F.element_at(F.expr(f"array({','.join(entries)})"), prefix + 1)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """Write the index of ``docs`` to the shared folder; return the documents' keys and the index.

    The index holds one part per bucket and a row for each distinct normal form: ``key``, ``digest``, ``chain`` (its
    place among different texts of the same key), ``keep_id``, ``group_size``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars"), normal_form(text).alias("form"))
    keyed = keyed.withColumn("key", F.xxhash64("form"))
    numbers = stage(keyed.select("doc_id", "n_chars", "key", F.sha2("form", 256).alias("digest")), "exact-keys")

    keys = numbers.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    counts = keys.groupBy(key_prefix(F.col("key")).alias("prefix")).count().collect()  # 2 ** MAX_DEPTH rows at most
    buckets = split_directory({r["prefix"]: r["count"] for r in counts}, capacity, MAX_DEPTH)
    bucket = bucket_of(F.col("key"), buckets).alias("bucket")

    slot = F.pmod("key", F.lit(1 << slot_bits)).alias("slot")
    slots = keys.filter("rows > 1").select(slot).distinct()
    compared = (keyed.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi")  # 2 ** slot_bits numbers at most
                .groupBy(bucket, "key", "form").agg(F.count(F.lit(1)).alias("equal_bytes"))
                .select("bucket", "key", F.sha2("form", 256).alias("digest"), "equal_bytes"))
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    groups = numbers.groupBy(bucket, "key", "digest").agg(best, F.count(F.lit(1)).alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest")).alias("chain")
    checked = F.when((F.col("group_size") > 1) & ~F.col("group_size").eqNullSafe(F.col("equal_bytes")),
                     F.raise_error(F.lit("texts of one digest differ"))).otherwise(F.col("group_size")).alias("group_size")
    entries = (groups.join(compared, ["bucket", "key", "digest"], "left").repartition("bucket")
               .select("bucket", "key", "digest", chain, F.col("best.doc_id").alias("keep_id"), checked))
    return numbers, stage(entries, "exact-index", partition_by="bucket")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per document with the group of equal texts it belongs to.

    Columns: the id, ``keep_id`` (of equal texts the one with the most code points, then the smallest id), ``group_size``,
    ``kept``, ``text_sha256`` of the normal form. NULL and blank texts are equal to the empty text. Other columns of
    ``docs`` are not read, so their names cannot clash. A NULL id never stays while an id is there. Rows that repeat an
    id and its text count in ``group_size`` and share their verdict. An empty table gives an empty result.
    """
    numbers, index = build_index(docs, id_col, text_col, **limits)
    joined = numbers.select("doc_id", "key", "digest").join(index, ["key", "digest"])
    return joined.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                          slot_bits: int = SLOT_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of equal texts.

    That is a row of ``keep_id``; of several such rows one is chosen by hashes of text and columns. Rows are judged by their
    text, so one without id or of a repeated id goes only if its own text is kept elsewhere. Texts travel only where a
    key's hash slot holds copies, and copies collapse in the reading task.
    """
    _, index = build_index(docs, id_col, text_col, capacity, slot_bits)
    slot = F.pmod("key", F.lit(1 << slot_bits)).alias("slot")
    slots = F.broadcast(index.filter("group_size > 1").select(slot).distinct())  # 2 ** slot_bits numbers at most
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = [F.xxhash64(text), F.xxhash64(*[docs[f"`{c}`"] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])]
    order = F.struct((-F.length(text)).alias("n"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), hashed[0].alias("text"), hashed[1].alias("all"))
    rows = docs.select(F.struct("*").alias("row"), order.alias("order"), normal_form(F.col(text_col)).alias("form"))
    rows = rows.withColumn("key", F.xxhash64("form")).withColumn("slot", slot)
    sure = rows.join(slots, "slot", "left_anti").select("row.*")
    doubt = rows.join(slots, "slot", "left_semi").select("row", "order", "key", F.sha2("form", 256).alias("digest"))
    chosen = doubt.groupBy("key", "digest").agg(F.min_by("row", "order").alias("row"))  # the index has compared the bytes
    return sure.unionByName(chosen.select("row.*"))
