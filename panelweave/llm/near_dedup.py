"""Near duplicates: circulant MinHash, banding, exact Jaccard verification, components.

Two permutations make a whole signature: the first scatters the shingle numbers over the circle of 2 ** 32 places, the
second, shifted by one more place for each coordinate, ranks them. Coordinates are banded; documents that share a band are
candidates, and only pairs whose full shingle sets overlap enough become links.

Equal shingle sets collapse to one class before anything is paired. A bucket never emits all its pairs: its members are
first compared with the smallest of them, then with their other anchors. For what still lies in different components of one
bucket, two sets that overlap enough must share one of their rarest shingles, early enough in both of them that enough
others follow; only pairs that do are looked up, once each, and verified on the full sets. Look-alikes below the threshold
with a common core thus meet nowhere, as their rarest shingles are their own. No link between candidates is lost.

With 32 bands of 4 coordinates a pair at similarity 0.75 fails to meet in any band with probability 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import THIN_SLICE, bound_batches, give_back, slices, stage, text_bytes, without_ids
from panelweave.llm.components import connected_components
from panelweave.llm.words import find_words, hash_spans, mix, windows
from panelweave.operators.blocks import spread_join

#: Words per shingle; links need ``100 * intersection >= PERCENT * union``.
WIDTH, PERCENT = 5, 75
#: Bands and coordinates per band.
BANDS, ROWS = 32, 4
#: Sets that start with one shingle, per task that looks it up.
CROWD = 1000
#: Tasks over which the rows of one bucket or one common shingle are dealt when they meet its facts.
DEALT = 8

_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)


def shingle_sets(part: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle numbers of each text of a slice, ascending; texts of fewer words have one shingle of them all."""
    data, bounds = text_bytes(part)
    starts, ends, first = find_words(data, bounds)
    words = hash_spans(data, starts, ends)
    whole = windows(words, WIDTH)
    for low, high in zip(first[:-1], first[1:]):
        n = int(high - low)
        if n >= WIDTH:
            yield np.unique(whole[low: high - WIDTH + 1])
        elif n:
            yield windows(words[low:high], n) ^ np.uint64(n)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates from two permutations of 32-bit numbers, the second circularly shifted."""
    scattered = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(scattered), 512):
        x = scattered[at: at + 512, None] + _SHIFTS[None, :]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=0), out=out)
    return out


_SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()),
                        T.StructField("bands", T.ArrayType(T.LongType()))])


@F.arrow_udf(_SIGNED)
def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Size of the shingle set, digest of the set, band numbers (none for an empty set)."""
    names = np.arange(BANDS, dtype=np.uint64)
    give_back()
    for batch in batches:
        for part in slices(batch, THIN_SLICE):
            sizes, digests, bands = [], [], []
            for shingles in shingle_sets(part):
                sizes.append(len(shingles))
                if not len(shingles):
                    digests.append(None)
                    bands.append(None)
                    continue
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                rows = signature(shingles).astype(np.uint64).reshape(BANDS, ROWS)
                band = names.copy()
                for k in range(ROWS):
                    band = mix(band + rows[:, k] + np.uint64(1))
                bands.append(band.view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                             names=["n_shingles", "set_id", "bands"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def sets_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The whole shingle set of each text."""
    give_back()
    for batch in batches:
        for part in slices(batch, THIN_SLICE):
            found = list(shingle_sets(part))
            cut = np.concatenate([[0], np.cumsum([len(s) for s in found])])
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int64()))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets overlap enough, with all their columns."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_right"))
    # intersection at least percent of the union, the intersection written once
    enough = (100 + percent) * F.size(F.array_intersect("_left", "_right")) >= percent * (F.size("_left") + F.size("_right"))
    return pairs.join(left, "a").join(right, "b").filter(enough).select(*pairs.columns)


def prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of different components (``c_a``, ``c_b``) that may overlap enough: all that do, and few others.

    ``members`` has ``doc_id, n_shingles, component, shingles``. Shingles are ranked from the rarest among these members to the
    commonest. Of two sets that overlap enough, the first common shingle has enough others behind it in both; so each set
    is looked up by its first shingles only, the smaller of two by still fewer. A shingle that many sets start with is dealt
    over as many tasks as it needs. An empty table, and members of one component, give no pair.
    """
    rows = members.select("doc_id", "n_shingles", "component", F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    rows = spread_join(rows, common, ["shingle"], spread=("doc_id",), salts=DEALT)
    # how many shingles of the set come at this rank or behind it
    behind = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("held"), F.desc("shingle")))
    starts = stage(rows.withColumn("behind", behind).filter(100 * F.col("behind") >= percent * F.col("n_shingles")).drop("held"), "prefixes")
    shared = starts.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"))
    starts = spread_join(starts, shared.filter("low <> high").select("shingle", "parts"), ["shingle"], spread=("doc_id",), salts=DEALT)
    dealt = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")

    def side(name: str, part: Column) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{name}") for c in ("n_shingles", "component", "behind")]
        return starts.select("shingle", F.col("doc_id").alias(name), *named, part.alias("part"))

    small = side("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter((100 + percent) * F.col("behind_a") >= 2 * percent * F.col("n_shingles_a"))
    large = side("b", dealt)
    fits = ((F.struct("n_shingles_a", "a") < F.struct("n_shingles_b", "b")) & (F.col("component_a") != F.col("component_b"))
            & ((100 + percent) * F.least("behind_a", "behind_b") >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b"))))
    met = (small["shingle"] == large["shingle"]) & (small["part"] == large["part"])
    return small.join(large, met & fits).select("a", "b", F.col("component_a").alias("c_a"), F.col("component_b").alias("c_b")).distinct()


def relabel(old: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after adding ``links`` between nodes or components to ``old``."""
    if old is None:
        return stage(connected_components(links), "components")
    merged = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = old.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = merged.join(old.select(F.col("component")).distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    return stage(moved.union(fresh), "components")


def labelled(df: DataFrame, components: DataFrame, column: str) -> DataFrame:
    """Add the component of ``column`` as ``c_<column>``; a node without links is its own."""
    named = components.select(F.col("node").alias(column), F.col("component").alias(f"_c_{column}"))
    return df.join(named, column, "left").withColumn(f"c_{column}", F.coalesce(f"_c_{column}", column)).drop(f"_c_{column}")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document with the component of near duplicates it belongs to.

    Columns: the id, ``n_shingles``, ``component_id`` (smallest id reachable over links, itself included), ``kept``
    (whether it is that smallest id). Texts without words, NULL ones too, are linked with nothing, and so is a row
    without id, whose component is NULL and which is kept. Rows that repeat an id count once for links and
    come out as often as they are. Other columns are not read. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = stage(docs.select(F.col(id_col).alias("doc_id"), signed(text).alias("s")).select("doc_id", "s.*"), "signatures")
    classes = stage(made.filter("set_id is not null and doc_id is not null").groupBy("set_id", "n_shingles")
                    .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "value"))
    crowded = banded.groupBy("band", "value").agg(F.min("doc_id").alias("anchor"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = stage(spread_join(banded, crowded.select("band", "value", "anchor"), ["band", "value"], spread=("doc_id",), salts=DEALT), "buckets")

    wanted = met.select("doc_id").distinct()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("slot")
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).filter("doc_id is not null")
    texts = texts.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi")  # 2 ** 20 numbers at most
    sets = stage(texts.select("doc_id", sets_of("text").alias("shingles")).join(wanted, "doc_id", "left_semi")
                 .dropDuplicates(["doc_id"]), "sets")

    # Every class with the smallest anchor it meets.
    first = met.filter("doc_id <> anchor").groupBy("doc_id").agg(F.min("anchor").alias("b")).select(F.col("doc_id").alias("a"), "b")
    components = relabel(None, verified(first, sets, percent))
    # Every class with its other anchors, where those lie elsewhere: one pair for each class and foreign component.
    others = met.filter("doc_id <> anchor").select(F.col("doc_id").alias("a"), F.col("anchor").alias("b")).distinct()
    others = labelled(labelled(others.join(first, ["a", "b"], "left_anti"), components, "a"), components, "b").filter("c_a <> c_b")
    links = verified(stage(others.select("a", "b", "c_a", "c_b"), "others"), sets, percent)
    links = links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    components = relabel(components, links)
    # Whatever shares a bucket and still lies apart; pairs with an anchor are known by now.
    apart = labelled(met, components, "doc_id").withColumnRenamed("c_doc_id", "component")
    split = apart.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    apart = spread_join(apart, split.select("band", "value"), ["band", "value"], "left_semi", spread=("doc_id",), salts=DEALT).filter("doc_id <> anchor")
    doors = stage(apart.groupBy("doc_id", "n_shingles", "component").agg(F.collect_set("value").alias("doors")), "apart")
    near = prefix_pairs(doors.drop("doors").join(sets, "doc_id"), percent)
    doors_of = lambda x: doors.select(F.col("doc_id").alias(x), F.col("doors").alias(f"doors_{x}"))
    near = near.join(doors_of("a"), "a").join(doors_of("b"), "b").filter(F.arrays_overlap("doors_a", "doors_b"))
    links = verified(stage(near.select("a", "b", "c_a", "c_b"), "near"), sets, percent)
    links = links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    components = relabel(components, links)

    member = labelled(classes.select("set_id", "doc_id"), components, "doc_id").select("set_id", F.col("c_doc_id").alias("component"))
    linked = made.filter("set_id is not null and doc_id is not null").join(member, "set_id")
    alone = made.filter("set_id is null or doc_id is null").withColumn("component", F.col("doc_id"))
    every = linked.select("doc_id", "n_shingles", "component").union(alone.select("doc_id", "n_shingles", "component"))
    return every.select(F.col("doc_id").alias(id_col), "n_shingles", F.col("component").alias("component_id"),
                        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, one document of each component.

    A document here is an id with a text, so one without id or of a repeated id is judged by its own text; those with an id
    come before those without. Rows that repeat an id and text share their verdict.
    """
    row_id = "_row_id" + "_" * max(map(len, docs.columns))
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text"))
    named = docs.withColumn(row_id, name)
    groups = near_groups(named, row_id, text_col, percent)
    return without_ids(named, groups.filter("not kept").select(row_id), row_id).drop(row_id)
