"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary of a corpus is counted with DataFrame functions. Every word proposes its neighbours at one edit: all
deletions of a letter, and all replacements by a later letter, so each pair of words is proposed from one side. The
proposals, some hundred per word, never leave the task: their hashes follow from the word's hash by arithmetic and are probed
against broadcast Bloom filters, one for each length of word, whose bits for a word lie in one block of 512. Only what a
filter knows travels, and an exact join with the vocabulary removes the false positives.

The filters of a round hold at most ``FILTER_BYTES``. A larger vocabulary is searched in several rounds, each with the filters
of one part of it, so no neighbour is missed at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import give_back, kept_aside, stage
from panelweave.llm.words import mix

#: A run of letters; the letters of a word after A-Z are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint32)
#: Code points and occurrences a word needs; the modulus of the noise; how much commoner a form is.
SHORTEST, LEAST, NOISE, COMMONER = 5, 3, 97, 2
#: Bits set per word, filter bits per word, bits of a block, bytes of all filters of a round.
PROBES, BITS, BLOCK, FILTER_BYTES = 5, 16, 512, 16 << 20
#: Proposals worked on at a time.
CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE) -> DataFrame:
    """``word``, ``n``: runs of letters in whole texts, some of them with a letter lost, of enough code points and occurrences.

    A run whose ``crc32`` of id, colon and run is a multiple of ``noise`` loses one code point. A NULL id is the empty string there.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(name.alias("_name"), F.explode(F.regexp_extract_all(F.translate(text_col, upper, lower), F.lit(RUN), F.lit(0))).alias("run"))
    # A run of fewer letters cannot become a word.
    runs = runs.filter(F.length("run") >= SHORTEST).withColumn("h", F.crc32(F.concat("_name", "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % noise == 0, lost).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= LEAST)


def code_points(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every length the numbers of the words of it and their code points as a matrix."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == n)
        data = "".join(words[i] for i in which.tolist()).encode("utf-32-le")
        yield which, np.frombuffer(data, np.uint32).reshape(len(which), n)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashes(matrix: np.ndarray) -> np.ndarray:
    """The hash of every row: the sum of its code points times powers of the base."""
    return (matrix.astype(np.uint64) * powers(matrix.shape[1])).sum(axis=1, dtype=np.uint64)


def bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its bits inside the block, one row per probe."""
    x = mix(h)
    block = ((x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    y = mix(x + np.uint64(1))
    return block, np.stack([(y >> np.uint64(9 * k)) & np.uint64(BLOCK - 1) for k in range(PROBES)]).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def bit_places(words: pa.Array, blocks: pa.Array) -> pa.Array:
    """The places of a word's bits in the filter of its length, which has so many blocks."""
    texts, sizes = words.to_pylist(), blocks.to_numpy(zero_copy_only=False)
    out = np.zeros((len(texts), PROBES), np.int64)
    for which, matrix in code_points(texts):
        block, inside = bits(hashes(matrix), int(sizes[which[0]]))
        out[which] = (block * BLOCK + inside).T
    return pa.array(list(out), pa.list_(pa.int64()))


def shards(counts: dict[int, int], limit: int = FILTER_BYTES) -> list[dict[tuple[int, int, int], int]]:
    """Rounds of filters: blocks of each (length, part, parts). A length whose filter passes the limit is parted by hash."""
    rounds: list[dict[tuple[int, int, int], int]] = [{}]
    room = limit * 8 // BLOCK
    left = room
    for length, n in sorted(counts.items()):
        need = n * BITS // BLOCK + 1
        parts = -(-need // room)
        for part in range(parts):
            blocks = -(-need // parts)
            if blocks > left and rounds[-1]:
                rounds.append({})
                left = room
            rounds[-1][length, part, parts] = blocks
            left -= blocks
    return rounds


def build_filters(words: DataFrame, shard: dict[tuple[int, int, int], int]) -> dict[int, list[np.ndarray]]:
    """The filters of a round by length of word: bits are set by tasks and joined by OR; the driver gets what the limit allows."""
    keys = F.create_map(*[F.lit(x) for (length, part, parts), blocks in shard.items() for x in (f"{length}/{part}/{parts}", blocks)])
    parts = F.create_map(*[F.lit(x) for length, _, n in shard for x in (length, n)])
    size = F.length("word")
    named = words.withColumn("_parts", F.try_element_at(parts, size)).filter("_parts is not null")
    named = named.withColumn("shard", F.concat_ws("/", size, F.pmod(F.xxhash64("word"), F.col("_parts")), "_parts"))
    named = named.withColumn("_blocks", F.try_element_at(keys, F.col("shard"))).filter("_blocks is not null")
    places = named.select("shard", F.explode(bit_places("word", "_blocks")).alias("place"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    longs = places.groupBy("shard", F.floor(F.col("place") / 64).cast("long").alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out: dict[int, list[np.ndarray]] = {}
    names, at, masks = (longs.column(c).combine_chunks() for c in ("shard", "at", "mask"))
    names, at, masks = names.to_numpy(zero_copy_only=False), at.to_numpy(), masks.to_numpy()
    for (length, part, n), blocks in shard.items():
        table = np.zeros(blocks * BLOCK // 64, np.int64)
        here = names == f"{length}/{part}/{n}"
        table[at[here]] = masks[here]
        out.setdefault(length, []).append(table.view(np.uint64))
    return out


def known(h: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    """Which hashes some filter of their length may hold."""
    out = np.zeros(len(h), bool)
    for table in filters:
        block, inside = bits(h, len(table) * 64 // BLOCK)
        hit = np.ones(len(h), bool)
        for row in inside:
            place = block * BLOCK + row
            hit &= (table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        out |= hit
    return out


def proposals(matrix: np.ndarray, filters: dict[int, list[np.ndarray]]) -> Iterator[tuple[int, str]]:
    """For words of one length the edits that the filters know: (row, edited word). Long words are worked on in ranges of places."""
    n, length = matrix.shape
    power, whole = powers(length), hashes(matrix)
    values = matrix.astype(np.uint64)

    def written(row: int, at: int, letter: int | None) -> str:
        code = matrix[row]
        middle = code[:0] if letter is None else np.array([letter], np.uint32)
        return np.concatenate([code[:at], middle, code[at + 1:]]).tobytes().decode("utf-32-le")

    step = max(1, CHUNK // (max(1, n) * len(LETTERS)))
    for low in range(0, length, step):
        at = np.arange(low, min(length, low + step))
        if length in filters:  # replacements by a later letter
            later = LETTERS[None, None, :] > matrix[:, at, None]
            h = whole[:, None, None] + (LETTERS.astype(np.uint64)[None, None, :] - values[:, at, None]) * power[None, at, None]
            row, place, letter = np.nonzero(later)
            hit = known(h[later], filters[length])
            for r, p, c in zip(row[hit].tolist(), place[hit].tolist(), letter[hit].tolist()):
                yield r, written(r, low + p, int(LETTERS[c]))
    if length - 1 in filters:  # deletions; of a run of equal letters the first
        terms = values * power
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        h = before + (whole[:, None] - before - terms) * _INVERSE
        first = np.ones(matrix.shape, bool)
        first[:, 1:] = matrix[:, 1:] != matrix[:, :-1]
        row, place = np.nonzero(first)
        hit = known(h[first], filters[length - 1])
        for r, p in zip(row[hit].tolist(), place[hit].tolist()):
            yield r, written(r, p, None)


_PROPOSED = "word string, n long, near string"


def propose(words: DataFrame, filters: Broadcast) -> DataFrame:
    """``word``, ``n``, ``near`` for every edit of a word that the filters know."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for which, matrix in code_points(texts):
                rows = max(1, CHUNK // (matrix.shape[1] * len(LETTERS)))
                for low in range(0, len(which), rows):
                    part, near = [], []
                    for r, found in proposals(matrix[low: low + rows], filters.value):
                        part.append(int(which[low + r]))
                        near.append(found)
                    yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in part], pa.string()), pa.array([counts[i] for i in part], pa.int64()), pa.array(near, pa.string())],
                                                     names=["word", "n", "near"])

    return words.select("word", "n").mapInArrow(run, _PROPOSED)


def near_pairs(words: DataFrame, limit: int = FILTER_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Every pair of words one edit apart, once in each direction: ``word``, ``n``, ``near``, ``near_n``; and the tables to unpersist."""
    spark = words.sparkSession
    counts = {r["k"]: r["m"] for r in words.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}  # one row per length
    found, aside = None, []
    for shard in shards(counts, limit):
        if not shard:
            continue
        filters = spark.sparkContext.broadcast(build_filters(words, shard))  # at most ``limit`` bytes
        positive = kept_aside(propose(words, filters))
        aside.append(positive)
        found = positive if found is None else found.unionByName(positive)
        filters.unpersist()
    if found is None:
        return spark.createDataFrame([], "word string, n long, near string, near_n long"), aside
    target = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = kept_aside(found.distinct().join(target, "near").select("word", "n", "near", "near_n"))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return both, [*aside, pairs]


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of ``word``, ``form``: forms followed to the last, by doubling the reach until nothing moves.

    A form is at least twice as common as its word, so a chain has no more links than a count has bits.
    """
    moving, aside = forms.filter("form is not null").select("word", F.col("form").alias("root")), []
    while True:
        following = moving.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = kept_aside(moving.join(following, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moving, aside = moved.drop("_moved"), [*aside, moved]
        if moved.filter("_moved").isEmpty():
            break
    ends = stage(moving, "spelling-roots")
    for table in aside:
        table.unpersist()
    return ends


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FILTER_BYTES) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are counted as in :func:`vocabulary`. Two words are near if one inserted, deleted or replaced code point parts
    them. The form of a word is its near word of largest count (ties: the smallest in code-point order) if that is
    at least twice as common, else NULL; ``root`` is the end of the chain of forms, the word itself without one. NULL
    and empty texts have no words; every row counts, repeated ids and equal rows too. Words of any length take part.
    Other columns are not read. An empty table gives an empty result.
    """
    words = stage(vocabulary(docs, id_col, text_col), "vocabulary")
    pairs, aside = near_pairs(words, limit)
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near"))).alias("_best")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    commoner = -F.col("_best.k") >= COMMONER * F.col("n")
    forms = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(commoner, F.col("_best.near")).alias("form"),
                                F.when(commoner, -F.col("_best.k")).alias("form_n")), "spelling-forms")
    for table in aside:
        table.unpersist()
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
