"""Best-two-fit packing of token sequences.

How to fill sequences depends only on how many pieces there are of each length, and a length is 1 to the capacity. So the
plan is made once from a histogram with at most ``capacity`` entries, whatever the corpus: fill a sequence greedily,
then replace its smallest document by two unpacked ones that fill the opened gap more tightly, and use the pattern found
as often as the counts allow. Every pattern uses up at least one length (or leaves fewer than twice its use), so
patterns are few. Spark then numbers the pieces of each length and looks up the place of each number.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from panelweave.llm.common import bound_batches, process_state, slices, small_table, stage
from panelweave.llm.token_count import SEGMENT, SHORT, segments

CAPACITY, END_ID = 2048, 0
#: Rows that share a numbering group on average; words a process remembers per generation.
GROUP_ROWS, REMEMBERED = 20_000, 150_000

#: White space is a boundary of the word tokenizer, and so is the end of a run of letters before signs that no contraction or
#: special token begins with.
WORD = re.compile(r"[^ \t-\r]+")
_LATIN = "a-zß-öø-ÿ"
PARTS = re.compile(rf"([{_LATIN}]*)([.,;:!?#*$%&()]*)")
_LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
#: Signs that Python takes for white space and the tokenizer does not.
_NO_SPACE = "\x1c\x1d\x1e\x1f"


def unsigned(ids: list[int]) -> bytes:
    """Unsigned 32-bit numbers, little-endian."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Recent:
    """Values by key in two generations: what was not asked for while the younger one filled up is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.young[key] = value
        return value


class PieceIds:
    """Token ids of words as bytes (unsigned 32-bit, little-endian), remembered within bounds."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores are taken by other tasks
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {ord(c): bytewise.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.words, self.runs = Recent(REMEMBERED), Recent(REMEMBERED)

    def run(self, letters: str) -> bytes:
        """A run of lower-case Latin letters goes to the merges at once: neither normalised nor split further."""
        ids = self.runs.get(letters)
        if ids is None:
            ids = unsigned([t.id for t in self.model.tokenize(letters.translate(self.alphabet))])
            if len(letters) <= SHORT:
                self.runs.young[letters] = ids
        return ids

    def whole(self, word: str) -> bytes:
        return unsigned(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        parts = PARTS.fullmatch(word)
        if parts is None or not parts[1]:
            return self.whole(word)
        if not parts[2]:
            return self.run(word)
        signs = self.runs.get(parts[2])
        if signs is None:
            signs = self.whole(parts[2])
            if len(parts[2]) <= SHORT:
                self.runs.young[parts[2]] = signs
        return self.run(parts[1]) + signs

    def encode_words(self, words: list[str]) -> bytes:
        table, long = self.words.young, {}
        for word in set(words).difference(table):
            ids = self.words.get(word)
            if ids is None:
                ids = self.word(word)
                (table if len(word) <= SHORT else long)[word] = ids
        if long:
            return b"".join([long[w] if w in long else table[w] for w in words])
        return b"".join(map(table.__getitem__, words))

    def encode(self, text: str) -> bytes:
        self.words.turn()
        self.runs.turn()
        if len(text) > SEGMENT:
            return b"".join([self.encode_words([w for piece in part for w in split_words(piece)]) for part in segments(text, WORD)])
        return self.encode_words(split_words(text))


def split_words(text: str) -> list[str]:
    """The words between white space, lower-cased where that is the same letter by letter, so that fewer differ.

    Special tokens are matched before letters are lowered, so a text that could hold one stays as it is.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORD.findall(text)
    if "<|" not in text:
        text = text.lower()
    return WORD.findall(text) if any(c in text for c in _NO_SPACE) else text.split()


def encoder_for(definition: str) -> PieceIds:
    """The encoder of this process: tasks that follow each other share the tokenizer and what it remembers."""
    return process_state(("packing", definition), lambda: PieceIds(definition))


_PIECE = T.StructType([T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def document_pieces(text: Column, definition: str, capacity: int, end_id: int, with_ids: bool = False) -> Column:
    """Pieces of a text's ids as an array of (length, ids_crc32), and the ids themselves if asked for."""
    kind = T.StructType([*_PIECE.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    end = unsigned([end_id])

    @F.arrow_udf(T.ArrayType(kind))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_for(definition)
        for batch in batches:
            for part in slices(batch, SEGMENT):
                bounds, length, crc, ids = [0], [], [], []
                for text in part.to_pylist():
                    encoded = encoder.encode(text) + end
                    for at in range(0, len(encoded), 4 * capacity):
                        piece = encoded[at: at + 4 * capacity]
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        if with_ids:
                            ids.append(piece)
                    bounds.append(len(length))
                fields = {"length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    fields["ids"] = pa.array(ids, pa.binary())
                yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))

    return cut(F.coalesce(text, F.lit("")))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (times used, {length: copies}) that use every piece exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return patterns
        pattern, gap = Counter(), capacity
        spare = left.copy()
        while True:  # greedily: the longest that fits, as many as fit
            fitting = np.flatnonzero(spare[: gap + 1])
            if not len(fitting):
                break
            longest = int(fitting[-1])
            copies = min(int(spare[longest]), gap // longest)
            pattern[longest] += copies
            spare[longest] -= copies
            gap -= copies * longest
        if gap and sum(pattern.values()) > 1:
            smallest = min(pattern)
            pair = best_pair(spare, gap + smallest, smallest)
            if pair:
                pattern[smallest] -= 1
                pattern += Counter(pair)  # drops a count of zero
        times = min(int(left[length]) // copies for length, copies in pattern.items())
        for length, copies in pattern.items():
            left[length] -= times * copies
        patterns.append((times, dict(sorted(pattern.items(), reverse=True))))


def best_pair(spare: np.ndarray, room: int, smallest: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest up to ``room``, if that is more than ``smallest``."""
    lengths = np.flatnonzero(spare[: room + 1])
    if not len(lengths):
        return None
    partner = np.searchsorted(lengths, room - lengths, "right") - 1
    value = np.where(partner >= 0, lengths[np.maximum(partner, 0)], -1)
    same = (value == lengths) & (spare[lengths] < 2)  # one piece cannot be both
    value = np.where(same, np.where(partner > 0, lengths[np.maximum(partner - 1, 0)], -1), value)
    total = np.where(value > 0, value + lengths, 0)
    best = int(np.argmax(total))
    return (int(lengths[best]), int(value[best])) if total[best] > smallest else None


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first number, end, first sequence, copies, offset): where the numbered pieces of a length go."""
    rows, used, sequence = [], Counter(), 0
    for times, pattern in patterns:
        offset = 0
        for length, copies in pattern.items():
            rows.append((length, used[length], used[length] + times * copies, sequence, copies, offset))
            used[length] += times * copies
            offset += copies * length
        sequence += times
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity`` and columns ``doc_id``, ``piece``."""
    spark = pieces.sparkSession
    total = pieces.count()
    groups = max(1, total // GROUP_ROWS)
    pieces = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    counts = stage(pieces.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = places(plan(histogram, capacity))
    names = ["length", "low", "high", "first", "copies", "at"]
    table = F.broadcast(small_table(spark, rows, names))  # bounded by the capacity, not by the corpus
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_group", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece")) - 1
    numbered = pieces.withColumn("_number", number).join(starts, ["length", "_group"]).withColumn("_number", F.col("_number") + F.col("_before"))
    joined = numbered.join(table, (numbered["length"] == table["length"]) & (F.col("_number") >= table["low"]) & (F.col("_number") < table["high"])).drop(table["length"])
    place = F.col("_number") - F.col("low")
    return (joined.withColumn("sequence_id", F.col("first") + F.floor(place / F.col("copies")))
            .withColumn("offset", F.col("at") + place % F.col("copies") * F.col("length"))
            .drop("_number", "_before", "_group", "low", "high", "first", "copies", "at"))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most ``capacity`` tokens.

    Columns: the id, ``piece``, ``start`` (ids of the document before it), ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``; ``ids`` (little-endian unsigned 32-bit) if asked for. A document is the ids of its text, then
    ``end_id``; a NULL or empty text is that one id. Only longer documents are cut. Repeated rows are packed as often as
    they come, rows without id too. Other columns are not read. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as file:
        definition = file.read()
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(document_pieces(F.col(text_col), definition, capacity, end_id, with_ids)).alias("piece", "p"))
    pieces = stage(cut.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece").cast("long") * capacity).alias("start"), "p.*"), "pieces")
    packed = pack_pieces(pieces, capacity)
    return packed.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence from the rows of ``pack(..., with_ids=True)``: ``sequence_id``, ``n_tokens``, ``ids``.

    A sequence holds at most the capacity, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.concat(F.lit(b""), F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))).alias("ids"))
