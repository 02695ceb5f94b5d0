"""Alignment of two tokenizers' tokens by whitespace-token anchors.

Where a token of each ends at the same byte and the next token of each is marked with a space, that place is an anchor;
anchors split a document into windows of token ids. A space before a sign that is no white space is always one: no
token of the first tokenizer goes on over it, and no piece of the second holds a space behind another sign. So a text without
other spaces is tokenised word by word, and since words recur all over a corpus, a process remembers the window of a
word. Any other text is tokenised whole, and its windows are remembered under their two tuples of ids. Inside a window the
bytes where tokens of both end cut the tokens into groups, and all tokens of a group are linked with each other.

The number of documents that hold a pair linked is counted over distinct pairs per document. The commonest pairs, a bounded
number, are looked up in a broadcast table; all others are joined.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from panelweave.llm.common import process_state, slices, stage

#: Fixed value: how the byte-level tokenizer splits text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Windows a process remembers before it starts afresh, the tokens or code points up to which it does; new words tokenised at a time.
REMEMBERED, SHORT, WORDS = 100_000, 64, 256
#: Pairs that more than one in so many (document, pair) rows hold are looked up by broadcast; there are fewer of them.
HOT = 1 << 16


def byte_level_bytes() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level_vocabulary(definition: str) -> dict[bytes, int]:
    """Entries of a byte-level tokenizer's JSON as bytes; special tokens are left out, so their strings are plain text."""
    read = json.loads(definition)
    special = {t["id"] for t in read["added_tokens"]}
    letters = byte_level_bytes()
    return {bytes(letters[c] for c in entry): i for entry, i in read["model"]["vocab"].items() if i not in special}


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, ``<0xHH>`` one byte."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())]


def word_by_word(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether a piece model tokenises words apart: it changes no sign, and a space inside a piece follows nothing but spaces."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    normalizer = proto.normalizer_spec
    plain = not normalizer.precompiled_charsmap and not normalizer.remove_extra_whitespaces and normalizer.add_dummy_prefix and normalizer.escape_whitespaces
    known = proto.trainer_spec.model_type == proto.trainer_spec.BPE and not any(p.type == p.USER_DEFINED for p in proto.pieces)
    return plain and known and not any("▁" in p.piece[1:] and p.piece.strip("▁") for p in proto.pieces)


def ragged(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    n = stop - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Windows:
    """Alignments of windows under their tuples of ids, remembered within bounds and numbered."""

    def __init__(self, definition: str, model: bytes):
        vocabulary = byte_level_vocabulary(definition)
        # Ids follow the order of the merges, so they are the ranks.
        self.first = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes, self.b_bytes = [b""] * (max(vocabulary.values()) + 1), piece_bytes(self.second)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = entry
        self.a_length, self.b_length = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        self.a_flat, self.b_flat = ((np.frombuffer(b"".join(table), np.uint8), np.cumsum(n) - n) for table, n in ((self.a_bytes, self.a_length), (self.b_bytes, self.b_length)))
        self.a_marked, self.b_marked = (np.array([x[:1] == b" " for x in table]) for table in (self.a_bytes, self.b_bytes))
        # What a token adds to the text of its group: inside, or as the last of its side.
        self.written = [f"{i}{sign}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for sign in (",", last) for i in range(n)]
        self.apart = word_by_word(self.second)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        #: By word its window, or -1 for what only a whole text tells.
        self.words: dict[str, int] = {}
        self.text: list[str] = []
        #: By window: tokens of both, groups, links, where its distinct pairs end. By pair: its number and links.
        self.n_a, self.n_b, self.groups, self.links, self.end, self.pairs, self.times = (np.zeros(0, np.int64) for _ in range(7))

    def align(self, a: np.ndarray, b: np.ndarray, a_start: np.ndarray, b_start: np.ndarray, windows: tuple[np.ndarray, ...]) -> None:
        """Add windows, given by where their tokens in ``a`` and ``b`` begin and end, in order of place; ``*_start`` are the tokens' bytes."""
        p, q, r, s = windows
        at, bt = ragged(p, q), ragged(r, s)
        a, b, a_end, b_end = a[at].astype(np.int64), b[bt].astype(np.int64), a_start[at + 1], b_start[bt + 1]
        a_window = np.repeat(np.arange(len(p)), q - p)
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        n_a, n_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        window = a_window[a_first]
        groups, links = np.bincount(window, minlength=len(p)), np.bincount(window, n_a * n_b, len(p)).astype(np.int64)
        # Texts: the tokens of both sides in order of groups, as places in the table of what they add.
        a_last, b_last = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_first[a_group]] = a + len(self.a_bytes) * a_last
        order[np.arange(len(b)) + (a_first + n_a)[b_group]] = 2 * len(self.a_bytes) + b + len(self.b_bytes) * b_last
        written = list(map(self.written.__getitem__, order.tolist()))
        ends = np.cumsum((q - p) + (s - r)).tolist()
        self.text += ["".join(written[low:high]) for low, high in zip([0, *ends], ends)]
        # Links: every token of a group with every one of the other side; by distinct ids where a group is large.
        large = n_a * n_b > 4096
        rep = np.where(large[a_group], 0, n_b[a_group])
        partner = ragged(b_first[a_group], b_first[a_group] + rep)
        key = [np.repeat(a_window, rep) << 32 | (np.repeat(a, rep) * len(self.b_bytes) + b[partner])]
        times = [np.ones(len(partner), np.int64)]
        for g in np.flatnonzero(large).tolist():
            left, m = np.unique(a[a_first[g]: a_first[g] + n_a[g]], return_counts=True)
            right, n = np.unique(b[b_first[g]: b_first[g] + n_b[g]], return_counts=True)
            key.append(int(window[g]) << 32 | (left[:, None] * len(self.b_bytes) + right[None, :]).ravel())
            times.append((m[:, None] * n[None, :]).ravel())
        distinct, inverse = np.unique(np.concatenate(key), return_inverse=True)
        before = self.end[-1] if len(self.end) else 0
        self.end = np.append(self.end, before + np.searchsorted(distinct >> 32, np.arange(1, len(p) + 1)))
        self.pairs = np.append(self.pairs, distinct & 0xFFFFFFFF)
        self.times = np.append(self.times, np.bincount(inverse, np.concatenate(times), len(distinct)).astype(np.int64))
        self.groups, self.links = np.append(self.groups, groups), np.append(self.links, links)
        self.n_a, self.n_b = np.append(self.n_a, q - p), np.append(self.n_b, s - r)

    def gives(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        """Whether the tokens of both give a text back byte by byte."""
        raw = np.frombuffer(text.encode(), np.uint8)
        for ids, table, first, length in ((a, *self.a_flat, self.a_length), (b, *self.b_flat, self.b_length)):
            if length[ids].sum() != len(raw) or (table[ragged(first[ids], first[ids] + length[ids])] != raw).any():
                return False
        return True

    def tokenise(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """The ids of both for each text, and whether they give it back."""
        spaced = [f" {text}" for text in texts]
        a_parts = [self.first.encode_to_numpy(text, disallowed_special=()) for text in spaced]
        b_parts = [np.array(array("I", ids), np.uint32) for ids in self.second.encode(texts, num_threads=1)] if texts else []
        return a_parts, b_parts, [self.gives(a, b, text) for a, b, text in zip(a_parts, b_parts, spaced)]

    def anchors(self, a: np.ndarray, b: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, ...]:
        """Of the ids of texts, ``sizes`` of the first for each: where their tokens, the texts and the windows start in bytes, and the end of each."""
        a_start, b_start = (np.concatenate([[0], np.cumsum(length[ids])]) for length, ids in ((self.a_length, a), (self.b_length, b)))
        edges = a_start[np.concatenate([[0], np.cumsum(sizes)])]
        anchors = np.intersect1d(a_start[:-1][self.a_marked[a]], b_start[:-1][self.b_marked[b]], assume_unique=True)
        return a_start, b_start, edges, np.union1d(anchors, edges)

    def learn(self, words: list[str]) -> dict[str, int]:
        """The windows of distinct new words; short ones are remembered."""
        found = {word: -1 for word in words}
        fit = [word for word in words if word and not word[0].isspace() and "▁" not in word]
        groups = [fit[low: low + WORDS] for low in range(0, len(fit), WORDS)]
        a_parts, b_parts, given = self.tokenise([" ".join(group) for group in groups])
        a_parts, b_parts, groups = (list(compress(x, given)) for x in (a_parts, b_parts, groups))
        fit = list(chain.from_iterable(groups))
        if fit:
            a, b = np.concatenate(a_parts), np.concatenate(b_parts)
            a_start, b_start, _, anchors = self.anchors(a, b, [len(x) for x in a_parts])
            if len(anchors) == len(fit) + 1:  # a window for each word
                a_at, b_at, following = np.searchsorted(a_start, anchors), np.searchsorted(b_start, anchors), len(self.text)
                self.align(a, b, a_start, b_start, (a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]))
                found.update(zip(fit, range(following, following + len(fit))))
        self.words.update((word, number) for word, number in found.items() if len(word) <= SHORT)
        return found

    def by_words(self, texts: list[str]) -> list[list[int] | None]:
        """The windows of each text from its words; None for a text that takes more."""
        if not self.apart:
            return [None] * len(texts)
        split = [text.split(" ") for text in texts]
        new = dict.fromkeys(word for word in set(chain.from_iterable(split)) if word not in self.words)
        fresh = self.learn(sorted(new)) if new else {}
        long = {word: number for word, number in fresh.items() if len(word) > SHORT}
        get = {**self.words, **long}.__getitem__ if long else self.words.__getitem__
        numbers = [list(map(get, words)) for words in split]
        return [None if -1 in each else each for each in numbers]

    def whole(self, texts: list[str]) -> list[list[int] | None]:
        """The windows of each text from its tokens; None for a text that they do not give back."""
        out: list[list[int] | None] = [None] * len(texts)
        a_parts, b_parts, given = self.tokenise(texts)
        which, a_parts, b_parts = (list(compress(x, given)) for x in (range(len(texts)), a_parts, b_parts))
        if not which:
            return out
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        a_start, b_start, edges, anchors = self.anchors(a, b, [len(x) for x in a_parts])
        a_at, b_at = np.searchsorted(a_start, anchors), np.searchsorted(b_start, anchors)
        # Both tuples of a window one after the other, ids of the second above those of the first.
        both = np.empty(len(a) + len(b), np.uint32)
        both[np.arange(len(a)) + np.repeat(b_at[:-1], np.diff(a_at))] = a
        both[np.arange(len(b)) + np.repeat(a_at[1:], np.diff(b_at))] = b + np.uint32(len(self.a_bytes))
        raw, at, known = both.tobytes(), (4 * (a_at + b_at)).tolist(), self.number
        keys = [raw[low:high] for low, high in zip(at, at[1:])]
        number, new, following = list(map(known.get, keys)), [], len(self.text)
        for i in [i for i, found in enumerate(number) if found is None]:
            key = keys[i]
            number[i] = known.get(key)
            if number[i] is None:  # the first of its kind
                number[i], following = following, following + 1
                new.append(i)
                if len(key) <= 4 * SHORT:
                    known[key] = number[i]
        if new:
            at = np.array(new)
            self.align(a, b, a_start, b_start, (a_at[at], a_at[at + 1], b_at[at], b_at[at + 1]))
        cut = np.searchsorted(anchors, edges).tolist()
        for k, low, high in zip(which, cut, cut[1:]):
            out[k] = number[low:high]
        return out

    def documents(self, texts: list[str]) -> list[tuple]:
        """For each text: tokens of both, groups, links, digest of the groups, distinct pairs, links of each pair."""
        if max(len(self.text), len(self.words)) > REMEMBERED:
            self.forget()
        out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
        filled = [k for k, text in enumerate(texts) if text]
        numbers = dict(zip(filled, self.by_words([texts[k] for k in filled])))
        rest = [k for k in filled if numbers[k] is None]
        numbers.update(zip(rest, self.whole([texts[k] for k in rest])))
        which = [k for k in filled if numbers[k] is not None]
        if not which:
            return out
        n = np.array([len(numbers[k]) for k in which])
        window = np.fromiter(chain.from_iterable(numbers[k] for k in which), np.int64, n.sum())
        owner = np.repeat(np.arange(len(which)), n)
        n_a, n_b, groups, links = (np.bincount(owner, x[window], len(which)).astype(np.int64).tolist() for x in (self.n_a, self.n_b, self.groups, self.links))
        start, end = np.append(0, self.end)[window], self.end[window]
        place = ragged(start, end)
        distinct, inverse = np.unique(np.repeat(owner, end - start) << 32 | self.pairs[place], return_inverse=True)
        total = np.bincount(inverse, self.times[place]).astype(np.int64)
        bounds = np.searchsorted(distinct >> 32, np.arange(len(which) + 1)).tolist()
        pairs = distinct & 0xFFFFFFFF
        for x, k in enumerate(which):
            text = "".join(map(self.text.__getitem__, numbers[k]))[:-1]
            low, high = bounds[x], bounds[x + 1]
            out[k] = (n_a[x], n_b[x], groups[x], links[x], hashlib.sha256(text.encode()).hexdigest(), pairs[low:high], total[low:high])
        return out


_ALIGNED = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])


def aligned(text: Column, tokenizers: Broadcast) -> Column:
    """The alignment of each whole text as a struct; a pair is the first id times the size of the second vocabulary, plus the second id."""
    @F.arrow_udf(_ALIGNED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        definition, model = tokenizers.value
        windows = process_state(("alignment", hash(definition), hash(model)), lambda: Windows(definition, model))
        for batch in batches:
            for part in slices(batch):
                columns = zip(*windows.documents(part.to_pylist()))
                arrays = [pa.array(column, kind) for column, kind in zip(columns, [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2)]
                yield pa.StructArray.from_arrays(arrays, names=_ALIGNED.names)

    return run(F.coalesce(text, F.lit("")))


def pair_counts(staged: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """``pair``, ``n_docs`` (rows that hold it linked), ``best`` (1 if no pair of its first id is in more rows)."""
    counts = stage(staged.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pair-counts")
    first = F.floor(F.col("pair") / sizes[1]).cast("long")
    top = counts.groupBy(first.alias("_first")).agg(F.max("n_docs").alias("_top"))
    joined = counts.withColumn("_first", first).join(top, "_first")
    return stage(joined.select("pair", "n_docs", (F.col("n_docs") == F.col("_top")).cast("long").alias("best")), "pair-best")


def align_documents(docs: DataFrame, first_file: str, second_file: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``first_file`` is a byte-level tokenizer (JSON) that encodes a space and the text, ``second_file`` a piece model that
    adds the space itself; both without special tokens, whose strings are plain text. The count of a pair of ids is
    the number of rows that hold it linked. ``n_best`` are links whose count is the highest of their first id, ties
    included; ``count_sum`` adds the counts up over links. NULL and empty texts, and texts that the tokens of either tokenizer
    do not give back byte by byte, have zeros and an empty digest. Every row is a document, repeated ids and equal
    rows too. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(first_file, encoding="utf-8") as file:
        definition = file.read()
    with open(second_file, "rb") as file:
        model = file.read()
    sizes = (max(byte_level_vocabulary(definition).values()) + 1, sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size())
    if sizes[0] * sizes[1] >= 1 << 32:
        raise ValueError("the vocabularies have too many pairs of ids for 32 bits")
    made = docs.select(F.col(id_col).alias("doc_id"), aligned(F.col(text_col), spark.sparkContext.broadcast((definition, model))).alias("x"))
    # The number of a row is fixed by this table; rows with equal ids and texts stay apart.
    staged = stage(made.select("doc_id", "x.*").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(staged, sizes)
    total = staged.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0]
    common = F.broadcast(counts.filter(F.col("n_docs") > total / hot))  # fewer than ``hot`` rows, as the counts add up to the total
    rare = counts.filter(F.col("n_docs") <= total / hot)
    links = staged.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))

    sums = (summed(links.join(common, "pair")).unionByName(summed(links.join(common, "pair", "left_anti").join(rare, "pair")))
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    result = staged.drop("pairs", "times").join(sums, "row", "left")
    return result.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                         F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
