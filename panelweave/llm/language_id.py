"""Language of whole texts by unigram piece probabilities, summed over all segmentations.

The vocabulary is a fixed public one (byte pieces, so every text can be segmented). Each language has its own
probabilities of the pieces, learned by expectation-maximisation. A word's probability in a language is the sum over all
ways to cut it into pieces, by a forward recursion; a text's log-probability is the sum over its words.

A word is a space and a run of bytes that are not white space; runs longer than ``RUN`` bytes go on in further words, so the
recursion is bounded. Words repeat, so each slice of texts runs the recursion once per distinct word.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import sample_share, slices, text_bytes
from panelweave.llm.words import find_words, hash_spans

UNKNOWN = "und"
#: Bytes of a word; longest piece used; expected training rows per language; EM rounds; probability no piece falls below.
RUN, LONGEST, ROWS_PER_LANGUAGE, EM_ROUNDS, FLOOR = 48, 12, 1000, 3, 1e-8
#: Bytes of text per slice: longer ones repeat more words.
SLICE = 16 << 20


def read_pieces(vocabulary_file: str) -> list[bytes]:
    """Pieces of a rank file (base64 and number on each line), without those that a word cannot hold."""
    with open(vocabulary_file, "rb") as file:
        pieces = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    white = b"\t\n\v\f\r "
    return [p for p in pieces if len(p) == 1 or len(p) <= LONGEST and not any(c in white for c in p[1:]) and p[:1] not in (b"\t", b"\n", b"\v", b"\f", b"\r")]


class Trie:
    """Byte trie of the pieces as arrays: next node for (node, byte), piece that ends at a node or -1."""

    def __init__(self, pieces: list[bytes]):
        nodes: dict[bytes, int] = {b"": 0}
        for piece in pieces:
            for end in range(1, len(piece) + 1):
                nodes.setdefault(piece[:end], len(nodes))
        self.next = np.zeros((len(nodes), 256), np.int32)  # 0: no such node
        for prefix, node in nodes.items():
            if prefix:
                self.next[nodes[prefix[:-1]], prefix[-1]] = node
        self.piece = np.full(len(nodes), -1, np.int32)
        for number, piece in enumerate(pieces):
            self.piece[nodes[piece]] = number


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, numbers and owners of the words of a slice, long runs cut up."""
    starts, ends, first = find_words(data, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    parts = (ends - starts + RUN - 1) // RUN
    if len(parts) and parts.max() > 1:
        at = np.repeat(starts, parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        ends = np.minimum(at + RUN, np.repeat(ends, parts))
        starts, owner = at, np.repeat(owner, parts)
    return starts, ends - starts, hash_spans(data, starts, ends, lower=False), owner


def by_length(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length as byte matrices with the leading space, and which words they are."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        for at in range(0, len(same), rows):
            which = same[at: at + rows]
            if len(which):
                n = int(lengths[which[0]])
                matrix = np.full((len(which), n + 1), 0x20, np.uint8)
                matrix[:, 1:] = data[starts[which, None] + np.arange(n)]
                yield which, matrix


def arcs(trie: Trie, matrix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """All pieces in equally long words as (start, end, rows, pieces), by start."""
    n = matrix.shape[1]
    for i in range(n):
        rows, node = np.arange(len(matrix)), np.zeros(len(matrix), np.int32)
        for j in range(i, min(n, i + LONGEST)):
            node = trie.next[node, matrix[rows, j]]
            alive = node > 0
            if not alive.all():
                rows, node = rows[alive], node[alive]
            if not len(rows):
                break
            piece = trie.piece[node]
            ends = piece >= 0
            if ends.all():
                yield i, j + 1, rows, piece
            elif ends.any():
                yield i, j + 1, rows[ends], piece[ends]


def forward(trie: Trie, table: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language: the sum over all segmentations. ``table``: pieces by languages."""
    alpha = np.zeros((matrix.shape[1] + 1, len(matrix), table.shape[1]))
    alpha[0] = 1
    for i, j, rows, piece in arcs(trie, matrix):
        alpha[j, rows] += alpha[i, rows] * table[piece]
    return np.log(np.maximum(alpha[-1], 1e-300))


def expected_counts(trie: Trie, p: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over the words, by forward and backward sums."""
    total = np.zeros(len(p))
    for which, matrix in by_length(data, starts, lengths):
        n = matrix.shape[1]
        found = list(arcs(trie, matrix))
        alpha, beta = np.zeros((n + 1, len(matrix))), np.zeros((n + 1, len(matrix)))
        alpha[0], beta[n] = 1, 1
        for i, j, rows, piece in found:
            alpha[j, rows] += alpha[i, rows] * p[piece]
        for i, j, rows, piece in reversed(found):
            beta[i, rows] += beta[j, rows] * p[piece]
        weight = times[which] / np.maximum(alpha[n], 1e-300)
        for i, j, rows, piece in found:
            total += np.bincount(piece, alpha[i, rows] * p[piece] * beta[j, rows] * weight[rows], len(p))
    return total


def trainer(pieces: list[bytes]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(pieces)
        data, bounds = text_bytes(pa.array(rows.sort_values("order").text, pa.large_utf8()))
        starts, lengths, numbers, _ = words_of(data, bounds)
        _, first, times = np.unique(numbers, return_index=True, return_counts=True)
        p = np.full(len(pieces), 1 / len(pieces))
        for _ in range(EM_ROUNDS if len(first) else 0):
            counts = expected_counts(trie, p, data, starts[first], lengths[first], times)
            p = np.maximum(counts / counts.sum(), FLOOR)
        used = np.flatnonzero(p > FLOOR)
        return pd.DataFrame({"lang": [rows.lang.iloc[0]], "at": [used], "p": [p[used]]})

    return train


def fit(docs: DataFrame, vocabulary_file: str, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        rows_per_language: int = ROWS_PER_LANGUAGE) -> dict[str, dict[bytes, float]]:
    """Piece probabilities of every non-NULL language of ``docs``.

    ``rows_per_language`` bounds the expected number of rows learned from per language: beyond it a fixed share of its
    ids takes part, so a language of any size is one bounded group. Texts without letters and NULL texts are left out.
    """
    pieces = read_pieces(vocabulary_file)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("_lang")).agg(F.least(F.lit(1.0), rows_per_language / F.count(F.lit(1))).alias("_share"))
    rows = (known.join(F.broadcast(counts), F.col(lang_col) == F.col("_lang"))  # one row per language
            .filter(sample_share(F.col(id_col), F.col("_share")))
            .select(F.col("_lang").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("order")))
    learned = rows.groupBy("lang").applyInPandas(trainer(pieces), "lang string, at array<long>, p array<double>").collect()  # vocabulary times languages
    return {r["lang"]: {pieces[i]: p for i, p in zip(r["at"], r["p"])} for r in sorted(learned, key=lambda r: r["lang"])}


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def language(text: Column, model: dict[str, dict[bytes, float]], docs: DataFrame) -> Column:
    """Struct of the likeliest language of a whole text and its share of the probability."""
    langs = sorted(model)
    pieces = sorted({bytes([b]) for b in range(256)}.union(*model.values()))
    table = np.array([[model[lang].get(p, FLOOR) for lang in langs] for p in pieces]) if langs else np.zeros((256, 0))
    held = docs.sparkSession.sparkContext.broadcast((langs, pieces, table))

    @F.arrow_udf(_RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, pieces, table = held.value
        trie = Trie(pieces)
        for batch in batches:
            best, share = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in slices(batch, SLICE):
                data, bounds = text_bytes(part)
                starts, lengths, numbers, owner = words_of(data, bounds)
                _, first, which = np.unique(numbers, return_index=True, return_inverse=True)
                value = np.zeros((len(first), len(langs)))
                for at, matrix in by_length(data, starts[first], lengths[first]):
                    value[at] = forward(trie, table, matrix)
                total = np.stack([np.bincount(owner, value[which, k], len(part)) for k in range(len(langs))], axis=1)
                best.append(total.argmax(axis=1))
                share.append(1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1))
            names = pa.array(langs, pa.string()).take(pa.array(np.concatenate(best)))
            yield pa.StructArray.from_arrays([names, pa.array(np.concatenate(share))], names=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, model: dict[str, dict[bytes, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``lang_pred``, ``score`` (share of the likeliest language, 0 to 1).

    A NULL text, one without letters, and any text under a model without languages is ``und`` with score 0. Of equally
    likely languages the first by name is taken. Every row is judged by itself; other columns are not read. An empty
    table gives an empty result.
    """
    text = F.col(text_col)
    lettered = text.isNotNull() & text.rlike(r"\p{L}") if model else F.lit(False)
    judged = docs.select(id_col, lettered.alias("_lettered"), (language(F.coalesce(text, F.lit("")), model, docs) if model else F.lit(None).cast(_RESULT)).alias("_l"))
    return judged.select(id_col, F.when(F.col("_lettered"), F.col("_l.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                         F.when(F.col("_lettered"), F.col("_l.score")).otherwise(0.0).alias("score"))
