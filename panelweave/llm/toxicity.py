"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Features are single words, pairs of neighbours and
pairs with one word between, hashed to ``2 ** BITS`` coordinates. Each coordinate has its own learning rate, and L1 sets
most weights to exactly zero; what is left is a small table that every task gets as a broadcast.

Training takes a bounded sample of labelled rows, dealt to a fixed number of groups by id. In a round every group goes
on from the common state over its rows, a few times; the driver averages the groups' states (bounded by the coordinates).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import THIN_SLICE, bound_batches, give_back, sample_share, slices, stage, text_bytes
from panelweave.llm.words import find_words, hash_spans, mix

#: Hash bits; expected rows of the training sample; groups that learn side by side; rounds, and passes in each.
BITS, MAX_ROWS, GROUPS, ROUNDS, EPOCHS = 18, 20_000, 4, 3, 3
#: FTRL-proximal parameters: learning rate, smoothing, L1, L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
#: Coordinate of the constant term (not penalised).
BIAS = 1 << BITS

_SEPARATOR = np.ones(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _SEPARATOR[_low:_high + 1] = False


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features in a slice of texts, and the text each belongs to."""
    starts, ends, first = find_words(data, bounds, _SEPARATOR)
    words = hash_spans(data, starts, ends)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    found, owner = [words >> shift], [text]
    for gap in (1, 2):
        if len(words) > gap:
            pair = mix(words[:-gap] * np.uint64(2 * gap + 1) + words[gap:]) >> shift
            same = text[:-gap] == text[gap:]
            found.append(pair[same])
            owner.append(text[:-gap][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal step in closed form."""
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    return w


def learn(z: np.ndarray, n: np.ndarray, rows: Iterator[np.ndarray], labels: Iterator[float]) -> None:
    """One pass of FTRL over rows of distinct coordinates, changing ``z`` and ``n`` in place."""
    for at, label in zip(rows, labels):
        at = np.append(at, BIAS)
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0
        w[-1] = -zi[-1] / ((BETA + np.sqrt(ni[-1])) / ALPHA)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(ni + gradient * gradient) - np.sqrt(ni)) / ALPHA
        z[at] = zi + gradient - sigma * w
        n[at] = ni + gradient * gradient


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def distinct_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct coordinates of each text, ascending."""
    give_back()
    for batch in batches:
        for part in slices(batch, THIN_SLICE):
            data, bounds = text_bytes(part)
            at, text = features(data, bounds)
            key = np.unique((text << (BITS + 1)) | at)
            cut = np.searchsorted(key >> (BITS + 1), np.arange(len(part) + 1))
            yield pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key & (2 * BIAS - 1), pa.int32()))


def training_round(state: Broadcast, number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("order")
        z, n = (x.astype(np.float64) for x in state.value)
        for epoch in range(EPOCHS):
            shuffled = part.sample(frac=1, random_state=number * EPOCHS + epoch)
            learn(z, n, iter(shuffled.features), iter(shuffled.label))
        return pd.DataFrame({"part": [part.part.iloc[0]], "z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS, groups: int = GROUPS, rounds: int = ROUNDS) -> dict[int, float]:
    """Learn weights from ``docs`` that ``labels`` (id, 0/1) marks; return the non-zero ones by coordinate.

    ``max_rows`` bounds the expected number of rows learned from: beyond it a fixed share of the ids takes part. Rows
    without label are left out; several labels of one id count as their largest. Without rows only the constant is
    left, and every score is one half.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    total = marked.count()
    if total > max_rows:
        marked = marked.filter(sample_share(F.col(id_col), F.lit(max_rows / total)))
    rows = stage(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
                 .join(F.broadcast(marked), id_col)  # about max_rows small rows
                 .select(F.xxhash64(id_col).alias("order"), F.col("_label").cast("double").alias("label"), distinct_features("_text").alias("features")),
                 "toxicity-rows")
    rows = rows.withColumn("part", F.pmod("order", F.lit(groups)))
    z, n = np.zeros(BIAS + 1, np.float32), np.zeros(BIAS + 1, np.float32)
    for number in range(rounds):
        state = spark.sparkContext.broadcast((z, n))
        # two numbers per coordinate and group, as Arrow: as rows they would lie in the driver's heap decoded and pickled
        learned = rows.groupBy("part").applyInPandas(training_round(state, number), "part long, z binary, n binary").toArrow().sort_by("part")
        if not learned.num_rows:
            break
        z, n = (sum(np.frombuffer(x.as_buffer(), np.float32) / learned.num_rows for x in learned[name]) for name in ("z", "n"))
        state.unpersist()
    w = weights(z, n)
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def score(text: Column, model: dict[int, float], docs: DataFrame) -> Column:
    """Probability of label 1 for each whole text; NULL counts as empty, and an empty text scores by the constant alone."""
    bound_batches(docs.sparkSession)
    at = np.array(sorted(model), np.int64)
    held = docs.sparkSession.sparkContext.broadcast((at, np.array([model[i] for i in at], np.float32)))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, values = held.value
        table = np.zeros(BIAS + 1, np.float32)
        table[at] = values
        active = table != 0
        give_back()
        for batch in batches:
            for part in slices(batch, THIN_SLICE):
                data, bounds = text_bytes(part)
                at, text = features(data, bounds)
                hit = active[at]
                key = np.unique((text[hit] << (BITS + 1)) | at[hit])
                total = np.bincount(key >> (BITS + 1), table[key & (2 * BIAS - 1)].astype(np.float64), len(part)) + float(table[BIAS])
                yield pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())

    return scored(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``score`` from 0 to 1, ``predicted`` (1 from one half on).

    Every row is scored by itself; other columns are not read, so their names cannot clash. An empty table gives an
    empty result.
    """
    scored = docs.select(id_col, score(F.col(text_col), model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: dict[int, float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below one half.

    A model without weights (nothing was labelled) knows no toxic text, so every row stays. NULL and empty texts score by
    the constant alone. Rows are judged one by one, so repeated rows and equal texts fare alike; the name of the
    score's column clashes with none. An empty table gives an empty result.
    """
    if not model:
        return docs
    columns = docs.columns
    name = "_score" + "_" * max(map(len, columns))
    return docs.withColumn(name, score(F.col(text_col), model, docs)).filter(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in columns])
