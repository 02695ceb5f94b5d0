"""Token counts of whole texts: batches in Arrow functions, lengths only.

A text is cut at *safe boundaries*: places before white space where no pattern of a byte-level tokenizer can reach
across. The pieces between boundaries repeat a lot, so each task remembers the counts of pieces it has met and sends only
new ones to the tokenizer, in batches balanced by bytes. Long texts pass through in segments that end at safe boundaries.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelweave.llm.common import process_state, slices

#: The characters with Unicode's White_Space property.
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"
#: A run of white space with what follows; both ends are safe boundaries.
PIECE = re.compile(f"[{UNICODE_SPACE}]*[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+")
#: Characters of a long text that are worked on at a time, and characters per call of the tokenizer.
SEGMENT, BATCH = 1 << 20, 1 << 16
#: Pieces a task remembers before it starts afresh, and the length up to which it does.
REMEMBERED, SHORT = 250_000, 64


def balanced(pieces: list[str], limit: int = BATCH) -> Iterator[list[str]]:
    """Consecutive batches of about equal size."""
    batch, size = [], 0
    for piece in pieces:
        if batch and size + len(piece) > limit:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += len(piece)
    if batch:
        yield batch


def segments(text: str, pattern: re.Pattern = PIECE) -> Iterator[list[str]]:
    """The pieces of a text, in lists that together hold about ``SEGMENT`` characters."""
    if len(text) <= SEGMENT:
        yield pattern.findall(text)
        return
    part, size = [], 0
    for match in pattern.finditer(text):
        part.append(match[0])
        size += len(match[0])
        if size >= SEGMENT:
            yield part
            part, size = [], 0
    if part:
        yield part


class PieceCounter:
    """Token counts of pieces, remembered within bounds."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores are taken by other tasks
        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Count new pieces; the long ones are returned, not remembered."""
        new = list(pieces - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(pieces)
        long = {}
        for batch in balanced(new):
            for piece, encoding in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                (self.known if len(piece) <= SHORT else long)[piece] = len(encoding)
        return long

    def count(self, texts: list[str]) -> list[int]:
        if sum(map(len, texts)) <= 8 * SEGMENT:
            lists = [PIECE.findall(t) for t in texts]
            long = self.learn(set().union(*lists))
            table = {**self.known, **long} if long else self.known
            return [sum(map(table.__getitem__, pieces)) for pieces in lists]
        totals = []
        for text in texts:
            total = 0
            for pieces in segments(text):
                long = self.learn(set(pieces))
                total += sum(long[p] if p in long else self.known[p] for p in pieces)
            totals.append(total)
        return totals


def counter_for(definition: str) -> PieceCounter:
    """The counter of this process: tasks that follow each other share the tokenizer and what it remembers."""
    return process_state(("token_count", definition), lambda: PieceCounter(definition))


def token_count(text: Column, definition: str) -> Column:
    """Number of tokens of a text column under a tokenizer definition (the JSON of the ``tokenizers`` library).

    NULL and empty texts have 0 tokens; special strings inside a text are one token each, as the library does by default;
    nothing is added, cut off or padded.
    """
    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = counter_for(definition)
        for batch in batches:
            parts = [pa.array(counter.count(part.to_pylist()), pa.int64()) for part in slices(batch, SEGMENT)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.int64())

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    Every row is counted by itself, repeated ids and texts too. Other columns are not read, so their names cannot clash.
    An empty table gives an empty result.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        definition = file.read()
    counted = docs.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
                          token_count(F.col(text_col), definition).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
