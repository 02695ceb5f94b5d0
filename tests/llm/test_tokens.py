import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelweave.llm import packing, token_count

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(seed, n=300):
    rng = random.Random(seed)
    signs = "abcdeABCDE      \n\t\r\v\f\x1c\x1f\x85  　éÉßüΣσİıŉ漢字かな가각̧́'`´.,!?0123456789²½<>|#\U0001f600"
    words = ["<|endoftext|>", "<|startoftext|>", "it's", "WE'LL", "don’t", " the", "\n\n", "Straße", "naïve", "é"]
    return ["".join(rng.choice(words) if rng.random() < 0.1 else rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library(corpus, awkward):
    tokenizer = Tokenizer.from_file(BYTE)
    rows = awkward + [(1000 + i, t) for i, t in enumerate(odd_texts(1))]
    found = {r["doc_id"]: r for r in token_count.count_tokens(corpus(rows), BYTE).collect()}
    for i, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((text or "").encode()), n > 512), text


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(token_count, "SEGMENT", 50)
    with open(BYTE, encoding="utf-8") as file:
        counter = token_count.PieceCounter(file.read())
    texts = odd_texts(2)
    assert sum(map(len, texts)) > 8 * 50
    assert counter.count(texts) == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packed_ids_equal_the_library(corpus, awkward):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = awkward + [(1000 + i, t) for i, t in enumerate(odd_texts(3))]
    packed = packing.pack(corpus(rows), WORDS, capacity=64, with_ids=True)
    found = {}
    for r in packed.collect():
        found[r["doc_id"], r["piece"]] = r
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            r = found.pop((i, piece))
            part = ids[at: at + 64]
            assert (r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) == (at, len(part), zlib.crc32(part.tobytes()), part.tobytes()), text
    assert not found
    check_places(packed.select("sequence_id", "offset", "length").collect(), 64)
    whole = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] <= 64 for r in whole)
    assert sum(r["n_tokens"] for r in whole) == packed.agg(F.sum("length")).first()[0]


def test_special_tokens_are_matched_as_written(corpus):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|> Next", "A B<|endoftext|>C <|StartOfText|>", "<|STARTOFTEXT|>x<|startoftext|>", "WORDS < | Pipe <|", "É<|EndofText|>"]
    found = {r["doc_id"]: bytes(r["ids"]) for r in packing.pack(corpus(list(enumerate(texts))), WORDS, capacity=64, with_ids=True).collect()}
    for i, text in enumerate(texts):
        assert found[i] == np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes(), text


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_uses_every_piece_once():
    rng = random.Random(4)
    for capacity in (10, 50, 200):
        counts = Counter(rng.randint(1, capacity) for _ in range(500))
        used = Counter()
        patterns = packing.plan(dict(counts), capacity)
        for times, pattern in patterns:
            assert sum(n * c for n, c in pattern.items()) <= capacity
            for n, c in pattern.items():
                used[n] += times * c
        assert used == counts
        assert len(patterns) <= 4 * capacity


def test_two_fit_beats_greedy():
    """Greedy filling takes 6 + 3 and leaves a gap; swapping the 3 for two 2s fills the sequence."""
    patterns = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert (1, {6: 1, 2: 2}) in patterns
    assert packing.best_pair(np.array([0, 0, 1, 0, 0, 1]), 4, 3) is None  # one piece cannot be taken twice


def test_places_over_numbering_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    rng = random.Random(6)
    rows = [(i, 0, rng.choice([5, 5, 5, rng.randint(1, 20)])) for i in range(300)]
    packed = packing.pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 20)
    assert packed.count() == 300
    assert check_places(packed.collect(), 20) <= 1.03 * sum(r[2] for r in rows) / 20 + 1


def test_empty_tables(corpus):
    nothing = corpus([(1, "x")]).filter(F.lit(False))
    assert token_count.count_tokens(nothing, BYTE).collect() == []
    assert packing.pack(nothing, WORDS).collect() == []
