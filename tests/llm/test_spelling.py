import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import spelling


def noisy_rows(seed, n=120):
    """A vocabulary of chained and hub-like variants, with signs of Latin-1 and words in odd places."""
    rng = random.Random(seed)
    letters = "abcdeéüÿßÀ×z"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaab", "abaab", "a" * 40]
    words = list(base)
    for w in base * 3:
        k = rng.randrange(len(w))
        words.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:], w[:k] + rng.choice(letters) + w[k:]]))
    weights = [1 / (1 + k) for k in range(len(words))]
    return [(rng.choice([i, i, 3, None]), " ".join(rng.choice([str, str.upper, str.title])(w) + rng.choice(["", ",", "漢", "1"]) for w in rng.choices(words, weights, k=rng.randint(0, 60))))
            for i in range(n)]


@pytest.mark.parametrize("limit", [spelling.FILTER_BYTES, 256])
def test_equal_plain_groups(corpus, awkward, limit, monkeypatch):
    """With tiny filters several rounds are needed, and proposals come in many chunks."""
    if limit < spelling.FILTER_BYTES:
        monkeypatch.setattr(spelling, "CHUNK", 500)
    rows = awkward + noisy_rows(5) + noisy_rows(5)[:20]
    found = spelling.spelling_groups(corpus(rows), limit=limit)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = sorted(brute.spelling(rows), key=str)
    assert sum(w[1] is not None for w in expected) > 20 and any(w[1] and w[2] != w[1] for w in expected)
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_rounds_stay_within_the_limit():
    counts = {5: 10, 6: 5000, 7: 800, 90: 1}
    rounds = spelling.shards(counts, 2048)
    assert len(rounds) > 4 and all(sum(r.values()) * spelling.BLOCK <= 2048 * 8 for r in rounds)
    for length, n in counts.items():
        mine = [(key, blocks) for r in rounds for key, blocks in r.items() if key[0] == length]
        assert sorted(part for (_, part, _), _ in mine) == list(range(mine[0][0][2])) and sum(b for _, b in mine) * spelling.BLOCK >= n * spelling.BITS
    assert spelling.shards({}) == [{}]


def test_edited_hashes_are_the_hashes_of_the_edits():
    """With filters that know everything, all edits come out, each as written."""
    word = np.frombuffer("aabé".encode("utf-32-le"), np.uint32).reshape(1, 4)
    full = [np.full(8, np.iinfo(np.uint64).max, np.uint64)]
    edits = [w for _, w in spelling.proposals(word, {3: full, 4: full})]
    letters = [chr(c) for c in spelling.LETTERS]
    expected = {"abé", "aaé", "aab"} | {"aabé"[:k] + c + "aabé"[k + 1:] for k in range(4) for c in letters if c > "aabé"[k]}
    assert len(edits) == len(set(edits)) and set(edits) == expected
    for w in ["abé", "zabé"]:  # a filter that holds exactly this word finds it by the arithmetic of the edit
        code = np.frombuffer(w.encode("utf-32-le"), np.uint32).reshape(1, -1)
        block, inside = spelling.bits(spelling.hashes(code), 1)
        table = np.zeros(8, np.uint64)
        for place in (block * spelling.BLOCK + inside[:, 0]).tolist():
            table[place >> 6] |= np.uint64(1 << (place & 63))
        assert w in [v for _, v in spelling.proposals(word, {len(w): [table]})]


def test_few_tables_are_written(corpus, monkeypatch):
    """Every file a task makes is a process of its own on local disks; a chain of forms and rounds of filters make none, and nothing stays cached."""
    written = []
    monkeypatch.setattr(spelling, "stage", lambda df, name, f=spelling.stage: written.append(name) or f(df, name))
    docs = corpus([(k, " ".join("a" * (5 + k) for _ in range(3 << k))) for k in range(6)])
    found = {r["word"]: r["root"] for r in spelling.spelling_groups(docs, limit=256).collect()}
    assert len(found) >= 6 and set(found.values()) == {"a" * 10}
    assert written == ["vocabulary", "spelling-forms", "spelling-roots"]
    assert docs.sparkSession.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_very_long_words(corpus):
    long = "abcdefghij" * 2000
    rows = [(i, f"{long} {long[:-1]}") for i in range(6)] + [(i, "noise") for i in range(50)]
    found = {r["word"]: r for r in spelling.spelling_groups(corpus(rows)).collect()}
    assert found[long]["n_near"] >= 1 and found["noise"]["n_near"] == 0


def test_empty_table(corpus):
    assert spelling.spelling_groups(corpus([(1, "x")]).filter(F.lit(False))).collect() == []
    assert spelling.spelling_groups(corpus([(1, None), (2, "")])).collect() == []
