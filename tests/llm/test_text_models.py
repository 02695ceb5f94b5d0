import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelweave.llm import language_id, mixing, toxicity, words
from panelweave.llm.common import held_out
from panelweave.llm.words import find_words, hash_spans

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def labels(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def test_held_out(spark):
    import zlib

    rows = spark.range(-3, 40).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_word_numbers_follow_the_words():
    texts = [b"a bb\tA", b"", b"bb  ccc ", b"x" * 70, b"\x0ba\x0c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, first = find_words(data, bounds)
    words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in t.split()]
    assert list(np.diff(first)) == [len(t.split()) for t in texts]
    numbers = hash_spans(data, starts, ends)
    same = {}
    for w, n in zip(words, numbers):
        same.setdefault(w.lower(), set()).add(int(n))
    assert all(len(v) == 1 for v in same.values()) and len({*map(tuple, same.values())}) == len(same)


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba"]
    p = {s: (k + 1) / 30 for k, s in enumerate(pieces)}

    def total(word):
        return 1.0 if not word else sum(q * total(word[len(s):]) for s, q in p.items() if word.startswith(s))

    trie = language_id.Trie(pieces)
    table = np.array([[p[s]] for s in pieces])
    for word in (b" a", b" ab", b" abab", b" ababa"):
        value = language_id.forward(trie, table, np.frombuffer(word, np.uint8)[None, :])[0, 0]
        assert value == pytest.approx(np.log(total(word)))
    counts = language_id.expected_counts(trie, table[:, 0], np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]), np.array([3]))
    ways = {(b" ", b"a", b"b"): 1, (b" ", b"ab"): 1, (b" a", b"b"): 1}
    weight = {w: np.prod([p[s] for s in w]) for w in ways}
    expected = [3 * sum(v * w.count(s) for w, v in weight.items()) / sum(weight.values()) for s in pieces]
    assert counts == pytest.approx(expected)


def test_languages(corpus, awkward):
    rng = random.Random(1)
    vocabulary = {"en": "the and of house water running over green hill with".split(), "de": "der und die häuser wasser läuft über grüne hügel mit".split()}
    rows, langs = [], {}
    for i in range(80):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) for _ in range(25))))
        langs[i] = lang
    model = language_id.fit(corpus(rows, langs), MULTI)
    found = {r["doc_id"]: r for r in language_id.identify(corpus([(1000, "das wasser und die hügel"), (1001, "water over the hill"), *[(i + 2000, t) for i, t in awkward]]), model).collect()}
    assert found[1000]["lang_pred"] == "de" and found[1001]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert {i - 2000 for i, r in found.items() if r["lang_pred"] == "und"} == {1, 2, 3, 13, 14}
    nothing = language_id.fit(corpus(rows).filter(F.lit(False)), MULTI)
    assert [tuple(r) for r in language_id.identify(corpus([(1, "text")]), nothing).collect()] == [(1, "und", 0.0)]
    assert language_id.identify(corpus([(1, "x")]).filter(F.lit(False)), model).collect() == []


def test_toxicity(spark, corpus, awkward):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(60)]
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            words[rng.randrange(20)] = rng.choice(["Idiot!", "moron"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    docs = corpus(rows)
    mark = labels(spark, marks, "toxic")
    model = toxicity.fit(docs, mark.filter("doc_id < 300"))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, model).collect()}
    assert sum(found[i] == t for i, t in marks[300:]) >= 97
    assert len(model) < 2000
    odd = {r["doc_id"]: r["score"] for r in toxicity.score_documents(corpus(awkward), model).collect()}
    assert len(odd) == len(awkward) and all(0 <= s <= 1 for s in odd.values()) and odd[1] == odd[2] == odd[3]
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, p in found.items() if p == 0}
    empty = toxicity.fit(docs, mark.filter(F.lit(False)))
    assert {r["score"] for r in toxicity.score_documents(docs, empty).collect()} == {0.5}


def mixing_corpus(corpus, spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(300):
        low = i % 3 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(w.upper() + "!!" if low else w for w in words)))
        marks.append((i, "low" if low else "high"))
    return corpus(rows), spark.createDataFrame(marks, "doc_id long, domain string")


def test_toxicity_states_reach_the_driver_as_arrow(spark, corpus, monkeypatch):
    """The groups' states are whole tables of coordinates; as pickled rows they would take a multiple in the driver's heap."""
    docs = corpus([(i, "good words here" if i % 2 else "bad words there") for i in range(40)])
    gathered, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: gathered.append(self.columns) or collect(self))
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert len(model) > 1 and ["part", "z", "n"] not in gathered


def test_rates_reach_the_targets(spark, corpus, awkward):
    docs, marked = mixing_corpus(corpus, spark)
    domains = mixing.fit_domains(docs, marked.filter("doc_id < 150"))
    mixed = mixing.mix(docs, domains, {"high": 3.0, "low": 1.0}).join(marked.withColumnRenamed("domain", "actual"), "doc_id")
    assert mixed.filter("domain <> actual").count() == 0
    tokens = {r["actual"]: r["t"] for r in mixed.groupBy("actual").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("t")).collect()}
    total = mixed.agg(F.sum("n_tokens")).first()[0]
    assert tokens["high"] == pytest.approx(0.75 * total, rel=0.01) and tokens["low"] == pytest.approx(0.25 * total, rel=0.01)
    assert mixed.filter("rate < 0 or copies < floor(rate) or copies > ceil(rate)").count() == 0
    held = mixing.mix(docs, domains, {"high": 0.9, "low": 0.1}, anchor="high", most=1.0).join(marked.withColumnRenamed("domain", "actual"), "doc_id")
    assert held.filter("actual = 'high' and copies <> 1").count() <= 2
    assert held.filter("rate > 1").count() == 0
    odd = mixing.mix(corpus(awkward), domains, {"high": 1.0, "other": 2.0}).collect()
    assert len(odd) == len(awkward) and all(r["rate"] >= 0 for r in odd)
    copies = mixing.take_copies(docs, mixed)
    assert copies.columns == docs.columns and copies.count() == mixed.agg(F.sum("copies")).first()[0]


def test_gradient_steps_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 100), [p, 1 - p]) for i in range(50) for p in [rng.random()]]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    targets = [1500.0, 300.0]
    history = mixing.fit_rates(members, targets, steps=200)
    rates = {r["doc_id"]: r["rate"] for r in members.select("doc_id", mixing.rate_column(history, None).alias("rate")).collect()}
    got = [sum(rates[i] * t * p[k] for i, t, p in rows) for k in range(2)]
    assert got == pytest.approx(targets, rel=0.02)


def test_soft_posteriors_meet_the_targets_with_default_steps(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 100), [p, 1 - p]) for i in range(50) for p in [rng.random()]]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")

    def totals(targets, most):
        fitted = mixing.fit_rates(members, targets, most)
        rates = {r["doc_id"]: r["rate"] for r in members.select("doc_id", mixing.rate_column(fitted, most).alias("rate")).collect()}
        assert all(0 <= r <= (most or r) for r in rates.values())
        return fitted, rates, [sum(rates[i] * t * p[k] for i, t, p in rows) for k in range(2)]

    for targets, most in (([1500.0, 300.0], None), ([300.0, 700.0], 1.0), ([900.0, 900.0], 2.0)):
        fitted, _, got = totals(targets, most)
        assert fitted.reached and got == pytest.approx(targets, rel=1e-4)
    mass = [sum(t * p[k] for _, t, p in rows) for k in range(2)]
    targets = [mass[0], 0.05 * mass[1]]  # out of reach with rates up to 1: the least squares, by the conditions on its slope
    fitted, rates, got = totals(targets, 1.0)
    assert not fitted.reached and fitted.misses == pytest.approx([(g - w) / w for g, w in zip(got, targets)], abs=1e-6)
    pull = [(g - w) / m for g, w, m in zip(got, targets, mass)]
    for i, _, p in rows:
        slope = p[0] * pull[0] + p[1] * pull[1]
        assert rates[i] == (0 if slope > 0.003 else 1 if slope < -0.003 else pytest.approx(0.5, abs=0.5))


def test_mixing_without_labels_or_rows(spark, corpus):
    docs, marked = mixing_corpus(corpus, spark)
    domains = mixing.fit_domains(docs, marked.filter(F.lit(False)))
    assert {(r["rate"], r["domain"]) for r in mixing.mix(docs, domains, {"high": 1.0}).collect()} == {(1.0, None)}
    learned = mixing.fit_domains(docs, marked)
    assert mixing.mix(docs.filter(F.lit(False)), learned, {"high": 1.0}).collect() == []


def test_no_labels_drop_nothing(spark, corpus, awkward):
    docs = corpus(awkward)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.drop_toxic(docs, model).count() == len(awkward)
    assert toxicity.drop_toxic(docs.filter(F.lit(False)), model).collect() == []


def test_long_words_are_hashed_in_blocks(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    starts, ends = np.array([0, 10, 3000]), np.array([7, 2999, 5000])
    whole = words.hash_spans(data, starts, ends)
    monkeypatch.setattr(words, "_BLOCK", 64)
    monkeypatch.setattr(words, "_powers", [])
    assert (words.hash_spans(data, starts, ends) == whole).all()


def plain_rates(rows, targets, most, steps):
    """Projected gradient without momentum, document by document."""
    mass = [sum(t * p[k] for t, p in rows) for k in range(len(targets))]
    rates = [1.0] * len(rows)
    for _ in range(steps):
        pull = [(sum(r * t * p[k] for r, (t, p) in zip(rates, rows)) - w) / m for k, (w, m) in enumerate(zip(targets, mass))]
        rates = [min(most, max(0.0, r - sum(a * b for a, b in zip(p, pull)))) for r, (_, p) in zip(rates, rows)]
    return [sum(r * t * p[k] for r, (t, p) in zip(rates, rows)) / m for k, m in enumerate(mass)]


@pytest.mark.parametrize("targets,most", [([0.2, 0.5, 0.9], 1.0), ([1.5, 0.3, 0.6], 3.0), ([0.9, 0.05, 0.9], 1.0)])
def test_rates_of_three_domains_against_plain_steps(spark, targets, most):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 90)), rng.dirichlet([0.8] * 3).tolist()) for _ in range(120)]
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    mass = [sum(t * p[k] for t, p in rows) for k in range(3)]
    wanted = [a * m for a, m in zip(targets, mass)]
    fitted = mixing.fit_rates(members, wanted, most)
    found = members.select("n_tokens", "posterior", mixing.rate_column(fitted, most).alias("rate")).collect()
    got = [sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in found) / m for k, m in enumerate(mass)]
    assert got == pytest.approx(plain_rates(rows, wanted, most, 4000), abs=0.005)
    assert fitted.misses == pytest.approx([(g - t) / min(1, t) for g, t in zip(got, targets)], abs=1e-6)
    assert fitted.settled and fitted.steps < 120
