import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from panelweave.llm import boosting, pii, quality_rules


def test_base_spans(corpus, awkward):
    rng = random.Random(1)
    signs = ["1", "2", "12", "255", "256", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b_", "%", "é", "4111 1111 1111 1111", "10.0.0.1", "x@y.z", "+49 30 1234567", "\n"]
    rows = awkward + [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 40)))) for i in range(400)]
    rows += [(5000, "7 " * 3000), (5001, "a@b" + ".c" * 3000), (5002, "1." * 3000), (5003, "0" * 400 + "1.2.3.4"), (5004, "a" * 100_000 + "@"), (5005, "+1" + " " * 5000)]
    model = {kind: ([], float("inf")) for kind in pii.BASE}
    found = {r["doc_id"]: r for r in pii.pii(corpus(rows), model).collect()}
    for i, text in rows:
        spans = brute.pii(text)
        r = found[i]
        assert r["spans"] == ",".join(spans), (i, text[:200])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]


def test_trees_add_lookalikes(corpus):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        words = [rng.choice(["alpha", "beta", "gamma"]) for _ in range(12)]
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        words[5] = f"call +1 {phone}" if i % 3 == 0 else f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}" if i % 3 == 1 else "section 4 - 12"
        rows.append((i, " ".join(words)))
    docs = corpus(rows)
    model = pii.fit(docs)
    assert 0 <= model["phone"][1] < float("inf")
    new = [(1, "alpha beta call 1 (988) 555-2485 gamma"), (2, "alpha version 3.4 beta"), (3, "plain"), (4, "beta call +1 (988) 555-2485 gamma")]
    found = {r["doc_id"]: r for r in pii.pii(corpus(new), model).collect()}
    assert found[1]["n_phone"] == 0 and found[1]["spans"] == "phone:16:32"
    assert found[2]["spans"] == found[3]["spans"] == "" and found[4]["spans"] == ",".join(brute.pii(new[3][1]))


def test_parts_of_zeros(corpus):
    parts = ["0", "00", "000", "0255", "0256", "255", "256", "00000000255", "0000"]
    rows = [(i, f"at {a}.{b}.{c}.1 end") for i, (a, b, c) in enumerate((a, b, c) for a in parts for b in parts for c in parts[::2])]
    model = {kind: ([], float("inf")) for kind in pii.BASE}
    for r in pii.pii(corpus(rows), model).collect():
        assert r["spans"] == ",".join(brute.pii(rows[r["doc_id"]][1])), rows[r["doc_id"]]


@pytest.mark.parametrize("share", [0.05, 0.2])
def test_unmarked_variants_are_found_however_common(corpus, share):
    """The training table itself holds phones without the plus; they are unlabelled, not counterexamples."""
    rng = random.Random(3)
    rows, unmarked = [], set()
    for i in range(1000):
        words = [rng.choice(["alpha", "beta", "gamma"]) for _ in range(12)]
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        if i % 2:
            words[5] = rng.choice([f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", "section 4 - 12", f"page {rng.randint(1, 99)}"])
        elif rng.random() < share:
            words[5] = f"call 1 {phone}"
            unmarked.add(i)
        else:
            words[5] = f"call +1 {phone}"
        rows.append((i, " ".join(words)))
    docs = corpus(rows)
    found = {r["doc_id"]: r for r in pii.pii(docs, pii.fit(docs)).collect()}
    assert len(unmarked) > 10 and all("phone" in found[i]["spans"] and found[i]["n_phone"] == 0 for i in unmarked)
    assert all(found[i]["spans"] == "" for i in range(1, 1000, 2))


def test_trees_learn_from_all_documents(spark):
    """Few marked phones in a large table: a part of it holds too few for a threshold."""
    phone = F.format_string("(%d) 555-%04d", F.col("id") % 800 + 200, F.col("id") % 10_000)
    text = F.when(F.col("id") % 400 == 0, F.concat(F.lit("call +1 "), phone)).when(F.col("id") % 400 == 1, F.lit("version 3.4")).otherwise(F.lit("plain"))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert pii.fit(docs)["phone"][1] < float("inf")


def test_pii_odd_rows(corpus):
    docs = corpus([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (1, "x y@z.w"), (2, None)])
    model = pii.fit(docs)
    rows = sorted((str(r["doc_id"]), r["spans"]) for r in pii.pii(docs, model).collect())
    assert rows == [("1", "email:0:5"), ("1", "email:0:5"), ("1", "email:2:7"), ("2", ""), ("None", "email:0:5")]
    assert pii.pii(docs.filter(F.lit(False)), pii.fit(docs.filter(F.lit(False)))).collect() == []


def test_boosting_separates_and_reads_like_its_expression(spark):
    rows = [{"a": a, "b": b, "n": 10, "y": 10 if a > 3 and b < 2 else 0} for a in range(6) for b in range(4)]
    trees = boosting.fit(rows, ["a", "b"])
    assert all((boosting.margin(trees, r) > 0) == (r["y"] > 0) for r in rows)
    df = spark.createDataFrame([(r["a"], r["b"]) for r in rows], "a int, b int")
    for r in df.select("*", boosting.margin_column(trees).alias("m")).collect():
        assert abs(r["m"] - boosting.margin(trees, r.asDict())) < 1e-9
    assert boosting.threshold(trees, rows, 0.99, 20) >= 0
    assert boosting.threshold(trees, rows, 0.99, 10_000) == float("inf")


def test_statistics(corpus, awkward):
    rng = random.Random(3)
    rows = list(awkward)
    for i in range(60):
        lines = [" ".join(rng.choice("abcd#|é!") + rng.choice(["", "x", "<>"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        rows.append((1000 + i, "\n".join(lines + rng.choices(lines, k=rng.randint(0, 4)))))
    for r in quality_rules.judge(corpus(rows), []).collect():
        text = dict(rows)[r["doc_id"]]
        expected = brute.quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected, text[:300]
        assert r["kept"] == (not expected[-1])


def test_list_is_learned_and_ordered(spark, corpus):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(40, 90))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "###" if bad and rng.random() < 0.5 else w for w in words)))
        marks.append((i, int(not bad)))
    docs = corpus(rows)
    rules = quality_rules.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert rules and all(len(rule) <= quality_rules.MAX_CONDITIONS for rule in rules)
    found = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, rules).collect()}
    assert all(found[i] == bool(q) for i, q in marks)
    assert quality_rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert quality_rules.judge(docs.filter(F.lit(False)), rules).collect() == []
