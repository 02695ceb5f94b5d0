import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import components, exact_dedup, near_dedup, substring_dedup, toxicity
from panelweave.llm.components import connected_components


def test_exact_groups(corpus, awkward):
    for limits in ({}, {"capacity": 2, "slot_bits": 2}):
        found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(corpus(awkward), **limits).collect()}
        assert found == brute.exact(awkward)


def test_exact_drop_keeps_columns(corpus, awkward):
    docs = corpus(awkward)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, v in brute.exact(awkward).items() if v[2])


def test_directory_doubles_until_buckets_fit():
    rng = random.Random(1)
    counts = {p: rng.randint(0, 9) for p in range(16)}
    buckets = exact_dedup.split_directory(counts, 12, 4)
    assert sum(1 << (4 - d) for d, _ in buckets) == 16
    for depth, prefix in buckets:
        inside = sum(counts[p] for p in range(16) if p >> (4 - depth) == prefix)
        assert inside <= 12 or depth == 4


def test_exact_odd_ids(corpus):
    docs = corpus([(None, "a"), (3, "a"), (3, "a"), (None, None)])
    rows = exact_dedup.exact_groups(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows) == [
        ("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)]


def noisy_corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(words)))
    return rows


def test_near_groups(corpus, awkward):
    for rows in (awkward, noisy_corpus(3)):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(corpus(rows)).collect()}
        assert found == brute.near(rows)


def test_near_chain_reaches_across(corpus):
    """Neighbours in a chain are linked although its ends share little."""
    words = [f"v{k}" for k in range(160)]
    rows = [(100 - i, " ".join(words[3 * i: 3 * i + 80])) for i in range(12)]
    expected = brute.near(rows)
    assert len({c for _, c in expected.values()}) == 1
    left = near_dedup.drop_near_duplicates(corpus(rows)).collect()
    assert [r["doc_id"] for r in left] == [89]


@pytest.mark.parametrize("crowd", [1000, 7])
def test_lookalikes_are_not_paired(spark, corpus, monkeypatch, crowd):
    """A third of the rows is one crowd of look-alikes at 0.6 to 0.74: links are whole, and hardly a pair of the crowd is compared."""
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    core = fresh(200)
    rows = [(i, " ".join(core[:rng.randint(170, 200)] + fresh(rng.randint(36, 50)))) for i in range(80)]
    rows += [(1000 + i, rows[i][1] + " " + " ".join(fresh(rng.randint(1, 60)))) for i in range(30)]  # some of them link
    rows += [(2000 + i, " ".join(fresh(60))) for i in range(130)]
    expected = brute.near(rows)
    assert 5 < sum(i != c for i, (_, c) in expected.items()) < 40
    compared = []
    pairs = near_dedup.prefix_pairs
    monkeypatch.setattr(near_dedup, "prefix_pairs", lambda *args: compared.append(pairs(*args)) or compared[-1])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(corpus(rows)).collect()}
    assert found == expected
    assert compared[0].count() < 500  # of 5,995 pairs of the crowd


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_prefixes_lose_no_pair(spark, percent):
    """All pairs that overlap enough, among sets over few shingles with ties in every rank; not those of one component."""
    rng = random.Random(percent)
    sets = [rng.sample(range(40), rng.randint(1, 30)) for _ in range(60)]
    sets += [sorted(set(s) ^ set(rng.sample(range(40), rng.randint(1, 3)))) or [1] for s in sets]
    members = [(i, len(s), i % 50, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(members, "doc_id long, n_shingles int, component long, shingles array<long>")
    wanted = {frozenset((i, j)) for i, n, c, s in members for j, m, d, t in members
              if i < j and c != d and 100 * len(set(s) & set(t)) >= percent * len(set(s) | set(t))}
    found = [frozenset((r["a"], r["b"])) for r in near_dedup.prefix_pairs(df, percent).collect()]
    assert len(wanted) > 10 and wanted <= set(found) and len(found) == len(set(found))
    assert all(members[min(p)][2] != members[max(p)][2] for p in found)
    assert near_dedup.prefix_pairs(df.filter("component = 3"), percent).collect() == []
    assert near_dedup.prefix_pairs(df.filter("false"), percent).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 9), (2, 2)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_rounds_are_short_and_end_with_stars(spark, monkeypatch):
    """Stars take no round, the last round is not repeated to see it change nothing, and a round reads its edges four times."""
    written, plain = [], components.stage
    scans = lambda df: df._jdf.queryExecution().sparkPlan().collectLeaves().size()
    monkeypatch.setattr(components, "stage", lambda df, name: written.append(scans(df)) or plain(df, name))

    def found(pairs):
        written.clear()
        rows = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert len(rows) == len({r["node"] for r in rows})
        return {r["node"]: r["component"] for r in rows}

    assert found([(1, 5), (7, 1), (9, 8), (1, 7), (3, 3)]) == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8} and len(written) == 1
    assert found([(3, 2), (2, 1)]) == {1: 1, 2: 1, 3: 1} and len(written) == 2 and written[1] == 4
    assert found([(3, 1), (3, 2)]) == {1: 1, 2: 1, 3: 1}
    rng = random.Random(4)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    groups = {x: {x} for p in pairs if p[0] != p[1] for x in p}
    for a, b in pairs:
        if a != b and groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    assert found(pairs) == {x: min(g) for x, g in groups.items()}
    assert found([]) == {} and len(written) == 1


def test_shared_passage_survives_shifts(corpus):
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = make(60)
    rows = [(i, make(40 + 7 * i) + (" " + passage + " " if i in (2, 5, 9) else " ") + make(30)) for i in range(12)]
    docs = corpus([*rows, (20, None), (21, ""), (None, passage)])
    spans = substring_dedup.repeated_spans(docs)
    found = {r["doc_id"]: r for r in spans.collect()}
    assert set(found) == {2, 5, 9, None}  # a row without id is evidence and has its spans too
    texts = dict([*rows, (None, passage)])
    for i, r in found.items():
        assert texts[i].encode()[r["start_byte"]:r["end_byte"]].decode() in passage
        assert r["first_doc_id"] == 2 and r["copies"] == 4 and (r["n_repeats"] == 0) == (i == 2)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs, spans).collect()}
    assert left[2] == texts[2] and left[20] is None
    assert len(left[5]) == len(texts[5]) - (found[5]["end_byte"] - found[5]["start_byte"])


def plain_spans(rows, span):
    """Repeated spans by dictionaries over the chunks of each row; equal rows are one answer."""
    cut = []
    for i, text in rows:
        raw = (text or "").encode()
        ends = substring_dedup.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist() if raw else []
        cut.append([raw[a:b] for a, b in zip([0, *ends], ends)])
    count, first = Counter(c for chunks in cut for c in chunks), {}
    for (i, _), chunks in zip(rows, cut):
        for c in chunks:
            first[c] = i if first.get(c) is None else first[c] if i is None else min(i, first[c])
    out = set()
    for (i, text), chunks in zip(rows, cut):
        at, run, seen, earlier = 0, [], set(), 0
        for c in [*chunks, None]:
            if c is not None and count[c] > 1:
                run.append(c)
                earlier += c in seen or i != first[c]
                seen.add(c)
            else:
                size = sum(map(len, run))
                if size >= span:
                    firsts = [first[x] for x in run if first[x] is not None]
                    out.add((i, text, at - size, at, len(run), earlier, max(count[x] for x in run), min(firsts, default=None)))
                run, earlier = [], 0
            at += len(c or b"")
    return out


def test_spans_equal_plain_ones(corpus, spark, monkeypatch):
    """Edits inside passages, neighbouring passages, repeated ids with other texts, equal rows, rows without id, hot chunks."""
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [make(60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [make(rng.randint(5, 40))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            words = p.split(" ")
            if rng.random() < 0.5:
                words[rng.randrange(60)] = make(1)
            parts += [" ".join(words), *([make(10)] if rng.random() < 0.5 else [])]
        rows.append((rng.choice([i, i, i, 7, None]), " ".join(parts)))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, rows[5][1]), (90, None), (91, "")]
    texts = {name: t for (_, t), name in zip(rows, names_of(spark, rows))}
    expected = plain_spans(rows, substring_dedup.SPAN)
    assert len(expected) > 20
    for hot in (4096, 50):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        found = [(r["doc_id"], texts[r["text_hash"]], r["start_byte"], r["end_byte"], r["n_chunks"], r["n_repeats"], r["copies"], r["first_doc_id"])
                 for r in substring_dedup.repeated_spans(corpus(rows)).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def names_of(spark, rows):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k long, text string")
    return [r["n"] for r in df.select("k", substring_dedup.text_name(F.col("text")).alias("n")).orderBy("k").collect()]


def test_periodic_text_is_found(corpus):
    docs = corpus([(1, "start here " + "of " * 80), (2, "another beginning " + "of " * 90), (3, "x" * 200_000)])
    assert {1, 2} <= {r["doc_id"] for r in substring_dedup.repeated_spans(docs).collect()}


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, near_dedup.near_groups, substring_dedup.repeated_spans, exact_dedup.drop_exact_duplicates,
                                 near_dedup.drop_near_duplicates])
def test_empty_table(corpus, run):
    assert run(corpus([(1, "x")]).filter(F.lit(False))).collect() == []


@pytest.mark.parametrize("function", [near_dedup.signed, near_dedup.sets_of, toxicity.distinct_features])
def test_batches_are_answered_slice_by_slice(function):
    """What a worker holds follows from the slice, however many texts a batch has."""
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 10_000, 2000))) for _ in range(600)] + [None, ""]
    answers = list(function.func(iter([pa.array(texts), pa.array(["one more text of six words"])])))
    assert len(answers) >= 5 and sum(map(len, answers)) == len(texts) + 1 and max(map(len, answers)) < 200
    apart = [row for text in texts[:3] + [None] for answer in function.func(iter([pa.array([text], pa.string())])) for row in answer.to_pylist()]
    every = [row for answer in answers for row in answer.to_pylist()]
    assert every[:3] + every[600:601] == apart
