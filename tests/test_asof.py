import random
from datetime import datetime, timedelta

import pytest

from panelweave.operators.asof import asof_join

START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def made(spark, left, right):
    return (spark.createDataFrame([(i, k, at(s)) for i, (k, s) in enumerate(left)], "id long, k string, ts timestamp"),
            spark.createDataFrame([(k, at(s), v) for k, s, v in right], "k string, ts timestamp, id long"))


def nearest(left, right, forward, within):
    """The partner's value of every left row by looking at all pairs."""
    out = {}
    for i, (k, s) in enumerate(left):
        fit = [(abs(s - r), v) for key, r, v in right if None not in (k, s, key, r) and key == k
               and (r >= s if forward else r <= s) and (within is None or abs(s - r) <= within)]
        out[i] = min(fit)[1] if fit else None
    return out


@pytest.mark.parametrize("forward,within,block,salts", [(False, None, 50, 1), (False, 40, 7, 3), (True, None, 1000, 2), (True, 15, 13, 1)])
def test_against_all_pairs(spark, forward, within, block, salts):
    rng = random.Random(2)
    left = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(0, 600, 3)])) for _ in range(300)]
    times = rng.sample(range(0, 600), 60)
    right = [(rng.choice(["a", "b", None]), s, s) for s in times] + [("a", None, -1)]
    ours, theirs = made(spark, left, right)
    rows = asof_join(ours, theirs, ["k"], forward=forward, within=within, block_seconds=block, salts=salts).collect()
    assert len(rows) == len(left)
    assert {r["id"]: r["match"] and r["match"]["id"] for r in rows} == nearest(left, right, forward, within)


def test_ties_repeats_and_empty_frames(spark):
    ours, theirs = made(spark, [("a", 10), ("a", 10)], [("a", 10, 1), ("a", 10, 2), ("a", 9, 3)])
    first = {r["match"]["id"] for r in asof_join(ours, theirs, ["k"]).collect()}
    again = {r["match"]["id"] for r in asof_join(ours, theirs.orderBy("id"), ["k"], block_seconds=1).collect()}
    assert first == again and first < {1, 2} and len(first) == 1
    assert asof_join(ours.limit(0), theirs, ["k"]).collect() == []
    assert [r["match"] for r in asof_join(ours, theirs.limit(0), ["k"]).collect()] == [None, None]
    assert asof_join(ours, theirs, ["k"]).columns == ["id", "k", "ts", "match"]
    with pytest.raises(ValueError):
        asof_join(ours, theirs, ["k"], into="id")


def test_no_join_and_one_exchange_of_rows(spark):
    ours, theirs = made(spark, [("a", 10)], [("a", 9, 3)])
    plan = asof_join(ours, theirs, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
