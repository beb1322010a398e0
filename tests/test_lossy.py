import random

import pytest
from rillcount.operators import lossy
from rillcount.operators.order_stats import kth_smallest

SCHEMA = "item long, weight long, pos long"


def one_by_one(rows, w, tail=False):
    """Lossy counting as it is defined, update by update."""
    held, epochs = {}, len(rows) // w
    for e in range(epochs):
        seen = {}
        for item, weight, _ in rows[e * w:(e + 1) * w]:
            seen[item] = seen.get(item, 0) + weight
        for item in set(held) | set(seen):
            kept, used = held.get(item, (0, 0))
            kept, used = kept + seen.get(item, 0) - 1, used + seen.get(item, 0)
            held[item] = (kept, used)
        held = {i: v for i, v in held.items() if v[0] > 0}
    return {i: (kept, kept + epochs, used) for i, (kept, used) in held.items()}


@pytest.fixture(params=["in order", "scattered"])
def updates_of(request, spark, make):
    """Updates whose tasks read contiguous stretches, or positions in any order."""
    return make if request.param == "scattered" else lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("signed", [False, True])
@pytest.mark.parametrize("w", [4, 10])
def test_fold_equals_the_recursion(updates_of, w, signed):
    make = updates_of
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(rng.choice([1, 1, 2, 3, 4, 5 + i % 20]),
                 -1 if signed and rng.random() < 0.2 else 1, i) for i in range(137)]
        got = lossy.lossy_count(make(rows, SCHEMA), 1 / w, include_tail=False).collect()
        assert {r.item: (r.kept, r.est, r.lower) for r in got} == one_by_one(rows, w)


def test_bursts_and_gaps(updates_of):
    """An item that comes, dies out, and comes back."""
    make = updates_of
    rows = [(1 if i // 10 in (0, 5, 6) else 2 + i % 7, 1, i) for i in range(95)]
    got = lossy.lossy_count(make(rows, SCHEMA), 1 / 10, include_tail=False).collect()
    assert {r.item: (r.kept, r.est, r.lower) for r in got} == one_by_one(rows, 10)


def test_one_row_for_an_item_and_stretch(spark):
    """What is shuffled does not grow with the epochs, and short stretches give the same counts."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None, "c", f"x{i % 9}"]), 1, i) for i in range(4000)]
    updates = spark.createDataFrame(rows, "item string, weight long, pos long").coalesce(2)
    folded = lossy.stretches(updates, 10)
    inner, parts = folded.where("whole").count(), folded.where("not whole").count()
    assert inner <= 2 * 13 and parts <= 4 * 13
    assert lossy.epoch_counts(updates, 10).count() > 1000
    held = {r.item: (r.kept, r.est, r.lower) for r in lossy.lossy_count(updates, 1 / 10, include_tail=False).collect()}
    assert held == one_by_one(rows, 10)


def test_tail_is_left_out_on_request(make):
    rows = [(1, 1, i) for i in range(20)] + [(2, 1, 20 + i) for i in range(5)]
    updates = make(rows, SCHEMA)
    plain = {r.item: r.est for r in lossy.lossy_count(updates, 1 / 10, include_tail=False).collect()}
    full = {r.item: (r.est, r.lower) for r in lossy.lossy_count(updates, 1 / 10).collect()}
    assert plain == {1: 20}
    assert full == {1: (20, 20), 2: (7, 5)}


def test_estimates_bracket_the_truth(make):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, 3 + i % 60]), 1, i) for i in range(660)]
    true = {}
    for item, *_ in rows:
        true[item] = true.get(item, 0) + 1
    for delta in (False, True):
        w = lossy.window_size(1 / 30, delta)
        n = len(rows) // w * w
        exact = {}
        for item, *_ in rows[:n]:
            exact[item] = exact.get(item, 0) + 1
        held = lossy.lossy_count(make(rows, SCHEMA), 1 / 30, with_delta=delta, include_tail=False).collect()
        assert all(r.lower <= exact[r.item] <= r.est for r in held)
        assert {i for i, c in exact.items() if c > n // w} <= {r.item for r in held}


def test_point_and_sizes(make):
    rows = [(1, 1, i) for i in range(20)]
    counts = lossy.lossy_count(make(rows, SCHEMA), 1 / 10)
    got = lossy.lossy_point(counts, make([(1,), (9,)], "item long")).collect()
    assert {r.item: r.est for r in got} == {1: 20, 9: 0}
    assert lossy.window_size(1 / 10) == 10 and lossy.window_size(1 / 10, True) == 11
    assert lossy.dense_size(0.01) == 5 * 100 * 8 + 48


@pytest.mark.parametrize("bits,span", [(64, 2**60), (32, 2**30), (16, 100), (40, 2**39), (20, 2**19), (8, 100)])
def test_kth_smallest_against_sorting(make, bits, span):
    rng = random.Random(bits)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randint(-span // 2, span // 2)
             if bits > 16 else rng.randint(-50, 50)) for _ in range(900)]
    df = make(rows, "g string, v long")
    for k in (1, 40, 10**4):
        got = {r.g: r.value for r in kth_smallest(df, ["g"], "v", k, bits).collect()}
        want = {}
        for g in {"hot", "a", "b", "c"}:
            values = sorted(v for x, v in rows if x == g)
            if len(values) >= k:
                want[g] = values[k - 1]
        assert got == want
    everything = sorted(v for _, v in rows)
    assert kth_smallest(df, [], "v", 17, bits, zero_based=True).first().value == everything[17]


WHOLE = ["k2_dim_sum_epochs", "k11_lossy_count", "k11_lossy_count_signed", "k12_lossy_point", "k13_lossy_count_delta"]


@pytest.mark.parametrize("name", WHOLE)
def test_registered_queries_count_the_tail(spark, make, monkeypatch, name):
    """An item that is used after the last full epoch only, and never before."""
    from checks import counters
    from rillcount.sources import tables

    rows = [(i % 5, 1, i) for i in range(262)] + [(99, 1, 262)]  # 262 is no full epoch, nor the end of a quarter
    updates = make(rows, SCHEMA)
    monkeypatch.setattr(tables, "user_events", lambda spark, d: updates)
    monkeypatch.setattr(counters, "users", lambda spark, d: updates.select("item").distinct())
    found = {r.item: r for r in counters.CHECKS[name][0](spark, "").collect()}
    assert 99 in found and (name[1:3] != "12" or found[99].est > 0)
