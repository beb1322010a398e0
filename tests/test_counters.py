import random

import pytest
from pyspark.sql import functions as F

from rillcount.operators import counters
from rillcount.operators.counters import Budget
from rillcount.operators.exact import item_totals, split_runs, top_k

SCHEMA = "item long, weight long, pos long"


def stream(seed, n=1500, hot=0.3):
    """Skewed stream in which one item holds about a third of all rows."""
    rng = random.Random(seed)
    return [(7 if rng.random() < hot else int(rng.paretovariate(0.6)) % 5000, rng.randint(1, 9), i)
            for i in range(n)]


def totals_of(rows):
    found = {}
    for item, weight, *_ in rows:
        found[item] = found.get(item, 0) + weight
    return found


def check(summary, rows, make, counters_used, extra=1):
    """Every item's bracket holds its true total and q keeps its bound."""
    true = totals_of(rows)
    n = sum(true.values())
    asked = make([(i,) for i in list(true) + [10**6, 10**6 + 1]], "item long")
    for r in summary.point(asked).collect():
        assert r.lower <= true.get(r.item, 0) <= r.est
        assert r.q <= extra * n / counters_used
    return summary


def test_budgets():
    assert Budget.im_sum(0.01, 4.0) == Budget(100, 499)
    assert Budget.dim_sum(0.01, 1.0) == Budget(101, 201)
    assert Budget.space_saving(0.01) == Budget(103, 102)
    assert Budget.unit_space_saving(0.01) == Budget(101, 100)


@pytest.mark.parametrize("shards", [1, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_im_sum_brackets_and_prunes(make, seed, shards):
    rows = stream(seed, 6000)  # enough distinct items to fill every shard
    totals = item_totals(make(rows, SCHEMA))
    summary = check(counters.im_sum(totals, 1 / 20, 1.0, shards), rows, make, 20)
    kept = {r.shard: r["count"] for r in summary.items.groupBy("shard").count().collect()}
    errors = {r.shard: r.q for r in summary.errors.collect()}
    assert len(errors) == shards and any(errors.values())
    # A pruned shard keeps fewer items than counters, another at most its capacity.
    assert all(kept.get(s, 0) < 20 if q else kept[s] <= 39 for s, q in errors.items())
    check(summary.collapse(), rows, make, 20, extra=2)


def test_nothing_is_pruned_below_capacity(make):
    rows = stream(3, 60)
    summary = counters.im_sum(item_totals(make(rows, SCHEMA)), 1 / 50, 4.0)
    assert {(r.item, r.residual, r.q) for r in summary.state().collect()} == {
        (i, c, 0) for i, c in totals_of(rows).items()}


def test_pruning_matches_sorting(make):
    rows = stream(4)
    true = totals_of(rows)
    delta = sorted(true.values(), reverse=True)[9]
    got = counters.summarise(item_totals(make(rows, SCHEMA)), Budget(10, 10)).state().collect()
    assert {(r.item, r.residual) for r in got} == {
        (i, c - delta) for i, c in true.items() if c > delta}
    assert {r.q for r in got} <= {delta}


@pytest.mark.parametrize("gamma", [0.25, 4.0])
def test_dim_sum_over_epochs(make, gamma):
    rows = stream(5)
    cut = split_runs(make(rows, SCHEMA), 5)
    epochs = [item_totals(cut.where(F.col("run") == e)) for e in range(5)]
    summary = check(counters.dim_sum(epochs, 1 / 20, gamma), rows, make, 20)
    thr = sum(totals_of(rows).values()) // 20 + 1
    heavy = {i for i, c in totals_of(rows).items() if c >= thr}
    assert heavy <= {r.item for r in summary.heavy_hitters(F.lit(thr)).collect()}


def test_merge_of_separate_summaries(make):
    rows = stream(6)
    parts = [counters.im_sum(item_totals(make(rows[i::4], SCHEMA)), 1 / 20, 0.5) for i in range(4)]
    check(counters.merge(parts), rows, make, 20)
    with pytest.raises(ValueError):
        counters.merge([parts[0], counters.im_sum(item_totals(make(rows, SCHEMA)), 1 / 30)])


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_in_place_summary_holds_for_any_split(make, partitions):
    rows = stream(7, 4000)
    updates = make(rows, SCHEMA).repartition(partitions)
    for budget in (Budget.im_sum(1 / 20, 0.5), Budget.space_saving(1 / 20)):
        summary = check(counters.summarise_in_place(updates, budget), rows, make, budget.counters)
        assert summary.errors.first().weight == sum(w for _, w, _ in rows)


def test_in_place_summary_of_nothing(make, spark):
    empty = spark.createDataFrame([], SCHEMA)
    summary = counters.summarise_in_place(empty, Budget.im_sum(0.1))
    assert summary.items.isEmpty()
    assert summary.errors.first().q == 0


def test_space_saving_finds_all_heavy_hitters(make):
    rows = stream(8)
    true = totals_of(rows)
    n = sum(true.values())
    phi = 1 / 25
    summary = counters.space_saving(item_totals(make(rows, SCHEMA)), phi)
    thr = int(phi * n) + 1
    found = {r.item: r for r in summary.heavy_hitters(F.lit(thr)).collect()}
    assert {i for i, c in true.items() if c >= thr} <= set(found)
    assert all(r.lower <= true[i] <= r.est for i, r in found.items())


def test_top_k_breaks_ties_by_item(make):
    est = make([(5, 9), (3, 9), (4, 1), (9, 20)], "item long, est long")
    assert [r.item for r in top_k(est, 3).collect()] == [9, 3, 5]


def test_sizes_grow_with_precision():
    for method in ("im_sum", "dim_sum", "space_saving", "unit_space_saving"):
        assert counters.dense_size(method, 0.001) > counters.dense_size(method, 0.01) > 0
    with pytest.raises(ValueError):
        counters.dense_size("other", 0.1)


@pytest.mark.parametrize("fan", [2, 16])
@pytest.mark.parametrize("size", [100, 700, 10_000])
def test_summary_from_blocks_brackets_and_differs(make, size, fan):
    rows = stream(9, 4000)
    updates = make(rows, SCHEMA).withColumn("block", F.expr(f"pos div {size}"))
    summary = check(counters.summarise_blocks(updates, Budget.im_sum(1 / 20, 0.5), fan=fan), rows, make, 20)
    error = summary.errors.collect()
    assert len(error) == 1 and error[0].weight == sum(w for _, w, _ in rows) and error[0].q > 0
    assert summary.items.count() <= 30
    true = totals_of(rows)
    assert any(r.est != true[r.item] for r in summary.estimates().collect()) or size > 4000


def test_summary_from_blocks_does_not_depend_on_splits(make):
    updates = make(stream(10, 3000), SCHEMA).withColumn("block", F.expr("pos div 200"))
    found = [sorted(map(tuple, counters.summarise_blocks(
        updates.repartition(n, "weight"), Budget(15, 20)).state().collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_summary_from_blocks_of_text_items_nulls_and_nothing(make):
    rows = [("a", 5, 0), (None, 9, 0), ("b", 1, 3), ("a", None, 3), ("a", 2, 9)]
    updates = make(rows, "item string, weight long, block long")
    summary = counters.summarise_blocks(updates, Budget(4, 8), fan=2)
    assert {tuple(r) for r in summary.state().collect()} == {(0, "a", 7, 0), (0, "b", 1, 0)}
    assert summary.errors.first().weight == 8
    nothing = counters.summarise_blocks(updates.where("false"), Budget(4, 8))
    assert nothing.items.isEmpty() and tuple(nothing.errors.first()) == (0, 0, 0)


def test_updates_that_no_summary_takes(make):
    negative = make([(1, -1, 0)], "item long, weight long, block long")
    for build in (counters.summarise_blocks, counters.summarise_in_place):
        with pytest.raises(Exception, match="must not be negative"):
            build(negative, Budget(4, 8)).items.collect()


def test_in_place_keeps_wide_ids_beside_nulls(make):
    wide = 9007199254740993
    updates = make([(wide, 2, 0), (None, 7, 1), (wide, 3, 2)], SCHEMA)
    summary = counters.summarise_in_place(updates, Budget(4, 8))
    assert [tuple(r) for r in summary.state().collect()] == [(0, wide, 5, 0)]
    assert summary.errors.first().weight == 5


def test_local_counters_fold_many_small_batches(monkeypatch):
    import numpy as np

    monkeypatch.setattr(counters, "GATHERED", 50)
    rows, budget = stream(11, 3000), Budget(20, 40)
    own = counters.LocalCounters(budget)
    for at in range(0, len(rows), 7):
        part = rows[at:at + 7]
        own.add(np.array([r[0] for r in part]), np.array([r[1] for r in part]))
    own.fold()
    true, kept = totals_of(rows), dict(zip(own.items.tolist(), own.residuals.tolist()))
    assert 0 < own.q <= own.weight / budget.counters and len(kept) <= budget.capacity
    assert all(kept.get(i, 0) <= c <= kept.get(i, 0) + own.q for i, c in true.items())


# Space-Saving with an error for each counter

def model(blocks, budget, fan):
    """Tracked summaries in plain Python: ``{item: (residual, seen)}`` and ``q`` of each part, merged ``fan`` at a time."""
    def pruned(kept, q):
        values = sorted((r for r, _ in kept.values()), reverse=True)
        d = values[budget.counters - 1] if len(values) > budget.capacity and len(values) >= budget.counters else 0
        return {i: (r - d, s) for i, (r, s) in kept.items() if r > d}, q + d

    parts = []
    for rows in blocks:
        kept = {}
        for item, weight in rows:
            kept[item] = kept.get(item, 0) + weight
        parts.append(pruned({i: (c, c) for i, c in kept.items()}, 0))
    while len(parts) > 1:
        merged = []
        for at in range(0, len(parts), fan):
            kept = {}
            for part, _ in parts[at:at + fan]:
                for i, (r, s) in part.items():
                    kept[i] = (kept.get(i, (0, 0))[0] + r, kept.get(i, (0, 0))[1] + s)
            merged.append(pruned(kept, sum(q for _, q in parts[at:at + fan])))
        parts = merged
    return parts[0]


@pytest.mark.parametrize("n_blocks, fan", [(1, 16), (7, 16), (9, 2)])
def test_counters_of_blocks_equal_the_model(make, n_blocks, fan):
    rng = random.Random(n_blocks)
    budget = Budget.space_saving(1 / 9)
    blocks = [[(rng.choice([1, 1, 2, 2, 3, 4, rng.randint(5, 60)]), rng.randint(0, 9)) for _ in range(80)] for _ in range(n_blocks)]
    rows = [(i, w, b) for b, block in enumerate(blocks) for i, w in block]
    summary = counters.summarise_blocks(
        make(rows, "item long, weight long, block long"), budget, fan=fan, tracked=True)
    kept, q = model(blocks, budget, fan)
    assert {r.item: (r["count"], r.delta) for r in summary.counters().collect()} == {
        i: (r + q, r + q - s) for i, (r, s) in kept.items()}
    true = {}
    for i, w, _ in rows:
        true[i] = true.get(i, 0) + w
    asked = make([(i,) for i in [*true, 999]], "item long")
    found = {r.item: r for r in summary.count_of(asked).collect()}
    assert all(r["count"] - r.delta <= true.get(i, 0) <= r["count"] for i, r in found.items())
    assert (found[999]["count"], found[999].delta) == (q, q)
    assert q * budget.counters <= sum(true.values())
    deltas = {found[i].delta for i in kept}
    assert deltas == {0} if n_blocks == 1 else len(deltas) > 1


@pytest.mark.parametrize("dealt", [True, False])
def test_several_budgets_have_one_pass_over_the_updates(make, monkeypatch, dealt):
    rng = random.Random(8)
    blocks = [[(rng.choice([1, 1, 2, rng.randint(3, 60)]), rng.randint(0, 9)) for _ in range(80)] for _ in range(9)]
    blocks[4] = [(i, 2) for i in range(100, 180)]  # nothing is left of a block whose items all weigh the same
    rows = [(i, w, b) for b, block in enumerate(blocks) for i, w in block] + [(None, 5, 1), (3, None, 2)]
    updates = make(rows, "item long, weight long, block long")
    budgets = [Budget.im_sum(1 / 9, 1.0), Budget.dim_sum(1 / 9, 1.0), Budget.space_saving(1 / 9), Budget(200, 300)]
    kept, cut = [], counters.cut_lineage
    monkeypatch.setattr(counters, "cut_lineage", lambda df: (kept.append(df), cut(df))[1])
    found = counters.summarise_blocks(updates.repartition("block") if dealt else updates, budgets, fan=3)
    plans = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1] for df in kept]
    source = next(line for line in plans[0].splitlines() if "Scan ExistingRDD" in line)
    assert [plan.count(source.strip(" +-:")) for plan in plans] == [1] + [0] * (len(plans) - 1)
    assert plans[0].count("Exchange hashpartitioning(") == (1 if dealt else 2)
    assert len(found) == len(budgets)
    for summary, budget in zip(found, budgets):
        items, q = model(blocks, budget, 3)
        assert {(r.shard, r.item, r.residual, r.q) for r in summary.state().collect()} == {
            (0, i, residual, q) for i, (residual, _) in items.items()}
        assert tuple(summary.errors.first()) == (0, q, sum(w for block in blocks for _, w in block))


def test_claims_are_sure_or_may_be_false(make):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, rng.randint(4, 90)]), 1, i // 50) for i in range(1000)]
    summary = counters.summarise_blocks(make(rows, "item long, weight long, block long"), Budget.space_saving(1 / 20), tracked=True)
    true = {}
    for i, *_ in rows:
        true[i] = true.get(i, 0) + 1
    claims = {r.item: r for r in summary.claims(F.lit(60)).collect()}
    assert {i for i, c in true.items() if c >= 60} <= set(claims)
    assert all(true[i] >= 60 for i, r in claims.items() if r.sure) and any(r.sure for r in claims.values())


def test_tracked_summaries_survive_storage_merging_and_scans(spark, make, tmp_path):
    rng = random.Random(12)
    halves = [[(rng.choice([1, 2, 3, rng.randint(4, 400)]), rng.randint(1, 5)) for _ in range(900)] for _ in range(2)]
    budget = Budget.unit_space_saving(1 / 15)
    parts = [counters.summarise_in_place(make(h, "item long, weight long"), budget, tracked=True) for h in halves]
    parts[0].rows().write.parquet(str(tmp_path / "first"))
    stored = parts[0].with_rows(spark.read.parquet(str(tmp_path / "first")))
    both = counters.merge([stored, parts[1]])
    true = {}
    for i, w in halves[0] + halves[1]:
        true[i] = true.get(i, 0) + w
    found = {r.item: r for r in both.count_of(make([(i,) for i in true], "item long")).collect()}
    assert all(r["count"] - r.delta <= true[i] <= r["count"] for i, r in found.items())
    assert len(both.counters().collect()) <= budget.capacity
    plain = counters.summarise_in_place(make(halves[0], "item long, weight long"), budget)
    with pytest.raises(ValueError):
        counters.merge([plain, parts[1]])
    with pytest.raises(ValueError):
        plain.counters()
