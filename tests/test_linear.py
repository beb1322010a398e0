import random

import pytest
from pyspark.sql import functions as F

from rillcount.functions import hashing
from rillcount.operators.exact import (
    cumulative_heavy_hitters, dense_position, inner_product, item_totals, run_slices, second_moment,
    split_runs,
)
from rillcount.operators.linear import CountMin, SketchShape, merge_all

SCHEMA = "item long, weight long"


def stream(seed, n=3000, items=200, low=1, high=9):
    rng = random.Random(seed)
    return [(int(rng.paretovariate(0.8)) % items, rng.randint(low, high)) for _ in range(n)]


def hash31(a, b, x):
    r = a * x + b
    return ((r >> 31) + r) & 2147483647


def plain_cells(shape, updates):
    cells = {}
    for item, weight in updates:
        for row, (a, b) in enumerate(shape.coeffs):
            key = row, hash31(a, b, item) % shape.width
            cells[key] = cells.get(key, 0) + weight
    return cells


def as_dict(cells):
    return {(r.row, r.bucket): r.c for r in cells.collect()}


def test_hash_values(spark):
    xs = [0, 1, 2, 2**31 - 1, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    a, b, c, d = 2**31 - 2, 2**31 - 2, 77, 99
    got = df.select(
        "x", hashing.hash31(a, b, F.col("x")).alias("h"),
        hashing.fourwise(a, b, c, d, F.col("x")).alias("f"),
        hashing.sign_hash(c, d, F.col("x")).alias("s")).collect()
    for r in got:
        assert r.h == hash31(a, b, r.x)
        assert r.f == hash31(hash31(hash31(a, b, r.x), c, r.x), d, r.x)
        assert r.s == (1 if hash31(c, d, r.x) & 1 else -1)


def test_threshold_is_strictly_above(spark):
    df = spark.createDataFrame([(13,), (10,), (0,)], "n long")
    assert [r[0] for r in df.select(hashing.threshold(0.2, F.col("n"))).collect()] == [3, 3, 1]


@pytest.mark.parametrize("depth", [1, 2, 5])
@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_build_and_points_match_plain_python(spark, make, depth, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        shape = SketchShape(32, depth, 5)
        updates = stream(1, low=-3, high=5)
        sketch = CountMin.build(make(updates, SCHEMA), shape)
        cells = plain_cells(shape, updates)
        assert as_dict(sketch.cells) == cells
        direct = CountMin.build(make(updates, SCHEMA), shape, per_item_first=False)
        assert as_dict(direct.cells) == cells
        queried = make([(i,) for i in list(range(0, 400, 3)) + [3, 3]], "item long")
        mine = sketch.point_median(sketch.point(queried).withColumnRenamed("est", "low")).collect()
        assert len(mine) == queried.count()
        for r in mine:
            found = [cells.get((row, hash31(a, b, r.item) % 32), 0)
                     for row, (a, b) in enumerate(shape.coeffs)]
            assert r.low == min(found)
            if depth == 2:
                want = found[0] if abs(found[0]) < abs(found[1]) else found[1]
            else:
                want = sorted(found)[depth // 2]
            assert r.est == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_linear_laws(make):
    shape = SketchShape(64, 4, 6)
    a, b = stream(2), stream(3)
    whole = CountMin.build(make(a + b, SCHEMA), shape)
    left, right = (CountMin.build(make(x, SCHEMA), shape) for x in (a, b))
    assert as_dict(left.merge(right).cells) == as_dict(whole.cells)
    assert as_dict(merge_all([left, right, left.empty_like()]).cells) == as_dict(whole.cells)
    undone = CountMin.build(make(a + [(i, -w) for i, w in a], SCHEMA), shape)
    assert set(as_dict(undone.cells).values()) == {0}
    shuffled = random.Random(1).sample(a, len(a))
    assert as_dict(CountMin.build(make(shuffled, SCHEMA).repartition(7), shape).cells) == as_dict(left.cells)


def test_incompatible_sketches_are_refused(make):
    df = make(stream(2, 50), SCHEMA)
    a, b = (CountMin.build(df, SketchShape(64, 4, s)) for s in (1, 2))
    assert not a.compatible(b) and a.compatible(a.empty_like())
    with pytest.raises(ValueError):
        a.inner_product(b)
    with pytest.raises(ValueError):
        CountMin.build(df, SketchShape(63, 4)).second_moment()


def test_estimates_bound_the_truth(make):
    shape = SketchShape(128, 5, 7)
    fa, fb = make(stream(4), SCHEMA), make(stream(5), SCHEMA)
    a, b = CountMin.build(fa, shape), CountMin.build(fb, shape)
    ta, tb = item_totals(fa), item_totals(fb)
    assert a.inner_product(b).first().est >= inner_product(ta, tb).first().product
    assert a.point(ta).where("est < total").isEmpty()
    nothing = ta.where("total < 0")
    n = ta.agg(F.sum("total")).first()[0]
    assert a.residue(nothing).first().est == n
    assert a.residue(ta).first().est == 0
    assert a.empty_like().inner_product(b).first().est == 0
    assert a.empty_like().second_moment().first().est == 0


def test_second_moment_matches_plain_python(make):
    shape = SketchShape(16, 5, 8)
    updates = stream(6, 500)
    cells = plain_cells(shape, updates)
    sums = sorted(
        sum((cells.get((r, 2 * p), 0) - cells.get((r, 2 * p + 1), 0)) ** 2 for p in range(8))
        for r in range(5))
    sketch = CountMin.build(make(updates, SCHEMA), shape)
    assert sketch.second_moment().first().est == sums[2]


def test_large_products_do_not_overflow(make):
    big = make([(1, 4 * 10**12), (2, 10**12)], SCHEMA)
    assert second_moment(item_totals(big)).first().f2 == 17 * 10**24
    shape = SketchShape(64, 3, 1)
    a = CountMin.build(big, shape)
    assert a.inner_product(a).first().est >= 17 * 10**24


TINY = [(1, 5, 0), (2, 3, 1), (1, 2, 2), (3, 1, 3), (4, 1, 4), (1, 1, 5)]


def test_runs_of_the_tiny_stream(make):
    tiny = make(TINY, "item long, weight long, pos long")
    assert {r.run: r.n for r in split_runs(tiny, 4, include_tail=False).groupBy("run").agg(
        F.count("*").alias("n")).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    assert split_runs(tiny, 4).count() == 6
    whole, cut = run_slices(tiny, 4), run_slices(tiny, 4, include_tail=False)
    assert [sorted(r.pos for r in s.collect()) for s in whole] == [[0], [1], [2], [3, 4, 5]]
    assert [sorted(r.pos for r in s.collect()) for s in cut] == [[0], [1], [2], [3]]
    got = cumulative_heavy_hitters(split_runs(tiny, 3), 0.2).collect()
    assert {(r.run, r.item, r.total) for r in got} == {
        (0, 1, 5), (0, 2, 3), (1, 1, 7), (1, 2, 3), (2, 1, 8), (2, 2, 3)}


def test_cumulative_heavy_hitters_after_removals(make):
    """A falling threshold makes an item heavy that was not used since."""
    rows = make([(0, 1, 10), (0, 2, 4), (1, 1, -8)], "run int, item long, weight long")
    got = {(r.run, r.item, r.total) for r in cumulative_heavy_hitters(rows, 0.4).collect()}
    assert got == {(0, 1, 10), (1, 2, 4)}


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_null_items_are_alike_on_every_path(spark, make, limit):
    rows = make([(1, 5), (None, 7), (2, 3)], "item long, weight long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for first in (True, False):
            sketch = CountMin.build(rows, SketchShape(16, 3), per_item_first=first)
            assert sketch.total().first().n == 8
            assert {r.item: r.est for r in sketch.point(rows.select("item")).collect()} == {1: 5, 2: 3, None: None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cumulative_heavy_hitters_match_plain_python(make):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3, 4, 5 + i % 40]), rng.randint(1, 5), i) for i in range(600)]
    got = cumulative_heavy_hitters(
        split_runs(make(rows, "item long, weight long, pos long"), 8), 0.05).collect()
    size, total, want = 600 // 8, {}, set()
    for run in range(8):
        for item, weight, _ in rows[run * size:(run + 1) * size]:
            total[item] = total.get(item, 0) + weight
        thr = int(0.05 * sum(total.values())) + 1
        want |= {(run, i, c) for i, c in total.items() if c >= thr}
    assert {(r.run, r.item, r.total) for r in got} == want


def test_dense_position_of_skewed_keys(spark):
    keys = [i**3 for i in range(1500)] + [-5, 10**12]
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(5)
    for ranges in (None, 1, 2, 40):
        got = {r.key: r.pos for r in dense_position(df, "key", ranges).collect()}
        assert got == {k: i for i, k in enumerate(sorted(keys))}
