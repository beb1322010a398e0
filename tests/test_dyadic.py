import random

import pytest
from pyspark.sql import functions as F

from rillcount.operators.dyadic import DyadicCountMin, DyadicCountSketch, Hierarchy
from rillcount.operators.exact import item_totals

SCHEMA = "item long, weight long"
# All levels exact: every answer must be the true one.
EXACT = Hierarchy(6, 2, 64, 4)
MIXED = Hierarchy(12, 4, 512, 4, 3)
UNEVEN = Hierarchy(10, 4, 256, 4, 3)


def stream(seed, top, n=2000):
    rng = random.Random(seed)
    return [(int(rng.paretovariate(0.7) * 5) % top, rng.randint(1, 9)) for _ in range(n)]


def totals_of(updates):
    found = {}
    for item, weight in updates:
        found[item] = found.get(item, 0) + weight
    return found


def test_levels():
    assert EXACT.levels == 3 and EXACT.exact_from == 1
    assert MIXED.levels == 3 and MIXED.exact_from == 1
    assert Hierarchy(32, 8, 2000, 10).exact_from == 3
    for bad in ((0, 1), (33, 8), (8, 9), (8, 0)):
        with pytest.raises(ValueError):
            Hierarchy(*bad, 10, 2)


@pytest.mark.parametrize("h", [EXACT, MIXED, UNEVEN, Hierarchy(12, 4, 8, 1, 3)])
def test_union_of_levels_equals_each_level(make, h):
    tree = DyadicCountMin.build(make(stream(1, h.top), SCHEMA), h)
    cells = {(r.level, r.row, r.bucket): r.c for r in tree.cells().collect()}
    for level in range(h.levels):
        if level >= h.exact_from:
            want = {(level, -1, r.prefix): r.c for r in tree.prefix_counts(level).collect()}
        else:
            want = {(level, r.row, r.bucket): r.c for r in tree.level_cells(level).collect()}
        assert {k: v for k, v in cells.items() if k[0] == level} == want


@pytest.mark.parametrize("h", [MIXED, UNEVEN, Hierarchy(12, 3, 8, 2, 3), Hierarchy(12, 12, 64, 3, 3)])
def test_heavy_hitters_have_full_recall(make, h):
    updates = stream(2, h.top)
    true = totals_of(updates)
    thr = sum(true.values()) // 50 + 1
    tree = DyadicCountMin.build(make(updates, SCHEMA), h)
    found = {r.item: r.est for r in tree.heavy_hitters(F.lit(thr)).collect()}
    assert {i for i, c in true.items() if c >= thr} <= set(found)
    assert all(est >= max(thr, true.get(i, 0)) and 0 <= i < h.top for i, est in found.items())


@pytest.mark.parametrize("kind", [DyadicCountMin, DyadicCountSketch])
def test_stored_cells_answer_the_same(make, spark, tmp_path, kind):
    updates = stream(7, MIXED.top)
    direct = kind.build(make(updates, SCHEMA), MIXED)
    single = kind.build(make(updates, SCHEMA), MIXED, per_item_first=False).store()
    single.cells().write.partitionBy("level").parquet(str(tmp_path / "cells"))
    written = kind.from_cells(MIXED, spark.read.parquet(str(tmp_path / "cells")))
    thr = F.lit(sum(w for _, w in updates) // 60)
    want = sorted(map(tuple, direct.heavy_hitters(thr).collect()))
    for tree in (single, written):
        assert tree.total().first().n == sum(w for _, w in updates)
        assert sorted(map(tuple, tree.heavy_hitters(thr).collect())) == want
        assert tree.second_moment().first() == direct.second_moment().first()
        assert tree.size().first() == direct.size().first()
    assert MIXED.max_cells >= direct.cells().count()


@pytest.mark.parametrize("kind", [DyadicCountMin, DyadicCountSketch])
def test_descent_without_broadcasts(make, spark, kind):
    """Shuffled joins and a frontier spread over tasks give the same answer."""
    h = Hierarchy(16, 8, 4096, 3, 4)
    updates = stream(8, h.top)
    tree = kind.build(make(updates, SCHEMA), h).store()
    thr = F.lit(sum(w for _, w in updates) // 80)
    want = sorted(map(tuple, tree.heavy_hitters(thr).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, tree.heavy_hitters(thr).collect())) == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_removals_hide_children_of_light_ancestors(make):
    """An id whose ancestor falls below the threshold is not reached."""
    h = Hierarchy(8, 2, 64, 4)
    updates = [(4, 100), (5, -99), (200, 50)]
    tree = DyadicCountMin.build(make(updates, SCHEMA), h)
    assert [r.item for r in tree.heavy_hitters(F.lit(20)).collect()] == [200]


@pytest.mark.parametrize("h", [Hierarchy(8, 2, 4096, 4), Hierarchy(7, 3, 4096, 4), Hierarchy(8, 8, 4096, 4)])
def test_ranges_and_quantiles_with_little_noise(make, h):
    """Wide sketches have no collisions here, so answers must equal brute force."""
    updates = stream(3, h.top, 800)
    true = totals_of(updates)
    n = sum(true.values())
    tree = DyadicCountMin.build(make(updates, SCHEMA), h)
    assert tree.count(make([(i,) for i in range(h.top)], "prefix long"), 0).where(
        F.col("est") > 0).count() == len([c for c in true.values() if c])
    rng = random.Random(4)
    spans = [(0, h.top - 1), (0, 0), (0, 2**h.gran - 2), (5, 5), (3, h.top + 50), (7, 2)]
    spans += [tuple(sorted(rng.sample(range(h.top), 2))) for _ in range(30)]
    got = {r.range_id: r.est for r in tree.range_sums(
        make([(i, a, b) for i, (a, b) in enumerate(spans)], "range_id int, start long, end long")).collect()}
    assert got == {i: sum(c for x, c in true.items() if a <= x <= b) for i, (a, b) in enumerate(spans)}

    goals = [0, 1, n // 3, n // 2, n - 1, n, n + 1]
    ask = make([(i, g) for i, g in enumerate(goals)], "target_id int, target long")
    left = {r.target_id: r.item for r in tree.find_range(ask).collect()}
    right = {r.target_id: r.item for r in tree.find_range_from_right(ask).collect()}
    for i, g in enumerate(goals):
        if g > n:
            assert left[i] == right[i] == h.top
            continue
        prefix = [x for x in range(h.top) if sum(c for y, c in true.items() if y <= x) > g]
        suffix = [x for x in range(h.top) if sum(c for y, c in true.items() if y >= x) >= g]
        assert left[i] == (prefix[0] if prefix else h.top - 1)
        assert right[i] == suffix[-1]

    fractions = make([(1, -0.1), (2, 1.5), (3, 0.5)], "target_id int, frac double")
    q = {r.target_id: r.item for r in tree.quantiles(fractions).collect()}
    assert q[1] == 0 and q[2] == h.top
    assert q[3] in range(h.top)


def test_second_moment_is_never_below_the_truth(make):
    updates = stream(5, 256, 400)
    tree = DyadicCountMin.build(make(updates, SCHEMA), Hierarchy(8, 4, 64, 4))
    assert tree.second_moment().first().est >= sum(c * c for c in totals_of(updates).values())


def hash31(a, b, x):
    r = a * x + b
    return ((r >> 31) + r) & 2147483647


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_count_sketch_matches_plain_python(make, depth):
    h = Hierarchy(8, 4, 16, depth, 9)
    updates = stream(6, h.top, 500)
    sketch = DyadicCountSketch.build(make(updates, SCHEMA), h)
    cells = {}
    for item, weight in updates:
        for level in range(2):
            x = item >> (4 * level)
            for row, (a, b, c, d) in enumerate(sketch.coeffs):
                key = level, row, hash31(a, b, x) % 16
                sign = 1 if hash31(c, d, x) & 1 else -1
                cells[key] = cells.get(key, 0) + sign * weight
    cells[2, -1, 0] = sum(w for _, w in updates)
    assert {(r.level, r.row, r.bucket): r.c for r in sketch.cells().collect()} == cells

    def estimate(level, x):
        found = [(1 if hash31(c, d, x) & 1 else -1) * cells.get((level, row, hash31(a, b, x) % 16), 0)
                 for row, (a, b, c, d) in enumerate(sketch.coeffs)]
        if depth == 2:
            s = sum(found)
            return -(-s // 2) if s < 0 else s // 2
        return sorted(found)[depth // 2]

    got = sketch.point(item_totals(make(updates, SCHEMA))).collect()
    assert all(r.est == estimate(0, r.item) for r in got)
    above = sketch.count(make([(p,) for p in range(16)], "prefix long"), 1).collect()
    assert all(r.est == estimate(1, r.prefix) for r in above)
    thr = 60
    want = {x for x in range(256) if estimate(1, x >> 4) >= thr and estimate(0, x) >= thr}
    assert {r.item for r in sketch.heavy_hitters(F.lit(thr)).collect()} == want


@pytest.mark.parametrize("limit", ["10485760", "-1"])
@pytest.mark.parametrize("kind", [DyadicCountMin, DyadicCountSketch])
def test_repeated_prefixes_come_back_as_often(spark, make, kind, limit):
    tree = kind.build(make([(5, 3), (300, 4)], "item long, weight long"), Hierarchy(16, 8, 16, 3, 5))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        asked = make([(5,), (5,), (300,)], "prefix long")
        assert sorted(map(tuple, tree.count(asked, 0).collect())) == [(5, 3), (5, 3), (300, 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ids_outside_the_universe_are_an_error(make):
    for item in (5000, -1):
        tree = DyadicCountMin.build(make([(item, 3)], "item long, weight long"), Hierarchy(12, 4, 16, 3, 5))
        with pytest.raises(Exception, match="universe"):
            tree.cells().collect()


def test_repeated_and_null_questions_each_have_their_answer(make):
    totals = make([(i, 11) for i in range(10)], "item long, total long")
    tree = DyadicCountMin(Hierarchy(8, 2, 64, 3, 5), totals).store()
    ranges = [(1, 0, 9), (1, 0, 9), (1, 3, 4), (2, None, 4), (3, 4, None), (4, 9, 0)]
    got = tree.range_sums(make(ranges, "range_id long, start long, end long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 110), (1, 110), (1, 22), (2, None), (3, None), (4, 0)], key=str)
    asked = make([(7, 100), (7, 100), (7, 0), (8, None), (9, 111)], "target_id long, target long")
    right = sorted(map(tuple, tree.find_range(asked).collect()), key=str)
    assert right == sorted([(7, 9), (7, 9), (7, 0), (8, None), (9, 256)], key=str)
    assert sorted(r.target_id for r in tree.find_range_from_right(asked).collect()) == [7, 7, 7, 8, 9]
    fractions = make([(1, 0.5), (1, 0.5), (1, 0.95), (2, None), (3, -1.0), (3, 2.0)], "target_id long, frac double")
    found = sorted(map(tuple, tree.quantiles(fractions).collect()), key=str)
    assert [r for r in found if r[0] != 1] == [(2, None), (3, 0), (3, 256)]
    halves = [r[1] for r in found if r[0] == 1]
    assert len(halves) == 3 and len(set(halves)) == 2
