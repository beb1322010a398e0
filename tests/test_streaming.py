import random

import pytest
from pyspark.sql import functions as F

from rillcount.operators.counters import Budget
from rillcount.operators.dyadic import DyadicCountMin, DyadicCountSketch, Hierarchy
from rillcount.operators.exact import item_totals
from rillcount.operators.linear import CountMin, SketchShape
from rillcount.streaming import counters, runs, sketches

SCHEMA = "item long, weight long, pos long"


@pytest.fixture
def arrivals(spark, tmp_path):
    """A stream that arrives as five files in order of position, and its rows."""
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.33 else rng.randint(0, 300), rng.randint(1, 5), i)
            for i in range(1003)]
    for part in range(5):
        spark.createDataFrame(rows[part * 201:(part + 1) * 201], SCHEMA).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"part={part}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in" / "part=*"))
    return stream, rows


def same(a, b, keys):
    left = {tuple(r[k] for k in keys): r.c for r in a.collect()}
    assert left == {tuple(r[k] for k in keys): r.c for r in b.collect()}
    assert left


def test_streamed_sketch_equals_batch(spark, make, arrivals):
    stream, rows = arrivals
    shape = SketchShape(64, 3, 2)
    state = sketches.run_to_memory(sketches.streaming_cells(stream, shape), "t_cm", 192)
    same(state, CountMin.build(make(rows, SCHEMA), shape).cells, ("row", "bucket"))
    collected = sketches.collect_cells(stream, lambda b: sketches.streaming_cells(b, shape))
    same(collected, CountMin.build(make(rows, SCHEMA), shape).cells, ("row", "bucket"))
    with pytest.raises(ValueError):
        sketches.run_to_memory(sketches.streaming_cells(stream, shape), "t_big", 10**9)


@pytest.mark.parametrize("signed", [False, True])
def test_streamed_levels_equal_batch(make, arrivals, signed):
    stream, rows = arrivals
    h = Hierarchy(12, 4, 32, 3, 5)
    kind = DyadicCountSketch if signed else DyadicCountMin
    state = sketches.run_to_memory(
        sketches.streaming_level_cells(stream, h, signed=signed), f"t_levels_{signed}", 10**4)
    same(state, kind.build(make(rows, SCHEMA), h).cells(), ("level", "row", "bucket"))


def test_runs_are_written_when_complete(arrivals):
    stream, rows = arrivals
    done = runs.run_to_table(runs.run_increments(stream, 100), "t_runs")
    want = {}
    for item, weight, pos in rows[:1000]:
        want[pos // 100, item] = want.get((pos // 100, item), 0) + weight
    assert {(r.run, r.item): r.w for r in done.collect()} == want
    totals = {(r.run, r.item): r.total for r in runs.snapshots(done).collect()}
    assert totals[9, 7] == sum(w for i, w, p in rows if i == 7 and p < 1000)


def test_collected_runs_lose_no_update(arrivals):
    stream, rows = arrivals
    want = {}
    for item, weight, pos in rows:
        want[pos // 100, item] = want.get((pos // 100, item), 0) + weight
    assert {(r.run, r.item): r.w for r in runs.collect_runs(stream, 100).collect()} == want


def test_folders_of_many_batches_are_summed_up(spark, make, tmp_path):
    """64 micro-batches leave at most a dozen folders; a batch that is repeated counts once."""
    path, want = str(tmp_path / "sums"), {}
    runs.open_sums(spark, path)
    for number in range(64):
        rows = [(number % 3, "hot", 5), (number, None, 1), (7, "hot", -2)]
        for run, item, w in rows:
            want[run, item] = want.get((run, item), 0) + w
        batch = make(rows, "run long, item string, w long").groupBy("run", "item").agg(F.sum("w").alias("w"))
        for _ in range(1 + (number in (3, 15, 16, 63))):
            runs.add_sums(batch, "w", path, number)
        if number in (2, 20, 63):
            runs.open_sums(spark, path)
            got = runs.read_sums(spark, path, batch.schema, "w")
            assert {(r.run, r.item): r.w for r in got.collect()} == want
            assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) <= {2: 3, 20: 3, 63: 1}[number]
    assert len([f for f in (tmp_path / "sums").iterdir() if f.name != "manifest"]) <= 12


def test_a_batch_that_breaks_off_counts_once(spark, make, tmp_path, monkeypatch):
    """Broken off between its folder and its manifest, at a batch that takes full levels in, and with numbers left out."""
    path, schema = str(tmp_path / "sums"), "item long, w decimal(18,2)"
    runs.open_sums(spark, path)
    assert runs.read_sums(spark, path, make([], schema).schema, "w").count() == 0
    numbers = [0, 1, 4, 5, 9, 10]
    for number in numbers:
        batch = make([(1, None), (number, None)], "item long, x int").select("item", F.lit(1).cast("decimal(18,2)").alias("w")).groupBy(
            "item").agg(F.sum("w").alias("w"))
        known = runs._live(spark, path, number)
        with monkeypatch.context() as m:
            m.setattr(runs, "_live", lambda *_: known)
            m.setattr(runs, "_MANIFEST", "no schema at all")
            with pytest.raises(Exception):
                runs.add_sums(batch, "w", path, number)
        runs.add_sums(batch, "w", path, number)
        assert runs.read_sums(spark, path, batch.schema, "w").agg(F.sum("w")).first()[0] == 2 * (numbers.index(number) + 1)
    got = {r.item: int(r.w) for r in runs.read_sums(spark, path, batch.schema, "w").collect()}
    assert got == {0: 1, 1: 7, 4: 1, 5: 1, 9: 1, 10: 1}


@pytest.mark.parametrize("budget", [Budget.im_sum(1 / 20, 0.5), Budget.space_saving(1 / 20)])
def test_streamed_summary_keeps_its_bounds(make, arrivals, budget):
    stream, rows = arrivals
    true, n = item_totals(make(rows, SCHEMA)), sum(w for _, w, _ in rows)
    collected = counters.collect_summary(stream, budget)
    assert collected.errors.first().weight == n
    judged = collected.point(true)
    assert judged.where(f"lower > total or total > est or q > {n / budget.counters}").isEmpty()
    written = runs.run_to_table(counters.streaming_summary(stream, budget, 3), "t_summary")
    assert written.agg(F.max("seq")).first()[0] == 5
    summary = counters.latest_summary(written, budget)
    assert summary.errors.first().weight == n
    judged = summary.point(true)
    assert judged.where("lower > total or total > est").isEmpty()
    assert judged.where(F.col("q") > n / budget.counters).isEmpty()
