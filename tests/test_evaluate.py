import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rillcount.functions.hashing import coefficients
from rillcount.operators.counters import Budget
from rillcount.operators.exact import split_runs
from rillcount.operators.linear import CountMin, SketchShape, place
from rillcount.plans import evaluate, sweep

TOTALS = [(1, 8), (2, 3), (3, 1), (4, 1)]
MEASURES = ("recall", "precision", "re_true", "re_false")


def scores(row):
    return tuple(row[m] for m in MEASURES)


def judge(make, claims, thr=3):
    df = make(claims, "item long, est long") if claims else make([(0, 0)], "item long, est long").limit(0)
    return evaluate.evaluate(df, make(TOTALS, "item long, total long"), F.lit(thr)).first()


def test_true_and_false_positives(make):
    row = judge(make, [(1, 10), (3, 4)])
    assert scores(row) == (50.0, 50.0, 0.25, 3.0)


def test_false_positive_that_never_occurred(make):
    row = judge(make, [(1, 8), (2, 3), (99, 7)])
    assert row.recall == 100.0 and math.isclose(row.precision, 200 / 3)
    assert row.re_true == 0.0 and row.re_false == 0.0


def test_empty_answers(make):
    assert scores(judge(make, [])) == (0.0, 100.0, 0.0, 0.0)
    assert scores(judge(make, [], thr=100)) == (100.0, 100.0, 0.0, 0.0)


def test_claims_without_anything_to_find(make):
    assert scores(judge(make, [(1, 9)], thr=100)) == (100.0, 0.0, 0.0, 0.125)


def test_every_run_is_judged(make):
    rows = [(1, 5, 0), (2, 3, 1), (1, 2, 2), (3, 1, 3), (4, 1, 4), (1, 1, 5)]
    runs = split_runs(make(rows, "item long, weight long, pos long"), 3)
    claims = make([(0, 1, 5), (2, 1, 8), (2, 2, 4), (2, 4, 9)], "run int, item long, est long")
    got = {r.run: scores(r) for r in evaluate.evaluate_runs(claims, runs, 0.2).collect()}
    assert got[0] == (50.0, 100.0, 0.0, 0.0)
    assert got[1] == (0.0, 100.0, 0.0, 0.0)
    assert got[2][0] == 100.0 and math.isclose(got[2][1], 200 / 3)
    assert math.isclose(got[2][2], (0 + 1 / 3) / 2) and got[2][3] == 8.0


def hash_joins(df):
    """What the hash joins on buckets of a collected frame were built on, in its first plan and its last."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return set(re.findall(r"HashJoin \[run#\d+, row#\d+, bucket.*, (Build\w+)", plan))


@pytest.fixture(scope="module")
def few_users(spark, tmp_path_factory):
    """Events of 300 users: fewer bytes than the cells before, and more after they are opened for runs and sketch rows."""
    path = tmp_path_factory.mktemp("events")
    spark.range(6000).selectExpr("id as event_id", "if(id % 3 = 0, id % 5, id * 7919 % 300) as user_id").repartition(
        4).write.parquet(f"{path}/events.parquet")
    return str(path)


#: Room for the cells of all runs, room for the items before they are opened, room for neither.
LIMITS = ["10485760", "60000", "-1"]


@pytest.fixture(params=LIMITS)
def limit(spark, request):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_claims_of_runs_never_broadcast_the_items(spark, few_users, limit):
    from checks import evaluation
    from checks.common import PHI_USERS

    shape, runs = evaluation.RUN_SHAPE, evaluation.RUNS
    claims = evaluation.run_claims(spark, few_users)
    got = {(r.run, r.item): r.est for r in claims.collect()}
    assert hash_joins(claims) <= {"BuildRight"}
    cells, seen, expected = {}, set(), {}
    events = [(i, i % 5 if i % 3 == 0 else i * 7919 % 300) for i in range(6000)]
    for i, user in events:
        hashes = [a * user + b for a, b in shape.coeffs]
        places = [(r, (((h >> 31) + h) & 2147483647) % shape.width) for r, h in enumerate(hashes)]
        seen.add((user, tuple(places)))
        for place_ in places:
            cells[place_] = cells.get(place_, 0) + 1
        if (i + 1) % (6000 // runs) == 0:
            ests = {(i * runs // 6000, u): min(cells[p] for p in ps) for u, ps in seen}
            expected |= {k: v for k, v in ests.items() if v >= math.floor(PHI_USERS * (i + 1)) + 1}
    assert got == expected and len(got) > 100


def test_summary_of_runs_never_broadcasts_the_items(spark, few_users, limit):
    from checks import evaluation

    summary = evaluation.run_summary(spark, few_users)
    got = {r.measure: (r["mean"], r.p5, r.p95) for r in summary.collect()}
    assert hash_joins(summary) <= {"BuildRight"}
    runs = evaluation.per_run(spark, few_users).collect()
    assert len(runs) == evaluation.RUNS and set(got) == set(MEASURES)
    for m, (mean, p5, p95) in got.items():
        values = sorted(r[m] for r in runs)
        assert (p5, p95) == (values[1], values[19])
        assert mean == pytest.approx(sum(values) / len(values), abs=1e-8)


def test_report_of_runs_never_broadcasts_the_items(spark, few_users, limit, monkeypatch):
    from checks import evaluation

    made, write = [], evaluation.write_report
    monkeypatch.setattr(evaluation, "write_report", lambda report, path: (made.append(report), write(report, path)))
    got = {r.method: r for r in evaluation.full_report(spark, few_users).collect()}
    expected = {r.method: r for r in made[0].collect()}
    assert hash_joins(made[0]) <= {"BuildRight"}
    assert set(got) == set(expected) == set(evaluation.REPORTED)
    for method, row in got.items():
        assert tuple(row[1:]) == pytest.approx(tuple(expected[method][1:]), abs=1e-8)
    assert got["not_run"].recall_p5 == -1.0 and got["count_min"].recall_mean == 100.0


def test_percentiles_are_elements(make):
    rows = [("a", float(i), 100.0 - i, 0.0, 0.0) for i in range(20)] + [("b", 5.0, 5.0, 1.0, 1.0)]
    df = make(rows, "method string, recall double, precision double, re_true double, re_false double")
    got = {(r.method, r.measure): (r["mean"], r.p5, r.p95) for r in evaluate.summarise_runs(df).collect()}
    assert got["a", "recall"] == (9.5, 1.0, 19.0)
    assert got["b", "precision"] == (5.0, 5.0, 5.0)
    table = {r.method: r for r in evaluate.report(df, {"a": 10, "none": 20}).collect()}
    assert table["a"].recall_p95 == 19.0 and table["none"].recall_p5 == -1.0
    assert table["none"].recall_mean == 0.0 and table["none"].space == 20


def test_compared_counters_read_the_documents_once(spark, tmp_path, monkeypatch):
    from checks import evaluation
    from checks.counters import word_uses
    from rillcount.operators import counters

    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 300) for _ in range(60)), "x") for i in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, cut = [], counters.cut_lineage
    monkeypatch.setattr(counters, "cut_lineage", lambda df: (plans.append(df), cut(df))[1])
    got = {r.method: r for r in evaluation.comparison(spark, str(tmp_path)).collect()}
    scans = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("FileScan parquet")
             for df in plans]
    assert sum(scans) == 1
    made = counters.summarise_blocks(word_uses(spark, str(tmp_path)), list(evaluation.COMPARED.values()))
    alone = [counters.summarise_blocks(word_uses(spark, str(tmp_path)), b) for b in evaluation.COMPARED.values()]
    words = [w for _, text, _ in texts for w in text.split()]
    thr = math.floor(evaluation.PHI_WORDS * len(words)) + 1
    for method, one, other in zip(evaluation.COMPARED, made, alone):
        assert sorted(map(tuple, one.state().collect())) == sorted(map(tuple, other.state().collect()))
        assert got[method].claimed == other.heavy_hitters(F.lit(thr)).count()
    assert {r.hh for r in got.values()} == {sum(words.count(w) >= thr for w in set(words))}


def test_sweep_equals_one_summary_per_setting(make):
    from rillcount.operators import counters

    rows = [(i, 1 + (997 * i) % 61 + (500 if i < 4 else 0)) for i in range(300)]
    totals = make(rows, "item long, total long")
    settings = {("im_sum", g): (1 / 40, Budget.im_sum(1 / 40, g)) for g in (0.5, 2.0, 16.0)}
    n = sum(c for _, c in rows)
    thr = int(n / 40) + 1
    got = {r.param: r for r in sweep.sweep_counters(totals, settings).collect()}
    for (_, gamma), (_, budget) in settings.items():
        summary = counters.summarise(totals, budget)
        found = summary.heavy_hitters(F.lit(thr)).count()
        assert got[gamma].claimed == found
        assert got[gamma].delta == summary.errors.first().q
        assert got[gamma].hh == sum(c >= thr for _, c in rows)


def test_repeats_with_an_infinity_are_left_out(make):
    rows = [(0, "a", 1.0, 2.0), (1, "a", 1.0, 4.0), (2, "a", 1.0, 100.0),
            (2, "b", 1.0, float("inf")), (0, "b", 1.0, 1.0)]
    df = make(rows, "repeat int, method string, param double, value double")
    assert {(r.method, r["mean"]) for r in sweep.average_repeats(df).collect()} == {
        ("a", 3.0), ("b", 1.0)}


def test_sweep_settings_follow_the_protocol():
    assert len(sweep.epsilon_settings()) == 33 and len(sweep.gamma_settings()) == 18
    assert sweep.SKEWS[0] == 0.1 and sweep.SKEWS[-1] == 2.0 and len(sweep.SKEWS) == 20


@pytest.mark.parametrize("signed", [False, True])
def test_folded_sketches_equal_sketches_of_their_own(make, signed):
    rng = random.Random(4)
    totals = make([(i, rng.randint(1, 40)) for i in rng.sample(range(10**6), 300)], "item long, total long")
    widths = [16, 64, 128]
    got = {r.item: r.ests for r in sweep.folded_estimates(totals, widths, 3, 9, signed).collect()}
    for i, width in enumerate(widths):
        if signed:
            placed = place(totals, SketchShape(width, 3, 9), F.col("item"), F.col("item"), F.col("total"),
                           signs=coefficients(9, 3, 4))
            cells = placed.groupBy("row", "bucket").agg(F.sum(F.col("total") * F.col("sign")).alias("c"))
            rows = placed.join(cells, ["row", "bucket"]).groupBy("item").agg(
                F.sort_array(F.collect_list(F.col("c") * F.col("sign")))[1].alias("est"))
        else:
            rows = CountMin.from_totals(totals, SketchShape(width, 3, 9)).point(totals)
        assert {r.item: r.est for r in rows.collect()} == {item: ests[i] for item, ests in got.items()}
    with pytest.raises(ValueError):
        sweep.folded_estimates(totals, [16, 24], 3, 9)


def test_a_sketch_folds_to_any_width_that_divides_its_own(make):
    totals = make([(i * 7919, i + 1) for i in range(200)], "item long, total long")
    wide = CountMin.from_totals(totals, SketchShape(96, 4, 2))
    for width in (96, 32, 6):
        narrow = CountMin.from_totals(totals, SketchShape(width, 4, 2))
        folded = wide.fold(width)
        assert folded.compatible(narrow)
        assert sorted(map(tuple, folded.cells.select("row", "bucket", "c").collect())) == sorted(
            map(tuple, narrow.cells.select("row", "bucket", "c").collect()))
    with pytest.raises(ValueError):
        wide.fold(36)


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_swept_count_min_has_sketches_and_hashes_of_its_own(spark, make, limit):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 3, 60, 300])) for i in rng.sample(range(10**6), 400)]
    totals = make(rows, "item long, total long")
    settings = {phi: phi for phi in (1 / 8, 1 / 64, 1 / 256, 1 / 1024)}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = {r.param: r for r in sweep.sweep_count_min(totals, settings, 3, 7).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(got) == len(settings)
    for i, phi in enumerate(settings):
        thr = math.floor(phi * sum(w for _, w in rows)) + 1
        point = CountMin.from_totals(totals, SketchShape(int(2 / phi), 3, 7 + i)).point(totals).collect()
        claims = [(r.est, r.total) for r in point if r.est >= thr]
        right, wrong = [[(e - t) / t for e, t in claims if (t >= thr) == side] for side in (True, False)]
        assert (got[phi].hh, got[phi].claimed) == (sum(w >= thr for _, w in rows), len(claims))
        assert got[phi].precision == pytest.approx(100 * len(right) / len(claims) if claims else 100)
        assert got[phi].re_true == pytest.approx(sum(right) / len(right) if right else 0)
        assert got[phi].re_false == pytest.approx(sum(wrong) / len(wrong) if wrong else 0)


def test_registered_sweep_of_count_min_draws_hashes_for_every_setting(spark):
    from checks import evaluation

    found = re.findall(r"\(CAST\('\S+' AS DOUBLE\), \d+, \d+, (\d+), (\d+)[,)]",
                       evaluation.CHECKS["p1_epsilon_sweep_count_min"][1])
    assert len(found) == len(set(found)) == len(evaluation.SWEEP_PHIS) * evaluation.SWEEP_DEPTH
    totals = evaluation.kept_words(spark, "/root/testdata/sf0.001")
    got = {r.param: r for r in evaluation.epsilon_sweep_count_min(spark, "/root/testdata/sf0.001").collect()}
    n = totals.agg(F.sum("total")).first()[0]
    for i, phi in enumerate(evaluation.SWEEP_PHIS):
        shape = SketchShape(int(2 / phi), evaluation.SWEEP_DEPTH, evaluation.SWEEP_SEED + i)
        thr = math.floor(phi * n) + 1
        assert got[phi].claimed == CountMin.from_totals(totals, shape).point(totals).where(f"est >= {thr}").count()
