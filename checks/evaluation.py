"""Judging approximate answers, comparing methods, sweeping parameters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.common import (
    PHI_USERS, PHI_WORDS, WORD_SHAPE, WORD_SIGNED_TREE, WORD_TREE, WORDS, cells, found, h31,
    kept_words, real, thr, values, with_, words,
)
from checks.counters import FAN, MERGES, WORD_USES, blocks_sql, word_uses
from checks.dyadic import heavy_sql, signed_heavy_sql
from checks.exact import RUN_SQL, RUNS
from checks.sources import u
from rillcount.functions.hashing import coefficients, uniform
from rillcount.operators import counters, exact
from rillcount.operators.counters import Budget
from rillcount.operators.dyadic import DyadicCountMin, DyadicCountSketch
from rillcount.operators.linear import CountMin, SketchShape, place
from rillcount.plans import evaluate, sweep
from rillcount.session import cut_lineage, fits_broadcast, scratch_path
from rillcount.sources import synthetic, tables
from rillcount.sources.reports import read_report, write_report

RUN_SHAPE = SketchShape(64, 4, 31)
MEASURES = ("recall", "precision", "re_true", "re_false")
SWEEP_DEPTH, SWEEP_SEED = 4, 41
SWEEP_PHIS = [2.0 ** -e for e in sweep.EPSILON_EXPONENTS]
SKEW_PHI = 2.0 ** -7
SKEW_DOMAIN = 1 << 12
REPORTED = {"count_min": 40 + 64 * 4 * 4 + 4 * 8, "not_run": counters.dense_size("im_sum", PHI_USERS)}
COMPARED = {"im_sum": Budget.im_sum(PHI_WORDS), "dim_sum": Budget.dim_sum(PHI_WORDS),
            "space_saving": Budget.space_saving(PHI_WORDS)}


def rounded(df, *keys):
    kept = [c for c in df.columns if c not in MEASURES]
    return df.select(*kept, *[F.round(m, 9).alias(m) for m in MEASURES])


def count_min(spark, d):
    w = kept_words(spark, d)
    thr_ = exact.heavy_threshold(w, PHI_WORDS)
    claims = CountMin.from_totals(w, WORD_SHAPE).point(w).where(F.col("est") >= thr_)
    return rounded(evaluate.evaluate(claims.select("item", "est"), w, thr_))


def relative_errors(spark, d):
    """Claims above half the threshold, so that false positives are judged too."""
    w = kept_words(spark, d)
    n = exact.stream_total(w).scalar()
    thr_ = exact.heavy_threshold(w, PHI_WORDS)
    claims = CountMin.from_totals(w, WORD_SHAPE).point(w).where(
        F.col("est") >= exact.threshold(PHI_WORDS / 2, n))
    return rounded(evaluate.evaluate(claims.select("item", "est"), w, thr_)).select(
        "claimed", "correct", "re_true", "re_false")


def empty_answer(spark, d):
    w = kept_words(spark, d)
    none = w.where(F.col("total") < 0).select("item", F.col("total").alias("est"))
    return rounded(evaluate.evaluate(none, w, exact.heavy_threshold(w, PHI_WORDS)))


def run_stream(spark, d):
    return exact.split_runs(tables.user_events(spark, d), RUNS)


def run_claims(spark, d):
    """Count-Min answers after every run: cell sums run on from run to run."""
    cut = run_stream(spark, d)
    per_run = cut.groupBy("run", "item").agg(F.sum("weight").alias("w"))
    placed = place(per_run, RUN_SHAPE, F.col("item"), F.col("item"), F.col("run"), F.col("w"))
    per_cell = placed.groupBy("run", "row", "bucket").agg(F.sum("w").alias("w"))
    by_cell = Window.partitionBy("row", "bucket").orderBy("run")
    stretches = per_cell.select(
        "row", "bucket", F.sum("w").over(
            by_cell.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
        F.col("run").alias("since"),
        F.coalesce(F.lead("run").over(by_cell) - 1, F.lit(RUNS - 1)).alias("until"),
    ).select("row", "bucket", "c", F.explode(F.sequence("since", "until")).alias("run"))
    seen = per_run.groupBy("item").agg(F.min("run").alias("first")).select(
        "item", F.explode(F.sequence("first", F.lit(RUNS - 1))).alias("run"))
    probed = place(seen, RUN_SHAPE, F.col("item"), F.col("item"), F.col("run"))
    # Spark takes opened rows for as small as they were before, so the items would be broadcast: of both sides
    # only the cells have a bound, and without room for them neither side is sent around.
    if fits_broadcast(spark, RUNS * RUN_SHAPE.width * RUN_SHAPE.depth, 40):
        stretches = F.broadcast(stretches)
    else:
        probed = probed.hint("merge")
    estimates = probed.join(stretches, ["run", "row", "bucket"]).groupBy("run", "item").agg(
        F.min("c").alias("est"))
    thrs = exact.run_thresholds(per_run, PHI_USERS)
    return estimates.join(thrs, "run").where(F.col("est") >= F.col("thr")).select(
        "run", "item", "est")


def per_run(spark, d):
    return rounded(evaluate.evaluate_runs(run_claims(spark, d), run_stream(spark, d), PHI_USERS))


def run_summary(spark, d):
    scores = evaluate.evaluate_runs(run_claims(spark, d), run_stream(spark, d), PHI_USERS)
    table = evaluate.summarise_runs(scores.withColumn("method", F.lit("count_min")))
    return table.select("method", "measure", *[
        F.round(c, 9).alias(c) for c in ("mean", "p5", "p95")])


def full_report(spark, d):
    """Space and scores over the runs of each method, written as text and read back; one method has no runs."""
    scores = evaluate.evaluate_runs(run_claims(spark, d), run_stream(spark, d), PHI_USERS)
    made = evaluate.report(scores.withColumn("method", F.lit("count_min")), REPORTED)
    path = scratch_path(spark, "report")
    write_report(made, path)
    read = read_report(spark, path, made.schema)
    return read.select("method", "space", *[F.round(c, 9).alias(c) for c in read.columns[2:]])


def comparison(spark, d):
    """Counter summaries are built from the uses of words, block by block, sketches from the same stream."""
    named = cut_lineage(tables.numbered_words(spark, d))
    w = exact.item_totals(named)
    thr_ = exact.heavy_threshold(w, PHI_WORDS)

    def counted(summary):
        claims = summary.heavy_hitters(thr_)
        return claims.select(F.col("item").alias("word"), "est").join(named, "word").select("item", "est")

    summaries = counters.summarise_blocks(word_uses(spark, d, together=True), list(COMPARED.values()))
    answers = {
        **{method: counted(summary) for method, summary in zip(COMPARED, summaries)},
        "count_min": CountMin.from_totals(w, WORD_SHAPE).point(w).where(F.col("est") >= thr_),
        "hierarchical_count_min": DyadicCountMin(WORD_TREE, w).store().heavy_hitters(thr_),
        "count_sketch": DyadicCountSketch(WORD_SIGNED_TREE, w).store().heavy_hitters(thr_)}
    return rounded(evaluate.compare(answers, w, thr_))


def word_sweep(spark, d, settings):
    totals = cut_lineage(exact.item_totals(word_uses(spark, d)))
    return rounded(sweep.sweep_summaries(word_uses(spark, d), totals, settings))


def epsilon_sweep(spark, d):
    return word_sweep(spark, d, sweep.epsilon_settings())


def epsilon_sweep_count_min(spark, d):
    settings = {phi: phi for phi in SWEEP_PHIS}
    return rounded(sweep.sweep_count_min(kept_words(spark, d), settings, SWEEP_DEPTH, SWEEP_SEED))


def epsilon_sweep_count_sketch(spark, d):
    return rounded(sweep.sweep_folded(words(spark, d), SWEEP_PHIS, SWEEP_DEPTH + 1, SWEEP_SEED, signed=True))


def gamma_sweep(spark, d):
    return word_sweep(spark, d, sweep.gamma_settings())


def skew_totals(spark, d):
    base = tables.read_table(spark, d, "events").select(F.col("event_id").alias("pos"))
    return synthetic.zipf_streams(
        base, uniform(F.col("pos"), 51), 0, SKEW_DOMAIN, sweep.SKEWS).groupBy("z", "item").agg(
        F.count(F.lit(1)).alias("total"))


def skew_settings():
    made = {}
    for g in sweep.SKEW_GAMMAS:
        made[("im_sum", g)] = (SKEW_PHI, Budget.im_sum(SKEW_PHI, g))
        made[("dim_sum", g)] = (SKEW_PHI, Budget.dim_sum(SKEW_PHI, g))
    made[("space_saving", 4.0)] = (SKEW_PHI, Budget.space_saving(SKEW_PHI))
    return made


def skew_sweep(spark, d):
    return rounded(sweep.sweep_counters(skew_totals(spark, d), skew_settings(), ["z"]))


def repeats(spark, d):
    """Events as repeats of a measurement; one repeat holds an infinite value."""
    results = tables.read_table(spark, d, "events").select(
        (F.col("user_id") % 8).alias("repeat"), F.col("event_type").alias("method"),
        (F.col("event_id") % 5).cast("double").alias("param"),
        F.when((F.col("user_id") % 8 == 3) & (F.col("event_id") % 97 == 0),
               F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    return sweep.average_repeats(results).select(
        "method", "param", F.round("mean", 6).alias("mean"))


# --- SQL -----------------------------------------------------------------

def score(claimed, correct, hh, rt, rf):
    return f"""(CASE WHEN {hh} = 0 THEN 100.0 ELSE round(100.0::DOUBLE * {correct} / {hh}, 9) END)::DOUBLE AS recall,
      (CASE WHEN {claimed} = 0 THEN 100.0 ELSE round(100.0::DOUBLE * {correct} / {claimed}, 9) END)::DOUBLE AS precision,
      round(coalesce({rt}, 0.0), 9)::DOUBLE AS re_true, round(coalesce({rf}, 0.0), 9)::DOUBLE AS re_false"""


def judged(claims, table, t):
    """SQL that scores ``claims(item, est)`` against ``table(item, total)``."""
    return f"""SELECT claimed, correct, hh, {score('claimed', 'correct', 'hh', 'rt', 'rf')} FROM (
      SELECT count(c.est) AS claimed, count(*) FILTER (c.est IS NOT NULL AND w.total >= {t}) AS correct,
        count(*) FILTER (w.total >= {t}) AS hh,
        avg(abs(w.total - c.est)::DOUBLE / w.total) FILTER (c.est IS NOT NULL AND w.total >= {t}) AS rt,
        avg(abs(w.total - c.est)::DOUBLE / w.total) FILTER (c.est IS NOT NULL AND w.total < {t}) AS rf
      FROM {table} w LEFT JOIN ({claims}) c ON c.item = w.item)"""


CM_ENTRIES = [WORDS, cells("s", "words", WORD_SHAPE), found("f", "words", "s", WORD_SHAPE),
              "ests AS (SELECT item, min(c) AS est FROM f GROUP BY item)"]
WORD_THR = thr(PHI_WORDS, "words")


def run_sql():
    """Score Count-Min after every run, from cumulative totals of every (run, item)."""
    return f"""WITH {RUN_SQL},
      seen AS (SELECT run, item, total FROM cum WHERE total > 0),
      k AS (SELECT * FROM {values([(r, a, b) for r, (a, b) in enumerate(RUN_SHAPE.coeffs)])} k(r, a, b)),
      placed AS (SELECT s.run, s.item, s.total, k.r, {h31('k.a', 'k.b', 's.item')} % {RUN_SHAPE.width} AS bucket
                 FROM seen s, k),
      cell AS (SELECT run, r, bucket, sum(total) AS c FROM placed GROUP BY ALL),
      est AS (SELECT run, item, total, min(c) AS est
              FROM placed JOIN cell USING (run, r, bucket) GROUP BY run, item, total),
      scored AS (
        SELECT e.run, count(*) FILTER (est >= thr) AS claimed,
          count(*) FILTER (est >= thr AND total >= thr) AS correct,
          count(*) FILTER (total >= thr) AS hh,
          avg((est - total)::DOUBLE / total) FILTER (est >= thr AND total >= thr) AS rt,
          avg((est - total)::DOUBLE / total) FILTER (est >= thr AND total < thr) AS rf
        FROM est e JOIN thrs t ON t.run = e.run GROUP BY e.run),
      final AS (SELECT run::INT AS run, {score('claimed', 'correct', 'hh', 'rt', 'rf')} FROM scored)
"""


def comparison_sql():
    def counter_sql(budget):
        return with_(WORD_USES, *blocks_sql(budget)) + f"""
          SELECT n.item AS item, (residual + q)::BIGINT AS est FROM items i JOIN named n ON n.w = i.item
          WHERE residual + q >= {WORD_THR}"""

    answers = {
        **{method: counter_sql(budget) for method, budget in COMPARED.items()},
        "count_min": with_(*CM_ENTRIES) + f"SELECT item, est FROM ests WHERE est >= {WORD_THR}",
        "hierarchical_count_min": heavy_sql(WORD_TREE, "words", WORDS, PHI_WORDS),
        "count_sketch": signed_heavy_sql()}
    return with_(WORDS, WORDS.replace("words AS (", "named AS (", 1).replace("item, total", "item, w, total", 1)) + " UNION ALL ".join(
        f"SELECT '{name}' AS method, * FROM ({judged(sql, 'words', WORD_THR)})"
        for name, sql in answers.items())


def sweep_sql(settings, stream, table, group=None):
    rows = values([
        (f"'{m}'", real(float(p)), real(phi), b.counters, b.capacity)
        for (m, p), (phi, b) in settings.items()])
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""{stream},
      ranked AS (SELECT {g}item, total, row_number() OVER ({part}ORDER BY total DESC) AS i,
        count(*) OVER ({part[:-1]}) AS m, sum(total) OVER ({part[:-1]}) AS n FROM {table}),
      st AS (SELECT * FROM {rows} t(method, param, phi, counters, capacity)),
      cut AS (SELECT {g}method, param, phi, n, CASE WHEN max(m) > max(capacity)
          THEN coalesce(max(total) FILTER (i = counters), 0) ELSE 0 END AS delta
        FROM ranked, st GROUP BY ALL),
      res AS (SELECT {g}method, param, n, delta,
          count(*) FILTER (total >= floor(phi * n)::BIGINT + 1) AS hh,
          count(*) FILTER (total >= floor(phi * n)::BIGINT + 1 AND total > delta) AS claimed
        FROM {table} {f'JOIN cut USING ({group})' if group else ', cut'} GROUP BY ALL)
      SELECT {g}method, param, n::BIGINT AS n, delta::BIGINT AS delta, hh, claimed,
        (CASE WHEN hh = 0 THEN 100.0 ELSE round(100.0::DOUBLE * claimed / hh, 9) END)::DOUBLE AS recall,
        100.0::DOUBLE AS precision, 0.0::DOUBLE AS re_true, 0.0::DOUBLE AS re_false FROM res"""


def summaries_sql(settings):
    """Every setting by itself: blocks of uses, summed, cut and merged; then judged by the exact totals."""
    rows = values([(k, f"'{m}'", real(float(p)), real(float(phi)), b.counters, b.capacity)
                   for k, ((m, p), (phi, b)) in enumerate(settings.items())])
    entries = [WORD_USES, f"st AS (SELECT * FROM {rows} t(k, method, param, phi, counters, capacity))",
               """m0 AS MATERIALIZED (SELECT k, shard, item, x FROM st,
                 (SELECT block AS shard, item, sum(weight) AS x FROM uses GROUP BY 1, 2))""",
               "e0 AS (SELECT DISTINCT k, shard, 0 AS q FROM m0)"]
    for level in range(MERGES + 1):
        entries += [
            f"""c{level} AS MATERIALIZED (SELECT k, shard, CASE WHEN count(*) > max(capacity)
              THEN coalesce(max(x) FILTER (i = counters), 0) ELSE 0 END AS d
              FROM (SELECT k, shard, x, row_number() OVER (PARTITION BY k, shard ORDER BY x DESC) AS i FROM m{level})
              JOIN st USING (k) GROUP BY 1, 2)""",
            f"l{level} AS MATERIALIZED (SELECT k, shard, item, x - d AS x FROM m{level} JOIN c{level} USING (k, shard) WHERE x > d)",
            f"r{level} AS (SELECT k, shard, q + coalesce(d, 0) AS q FROM e{level} LEFT JOIN c{level} USING (k, shard))",
            f"m{level + 1} AS MATERIALIZED (SELECT k, shard // {FAN} AS shard, item, sum(x) AS x FROM l{level} GROUP BY 1, 2, 3)",
            f"e{level + 1} AS (SELECT k, shard // {FAN} AS shard, sum(q) AS q FROM r{level} GROUP BY 1, 2)"]
    return with_(*entries, """
      w AS (SELECT item, sum(weight) AS total FROM uses GROUP BY 1), n AS (SELECT sum(total) AS n FROM w),
      t AS (SELECT k, method, param, n, floor(phi * n)::BIGINT + 1 AS thr FROM st, n)""", f"""
      res AS (SELECT t.k, count(x) FILTER (x + q >= thr) AS claimed, count(*) FILTER (total >= thr) AS hh,
        count(x) FILTER (x + q >= thr AND total >= thr) AS correct, max(q) AS q,
        avg((x + q - total)::DOUBLE / total) FILTER (x + q >= thr AND total >= thr) AS rt,
        avg((x + q - total)::DOUBLE / total) FILTER (x + q >= thr AND total < thr) AS rf
        FROM t JOIN r{MERGES} r ON r.k = t.k CROSS JOIN w LEFT JOIN l{MERGES} l ON l.k = t.k AND l.item = w.item
        GROUP BY t.k)""") + f"""
      SELECT method, param, n::BIGINT AS n, q::BIGINT AS q, claimed, correct, hh,
        {score('claimed', 'correct', 'hh', 'rt', 'rf')} FROM res JOIN t USING (k)"""


def sweep_cm_sql():
    """A Count-Min sketch of its own for every setting, with hashes of its own."""
    rows = []
    for i, e in enumerate(sweep.EPSILON_EXPONENTS):
        phi = 2.0 ** -e
        shape = SketchShape(int(2 / phi), SWEEP_DEPTH, SWEEP_SEED + i)
        rows += [(real(phi), r, shape.width, a, b) for r, (a, b) in enumerate(shape.coeffs)]
    return with_(WORDS, f"k AS (SELECT * FROM {values(rows)} t(param, r, width, a, b))", f"""
      placed AS (SELECT item, total, param, r, {h31('a', 'b', 'item')} % width AS bucket FROM words, k)""",
                 "cell AS (SELECT param, r, bucket, sum(total) AS c FROM placed GROUP BY ALL)",
                 "est AS (SELECT param, item, total, min(c) AS est FROM placed JOIN cell USING (param, r, bucket) GROUP BY ALL)",
                 "t AS (SELECT param, floor(param * (SELECT sum(total) FROM words))::BIGINT + 1 AS thr FROM (SELECT DISTINCT param FROM k))",
                 """res AS (SELECT param, count(*) FILTER (total >= thr) AS hh, count(*) FILTER (est >= thr) AS claimed,
          count(*) FILTER (est >= thr AND total >= thr) AS correct,
          avg((est - total)::DOUBLE / total) FILTER (est >= thr AND total >= thr) AS rt,
          avg((est - total)::DOUBLE / total) FILTER (est >= thr AND total < thr) AS rf
          FROM est JOIN t USING (param) GROUP BY param)""") + f"""
      SELECT 'count_min' AS method, param, hh, claimed, {score('claimed', 'correct', 'hh', 'rt', 'rf')} FROM res"""


def sweep_cs_sql(depth):
    """A Count Sketch of its own for every setting; all have the same hashes, modulo their width."""
    rows = [(real(phi), r, int(2 / phi), *c) for phi in SWEEP_PHIS for r, c in enumerate(coefficients(SWEEP_SEED, depth, 4))]
    sign = f"CASE WHEN {h31('c', 'd', 'item')} & 1 = 1 THEN 1 ELSE -1 END"
    pick = f"(list_sort(list(sign * v)))[{depth // 2 + 1}]"
    return with_(WORDS, f"k AS (SELECT * FROM {values(rows)} t(param, r, width, a, b, c, d))", f"""
      placed AS (SELECT item, total, param, r, {h31('a', 'b', 'item')} % width AS bucket, {sign} AS sign FROM words, k)""",
                 "cell AS (SELECT param, r, bucket, sum(sign * total) AS v FROM placed GROUP BY ALL)",
                 f"est AS (SELECT param, item, total, {pick} AS est FROM placed JOIN cell USING (param, r, bucket) GROUP BY ALL)",
                 "t AS (SELECT param, floor(param * (SELECT sum(total) FROM words))::BIGINT + 1 AS thr FROM (SELECT DISTINCT param FROM k))",
                 """res AS (SELECT param, count(*) FILTER (total >= thr) AS hh, count(*) FILTER (est >= thr) AS claimed,
          count(*) FILTER (est >= thr AND total >= thr) AS correct,
          avg(abs(est - total)::DOUBLE / total) FILTER (est >= thr AND total >= thr) AS rt,
          avg(abs(est - total)::DOUBLE / total) FILTER (est >= thr AND total < thr) AS rf
          FROM est JOIN t USING (param) GROUP BY param)""") + f"""
      SELECT 'count_sketch' AS method, param, hh, claimed,
        {score('claimed', 'correct', 'hh', 'rt', 'rf')} FROM res"""


RUN_SUMMARY = """,
      long AS (UNPIVOT final ON recall, precision, re_true, re_false INTO NAME measure VALUE x),
      ordered AS (SELECT measure, x, row_number() OVER (PARTITION BY measure ORDER BY x) - 1 AS i,
        count(*) OVER (PARTITION BY measure) AS n FROM long)"""


def report_sql():
    parts = [(m, f"max({x}) FILTER (measure = '{m}')", part) for m in MEASURES
             for part, x in (("mean", "mean"), ("p5", "p5"), ("p95", "p95"))]
    ran = ", ".join(f"{x} AS {m}_{part}" for m, x, part in parts)
    absent = ", ".join(f"{0 if part == 'mean' else -1}::DOUBLE AS {m}_{part}" for m, _, part in parts)
    return run_sql() + f"""{RUN_SUMMARY},
      summary AS (SELECT measure, round(avg(x), 9) AS mean, max(x) FILTER (i = floor(n * 0.05::DOUBLE)) AS p5,
        max(x) FILTER (i = floor(n * 0.95::DOUBLE)) AS p95 FROM ordered GROUP BY measure)
      SELECT 'count_min' AS method, 1096::BIGINT AS space, {ran} FROM summary
      UNION ALL SELECT 'not_run' AS method, {104 + (520 + 130 - 1) * (4 + 48 + 64)}::BIGINT AS space, {absent}"""


SKEW_STREAM = f"""WITH z AS (SELECT z FROM {values([(real(z),) for z in sweep.SKEWS])} t(z)),
  p AS (SELECT z, k, pow(k::DOUBLE, -z) AS p FROM z, range(1, {SKEW_DOMAIN}) t(k)),
  cdf AS (SELECT z, k, sum(p) OVER (PARTITION BY z ORDER BY k) / sum(p) OVER (PARTITION BY z) AS hi FROM p),
  steps AS (SELECT z, k, coalesce(lag(hi) OVER (PARTITION BY z ORDER BY k), -1.0) AS lo FROM cdf),
  d AS (SELECT z, {u(51)} AS u FROM events, z),
  drawn AS (SELECT d.z AS z, s.k AS item, count(*)::BIGINT AS total
    FROM d ASOF JOIN steps s ON d.z = s.z AND d.u > s.lo GROUP BY 1, 2)"""

CHECKS = {
    "v1_evaluate": (count_min, with_(*CM_ENTRIES) + judged(
        f"SELECT item, est FROM ests WHERE est >= {WORD_THR}", "words", WORD_THR)),
    "v2_relative_errors": (relative_errors, with_(*CM_ENTRIES) +
        "SELECT claimed, correct, re_true, re_false FROM (" + judged(
        f"SELECT item, est FROM ests WHERE est >= {thr(PHI_WORDS / 2, 'words')}", "words", WORD_THR) + ")"),
    "v3_empty_answer": (empty_answer, with_(WORDS) + judged(
        "SELECT item, total AS est FROM words WHERE total < 0", "words", WORD_THR)),
    "v1_evaluate_runs": (per_run, run_sql() + "SELECT * FROM final"),
    "v6_report": (full_report, report_sql()),
    "v4_run_summary": (run_summary, run_sql() + RUN_SUMMARY + """
      SELECT 'count_min' AS method, measure, round(avg(x), 9) AS mean,
        max(x) FILTER (i = floor(n * 0.05::DOUBLE)) AS p5, max(x) FILTER (i = floor(n * 0.95::DOUBLE)) AS p95
      FROM ordered GROUP BY measure"""),
    "v5_method_comparison": (comparison, comparison_sql()),
    "p1_epsilon_sweep": (epsilon_sweep, summaries_sql(
        sweep.epsilon_settings())),
    "p1_epsilon_sweep_count_min": (epsilon_sweep_count_min, sweep_cm_sql()),
    "p1_epsilon_sweep_count_sketch": (epsilon_sweep_count_sketch, sweep_cs_sql(SWEEP_DEPTH + 1)),
    "p2_gamma_sweep": (gamma_sweep, summaries_sql(sweep.gamma_settings())),
    "p3_skew_sweep": (skew_sweep, sweep_sql(skew_settings(), SKEW_STREAM, "drawn", "z")),
    "p4_average_repeats": (repeats, """
        WITH r AS (SELECT user_id % 8 AS repeat, event_type AS method, (event_id % 5)::DOUBLE AS param,
          CASE WHEN user_id % 8 = 3 AND event_id % 97 = 0 THEN 'inf'::DOUBLE ELSE value END AS value FROM events)
        SELECT method, param, round(avg(value), 6) AS mean FROM r
        WHERE repeat NOT IN (SELECT repeat FROM r WHERE isinf(value)) GROUP BY 1, 2"""),
}
