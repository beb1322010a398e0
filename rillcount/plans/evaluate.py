"""How good an approximate answer is, against exact totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcount.operators.exact import cumulative_heavy_hitters, run_thresholds
from rillcount.session import cut_lineage

MEASURES = ("recall", "precision", "re_true", "re_false")


def evaluate(claims: DataFrame, totals: DataFrame, thr: Column,
             keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, claimed, correct, hh, recall, precision, re_true, re_false)``.

    ``claims`` holds ``(*keys, item, est)``, ``totals`` the exact
    ``(*keys, item, total)``. Recall and precision are percentages. Relative errors
    are means over the true and the false positives; a false positive that never
    occurred has no relative error and is left out of the mean. An empty answer
    has precision 100, and recall 100 only if there was nothing to find.

    Only claims are looked up in the totals, and only counts are put together, so
    the totals are not sorted or moved for it.
    """
    keys = list(keys)
    judged = totals.select(*keys, "item", "total", (F.col("total") >= thr).alias("_hh"))
    return scores(_tally(claims, judged, keys), keys)


def _tally(claims: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and errors from claims, from claims met in ``judged``, and from its hits."""
    on = [k for k in keys if k in judged.columns] + ["item"]
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")

    def part(df: DataFrame, claimed=zero, correct=zero, hh=zero, rt=none, rf=none) -> DataFrame:
        grouped = df.groupBy(*keys) if keys else df
        return grouped.agg(
            claimed.alias("claimed"), correct.alias("correct"), hh.alias("hh"),
            rt.alias("_rt"), rf.alias("_rf"))

    error = F.abs(F.col("total") - F.col("est")) / F.nullif(F.col("total"), F.lit(0))
    met = claims.select(*keys, "item", "est").join(judged, on)
    parts = [
        part(claims, claimed=F.count(F.lit(1))),
        part(met, correct=F.count(F.when(F.col("_hh"), 1)),
             rt=F.avg(F.when(F.col("_hh"), error)), rf=F.avg(F.when(~F.col("_hh"), error)))]
    if set(keys) <= set(judged.columns):
        parts.append(part(judged.where("_hh"), hh=F.count(F.lit(1))))
    both = reduce(DataFrame.unionByName, parts)
    return (both.groupBy(*keys) if keys else both).agg(
        *[F.sum(c).alias(c) for c in ("claimed", "correct", "hh")],
        F.max("_rt").alias("_rt"), F.max("_rf").alias("_rf"))


def scores(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Percentages and errors from ``(*keys, claimed, correct, hh, _rt, _rf)``."""
    full = F.lit(100.0)
    return counted.select(
        *keys, "claimed", "correct", "hh",
        F.when(F.col("hh") == 0, full).otherwise(
            full * F.col("correct") / F.nullif(F.col("hh"), F.lit(0))).alias("recall"),
        F.when(F.col("claimed") == 0, full).otherwise(
            full * F.col("correct") / F.nullif(F.col("claimed"), F.lit(0))).alias("precision"),
        F.coalesce("_rt", F.lit(0.0)).alias("re_true"),
        F.coalesce("_rf", F.lit(0.0)).alias("re_false"))


def evaluate_runs(claims: DataFrame, runs: DataFrame, phi: float) -> DataFrame:
    """Evaluate claims ``(run, item, est)`` against the totals after every run.

    ``runs`` is the update stream with ``run``; all runs are evaluated, also those
    without any claim.
    """
    per_run = runs.groupBy("run", "item").agg(F.sum("weight").alias("w"))
    thresholds = run_thresholds(per_run, phi)
    # Claims stand among the updates of their item, at most one row for each run and side.
    so_far = Window.partitionBy("item").orderBy("run").rangeBetween(Window.unboundedPreceding, 0)
    placed = per_run.select("run", "item", "w", F.lit(False).alias("_claim")).unionByName(
        claims.select("run", "item", F.lit(None).cast(per_run.schema["w"].dataType).alias("w"), F.lit(True).alias("_claim")))
    exact = placed.withColumn("total", F.sum("w").over(so_far)).where(
        "_claim AND total IS NOT NULL").select("run", "item", "total")
    heavy = cumulative_heavy_hitters(runs, phi).select("run", "item", "total")
    known = exact.unionByName(heavy).dropDuplicates(["run", "item"])
    judged = known.join(thresholds, "run").select("run", "item", "total", "thr")
    scored = evaluate(claims, judged, F.col("thr"), ["run"])
    return thresholds.select("run").join(scored, "run", "left").select(
        "run",
        F.coalesce("recall", F.lit(100.0)).alias("recall"),
        F.coalesce("precision", F.lit(100.0)).alias("precision"),
        F.coalesce("re_true", F.lit(0.0)).alias("re_true"),
        F.coalesce("re_false", F.lit(0.0)).alias("re_false"))


def summarise_runs(scores: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """``(method, measure, mean, p5, p95)`` over the runs of every method.

    The percentiles are the sorted elements at ``floor(0.05 n)`` and
    ``floor(0.95 n)``, counted from 0.
    """
    pairs = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures])
    long = scores.select("method", F.explode(pairs).alias("p")).select("method", "p.*")
    ranked = Window.partitionBy("method", "measure").orderBy("x")
    whole = Window.partitionBy("method", "measure")
    placed = long.select(
        "method", "measure", "x", (F.row_number().over(ranked) - 1).alias("i"),
        F.count(F.lit(1)).over(whole).alias("n"))

    def at(p: float) -> Column:
        return F.max(F.when(F.col("i") == F.floor(F.col("n") * F.lit(p)), F.col("x")))

    return placed.groupBy("method", "measure").agg(
        F.avg("x").alias("mean"), at(0.05).alias("p5"), at(0.95).alias("p95"))


def report(scores: DataFrame, methods: Mapping[str, int]) -> DataFrame:
    """One row per method: space in bytes, then mean, 5th and 95th of every measure.

    Methods without runs get -1 for the percentiles and 0 for the means.
    """
    spark = scores.sparkSession
    known = spark.createDataFrame(list(methods.items()), "method string, space long")
    summary = summarise_runs(scores).groupBy("method").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(part))).alias(f"{m}_{part}")
        for m in MEASURES for part in ("mean", "p5", "p95")])
    known = known.join(summary, "method", "left")
    cols = [
        F.coalesce(f"{m}_{part}", F.lit(0.0 if part == "mean" else -1.0)).alias(f"{m}_{part}")
        for m in MEASURES for part in ("mean", "p5", "p95")]
    return known.select("method", "space", *cols)


def compare(answers: Mapping[str, DataFrame], totals: DataFrame, thr: Column) -> DataFrame:
    """Evaluate the heavy hitters ``(item, est)`` of several methods side by side."""
    # Claims are few and used twice, the plans that find them are long.
    tagged = cut_lineage(reduce(DataFrame.unionByName, [
        a.select(F.lit(name).alias("method"), "item", F.col("est").cast("long").alias("est"))
        for name, a in answers.items()]))
    judged = totals.select("item", "total", (F.col("total") >= thr).alias("_hh"))
    hh = judged.where("_hh").agg(F.count(F.lit(1)).alias("hh")).scalar()
    names = totals.sparkSession.createDataFrame([(m,) for m in answers], "method string")
    counted = names.join(_tally(tagged, judged, ["method"]), "method", "left").select(
        "method", F.coalesce("claimed", F.lit(0)).alias("claimed"),
        F.coalesce("correct", F.lit(0)).alias("correct"), hh.alias("hh"), "_rt", "_rf")
    return scores(counted, ["method"])
