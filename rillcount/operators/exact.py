"""Exact answers over update streams, and the cutting of streams into runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcount.functions.hashing import threshold
from rillcount.session import fits_broadcast

WIDE = "decimal(38,0)"


def item_totals(updates: DataFrame, item: str = "item", weight: str = "weight") -> DataFrame:
    """``(item, total)``: weights summed per item.

    Partial aggregation collapses a hot item inside each task, so one key with a
    third of the rows reaches the shuffle as one row per task. Updates without an
    item are left out here, where joins on the item would do so anyway; all uses of
    the totals in a query then share one scan and one shuffle.
    """
    return updates.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.sum(weight).alias("total"))


def stream_total(totals: DataFrame) -> DataFrame:
    """One row ``(n)``: total weight of the stream, 0 when it is empty."""
    return totals.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("n"))


def heavy_threshold(totals: DataFrame, phi: float) -> Column:
    """Scalar column with the heavy-hitter threshold of a stream."""
    return threshold(phi, stream_total(totals).scalar())


def exact_heavy_hitters(totals: DataFrame, phi: float) -> DataFrame:
    """Items whose exact total is strictly above ``phi`` of the stream."""
    return totals.where(F.col("total") >= heavy_threshold(totals, phi))


def second_moment(totals: DataFrame) -> DataFrame:
    """One row ``(f2)``: sum of squared item totals, wide enough not to overflow."""
    c = F.col("total").cast("decimal(19,0)")
    return totals.agg(F.coalesce(F.sum(c * c), F.lit(0)).cast(WIDE).alias("f2"))


def inner_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``(product)``: sum over items of the product of both totals.

    With unit weights this is the size of the equi-join of the two streams.
    """
    f = left.select("item", F.col("total").cast("decimal(19,0)").alias("f"))
    g = right.select("item", F.col("total").cast("decimal(19,0)").alias("g"))
    return (
        f.join(g, "item")
        .agg(F.coalesce(F.sum(F.col("f") * F.col("g")), F.lit(0)).cast(WIDE).alias("product"))
    )


def dense_position(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Add ``pos``: the 0-based rank of each row by the unique column ``key``.

    No single task ever sorts the whole table: approximate quantiles of the key
    give explicit ranges, by default as many as the session has shuffle partitions;
    rows are numbered inside their range, and the counts of the earlier ranges are
    added. The range is an ordinary column, so a recomputed task numbers its rows
    the same way.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.approxQuantile(key, shares, 0.5 / ranges))) if shares else []
    bounds = [-float("inf"), *cuts, float("inf")] if cuts else [
        -float("inf"), 0.0, float("inf")]
    ranged = Bucketizer(splits=bounds, inputCol="_key", outputCol="_range").transform(
        df.withColumn("_key", F.col(key).cast("double"))
    ).drop("_key")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    if fits_broadcast(df.sparkSession, len(bounds), 32):
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("_range").orderBy(key)
    return (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn("pos", (F.col("_offset") + F.col("_row") - 1).cast("long"))
        .drop("_range", "_row", "_offset")
    )


def split_runs(
    updates: DataFrame, runs: int, pos: str = "pos", include_tail: bool = True
) -> DataFrame:
    """Add ``run``: equal contiguous pieces of ``n div runs`` updates each.

    ``pos`` holds the dense 0-based position. The remainder after the last full
    run belongs to the last run; without ``include_tail`` it is left out.
    """
    n = updates.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.greatest(F.floor(n / F.lit(runs)), F.lit(1)).cast("long")
    run = F.call_function("div", F.col(pos), size)
    cut = updates.withColumn("run", run)
    if include_tail:
        return cut.withColumn("run", F.least("run", F.lit(runs - 1)).cast("int"))
    return cut.where(F.col("run") < runs).withColumn("run", F.col("run").cast("int"))


def run_slices(updates: DataFrame, runs: int, pos: str = "pos", include_tail: bool = True) -> list[DataFrame]:
    """The runs of :func:`split_runs` as one DataFrame each.

    Counts the updates first, so that every slice is a plain range of positions,
    which reaches the scan and lets it skip the files and row groups of other runs.
    """
    size = max(updates.count() // runs, 1)
    slices = [
        updates.where((F.col(pos) >= r * size) & (F.col(pos) < (r + 1) * size))
        for r in range(runs)]
    if include_tail:
        slices[-1] = updates.where(F.col(pos) >= (runs - 1) * size)
    return slices


def run_thresholds(per_run: DataFrame, phi: float) -> DataFrame:
    """``(run, thr)`` from the running total; one row per run."""
    so_far = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_run.groupBy("run").agg(F.sum("w").alias("w"))
        .select("run", threshold(phi, F.sum("w").over(so_far)).alias("thr"))
    )


def cumulative_heavy_hitters(
    runs: DataFrame, phi: float, item: str = "item", weight: str = "weight"
) -> DataFrame:
    """``(run, item, total, thr)``: exact heavy hitters after every run.

    An item's running total changes only in runs where it occurs. A total below the lowest
    threshold of its own and all later runs is below until the next update, so only the
    surviving stretches are opened into one row per run. With weights that are not
    negative, that lowest threshold is the run's own.
    """
    per_run = runs.groupBy("run", F.col(item).alias("item")).agg(F.sum(weight).alias("w"))
    thresholds = run_thresholds(per_run, phi)
    by_item = Window.partitionBy("item").orderBy("run")
    stretches = per_run.select(
        "item", "run",
        F.sum("w").over(by_item.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.lead("run").over(by_item).alias("_next"),
    )
    last_run = thresholds.agg(F.max("run").alias("r")).scalar()
    later = Window.orderBy("run").rowsBetween(0, Window.unboundedFollowing)
    lowest = thresholds.select("run", F.min("thr").over(later).alias("low"))
    hot = (
        stretches.join(lowest, "run")
        .where(F.col("total") >= F.col("low"))
        .select("item", "total", F.explode(
            F.sequence("run", F.coalesce(F.col("_next") - 1, last_run))).alias("run"))
    )
    return (
        hot.join(thresholds, "run").where(F.col("total") >= F.col("thr"))
        .select("run", "item", F.col("total").cast("long").alias("total"), "thr")
    )


def running_totals(runs: DataFrame, item: str = "item", weight: str = "weight") -> DataFrame:
    """``(run, item, total)`` at each run in which the item occurs."""
    by_item = Window.partitionBy("item").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return (
        runs.groupBy("run", F.col(item).alias("item")).agg(F.sum(weight).alias("w"))
        .select("run", "item", F.sum("w").over(by_item).cast("long").alias("total"))
    )


def top_k(estimates: DataFrame, k: int, by: str = "est", ties: Sequence[str] = ("item",)) -> DataFrame:
    """The ``k`` largest estimates; ties go to the smaller item."""
    return estimates.orderBy(F.col(by).desc(), *ties).limit(k)
