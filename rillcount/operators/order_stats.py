"""Exact order statistics per group without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcount.session import cut_lineage

# Each pass fixes this many bits of the answer.
DIGIT_BITS = 16


def kth_smallest(df: DataFrame, groups: Sequence[str], value: str, k: int | Column,
                 bits: int = 64, zero_based: bool = False) -> DataFrame:
    """``(*groups, value)``: the k-th smallest whole number of every group.

    Values are counted first, so repeats cost nothing, and the counts are checkpointed, so
    that the input is read once however many passes follow. Then the answer is fixed
    16 bits at a time from the top: a pass counts values per leading digit and
    keeps the digit in which the k-th one falls. Whatever the size of a group, its
    window never sees more than 65,536 rows. Groups shorter than ``k`` give no row.
    """
    groups = list(groups)
    keys = groups or ["_all"]
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    k = k if isinstance(k, Column) else F.lit(k)
    counted = cut_lineage(df.groupBy(*keys, F.col(value).cast("long").alias("value")).agg(
        F.count(F.lit(1)).alias("n")))
    state = counted.groupBy(*keys).agg(F.sum("n").alias("size")).select(
        *keys, (k + F.lit(1 if zero_based else 0)).cast("long").alias("rank"), "size"
    ).where((F.col("rank") >= 1) & (F.col("rank") <= F.col("size"))).drop("size")
    joined = counted.join(state, keys)
    for shift in [*range(bits - DIGIT_BITS, 0, -DIGIT_BITS), 0]:
        digits = joined.groupBy(
            *keys, "rank", F.shiftright("value", shift).alias("prefix")
        ).agg(F.sum("n").alias("m"))
        along = Window.partitionBy(*keys).orderBy("prefix").rowsBetween(
            Window.unboundedPreceding, 0)
        state = (
            digits.withColumn("cum", F.sum("m").over(along))
            .where((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("m") < F.col("rank")))
            .select(*keys, "prefix", (F.col("rank") - F.col("cum") + F.col("m")).alias("rank")))
        joined = counted.withColumn("prefix", F.shiftright("value", shift)).join(
            state, [*keys, "prefix"])
    return state.select(*groups, F.col("prefix").alias("value"))
