"""Linear sketches kept up to date by Structured Streaming.

A sketch is linear, so the cells of every micro-batch go to a table and add up on
reading (:func:`collect_cells`), for sketches of any size. A small one may instead be
the state of a streaming aggregation that ends in memory (:func:`run_to_memory`). Either
way it equals the sketch built from the same rows at once. Updates without item are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcount.operators.dyadic import Hierarchy, all_level_cells, in_universe
from rillcount.operators.linear import SketchShape, place
from rillcount.session import fits_broadcast, scratch_path
from rillcount.streaming.runs import collect_sums


def streaming_cells(updates: DataFrame, shape: SketchShape, item: str = "item",
                    weight: str = "weight") -> DataFrame:
    """Streaming ``(row, bucket, c)`` of a Count-Min sketch, whole or fractional."""
    return place(updates, shape, F.col(item), F.col(weight).alias("_w")).groupBy(
        "row", "bucket").agg(F.sum("_w").alias("c"))


def streaming_level_cells(updates: DataFrame, h: Hierarchy, item: str = "item",
                          weight: str = "weight", signed: bool = False) -> DataFrame:
    """Streaming ``(level, row, bucket, c)`` of a hierarchy of sketches."""
    known = updates.where(F.col(item).isNotNull())
    return all_level_cells(known, h, in_universe(F.col(item), h.bits), F.col(weight), signed)


def collect_cells(updates: DataFrame, cells: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """All cells of a stream; ``cells`` is one of the functions above with its settings."""
    return collect_sums(updates, cells, "c", path)


def run_to_memory(state: DataFrame, name: str, max_rows: int) -> DataFrame:
    """Run a stream over all available input and return its end state.

    Only for state with a proven bound, like cells: ``max_rows`` is checked against
    the session's broadcast limit, as the table ends up on the driver. Larger sketches
    go through :func:`collect_cells`.
    """
    spark = state.sparkSession
    if not fits_broadcast(spark, max_rows, 48):
        raise ValueError(f"{max_rows} rows of state do not fit the broadcast limit")
    query = (
        state.writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", scratch_path(spark, name))
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name)
