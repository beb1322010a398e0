"""A counter summary kept up to date by Structured Streaming.

:func:`collect_summary` sums up each micro-batch inside the tasks that read it, so that only
counters are shuffled, and adds it to the summary of the stream so far, of which the last
two versions stay on shared storage.

:func:`streaming_summary` keeps state per shard instead and puts out every version. Updates are dealt to shards by position, not by item, so that a hot item spreads
over all of them. Each shard's state is one bounded summary; the shards' errors
add up to at most ``weight / counters`` for the whole stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcount.operators.counters import (
    Budget, CounterSummary, LocalCounters, gather, item_shard, merge, summarise_in_place,
)
from rillcount.session import scratch_path

STATE = "items array<long>, residuals array<long>, q long, weight long, seq long"
OUTPUT = "shard int, seq long, item long, residual long, q long, weight long"


def _keep_summary(budget: Budget):
    def step(key, batches, state):
        import pandas as pd

        items, residuals, q, weight, seq = state.get if state.exists else ([], [], 0, 0, 0)
        own = LocalCounters(budget, items, residuals, q, weight)
        for batch in batches:
            own.add(batch["item"].to_numpy(), batch["weight"].to_numpy())
        own.fold()
        items, residuals = own.items.tolist(), own.residuals.tolist()
        state.update((items, residuals, own.q, own.weight, seq + 1))
        yield pd.DataFrame({
            "shard": key[0], "seq": seq + 1, "item": pd.array([*items, None], dtype="Int64"),
            "residual": [*residuals, 0], "q": [0] * len(items) + [own.q],
            "weight": [0] * len(items) + [own.weight]})

    return step


def streaming_summary(updates: DataFrame, budget: Budget, shards: int, item: str = "item",
                      weight: str = "weight", pos: str = "pos") -> DataFrame:
    """Stream of pruned summaries: one set of rows per shard and micro-batch.

    Every set ends with a row without item, which carries the shard's error even if
    nothing is kept. Updates without item or weight are left out.
    """
    dealt = updates.where(F.col(item).isNotNull() & F.col(weight).isNotNull()).select(
        item_shard(F.col(pos), shards).alias("shard"),
        F.col(item).cast("long").alias("item"), F.col(weight).cast("long").alias("weight"))
    return dealt.groupBy("shard").applyInPandasWithState(
        _keep_summary(budget), OUTPUT, STATE, "append", "NoTimeout")


def latest_summary(rows: DataFrame, budget: Budget) -> CounterSummary:
    """The whole-stream summary from what :func:`streaming_summary` has written."""
    newest = rows.groupBy("shard").agg(F.max("seq").alias("seq"))
    return gather(rows.join(newest, ["shard", "seq"]), budget)


def collect_summary(updates: DataFrame, budget: Budget, path: str | None = None, item: str = "item",
                    weight: str = "weight") -> CounterSummary:
    """Summary of all updates of a stream, kept below ``path`` from one micro-batch to the next.

    Version n goes to folder ``n % 2`` and is made from the batch and version n - 1 in the other folder,
    so a batch that is repeated counts once and old versions do not pile up. Errors of
    merged summaries add up and stay within ``weight / counters``.
    """
    spark = updates.sparkSession
    path = path or scratch_path(spark, "summary")
    stored = "shard int, item long, residual long, q long, weight long, version long"
    for folder in (0, 1):
        spark.createDataFrame([], stored).write.mode("ignore").parquet(f"{path}/{folder}")

    def step(batch: DataFrame, number: int) -> None:
        fresh = summarise_in_place(batch, budget, item, weight)
        before = spark.read.schema(stored).parquet(f"{path}/{(number + 1) % 2}")
        both = merge([fresh, fresh.with_rows(before.drop("version"))])
        both.rows().withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(
            f"{path}/{number % 2}")

    query = updates.writeStream.foreachBatch(step).option(
        "checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stored).parquet(f"{path}/0", f"{path}/1")
    newest = rows.where(F.col("version") == rows.agg(F.max("version")).scalar()).drop("version")
    return gather(newest, budget)
