"""The same answers from Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    PART_SHAPE, PART_TREE, PHI_USERS, PRICES, SIGNED, SIGNED_SHAPE, USERS, cells, users, with_,
)
from checks.counters import EXACT_OK, verdict
from checks.dyadic import build_sql, signed_cells
from rillcount.operators import lossy
from rillcount.operators.counters import Budget
from rillcount.operators.dyadic import DyadicCountSketch, Hierarchy
from rillcount.session import scratch_path
from rillcount.sources import tables
from rillcount.streaming import counters, runs, sketches

RUN_SIZE, FILES = 300, 4
USER_TREE = Hierarchy(32, 8, 256, 5, 61)


def arriving(spark, d, table, key):
    """A table as a stream of several files, one for each micro-batch."""
    path = scratch_path(spark, table)
    whole = tables.read_table(spark, d, table)
    whole.repartitionByRange(FILES, key).write.parquet(path)
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)


def events(spark, d):
    return arriving(spark, d, "events", "event_id").select(
        F.col("user_id").alias("item"), F.lit(1).cast("long").alias("weight"),
        F.col("event_id").alias("pos"))


def lines(spark, d):
    return arriving(spark, d, "lineitem", "l_orderkey")


def signed(spark, d):
    updates = events(spark, d).withColumn(
        "weight", F.when(F.col("pos") % 5 == 0, -1).otherwise(1).cast("long"))
    return sketches.collect_cells(updates, lambda b: sketches.streaming_cells(b, SIGNED_SHAPE)).select(
        F.col("row").alias("r"), "bucket", "c")


def prices(spark, d):
    updates = lines(spark, d).select(
        F.col("l_partkey").alias("item"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("weight"))
    return sketches.collect_cells(updates, lambda b: sketches.streaming_cells(b, PART_SHAPE)).select(
        F.col("row").alias("r"), "bucket", (F.col("c") * 100).cast("long").alias("cents"))


def levels(spark, d):
    updates = lines(spark, d).select(
        F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("weight"))
    return sketches.collect_cells(updates, lambda b: sketches.streaming_level_cells(b, PART_TREE)).select(
        "level", F.col("row").alias("r"), "bucket", "c")


def signed_level_cells(spark, d):
    return sketches.collect_cells(
        events(spark, d), lambda b: sketches.streaming_level_cells(b, USER_TREE, signed=True)).select(
        "level", F.col("row").alias("r"), "bucket", "c")


def signed_levels(spark, d):
    """Streamed and batch-built Count Sketch cells, subtracted: nothing may remain."""
    streamed = signed_level_cells(spark, d).withColumnRenamed("r", "row")
    batch = DyadicCountSketch(USER_TREE, users(spark, d)).cells()
    return streamed.join(
        batch.withColumnRenamed("c", "b"), ["level", "row", "bucket"], "full_outer"
    ).agg(F.count(F.lit(1)).alias("cells"), F.sum(
        (F.coalesce("c", F.lit(0)) != F.coalesce("b", F.lit(0))).cast("long")).alias("unequal"))


def exact_runs(spark, d):
    return runs.snapshots(runs.collect_runs(events(spark, d), RUN_SIZE))


def summary(spark, d):
    return verdict(counters.collect_summary(events(spark, d), Budget.im_sum(1 / 50, 1.0)), users(spark, d))


def space_summary(spark, d):
    return verdict(counters.collect_summary(events(spark, d), Budget.space_saving(1 / 60)), users(spark, d))


def epochs(spark, d):
    return lossy.epoch_counts(tables.user_events(spark, d), lossy.window_size(PHI_USERS))


CS_CELLS = with_(USERS, *[signed_cells(l, USER_TREE, "users") for l in range(USER_TREE.levels)],
                 "cells AS (" + " UNION ALL ".join(
    f"SELECT {l} AS level, r, bucket, c::BIGINT AS c FROM s{l}" for l in range(USER_TREE.levels)) + f"""
  UNION ALL SELECT {USER_TREE.levels} AS level, -1 AS r, 0::BIGINT AS bucket, sum(total)::BIGINT AS c FROM users)""")

CHECKS = {
    "t1_stream_cm": (signed, with_(SIGNED, cells("s", "signed", SIGNED_SHAPE)) +
                     "SELECT r, bucket, c::BIGINT AS c FROM s"),
    "t1_stream_cmf": (prices, with_(PRICES, cells("s", "prices", PART_SHAPE)) +
                      "SELECT r, bucket, (c * 100)::BIGINT AS cents FROM s"),
    "t1_stream_cmh": (levels, build_sql()),
    "t1_stream_cs": (signed_levels, CS_CELLS + "SELECT count(*) AS cells, 0::BIGINT AS unequal FROM cells"),
    "t1_stream_cs_cells": (signed_level_cells, CS_CELLS + "SELECT * FROM cells"),
    "t2_stream_runs": (exact_runs, f"""
        SELECT run, item, sum(w) OVER (PARTITION BY item ORDER BY run)::BIGINT AS total FROM (
          SELECT (event_id // {RUN_SIZE})::INT AS run, user_id AS item, count(*) AS w
          FROM events GROUP BY 1, 2)"""),
    "t3_stream_im_sum": (summary, with_(USERS) + f"SELECT {EXACT_OK} FROM users"),
    "t3_stream_space_saving": (space_summary, with_(USERS) + f"SELECT {EXACT_OK} FROM users"),
    "t4_epochs": (epochs, f"""SELECT user_id AS item, event_id // {lossy.window_size(PHI_USERS)} AS epoch,
        count(*) AS n FROM events GROUP BY 1, 2"""),
}
