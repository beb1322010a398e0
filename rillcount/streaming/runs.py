"""Exact counts per run of a stream, with runs cut by position.

:func:`collect_runs` sums every micro-batch by run and item and appends the sums to a table;
sums of one run add up on reading, so that no update is too late and the last run is
there as soon as it begins. :func:`run_increments` keeps state instead: the position
serves as event time, one second per update, a run is a tumbling window and comes out once, when the
watermark has passed its end. What is later than ``lateness`` positions is then lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillcount.operators.exact import running_totals
from rillcount.session import scratch_path

#: Folders of one level that are summed up into one of the next.
FAN = 4
_MANIFEST = "version long, place int, folder string"


def read_table_stream(spark: SparkSession, folder: str, name: str,
                      files_per_trigger: int = 1) -> DataFrame:
    """Stream over the parquet files of one table in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def run_increments(updates: DataFrame, run_size: int, lateness: int = 0, item: str = "item",
                   weight: str = "weight", pos: str = "pos") -> DataFrame:
    """Streaming ``(run, item, w)``: weight of each item in each complete run.

    Updates up to ``lateness`` positions out of order are still counted.
    """
    timed = updates.select(
        F.col(item).alias("item"), F.col(weight).alias("weight"),
        F.timestamp_seconds(F.col(pos)).alias("at"))
    per_run = timed.withWatermark("at", f"{lateness} seconds").groupBy(
        F.window("at", f"{run_size} seconds").alias("span"), "item"
    ).agg(F.sum("weight").alias("w"))
    start = F.unix_timestamp(F.col("span.start"))
    return per_run.select(
        F.floor(start / F.lit(run_size)).cast("int").alias("run"), "item", "w")


def open_sums(spark: SparkSession, path: str) -> None:
    """Prepare ``path`` for :func:`add_sums`; what is there stays."""
    for place in (0, 1):
        spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(f"{path}/manifest/{place}")


def _live(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, list[str]]:
    """Where the newest manifest (of a batch earlier than ``before``) is, and the folders it names."""
    rows = spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/manifest").collect()
    rows = [r for r in rows if before is None or r.version < before]
    newest = max((r.version for r in rows), default=-1)
    rows = [r for r in rows if r.version == newest]
    return (rows[0].place if rows else 1), sorted(r.folder for r in rows)


def _sum_up(rows: DataFrame, value: str) -> DataFrame:
    keys = [name for name in rows.columns if name != value]
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))


def add_sums(rows: DataFrame, value: str, path: str, number: int, fan: int = FAN) -> None:
    """Add the keyed sums of micro-batch ``number`` to those below ``path``.

    A level holds at most ``fan - 1`` live folders; a batch that finds levels full is summed up with
    them into one folder of the first level with room, so a row is written about once per level.
    Folders are named by a manifest, written last into the other of two places. A batch
    writes only to a folder that the manifest before it does not name; so one that breaks off,
    or is repeated after its manifest was written, starts from the same state and counts once.
    """
    spark = rows.sparkSession
    place, live = _live(spark, path, number)
    taken, level = [], 0
    while len(full := [f for f in live if f.startswith(f"{level}-")]) == fan - 1:
        taken, level = taken + full, level + 1
    if taken:
        kind, columns = rows.schema[value].dataType, rows.columns
        older = spark.read.schema(rows.schema).parquet(*[f"{path}/{f}" for f in taken])
        rows = _sum_up(rows.unionByName(older), value).withColumn(value, F.col(value).cast(kind)).select(*columns)
    own = next(f for f in (f"{level}-{i}" for i in range(fan - 1)) if f not in live)
    rows.write.mode("overwrite").parquet(f"{path}/{own}")
    names = [f for f in live if f not in taken] + [own]
    spark.createDataFrame([(number, 1 - place, f) for f in names], _MANIFEST).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/manifest/{1 - place}")


def read_sums(spark: SparkSession, path: str, schema: StructType, value: str) -> DataFrame:
    """The sums of all batches so far, from the live folders alone.

    Later batches write over folders that are no longer live; a result that has to outlive two of them is best stored.
    """
    _, live = _live(spark, path)
    if not live:
        return _sum_up(spark.createDataFrame([], schema), value)
    return _sum_up(spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in live]), value)


def collect_sums(updates: DataFrame, reduced: Callable[[DataFrame], DataFrame], value: str,
                 path: str | None = None) -> DataFrame:
    """``reduced`` of all updates of a stream, read back from a table on shared storage.

    ``reduced`` makes keyed sums of a micro-batch, which :func:`add_sums` writes out; sums of ``value`` with
    the same keys add up on reading. A repeated micro-batch counts once, nothing is kept in memory or
    on the driver between them, and reading touches a number of folders that grows with the logarithm of the batches.
    """
    spark = updates.sparkSession
    path = path or scratch_path(spark, "sums")
    open_sums(spark, path)
    query = updates.writeStream.foreachBatch(
        lambda batch, number: add_sums(reduced(batch), value, path, number)).option(
        "checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_sums(spark, path, reduced(updates).schema, value)


def collect_runs(updates: DataFrame, run_size: int, path: str | None = None, item: str = "item",
                 weight: str = "weight", pos: str = "pos") -> DataFrame:
    """``(run, item, w)`` of all updates of a stream, by :func:`collect_sums`."""
    run = F.call_function("div", F.col(pos), F.lit(run_size)).cast("int")
    return collect_sums(updates, lambda batch: batch.groupBy(
        run.alias("run"), F.col(item).alias("item")).agg(F.sum(weight).alias("w")), "w", path)


def run_to_table(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Append a stream's rows to a parquet table on shared storage until input ends."""
    spark = rows.sparkSession
    path = path or scratch_path(spark, name)
    query = (
        rows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def snapshots(increments: DataFrame) -> DataFrame:
    """``(run, item, total)``: running totals from per-run increments."""
    return running_totals(increments.withColumnRenamed("w", "weight"))
