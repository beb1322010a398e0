"""Weighted traces: text with one ``id length`` pair per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: a reader with 32-bit counts stops before the total weight would reach this.
WEIGHT_CAP = 0x7FFFFFFE

PAIR = r"^\s*([+-]?\d{1,18})\s+([+-]?\d{1,18})\s*$"


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, split, seq)``: text lines with the order they have in the files.

    ``split`` numbers the byte ranges in which the files are read, in file order;
    ``seq`` grows inside each of them.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("seq"))
    return lines.withColumn("split", F.struct("_file", "_start")).drop("_file", "_start")


def parse_trace(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``item``, ``weight`` and ``good``; blank lines disappear.

    A line is good if it holds two whole numbers of which the second is positive.
    """
    item = F.regexp_extract(line, PAIR, 1)
    weight = F.regexp_extract(line, PAIR, 2)
    parsed = lines.where(F.trim(F.col(line)) != "").withColumns({
        "item": F.nullif(item, F.lit("")).cast("long"),
        "weight": F.nullif(weight, F.lit("")).cast("long")})
    return parsed.withColumn("good", F.coalesce(F.col("weight") > 0, F.lit(False)))


def cut_trace(parsed: DataFrame, cap: int | Column | None = None, stop_at_bad: bool = False,
              split: str = "split", seq: str = "seq") -> DataFrame:
    """``(item, weight, split, seq)`` of all good lines.

    ``cap`` ends the trace before the total weight would reach it, ``stop_at_bad`` ends it at
    the first line that is no update. Weights and bad lines are then summed per split, whole
    splits before the end pass through, and one window sees the one split that is cut.
    """
    kept = [F.col("item"), F.col("weight"), F.col(split), F.col(seq)]
    if cap is None and not stop_at_bad:
        return parsed.where("good").select(*kept)
    weight = F.when(F.col("good"), F.col("weight")).otherwise(0)
    bad = F.when(F.col("good"), 0).otherwise(1) if stop_at_bad else F.lit(0)

    def inside(w: Column, b: Column) -> Column:
        return (F.lit(True) if cap is None else w < cap) & (b == 0)

    sums = parsed.groupBy(split).agg(F.sum(weight).alias("_w"), F.sum(bad).alias("_b"))
    upto = Window.orderBy(split).rowsBetween(Window.unboundedPreceding, 0)
    along = sums.select(split, "_w", F.sum("_w").over(upto).alias("_we"), F.sum("_b").over(upto).alias("_be"))
    ending = along.where(~inside(F.col("_we"), F.col("_be"))).agg(
        F.min(F.struct(F.col(split).alias("at"), (F.col("_we") - F.col("_w")).alias("_w0"))).alias("end")).select(
        F.struct("end.at").alias("at"), F.col("end._w0").alias("_w0"))
    end_at, before = ending.select("at.at").scalar(), ending.select("_w0").scalar()
    whole = parsed.where("good").where(end_at.isNull() | (F.col(split) < end_at)).select(*kept)
    order = Window.partitionBy(split).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    last = (
        parsed.where(F.col(split) == end_at)
        .withColumn("_ws", F.sum(weight).over(order)).withColumn("_bs", F.sum(bad).over(order))
        .where(F.col("good") & inside(before + F.col("_ws"), F.col("_bs"))).select(*kept))
    return whole.unionByName(last)


def read_weighted_trace(spark: SparkSession, path: str, cap: int | None = None,
                        stop_at_bad: bool = False) -> DataFrame:
    """``(item, weight, split, seq)`` of a weighted trace on disk; see :func:`cut_trace`."""
    return cut_trace(parse_trace(trace_lines(spark, path)), cap, stop_at_bad)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a trace that are not an update."""
    return parse_trace(trace_lines(spark, path)).where(~F.col("good")).select("line")
