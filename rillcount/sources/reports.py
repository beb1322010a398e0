"""Writing reports and keeping the results of sweeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str) -> None:
    """Tab-separated table with a heading, one row per method."""
    report.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def saved_sweep(spark: SparkSession, path: str, dataset: str, sweep: str,
                make: Callable[[], DataFrame]) -> DataFrame:
    """Results of a sweep, made once and then reused.

    The table is partitioned by ``dataset`` and ``sweep``; a missing partition is
    computed and written, a present one is only read.
    """
    wanted = (F.col("dataset") == dataset) & (F.col("sweep") == sweep)
    try:
        found = spark.read.parquet(path).where(wanted)
        if not found.isEmpty():
            return found
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
    tagged = make().withColumns({"dataset": F.lit(dataset), "sweep": F.lit(sweep)})
    tagged.write.mode("append").partitionBy("dataset", "sweep").parquet(path)
    return spark.read.parquet(path).where(wanted)
