"""Session settings the library relies on: shared scratch space and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SIZE_UNITS = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
               "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def _bytes(text: str) -> int:
    text = text.strip().lower()
    digits = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(digits) * _SIZE_UNITS.get(text[len(digits):] or "b", 1)


def broadcast_limit(spark: SparkSession) -> int:
    """The session's own broadcast threshold in bytes; -1 switches it off."""
    return _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))


def fits_broadcast(spark: SparkSession, max_rows: int, row_bytes: int) -> bool:
    """True when ``max_rows`` rows can be broadcast under the session's limit.

    ``max_rows`` has to be a proven upper bound, such as the width of a sketch.
    """
    return max_rows * row_bytes <= broadcast_limit(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, where every task runs on this machine, may fall back
    to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="rillcount-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
