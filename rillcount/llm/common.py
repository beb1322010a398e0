"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillcount.session import cut_lineage

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[list[dict]]:
    """The rows of Arrow batches as short lists of dictionaries."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size).to_pylist()


def map_rows(
    df: DataFrame, each: Callable[[Iterator[list[dict]]], Iterator[list[tuple]]], schema: str
) -> DataFrame:
    """``mapInArrow`` over short lists of rows; ``each`` yields lists of tuples in schema order."""
    fields = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for rows in each(slices(batches)):
            columns = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, fields)


#: Bytes of text to bytes of lower-cased words (digits, a-z, all beyond ASCII) between blanks.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def byte_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and characters beyond ASCII, A-Z lower-cased, in UTF-8; null has none."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold whose ``crc32`` of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def running_starts(totals: DataFrame, part: str, within: str, value: str) -> DataFrame:
    """``totals`` with ``start``: the sum of ``value`` over all rows before, by ``(part, within)``.

    Two levels: the sums of the parts, of which there are as many as partitions
    wrote them, and the rows inside each part.
    """
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(part).orderBy(within).rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy(part).agg(F.sum(value).alias("_n")).select(
        part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        totals.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(parts, part)
        .withColumn("start", (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_before", "_inside"))


def in_blocks(rows: DataFrame, size: str, limit: int) -> Iterator[list[Row]]:
    """``rows`` on the driver, one block after another: at most ``limit`` bytes by ``size``, and one row more."""
    rows = cut_lineage(rows)
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= limit:
        yield rows.collect()
        return
    places = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut_lineage(running_starts(places, "_part", "_at", size).withColumn(
        "_block", F.floor(F.col("start") / limit)).drop("_part", "_at", "start"))
    for block in range(-(-total // limit)):
        yield dealt.where(F.col("_block") == block).drop("_block").collect()
