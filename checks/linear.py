"""Count-Min sketches over whole and fractional weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    CUSTOMERS, ORDERS, PART_SHAPE, PARTS, PHI_WORDS, PRICES, SIGNED, SIGNED_SHAPE, WORD_SHAPE, WORDS,
    cells, found, parts, thr, with_, words,
)
from rillcount.operators import exact
from rillcount.operators.linear import FLOAT_CELL_BYTES, CountMin, SketchShape, merge_all
from rillcount.sources import tables

TWO_ROWS = SketchShape(128, 2, 14)


def sketch(totals, shape):
    return CountMin.from_totals(totals, shape)


def signed(spark, d):
    return exact.item_totals(tables.signed_events(spark, d))


def prices(spark, d):
    return exact.item_totals(tables.part_prices(spark, d))


def build(spark, d):
    return sketch(words(spark, d), WORD_SHAPE).cells.select(F.col("row").alias("r"), "bucket", "c")


def point(spark, d):
    w = words(spark, d)
    return sketch(w, WORD_SHAPE).point(w).select("item", "est")


def hitters(spark, d):
    """Items whose estimate reaches the threshold, beside their exact total."""
    w = words(spark, d)
    return sketch(w, WORD_SHAPE).point(w).where(
        F.col("est") >= exact.heavy_threshold(w, PHI_WORDS))


def median(spark, d):
    t = signed(spark, d)
    return sketch(t, SIGNED_SHAPE).point_median(t).select("item", "est")


def median_two_rows(spark, d):
    t = signed(spark, d)
    return sketch(t, TWO_ROWS).point_median(t).select("item", "est")


def inner(spark, d):
    a = sketch(exact.item_totals(tables.customer_orders(spark, d)), PART_SHAPE)
    b = sketch(exact.item_totals(tables.customers(spark, d)), PART_SHAPE)
    return a.inner_product(b).select(F.col("est").cast("long").alias("est"))


def moment(spark, d):
    return sketch(words(spark, d), WORD_SHAPE).second_moment().select(
        F.col("est").cast("long").alias("est"))


def residue(spark, d):
    w = words(spark, d)
    return sketch(w, WORD_SHAPE).residue(exact.exact_heavy_hitters(w, PHI_WORDS)).select(
        F.col("est").cast("long").alias("est"))


def merged(spark, d):
    lines = tables.read_table(spark, d, "lineitem")
    sketches = [
        CountMin.build(lines.where(F.col("l_returnflag") == flag).select(
            F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("weight")),
            PART_SHAPE)
        for flag in ("A", "N", "R")]
    return merge_all(sketches).cells.select(F.col("row").alias("r"), "bucket", "c")


def from_empty(spark, d):
    """A sketch with the same hashes and no content, merged with a full one."""
    full = sketch(parts(spark, d), PART_SHAPE)
    return full.empty_like().merge(full).cells.select(F.col("row").alias("r"), "bucket", "c")


def size(spark, d):
    return sketch(words(spark, d), WORD_SHAPE).size()


def float_build(spark, d):
    return sketch(prices(spark, d), PART_SHAPE).cells.select(
        F.col("row").alias("r"), "bucket", (F.col("c") * 100).cast("long").alias("cents"))


def float_point(spark, d):
    p = prices(spark, d)
    return sketch(p, PART_SHAPE).point(p).select("item", F.col("est").cast("double").alias("est"))


def float_product(spark, d):
    """Estimated price total times quantity total, per part."""
    q = parts(spark, d).withColumn("total", F.col("total").cast("decimal(12,0)"))
    p = prices(spark, d).withColumn("total", F.col("total").cast("decimal(18,2)"))
    return sketch(p, PART_SHAPE).point_product(sketch(q, PART_SHAPE), q).select(
        "item", (F.col("est") * 100).cast("long").alias("cents"))


def float_inner(spark, d):
    q = parts(spark, d).withColumn("total", F.col("total").cast("decimal(18,0)"))
    return sketch(prices(spark, d), PART_SHAPE).inner_product(sketch(q, PART_SHAPE)).select(
        F.round("est", 0).cast("long").alias("est"))


def float_size(spark, d):
    return sketch(prices(spark, d), PART_SHAPE).size(FLOAT_CELL_BYTES)


def _min_sql(table, shape):
    return with_({"words": WORDS, "prices": PRICES}[table], cells("s", table, shape),
                 found("f", table, "s", shape))


def _size_sql(stream, table, shape, cell_bytes):
    dense = 40 + shape.width * shape.depth * cell_bytes + shape.depth * 8
    return with_(stream, cells("s", table, shape)) + (
        f"SELECT {dense}::BIGINT AS bytes, count(*) AS stored_cells FROM s")


CHECKS = {
    "a1_cm_build": (build, with_(WORDS, cells("s", "words", WORD_SHAPE)) +
                    "SELECT r, bucket, c::BIGINT AS c FROM s"),
    "a2_cm_empty_like": (from_empty, with_(PARTS, cells("s", "parts", PART_SHAPE)) +
                         "SELECT r, bucket, c::BIGINT AS c FROM s"),
    "a3_cm_point": (point, _min_sql("words", WORD_SHAPE) +
                    "SELECT item, min(c)::BIGINT AS est FROM f GROUP BY item"),
    "a3_cm_heavy_hitters": (hitters, _min_sql("words", WORD_SHAPE) + f"""
        SELECT item, total, min(c)::BIGINT AS est FROM f GROUP BY item, total
        HAVING min(c) >= {thr(PHI_WORDS, 'words')}"""),
    "a4_cm_point_median": (median, with_(
        SIGNED, cells("s", "signed", SIGNED_SHAPE), found("f", "signed", "s", SIGNED_SHAPE)) + """
        SELECT item, (list_sort(list(c)))[3]::BIGINT AS est FROM f GROUP BY item"""),
    "a4_cm_point_median_two_rows": (median_two_rows, with_(
        SIGNED, cells("s", "signed", TWO_ROWS), found("f", "signed", "s", TWO_ROWS)) + """
        SELECT item, (CASE WHEN abs(max(c) FILTER (r = 0)) < abs(max(c) FILTER (r = 1))
          THEN max(c) FILTER (r = 0) ELSE max(c) FILTER (r = 1) END)::BIGINT AS est
        FROM f GROUP BY item"""),
    "a6_cm_inner_product": (inner, with_(
        ORDERS, CUSTOMERS, cells("s1", "orders_by", PART_SHAPE), cells("s2", "customers", PART_SHAPE)) + """
        SELECT min(p)::BIGINT AS est FROM (
          SELECT s1.r, sum(s1.c * coalesce(s2.c, 0)) AS p
          FROM s1 LEFT JOIN s2 ON s1.r = s2.r AND s1.bucket = s2.bucket GROUP BY 1)"""),
    "a7_cm_second_moment": (moment, with_(WORDS, cells("s", "words", WORD_SHAPE)) + """
        SELECT (list_sort(list(m)))[3]::BIGINT AS est FROM (
          SELECT r, sum(d * d) AS m FROM (
            SELECT r, bucket // 2 AS p, sum(CASE WHEN bucket % 2 = 0 THEN c ELSE -c END) AS d
            FROM s GROUP BY 1, 2) GROUP BY 1)"""),
    "a8_cm_residue": (residue, with_(
        WORDS, cells("s", "words", WORD_SHAPE),
        f"heavy AS (SELECT item, total FROM words WHERE total >= {thr(PHI_WORDS, 'words')})",
        cells("touched", "heavy", WORD_SHAPE)) + """
        SELECT greatest(max(w), 0)::BIGINT AS est FROM (
          SELECT s.r, sum(s.c) AS w FROM s ANTI JOIN touched t ON t.r = s.r AND t.bucket = s.bucket
          GROUP BY 1)"""),
    "a9_cm_merge": (merged, with_(PARTS, cells("s", "parts", PART_SHAPE)) +
                    "SELECT r, bucket, c::BIGINT AS c FROM s"),
    "a10_cm_size": (size, _size_sql(WORDS, "words", WORD_SHAPE, 4)),
    "b1_cmf_build": (float_build, with_(PRICES, cells("s", "prices", PART_SHAPE)) +
                     "SELECT r, bucket, (c * 100)::BIGINT AS cents FROM s"),
    "b2_cmf_point": (float_point, _min_sql("prices", PART_SHAPE) +
                     "SELECT item, min(c)::DOUBLE AS est FROM f GROUP BY item"),
    "b4_cmf_point_product": (float_product, with_(
        PRICES, PARTS, cells("s1", "prices", PART_SHAPE), cells("s2", "parts", PART_SHAPE),
        found("f1", "parts", "s1", PART_SHAPE), found("f2", "parts", "s2", PART_SHAPE)) + """
        SELECT item, (min(f1.c::DECIMAL(18,2) * f2.c::DECIMAL(12,0)) * 100)::BIGINT AS cents
        FROM f1 JOIN f2 USING (item, r) GROUP BY item"""),
    "b5_cmf_inner_product": (float_inner, with_(
        PRICES, PARTS, cells("s1", "prices", PART_SHAPE), cells("s2", "parts", PART_SHAPE)) + """
        SELECT round(min(p), 0)::BIGINT AS est FROM (
          SELECT s1.r, sum(s1.c::DECIMAL(24,2) * s2.c::DECIMAL(12,0)) AS p
          FROM s1 JOIN s2 ON s1.r = s2.r AND s1.bucket = s2.bucket GROUP BY 1)"""),
    "b6_cmf_size": (float_size, _size_sql(PRICES, "prices", PART_SHAPE, 8)),
}
