"""Update streams and hash arithmetic as SQL text, mirroring the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from rillcount.operators.dyadic import Hierarchy
from rillcount.operators.exact import item_totals
from rillcount.operators.linear import SketchShape
from rillcount.session import cut_lineage
from rillcount.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
PHI_WORDS = 0.001
PHI_USERS = 1 / 130
PHI_PARTS = 1 / 1500
WORD_SHAPE = SketchShape(2000, 5, 11)
PART_SHAPE = SketchShape(1024, 4, 12)
SIGNED_SHAPE = SketchShape(256, 5, 13)
WORD_TREE = Hierarchy(32, 8, 2000, 10, 21)
PART_TREE = Hierarchy(32, 8, 8192, 8, 22)
WORD_SIGNED_TREE = Hierarchy(32, 8, 2000, 10, 23)


def words(spark, sf_dir):
    return item_totals(tables.word_totals(spark, sf_dir))


def kept_words(spark, sf_dir):
    """Word totals checkpointed for queries that use them several times."""
    return tables.spread(cut_lineage(words(spark, sf_dir)))


def users(spark, sf_dir):
    return item_totals(tables.user_events(spark, sf_dir))


def parts(spark, sf_dir):
    return item_totals(tables.part_quantities(spark, sf_dir))


# Each stream as the body of a WITH clause entry with columns item, total.
WORDS = """words AS (
  SELECT (row_number() OVER (PARTITION BY class ORDER BY w) - 1) * 4096 + class AS item, total
  FROM (SELECT w, ('0x' || substr(md5(w), 1, 3))::BIGINT AS class, count(*)::BIGINT AS total
    FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) GROUP BY 1))"""
USERS = """users AS (
  SELECT user_id AS item, count(*)::BIGINT AS total FROM events GROUP BY 1)"""
SIGNED = """signed AS (
  SELECT user_id AS item,
         sum(CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END)::BIGINT AS total
  FROM events GROUP BY 1)"""
PARTS = """parts AS (
  SELECT l_partkey AS item, sum(l_quantity::BIGINT)::BIGINT AS total
  FROM lineitem GROUP BY 1)"""
PRICES = """prices AS (
  SELECT l_partkey AS item, sum(l_extendedprice::DECIMAL(18,2)) AS total
  FROM lineitem GROUP BY 1)"""
ORDERS = """orders_by AS (
  SELECT o_custkey AS item, count(*)::BIGINT AS total FROM orders GROUP BY 1)"""
CUSTOMERS = """customers AS (
  SELECT c_custkey AS item, count(*)::BIGINT AS total FROM customer GROUP BY 1)"""


def real(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def h31(a, b, x) -> str:
    r = f"({a} * {x} + {b})"
    return f"((({r} >> 31) + {r}) & 2147483647)"


def thr(phi: float, table: str) -> str:
    return f"(SELECT floor({real(phi)} * sum(total))::BIGINT + 1 FROM {table})"


def values(rows: Sequence[Sequence]) -> str:
    return "(VALUES " + ", ".join(
        "(" + ", ".join(str(v) for v in row) + ")" for row in rows) + ")"


def coeffs(shape: SketchShape) -> str:
    return values([(r, a, b) for r, (a, b) in enumerate(shape.coeffs)])


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def cells(name: str, table: str, shape: SketchShape, x: str = "t.item") -> str:
    """WITH entry ``name(r, bucket, c)``."""
    return f"""{name} AS (
  SELECT k.r AS r, {h31('k.a', 'k.b', x)} % {shape.width} AS bucket, sum(t.total) AS c
  FROM {table} t, {coeffs(shape)} k(r, a, b) GROUP BY 1, 2)"""


def found(name: str, table: str, cells_name: str, shape: SketchShape, x: str = "t.item") -> str:
    """WITH entry ``name``: every row of ``table`` once per sketch row, with its cell ``c``."""
    return f"""{name} AS (
  SELECT t.*, k.r AS r, coalesce(s.c, 0) AS c
  FROM {table} t CROSS JOIN {coeffs(shape)} k(r, a, b)
  LEFT JOIN {cells_name} s ON s.r = k.r
   AND s.bucket = {h31('k.a', 'k.b', x)} % {shape.width})"""
