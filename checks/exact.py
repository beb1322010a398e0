"""Scalar functions, exact answers and order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    PARTS, PHI_PARTS, PHI_USERS, PHI_WORDS, WORD_SHAPE, WORDS, h31, parts, real, thr, with_, words,
)
from rillcount.functions import hashing
from rillcount.operators import exact
from rillcount.operators.linear import place
from rillcount.operators.order_stats import kth_smallest
from rillcount.sources import tables

A, B, C, D = 1103515245, 12345, 907633385, 377003613
RUNS = 20


def hash31(spark, d):
    return tables.read_table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("item"),
        hashing.hash31(A, B, F.col("l_partkey")).alias("h")).distinct()


def fourwise(spark, d):
    return tables.read_table(spark, d, "part").select(
        F.col("p_partkey").alias("item"),
        hashing.fourwise(A, B, C, D, F.col("p_partkey")).alias("h"))


def sign(spark, d):
    return tables.read_table(spark, d, "part").select(
        F.col("p_partkey").alias("item"),
        hashing.sign_hash(C, D, F.col("p_partkey")).alias("s"))


def prefix(spark, d):
    return words(spark, d).select(
        "item", hashing.level_prefix(F.col("item"), 8, 1).alias("l1"),
        hashing.level_prefix(F.col("item"), 8, 3).alias("l3"))


def threshold(spark, d):
    n = exact.stream_total(parts(spark, d))
    return n.select("n", hashing.threshold(PHI_PARTS, F.col("n")).alias("thr"))


def coefficient_table(spark, d):
    """Every item's bucket in every row: the coefficients at work."""
    return place(words(spark, d), WORD_SHAPE, F.col("item"), F.col("item")).select(
        F.col("row").alias("r"), "bucket").groupBy("r", "bucket").agg(
        F.count(F.lit(1)).alias("items"))


def ingest(spark, d):
    return parts(spark, d)


def heavy(spark, d):
    return exact.exact_heavy_hitters(words(spark, d), PHI_WORDS)


def word_ids(spark, d):
    """As many ids as there are different words, and all their uses."""
    found = tables.word_totals(spark, d)
    return found.agg(F.count(F.lit(1)).alias("words"), F.countDistinct("item").alias("ids"),
                     F.sum("weight").alias("uses"))


def runs(spark, d):
    cut = exact.split_runs(tables.user_events(spark, d), 7)
    return cut.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def positions(spark, d):
    """Dense positions of a key with gaps."""
    orders = tables.read_table(spark, d, "orders").select(
        (F.col("o_orderkey") * 7 + 3).alias("key"))
    return exact.dense_position(orders, "key").select("key", "pos")


def cumulative(spark, d):
    cut = exact.split_runs(tables.user_events(spark, d), RUNS)
    return exact.cumulative_heavy_hitters(cut, PHI_USERS)


def cumulative_signed(spark, d):
    cut = exact.split_runs(tables.signed_events(spark, d), RUNS)
    return exact.cumulative_heavy_hitters(cut, PHI_USERS)


def turnstile(spark, d):
    return exact.item_totals(tables.signed_events(spark, d))


def moments(spark, d):
    f2 = exact.second_moment(parts(spark, d)).select(F.col("f2").cast("long").alias("f2"))
    return f2


def join_size(spark, d):
    left = exact.item_totals(tables.customer_orders(spark, d))
    right = exact.item_totals(tables.customers(spark, d))
    return exact.inner_product(left, right).select(F.col("product").cast("long").alias("product"))


def kth_one_based(spark, d):
    lines = tables.read_table(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_partkey").alias("v"))
    return kth_smallest(lines, ["l_returnflag"], "v", 500, bits=64).select(
        "l_returnflag", F.col("value").alias("kth"))


def kth_zero_based(spark, d):
    prices = tables.read_table(spark, d, "orders").select(
        "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return kth_smallest(prices, ["o_orderpriority"], "cents", 250, bits=48, zero_based=True).select(
        "o_orderpriority", F.col("value").alias("kth"))


RUN_SQL = f"""
  per AS (SELECT user_id AS item, event_id // size AS run, count(*)::BIGINT AS w
          FROM events, (SELECT count(*) // {RUNS} AS size FROM events)
          WHERE event_id // size < {RUNS} GROUP BY 1, 2),
  grid AS (SELECT item, run FROM (SELECT DISTINCT item FROM per), (SELECT DISTINCT run FROM per)),
  cum AS (SELECT g.run, g.item, sum(coalesce(p.w, 0)) OVER (PARTITION BY g.item ORDER BY g.run) AS total
          FROM grid g LEFT JOIN per p ON p.item = g.item AND p.run = g.run),
  thrs AS (SELECT run, floor({real(PHI_USERS)} * sum(total))::BIGINT + 1 AS thr FROM cum GROUP BY run)"""

CHECKS = {
    "f1_hash31": (hash31, f"SELECT DISTINCT l_partkey AS item, {h31(A, B, 'l_partkey')} AS h FROM lineitem"),
    "f2_fourwise": (fourwise, f"""SELECT p_partkey AS item,
        {h31(h31(h31(A, B, 'p_partkey'), C, 'p_partkey'), D, 'p_partkey')} AS h FROM part"""),
    "f3_sign_hash": (sign, f"""SELECT p_partkey AS item,
        (CASE WHEN {h31(C, D, 'p_partkey')} & 1 = 1 THEN 1 ELSE -1 END)::BIGINT AS s FROM part"""),
    "f4_level_prefix": (prefix, with_(WORDS) + "SELECT item, item >> 8 AS l1, item >> 24 AS l3 FROM words"),
    "f5_threshold": (threshold, with_(PARTS) + f"""SELECT sum(total)::BIGINT AS n,
        floor({real(PHI_PARTS)} * sum(total))::BIGINT + 1 AS thr FROM parts"""),
    "f6_coefficients": (coefficient_table, with_(WORDS) + f"""SELECT k.r, {h31('k.a', 'k.b', 'item')} % {WORD_SHAPE.width} AS bucket,
        count(*) AS items FROM words, (VALUES {', '.join(f'({r}, {a}, {b})' for r, (a, b) in enumerate(WORD_SHAPE.coeffs))}) k(r, a, b)
        GROUP BY 1, 2"""),
    "e1_item_totals": (ingest, with_(PARTS) + "SELECT item, total FROM parts"),
    "e2_exact_heavy_hitters": (heavy, with_(WORDS) + f"SELECT item, total FROM words WHERE total >= {thr(PHI_WORDS, 'words')}"),
    "e2_word_ids": (word_ids, """SELECT count(DISTINCT w) AS words, count(DISTINCT w) AS ids, count(*) AS uses
        FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents)"""),
    "e3_split_runs": (runs, """SELECT least(event_id // size, 6)::INT AS run, count(*) AS n, min(event_id) AS first, max(event_id) AS last
        FROM events, (SELECT count(*) // 7 AS size FROM events) GROUP BY 1"""),
    "e3_dense_position": (positions, """SELECT o_orderkey * 7 + 3 AS key,
        row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders"""),
    "e4_cumulative_heavy_hitters": (cumulative, f"""WITH {RUN_SQL}
        SELECT c.run::INT AS run, item, total::BIGINT AS total, thr
        FROM cum c JOIN thrs t ON t.run = c.run WHERE total >= thr"""),
    "e4_cumulative_signed": (cumulative_signed, f"""WITH s AS (
          SELECT least(event_id // (SELECT count(*) // {RUNS} FROM events), {RUNS - 1})::INT AS run, user_id AS item,
            CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS w FROM events),
        grid AS (SELECT r.run, i.item, coalesce(sum(s.w), 0)::BIGINT AS total
          FROM (SELECT DISTINCT run FROM s) r CROSS JOIN (SELECT DISTINCT item FROM s) i
          LEFT JOIN s ON s.item = i.item AND s.run <= r.run GROUP BY 1, 2),
        thrs AS (SELECT run, floor({real(PHI_USERS)} * sum(total))::BIGINT + 1 AS thr FROM grid GROUP BY 1),
        seen AS (SELECT item, min(run) AS since FROM s GROUP BY 1)
        SELECT run, item, total, thr FROM grid JOIN thrs USING (run) JOIN seen USING (item)
        WHERE run >= since AND total >= thr"""),
    "e5_turnstile": (turnstile, """SELECT user_id AS item,
        sum(CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END)::BIGINT AS total FROM events GROUP BY 1"""),
    "e6_second_moment": (moments, with_(PARTS) + "SELECT sum(total * total)::BIGINT AS f2 FROM parts"),
    "e6_inner_product": (join_size, "SELECT count(*)::BIGINT AS product FROM orders JOIN customer ON c_custkey = o_custkey"),
    "r1_kth_smallest": (kth_one_based, """SELECT l_returnflag, v AS kth FROM (
        SELECT l_returnflag, l_partkey AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS i
        FROM lineitem) WHERE i = 500"""),
    "r2_kth_smallest_zero_based": (kth_zero_based, """SELECT o_orderpriority, v AS kth FROM (
        SELECT o_orderpriority, v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY v) - 1 AS i
        FROM (SELECT o_orderpriority, round(o_totalprice * 100)::BIGINT AS v FROM orders)) WHERE i = 250"""),
}
