"""Traces and synthetic columns, drawn per row of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.common import h31, real
from rillcount.functions.hashing import uniform
from rillcount.sources import synthetic, tables, trace
from rillcount.sources.reports import read_report, saved_sweep, write_report
from rillcount.session import scratch_path

ZIPF_N, ZIPF_S = 1 << 12, 1.0
FAST_N, FAST_THETA = 5000, 0.7
SPLIT = 1024


def draws(spark, d, *seeds):
    """``(pos, u...)``: uniform draws for every event."""
    events = tables.read_table(spark, d, "events").select(F.col("event_id").alias("pos"))
    return events.select("pos", *[
        uniform(F.col("pos"), s).alias(f"u{i}") for i, s in enumerate(seeds, 1)])


def weighted_trace(spark, d):
    """A trace of user and length written as text, read up to the weight cap."""
    events = tables.read_table(spark, d, "events")
    lines = events.select(
        F.concat_ws(" ", "user_id", (F.col("event_id") % 50 + 1).cast("string")).alias("line"),
        F.floor(F.col("event_id") / SPLIT).alias("split"), F.col("event_id").alias("seq"))
    total = events.agg(F.sum(F.col("event_id") % 50 + 1).alias("n")).select(
        F.floor(F.col("n") / 2).alias("cap")).scalar()
    return trace.cut_trace(trace.parse_trace(lines), total).select(
        F.col("seq").alias("pos"), "item", "weight")


def trace_file(spark, d):
    """The same through a file: totals per item do not depend on the order of lines."""
    path = scratch_path(spark, "trace")
    tables.read_table(spark, d, "lineitem").select(
        F.concat_ws(" ", F.col("l_partkey"), F.col("l_quantity").cast("long"))
    ).write.text(path)
    return trace.read_weighted_trace(spark, path).groupBy("item").agg(
        F.sum("weight").alias("total"))


def zipf(spark, d):
    return synthetic.zipf_stream(
        draws(spark, d, 1), F.col("u1"), 0, ZIPF_N, ZIPF_S).select("pos", "item")


def zipf_fast(spark, d):
    zetan = synthetic.zeta(spark, FAST_N, FAST_THETA).scalar()
    return draws(spark, d, 2).select("pos", synthetic.zipf_fast(
        F.col("u1"), FAST_N, FAST_THETA, zetan).alias("item"))


def zeta(spark, d):
    """Harmonic sums as long as the number of parts in each size class."""
    ranked = tables.read_table(spark, d, "part").select("p_size", F.row_number().over(
        Window.partitionBy("p_size").orderBy("p_partkey")).alias("i"))
    return synthetic.power_sums(ranked, 0.8, "p_size", rank="i").select(
        "p_size", F.round("zeta", 9).alias("zeta"))


def scrambled(spark, d):
    return tables.read_table(spark, d, "part").select(
        "p_partkey", synthetic.scramble_ids(F.col("p_partkey"), 1103515245, 12345).alias("item"))


def numeric(spark, d):
    u = F.col("u1")
    return draws(spark, d, 3).select(
        "pos", synthetic.uniform_int(u, -5, 95).alias("i"),
        F.round(synthetic.uniform_double(u, 2.0, 7.5), 9).alias("x"))


def normal(spark, d):
    return draws(spark, d, 4, 5).select("pos", F.round(
        synthetic.normal(F.col("u1"), F.col("u2"), 10.0, 2.5), 8).alias("x"))


def cauchy(spark, d):
    return draws(spark, d, 6).select("pos", F.round(synthetic.cauchy(F.col("u1")), 4).alias("x"))


def stable(spark, d):
    u1, u2 = F.col("u1"), F.col("u2")
    return draws(spark, d, 7, 8).select(
        "pos", F.round(synthetic.stable(u1, u2, 1.5), 5).alias("x15"),
        F.round(synthetic.stable(u1, u2, 2.0), 8).alias("x20"),
        F.round(synthetic.stable(u1, u2, 1.0), 4).alias("x10"),
        F.round(F.ln(F.abs(synthetic.stable(u1, u2, 0.001))), 6).alias("log_alt"))


def skewed(spark, d):
    return synthetic.skewed(
        draws(spark, d, 9), F.col("u1"), "medium", 0.0, 100.0, ranks=ZIPF_N).select(
        "pos", F.round("skewed", 9).alias("x"))


def skewed_full(spark, d):
    """Over the full million ranks."""
    return synthetic.skewed(draws(spark, d, 10), F.col("u1"), "low").select(
        "pos", F.col("skewed").alias("x"))


def bernoulli(spark, d):
    return draws(spark, d, 11).select(
        "pos", synthetic.bernoulli(F.col("u1"), 0.3).alias("hit"),
        synthetic.coin(F.col("u1")).alias("head"))


def _report(spark, d):
    return tables.read_table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(
        F.count(F.lit(1)).alias("updates"), F.sum(F.col("l_quantity").cast("long")).alias("weight"))


def report(spark, d):
    """A report written as text and read back."""
    path = scratch_path(spark, "report")
    made = _report(spark, d)
    write_report(made, path)
    return read_report(spark, path, made.schema)


def saved(spark, d):
    """A result computed once; the second request is served from the saved table."""
    path = scratch_path(spark, "sweep")
    saved_sweep(spark, path, "lineitem", "flags", lambda: _report(spark, d))
    return saved_sweep(spark, path, "lineitem", "flags", lambda: _report(spark, d).limit(0)).select(
        "method", "updates", "weight")


# --- SQL -----------------------------------------------------------------

def u(seed, key="event_id"):
    return f"(('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal_sql(a, b):
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {a})) * cos({real(2 * 3.141592653589793)} * {b}))"


def cauchy_sql(a):
    return f"tan({real(3.141592653589793)} * ({a} - 0.5::DOUBLE))"


def stable_sql(a, b, alpha):
    th = f"({real(3.141592653589793)} * ({a} - 0.5::DOUBLE))"
    return (f"(sin({real(alpha)} * {th}) / pow(cos({th}), {real(1 / alpha)})"
            f" * pow(cos({th} * {real(1 - alpha)}) / (-ln(1.0::DOUBLE - {b})), {real((1 - alpha) / alpha)}))")


def zipf_sql(seed, ranks, s):
    """First rank whose cumulative share reaches the draw, by an ASOF join."""
    return f"""WITH p AS (SELECT k, pow(k::DOUBLE, {real(-s)}) AS p FROM range(1, {ranks} + 1) t(k)),
      cdf AS (SELECT k, sum(p) OVER (ORDER BY k) / (SELECT sum(p) FROM p) AS hi FROM p),
      steps AS (SELECT k, coalesce(lag(hi) OVER (ORDER BY k), -1.0) AS lo FROM cdf),
      d AS (SELECT event_id AS pos, {u(seed)} AS u FROM events)
      SELECT pos, s.k AS k FROM d ASOF JOIN steps s ON d.u > s.lo"""


FAST_SQL = f"""WITH zz AS (SELECT sum(pow(1.0::DOUBLE / i, {real(FAST_THETA)})) AS z FROM range(1, {FAST_N} + 1) t(i)),
  d AS (SELECT event_id AS pos, {u(2)} AS u FROM events),
  e AS (SELECT (1.0::DOUBLE - pow(2.0::DOUBLE / {FAST_N}, {real(1 - FAST_THETA)}))
    / (1.0::DOUBLE - {real(1 + 0.5 ** FAST_THETA)} / z) AS eta, z FROM zz)
  SELECT pos, (CASE WHEN u * z < 1 THEN 1 WHEN u * z < {real(1 + 0.5 ** FAST_THETA)} THEN 2
    ELSE 1 + floor({FAST_N} * pow(eta * u - eta + 1.0::DOUBLE, {real(1 / (1 - FAST_THETA))})) END)::BIGINT AS item
  FROM d, e"""

REPORT_SQL = """SELECT l_returnflag AS method, count(*) AS updates,
  sum(l_quantity::BIGINT)::BIGINT AS weight FROM lineitem GROUP BY 1"""

CHECKS = {
    "s1_weighted_trace": (weighted_trace, """
        SELECT pos, item, weight FROM (
          SELECT event_id AS pos, user_id AS item, event_id % 50 + 1 AS weight,
            sum(event_id % 50 + 1) OVER (ORDER BY event_id) AS running FROM events)
        WHERE running < (SELECT sum(event_id % 50 + 1) // 2 FROM events)"""),
    "s1_weighted_trace_file": (trace_file, """
        SELECT l_partkey AS item, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1"""),
    "s2_zipf_stream": (zipf, f"SELECT pos, k AS item FROM ({zipf_sql(1, ZIPF_N - 1, ZIPF_S)})"),
    "s3_zipf_fast": (zipf_fast, FAST_SQL),
    "s4_zeta": (zeta, """SELECT p_size, round(sum(pow(1.0::DOUBLE / i, 0.8::DOUBLE)), 9) AS zeta
        FROM (SELECT p_size, row_number() OVER (PARTITION BY p_size) AS i FROM part) GROUP BY 1"""),
    "s5_scramble_ids": (scrambled, f"""SELECT p_partkey,
        {h31(1103515245, 12345, 'p_partkey')} & 1048575 AS item FROM part"""),
    "s6_uniform": (numeric, f"""SELECT event_id AS pos, (-5 + floor(100 * {u(3)}))::BIGINT AS i,
        round(5.5::DOUBLE * {u(3)} + 2.0::DOUBLE, 9) AS x FROM events"""),
    "s7_normal": (normal, f"""SELECT event_id AS pos,
        round(10.0::DOUBLE + 2.5::DOUBLE * {normal_sql(u(4), u(5))}, 8) AS x FROM events"""),
    "s8_cauchy": (cauchy, f"SELECT event_id AS pos, round({cauchy_sql(u(6))}, 4) AS x FROM events"),
    "s9_stable": (stable, f"""SELECT event_id AS pos, round({stable_sql(u(7), u(8), 1.5)}, 5) AS x15,
        round({normal_sql(u(7), u(8))}, 8) AS x20, round({cauchy_sql(u(7))}, 4) AS x10,
        round(ln(abs(pow(1.0::DOUBLE - {u(7)}, -50.0::DOUBLE))), 6) AS log_alt FROM events"""),
    "s10_skewed": (skewed, f"""SELECT pos, round(100.0::DOUBLE * ((k - 1) / {ZIPF_N - 1}.0::DOUBLE), 9) AS x
        FROM ({zipf_sql(9, ZIPF_N, 1.5)})"""),
    "s10_skewed_million_ranks": (skewed_full, None),
    "s11_bernoulli": (bernoulli, f"""SELECT event_id AS pos, {u(11)} < 0.3::DOUBLE AS hit,
        {u(11)} < 0.5::DOUBLE AS head FROM events"""),
    "s12_report": (report, REPORT_SQL),
    "s13_saved_sweep": (saved, REPORT_SQL),
}
