"""Synthetic columns drawn from a repeatable uniform draw per row.

Every function takes uniform columns in [0, 1), such as
:func:`rillcount.functions.hashing.uniform` of a key, so draws depend on the row
and not on the partition it happens to be in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillcount.functions.hashing import hash31, uniform
from rillcount.session import fits_broadcast

# Exponent and normalising constant of the five named skews, over a
# million ranks; the size of the id domain minus one that scrambled ids fall in.
SKEW_LEVELS = {
    "very_low": (0.5, 1998.54),
    "low": (1.0, 14.3927),
    "medium": (1.5, 2.61038),
    "high": (2.0, 1.64493),
    "very_high": (2.5, 1.34149),
}
SKEW_RANKS = 1000000
ID_MASK = 1048575
ALT_STABLE_POWER = -50.0

SCAN_BLOCK = 4096


def keys(spark: SparkSession, n: int) -> DataFrame:
    """``(pos)``: ``n`` stream positions."""
    return spark.range(n).select(F.col("id").alias("pos"))


def rank_cdf(spark: SparkSession, first: int, last: int, exponents: Sequence[float],
             norm: float | None = None) -> DataFrame:
    """``(z, k, lo, hi)``: rank k of skew z holds the share between ``lo`` and ``hi``.

    Sums run inside blocks of ranks and then over blocks, so no task scans all
    ranks. ``norm`` replaces the true sum as the divisor.
    """
    ranks = spark.range(first, last + 1).select(
        F.col("id").alias("k"), F.floor(F.col("id") / SCAN_BLOCK).alias("block"),
        F.explode(F.array(*[F.lit(float(z)) for z in exponents])).alias("z"),
    ).withColumn("p", F.pow(F.col("k").cast("double"), -F.col("z")))
    inside = Window.partitionBy("z", "block").orderBy("k")
    over_blocks = Window.partitionBy("z").orderBy("block")
    whole_skew = Window.partitionBy("z")
    blocks = ranks.groupBy("z", "block").agg(F.sum("p").alias("s"))
    bases = blocks.select(
        "z", "block",
        F.coalesce(F.sum("s").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0.0)).alias("base"),
        F.sum("s").over(over_blocks.rowsBetween(Window.unboundedPreceding, 0)).alias("next"),
        (F.lit(float(norm)) if norm else F.sum("s").over(whole_skew)).alias("whole"))
    summed = ranks.select(
        "z", "k", "block",
        F.sum("p").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.lead("k").over(inside).isNull().alias("ends"),
    ).withColumn("before", F.lag("run").over(inside)).join(bases, ["z", "block"])
    # Neighbours share their border to the last bit, so every draw meets one rank;
    # the last rank takes what is left.
    lo = F.col("base") + F.coalesce("before", F.lit(0.0))
    hi = F.when(F.col("ends"), F.col("next")).otherwise(F.col("base") + F.col("run"))
    return summed.select(
        "z", "k", (lo / F.col("whole")).alias("lo"),
        F.when(F.col("k") == last, F.lit(2.0)).otherwise(hi / F.col("whole")).alias("hi"))


def draw_ranks(draws: DataFrame, u: Column, first: int, last: int, exponents: Sequence[float],
               name: str = "rank", norm: float | None = None) -> DataFrame:
    """Per skew ``z``, the first rank whose cumulative share reaches ``u``.

    Gives every row of ``draws`` once per exponent, with ``z`` and the rank. Shares
    and draws meet on equal cells of [0, 1], one cell per rank on average, so this
    is an ordinary equi-join: broadcast while the ranks fit, shuffled on evenly used
    cells beyond that.
    """
    spark = draws.sparkSession
    cells = last - first + 1
    cdf = rank_cdf(spark, first, last, exponents, norm)

    def cell(x: Column) -> Column:
        return F.least(F.floor(x * F.lit(float(cells))), F.lit(cells)).cast("long")

    opened = cdf.select("z", "k", "lo", "hi", F.explode(
        F.sequence(F.greatest(cell(F.col("lo")) - 1, F.lit(0).cast("long")),
                   F.least(cell(F.col("hi")) + 1, F.lit(cells).cast("long")))).alias("_cell"))
    if fits_broadcast(spark, 5 * cells * len(exponents), 56):
        opened = F.broadcast(opened)
    probed = draws.withColumn("_u", u).withColumn("_cell", cell(F.col("_u")))
    met = probed.join(opened, "_cell").where(
        (F.col("_u") <= F.col("hi"))
        & ((F.col("_u") > F.col("lo")) | ((F.col("k") == first) & (F.col("_u") >= 0))))
    return met.withColumn(name, F.col("k")).drop("_u", "_cell", "k", "lo", "hi")


def zipf_streams(draws: DataFrame, u: Column, lo: int, hi: int, exponents: Sequence[float],
                 name: str = "item") -> DataFrame:
    """Zipf draws of several skews ``z`` from ``lo + 1`` to ``hi - 1``, in one job.

    ``P(lo + k)`` is proportional to ``k**-z``. A draw of exactly 0 falls on ``lo``
    itself, which otherwise has no share.
    """
    drawn = draw_ranks(
        draws.withColumn("_draw", u), F.col("_draw"), 1, hi - lo - 1, exponents, "_k")
    return drawn.withColumn(
        name, F.when(F.col("_draw") == 0.0, F.lit(lo).cast("long")).otherwise(F.col("_k") + lo)
    ).drop("_k", "_draw")


def zipf_stream(draws: DataFrame, u: Column, lo: int, hi: int, s: float,
                name: str = "item") -> DataFrame:
    """Zipf draws of one skew."""
    return zipf_streams(draws, u, lo, hi, [s], name).drop("z")


def power_sums(ranks: DataFrame, theta: float, *keys: str, rank: str = "id") -> DataFrame:
    """``(*keys, zeta)``: sum of ``rank**-theta`` over the rows of each key."""
    return ranks.groupBy(*keys).agg(F.sum(F.pow(F.lit(1.0) / F.col(rank), F.lit(float(theta)))).alias("zeta"))


def zeta(spark: SparkSession, n: int, theta: float) -> DataFrame:
    """One row ``(zeta)``: sum of ``i**-theta`` for i up to n."""
    return power_sums(spark.range(1, n + 1), theta)


def zipf_fast(u: Column, n: int | Column, theta: float, zetan: Column) -> Column:
    """Closed-form approximate Zipf draw from 1 to n; ``theta`` must not be 1."""
    if theta == 1.0:
        raise ValueError("theta = 1 has no closed form here")
    n = (n if isinstance(n, Column) else F.lit(n)).cast("double")
    alpha = 1.0 / (1.0 - theta)
    zeta2 = 1.0 + 0.5 ** theta
    eta = (F.lit(1.0) - F.pow(F.lit(2.0) / n, F.lit(1.0 - theta))) / (F.lit(1.0) - F.lit(zeta2) / zetan)
    uz = u * zetan
    tail = F.lit(1) + F.floor(n * F.pow(eta * u - eta + F.lit(1.0), F.lit(alpha)))
    return (F.when(uz < 1.0, F.lit(1)).when(uz < 1.0 + 0.5 ** theta, F.lit(2))
            .otherwise(tail).cast("long"))


def scramble_ids(rank: Column, a: int, b: int, mask: int = ID_MASK) -> Column:
    """Spread ranks over the id domain."""
    return hash31(a, b, rank).bitwiseAND(F.lit(mask).cast("long"))


def uniform_int(u: Column, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(F.lit(high - low) * u)).cast("long")


def uniform_double(u: Column, low: float, high: float) -> Column:
    return F.lit(float(high - low)) * u + F.lit(float(low))


def normal(u1: Column, u2: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    """Normal draw from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1))
    return F.lit(float(mean)) + F.lit(float(std)) * radius * F.cos(F.lit(2.0 * math.pi) * u2)


def cauchy(u: Column) -> Column:
    return F.tan(F.lit(math.pi) * (u - F.lit(0.5)))


def stable(u1: Column, u2: Column, alpha: float) -> Column:
    """Symmetric alpha-stable draw; normal, Cauchy and near-zero alpha have their own forms."""
    if alpha == 2.0:
        return normal(u1, u2)
    if alpha == 1.0:
        return cauchy(u1)
    if alpha < 0.01:
        size = F.pow(F.lit(1.0) - u1, F.lit(ALT_STABLE_POWER))
        return F.when(u2 < 0.5, -size).otherwise(size)
    theta = F.lit(math.pi) * (u1 - F.lit(0.5))
    w = -F.ln(F.lit(1.0) - u2)
    left = F.sin(F.lit(alpha) * theta) / F.pow(F.cos(theta), F.lit(1.0 / alpha))
    right = F.pow(F.cos(theta * F.lit(1.0 - alpha)) / w, F.lit((1.0 - alpha) / alpha))
    return left * right


def skewed(draws: DataFrame, u: Column, level: str, low: float = 0.0, high: float = 1.0,
           name: str = "skewed", ranks: int = SKEW_RANKS) -> DataFrame:
    """Add a Zipf draw of a named skew, scaled from rank to ``[low, high]``."""
    exponent, norm = SKEW_LEVELS[level]
    drawn = draw_ranks(
        draws, u, 1, ranks, [exponent], "_k", norm if ranks == SKEW_RANKS else None).drop("z")
    share = (F.col("_k") - F.lit(1)) / F.lit(float(ranks - 1))
    return drawn.withColumn(name, F.lit(float(high - low)) * share + F.lit(float(low))).drop("_k")


def bernoulli(u: Column, p: float) -> Column:
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must lie between 0 and 1")
    return u < F.lit(float(p))


def coin(u: Column) -> Column:
    return bernoulli(u, 0.5)


def zipf_updates(draws: DataFrame, key: str, seed: int, s: float, a: int, b: int,
                 mask: int = ID_MASK) -> DataFrame:
    """``draws`` with ``item``: scrambled Zipf ids over the whole id domain."""
    drawn = zipf_stream(draws, uniform(F.col(key), seed), 0, mask, s, "_rank")
    return drawn.withColumn("item", scramble_ids(F.col("_rank"), a, b, mask)).drop("_rank")
