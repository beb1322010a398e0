"""Pairwise hashing as column expressions, and the parameters that go with it.

Everything here is plain arithmetic on LONG columns, so it stays inside
whole-stage code generation and can be repeated in any SQL engine.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hash folds once at bit 31 and keeps 31 bits.
FOLD_BITS = 31
FOLD_MASK = 2147483647


def _as_column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("long")


def hash31(a: int | Column, b: int | Column, x: int | Column) -> Column:
    """``a*x + b`` folded once to 31 bits.

    The single fold is not a full reduction modulo ``2**31 - 1``; callers reduce
    to their own width afterwards. With ``0 <= a, b < 2**31`` and
    ``0 <= x < 2**32`` the product fits a LONG, so ANSI mode never overflows.
    """
    r = _as_column(a) * _as_column(x) + _as_column(b)
    return (F.shiftright(r, FOLD_BITS) + r).bitwiseAND(F.lit(FOLD_MASK).cast("long"))


def fourwise(a, b, c, d, x) -> Column:
    """Four-wise independent hash: three chained pairwise hashes."""
    return hash31(hash31(hash31(a, b, x), c, x), d, x)


def sign_hash(c, d, x) -> Column:
    """+1 where the hash is odd, -1 where it is even."""
    odd = hash31(c, d, x).bitwiseAND(F.lit(1).cast("long"))
    return odd * F.lit(2) - F.lit(1)


def level_prefix(x: Column, gran: int, level: int) -> Column:
    """Ancestor of ``x`` after dropping ``gran`` bits per level."""
    return F.shiftright(x, gran * level) if level else x


def threshold(phi: float, total: Column) -> Column:
    """Smallest whole weight strictly above ``phi * total``; compare with ``>=``."""
    return (F.floor(F.lit(float(phi)) * total) + F.lit(1)).cast("long")


def coefficients(seed: int, rows: int, per_row: int) -> tuple[tuple[int, ...], ...]:
    """``rows`` independent coefficient tuples, the same for the same seed.

    Multipliers (even positions) are never zero; offsets may be.
    """
    rng = random.Random(seed)
    return tuple(
        tuple(rng.randrange(1 if i % 2 == 0 else 0, FOLD_MASK) for i in range(per_row))
        for _ in range(rows)
    )


def bucket(a, b, x, width: int | Column) -> Column:
    """Bucket of ``x`` in a row of ``width`` cells.

    Spark takes every remainder as possibly null; saying that this one is not keeps
    aggregations and joins on buckets from hashing twice to test for it.
    """
    return F.coalesce(hash31(a, b, x) % _as_column(width), F.lit(0).cast("long"))


def bucket_hashes(x: Column, coeffs: Sequence[Sequence[int]], width: int) -> list[Column]:
    """One bucket number per sketch row."""
    return [bucket(c[0], c[1], x, width) for c in coeffs]


def coefficient_rows(coeffs: Sequence[Sequence[int]]) -> Column:
    """Generator of one struct ``h`` per sketch row: its number and coefficients.

    The array is a constant, so the generated code holds one hash expression for
    all rows of a sketch and stays small enough for the JVM to compile.
    """
    names = "abcd"
    rows = ", ".join(
        f"named_struct('row', {r}, " + ", ".join(
            f"'{names[i]}', {v}L" for i, v in enumerate(c)) + ")"
        for r, c in enumerate(coeffs))
    return F.expr(f"explode(array({rows}))").alias("h")


def string_id(s: Column, bits: int = 32) -> Column:
    """Stable integer id of a string: the leading ``bits`` bits of its MD5.

    ``bits`` must be a multiple of four up to 60. 32 matches the id domain of the
    hierarchical sketches.
    """
    if bits % 4 or not 0 < bits <= 60:
        raise ValueError("bits must be a multiple of 4 between 4 and 60")
    return F.conv(F.substring(F.md5(s), 1, bits // 4), 16, 10).cast("long")


def uniform(key: Column, seed: int | str) -> Column:
    """Repeatable uniform draw in [0, 1) for each key: 52 bits of an MD5.

    Unlike ``rand(seed)`` the value depends on the row's key only, never on how
    the data happens to be partitioned, so a lost task redraws the same values.
    """
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return string_id(text, 52) / F.lit(float(1 << 52))
