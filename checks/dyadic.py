"""Hierarchies of sketches: heavy hitters, range sums, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    PARTS, PART_TREE, PHI_WORDS, WORD_SIGNED_TREE, WORD_TREE, WORDS, cells, found, h31, thr,
    values, with_, words,
)
from rillcount.functions import hashing
from rillcount.operators import exact
from rillcount.operators.dyadic import DyadicCountMin, DyadicCountSketch
from rillcount.sources import tables


def word_tree(spark, d):
    """One pass over the documents; descents read the stored cells."""
    return DyadicCountMin.build(tables.word_totals(spark, d), WORD_TREE, per_item_first=False)


def part_tree(spark, d):
    return DyadicCountMin.build(tables.part_quantities(spark, d), PART_TREE)


def signed_tree(spark, d):
    return DyadicCountSketch.build(
        tables.word_totals(spark, d), WORD_SIGNED_TREE, per_item_first=False)


def tree_threshold(tree):
    return hashing.threshold(PHI_WORDS, tree.total().scalar())


def build(spark, d):
    return part_tree(spark, d).cells().select("level", F.col("row").alias("r"), "bucket", "c")


def count(spark, d):
    tree = part_tree(spark, d)
    prefixes = tables.read_table(spark, d, "part").select(
        F.shiftright("p_partkey", 8).alias("prefix")).distinct()
    return tree.count(prefixes, 1).select("prefix", "est")


def heavy(spark, d):
    tree = word_tree(spark, d).store()
    return tree.heavy_hitters(tree_threshold(tree))


def heavy_judged(spark, d):
    """Every exact heavy hitter is found, and no estimate is below the truth."""
    w = words(spark, d)
    tree = word_tree(spark, d).store()
    found = tree.heavy_hitters(tree_threshold(tree))
    return exact.exact_heavy_hitters(w, PHI_WORDS).join(found, "item", "left").select("item", "total", F.coalesce(F.col("est") >= F.col("total"), F.lit(False)).alias("ok"))


def repeated(rows):
    """Every third row twice, and one row that asks for nothing."""
    first, *others = rows.columns
    nothing = rows.limit(1).select(
        F.lit(-1).cast(rows.schema[first].dataType).alias(first),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others])
    return rows.union(rows.where(F.col(first) % 3 == 0)).union(nothing)


def repeated_sql(sql, key, value):
    """The answers ``(key, value)`` to such rows."""
    return f"""WITH found AS MATERIALIZED ({sql})
      SELECT {key}, {value} FROM found UNION ALL SELECT {key}, {value} FROM found WHERE {key} % 3 = 0
      UNION ALL SELECT -1, NULL"""


def part_ranges(spark, d):
    return repeated(tables.read_table(spark, d, "part").groupBy(
        F.floor(F.col("p_partkey") / 97).alias("range_id")
    ).agg(F.min("p_partkey").alias("start"), (F.max("p_partkey") + 41).alias("end")))


def range_sums(spark, d):
    return part_tree(spark, d).store().range_sums(part_ranges(spark, d))


def fractions(spark, d):
    return tables.read_table(spark, d, "part").select(
        F.col("p_size").alias("target_id"), (F.col("p_size") / F.lit(50.0)).alias("frac")).distinct()


def targets(spark, d, tree):
    n = tree.total().scalar()
    return fractions(spark, d).select(
        "target_id", F.floor(n * F.col("frac")).cast("long").alias("target"))


def find_range(spark, d):
    tree = part_tree(spark, d).store()
    return tree.find_range(repeated(targets(spark, d, tree)))


def find_range_right(spark, d):
    tree = part_tree(spark, d).store()
    return tree.find_range_from_right(repeated(targets(spark, d, tree)))


def quantiles(spark, d):
    return part_tree(spark, d).store().quantiles(repeated(fractions(spark, d)))


def prefix_counts(spark, d):
    return part_tree(spark, d).prefix_counts(2).unionByName(
        part_tree(spark, d).prefix_counts(1)).select("prefix", "c")


def moment(spark, d):
    return part_tree(spark, d).second_moment().select(F.col("est").cast("long").alias("est"))


def size(spark, d):
    return part_tree(spark, d).size()


def signed_build(spark, d):
    return signed_tree(spark, d).cells().select("level", F.col("row").alias("r"), "bucket", "c")


def signed_count(spark, d):
    tree = signed_tree(spark, d)
    prefixes = tree.totals.select(F.shiftright("item", 16).alias("prefix")).distinct()
    return tree.count(prefixes, 2)


def signed_heavy(spark, d):
    tree = signed_tree(spark, d).store()
    return tree.heavy_hitters(tree_threshold(tree))


def signed_point(spark, d):
    return signed_tree(spark, d).point(words(spark, d).select("item"))


def signed_moment(spark, d):
    return signed_tree(spark, d).second_moment().select(F.col("est").cast("long").alias("est"))


def signed_size(spark, d):
    return signed_tree(spark, d).size()


# --- SQL -----------------------------------------------------------------

def level_table(h, table, level):
    """WITH entries for one level: ``s{l}(r, bucket, c)`` or exact ``x{l}(prefix, c)``."""
    if level >= h.exact_from:
        return f"""x{level} AS (SELECT item >> {h.gran * level} AS prefix, sum(total) AS c
          FROM {table} GROUP BY 1)"""
    return cells(f"s{level}", table, h.shape(level), f"(t.item >> {h.gran * level})")


def estimate(h, level, source, name):
    """WITH entries adding ``est`` to a table with ``prefix`` at one level."""
    if level >= h.exact_from:
        return [f"""{name} AS (SELECT t.*, coalesce(x.c, 0) AS est FROM {source} t
          LEFT JOIN x{level} x ON x.prefix = t.prefix)"""]
    return [
        found(f"{name}_f", source, f"s{level}", h.shape(level), "t.prefix"),
        f"{name} AS (SELECT * EXCLUDE (r, c), min(c) AS est FROM {name}_f GROUP BY ALL)"]


def opened(h, source, name, kept=""):
    return f"""{name} AS (SELECT {kept} (prefix << {h.gran}) + k AS prefix
      FROM {source}, range({1 << h.gran}) t(k))"""


def heavy_sql(h, table, stream, phi):
    entries = [stream] + [level_table(h, table, l) for l in range(h.levels)]
    entries.append(f"f{h.levels} AS (SELECT 0::BIGINT AS prefix)")
    for l in reversed(range(h.levels)):
        entries.append(opened(h, f"f{l + 1}", f"o{l}"))
        entries += estimate(h, l, f"o{l}", f"e{l}")
        entries.append(f"f{l} AS (SELECT prefix, est FROM e{l} WHERE est >= {thr(phi, table)})")
    return with_(*entries) + "SELECT prefix AS item, est::BIGINT AS est FROM f0"


def descent_sql(h, table, targets_sql, from_right, tag=""):
    """WITH entries that end in ``g{tag}0(target_id, target, rem, prefix)``."""
    entries = [f"""g{tag}{h.levels} AS (
      SELECT target_id, target, target AS rem, 0::BIGINT AS prefix FROM ({targets_sql}))"""]
    order = "DESC" if from_right else "ASC"
    hit = "cum >= rem" if from_right else "cum > rem"
    for l in reversed(range(h.levels)):
        entries.append(opened(h, f"g{tag}{l + 1}", f"o{tag}{l}", "target_id, target, rem,"))
        entries += estimate(h, l, f"o{tag}{l}", f"e{tag}{l}")
        entries.append(f"""w{tag}{l} AS (SELECT *,
          sum(est) OVER (PARTITION BY target_id ORDER BY prefix {order}) AS cum,
          row_number() OVER (PARTITION BY target_id ORDER BY prefix {order}) AS i FROM e{tag}{l})""")
        entries.append(f"""g{tag}{l} AS (SELECT target_id, target, rem - cum + est AS rem, prefix
          FROM w{tag}{l} WHERE {hit} OR i = {1 << h.gran}
          QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY i) = 1)""")
    return entries


def levels_sql(h, table):
    return [level_table(h, table, l) for l in range(h.levels)]


def target_sql(frac):
    return f"""SELECT DISTINCT p_size AS target_id,
      floor((SELECT sum(total) FROM parts) * {frac})::BIGINT AS target FROM part"""


FRAC = "(p_size / 50.0::DOUBLE)"


def found_sql(from_right):
    h = PART_TREE
    return with_(PARTS, *levels_sql(h, "parts"),
                 *descent_sql(h, "parts", target_sql(FRAC), from_right)) + f"""
      SELECT target_id, CASE WHEN target > (SELECT sum(total) FROM parts) THEN {h.top}
        ELSE prefix END AS item FROM g0"""


def quantile_sql():
    h = PART_TREE
    return with_(
        PARTS, *levels_sql(h, "parts"),
        *descent_sql(h, "parts", target_sql(FRAC), False, "l"),
        *descent_sql(h, "parts", target_sql(f"(1.0::DOUBLE - {FRAC})"), True, "r")) + """
      SELECT target_id, (a.prefix + b.prefix) // 2 AS item FROM gl0 a JOIN gr0 b USING (target_id)"""


def range_sql():
    """Canonical cover found by testing every block of every level against its range."""
    h = PART_TREE
    entries = [PARTS, *levels_sql(h, "parts"), """ranges AS (
      SELECT p_partkey // 97 AS range_id, min(p_partkey) AS a, max(p_partkey) + 42 AS b
      FROM part GROUP BY 1)"""]
    unions = []
    for l in range(h.levels):
        lo, hi = 1 << (h.gran * l), 1 << (h.gran * (l + 1))
        outside = "true" if l == h.levels - 1 else (
            f"NOT ((p // {1 << h.gran}) * {hi} >= a AND ((p // {1 << h.gran}) + 1) * {hi} <= b)")
        entries.append(f"""b{l} AS (SELECT range_id, p AS prefix FROM (
          SELECT range_id, a, b, unnest(range(a // {lo}, b // {lo} + 1)) AS p FROM ranges)
          WHERE p * {lo} >= a AND (p + 1) * {lo} <= b AND {outside})""")
        entries += estimate(h, l, f"b{l}", f"q{l}")
        unions.append(f"SELECT range_id, est FROM q{l}")
    return with_(*entries) + f"""SELECT range_id, sum(est)::BIGINT AS est
      FROM ({' UNION ALL '.join(unions)}) GROUP BY 1"""


def build_sql():
    h = PART_TREE
    parts_ = []
    for l in range(h.levels):
        parts_.append(f"SELECT {l} AS level, -1 AS r, prefix AS bucket, c::BIGINT AS c FROM x{l}"
                      if l >= h.exact_from else
                      f"SELECT {l} AS level, r, bucket, c::BIGINT AS c FROM s{l}")
    parts_.append(f"SELECT {h.levels} AS level, -1 AS r, 0::BIGINT AS bucket, "
                  "sum(total)::BIGINT AS c FROM parts")
    return with_(PARTS, *levels_sql(h, "parts")) + " UNION ALL ".join(parts_)


CS = DyadicCountSketch(WORD_SIGNED_TREE, None)
CS_COEFFS = values([(r, *c) for r, c in enumerate(CS.coeffs)])


def sign_sql(x):
    return f"(CASE WHEN {h31('k.c', 'k.d', x)} & 1 = 1 THEN 1 ELSE -1 END)"


def signed_cells(level, tree=WORD_SIGNED_TREE, table="words"):
    x = f"(t.item >> {tree.gran * level})"
    rows = values([(r, *c) for r, c in enumerate(hashing.coefficients(tree.seed, tree.depth, 4))])
    return f"""s{level} AS (SELECT k.r, {h31('k.a', 'k.b', x)} % {tree.width} AS bucket,
      sum({sign_sql(x)} * t.total) AS c FROM {table} t, {rows} k(r, a, b, c, d) GROUP BY 1, 2)"""


def signed_estimate(level, source, name):
    pick = WORD_SIGNED_TREE.depth // 2 + 1
    return f"""{name} AS (SELECT prefix, (list_sort(list(v)))[{pick}] AS est FROM (
      SELECT t.prefix, {sign_sql('t.prefix')} * coalesce(s.c, 0) AS v
      FROM {source} t CROSS JOIN {CS_COEFFS} k(r, a, b, c, d) LEFT JOIN s{level} s
        ON s.r = k.r AND s.bucket = {h31('k.a', 'k.b', 't.prefix')} % {WORD_SIGNED_TREE.width})
      GROUP BY prefix)"""


def signed_heavy_sql():
    h = WORD_SIGNED_TREE
    entries = [WORDS, *[signed_cells(l) for l in range(h.levels)],
               f"f{h.levels} AS (SELECT 0::BIGINT AS prefix)"]
    for l in reversed(range(h.levels)):
        entries.append(opened(h, f"f{l + 1}", f"o{l}"))
        entries.append(signed_estimate(l, f"o{l}", f"e{l}"))
        entries.append(f"f{l} AS (SELECT prefix, est FROM e{l} WHERE est >= {thr(PHI_WORDS, 'words')})")
    return with_(*entries) + "SELECT prefix AS item, est::BIGINT AS est FROM f0"


def _cm_bytes(h):
    low = h.exact_from
    counts = low * h.width * h.depth * 4 + sum(
        (1 << (h.gran * (h.levels - i))) * 4 for i in range(low, h.levels))
    return 56 + 16 * h.levels + counts + low * h.depth * 8


CHECKS = {
    "h1_cmh_build": (build, build_sql()),
    "h2_cmh_count": (count, with_(
        PARTS, *levels_sql(PART_TREE, "parts"),
        "p AS (SELECT DISTINCT p_partkey >> 8 AS prefix FROM part)",
        *estimate(PART_TREE, 1, "p", "e")) + "SELECT prefix, est::BIGINT AS est FROM e"),
    "h3_cmh_heavy_hitters": (heavy, heavy_sql(WORD_TREE, "words", WORDS, PHI_WORDS)),
    "h3_cmh_recall": (heavy_judged, with_(WORDS) + f"""
        SELECT item, total, true AS ok FROM words WHERE total >= {thr(PHI_WORDS, 'words')}"""),
    "h4_cmh_range_sums": (range_sums, repeated_sql(range_sql(), "range_id", "est")),
    "h5_cmh_find_range": (find_range, repeated_sql(found_sql(False), "target_id", "item")),
    "h6_cmh_find_range_from_right": (find_range_right, repeated_sql(found_sql(True), "target_id", "item")),
    "h7_cmh_quantiles": (quantiles, repeated_sql(quantile_sql(), "target_id", "item")),
    "h8_prefix_counts": (prefix_counts, with_(PARTS) + """
        SELECT item >> 16 AS prefix, sum(total)::BIGINT AS c FROM parts GROUP BY 1
        UNION ALL SELECT item >> 8 AS prefix, sum(total)::BIGINT AS c FROM parts GROUP BY 1"""),
    "h9_cmh_second_moment": (moment, with_(PARTS, level_table(PART_TREE, "parts", 0)) + """
        SELECT min(m)::BIGINT AS est FROM (SELECT r, sum(c * c) AS m FROM s0 GROUP BY 1)"""),
    "h10_cmh_size": (size, with_(PARTS, *levels_sql(PART_TREE, "parts")) + f"""
        SELECT {_cm_bytes(PART_TREE)}::BIGINT AS bytes, ({' + '.join(
            f"(SELECT count(*) FROM {'x' if l >= PART_TREE.exact_from else 's'}{l})"
            for l in range(PART_TREE.levels))})::BIGINT AS stored_cells"""),
    "c1_cs_build": (signed_build, with_(WORDS, *[signed_cells(l) for l in range(4)]) + " UNION ALL ".join(
        f"SELECT {l} AS level, r, bucket, c::BIGINT AS c FROM s{l}" for l in range(4)) + """
        UNION ALL SELECT 4 AS level, -1 AS r, 0::BIGINT AS bucket, sum(total)::BIGINT AS c FROM words"""),
    "c2_cs_count": (signed_count, with_(
        WORDS, signed_cells(2), "p AS (SELECT DISTINCT item >> 16 AS prefix FROM words)",
        signed_estimate(2, "p", "e")) + "SELECT prefix, est::BIGINT AS est FROM e"),
    "c3_cs_heavy_hitters": (signed_heavy, signed_heavy_sql()),
    "c4_cs_point": (signed_point, with_(
        WORDS, signed_cells(0), "p AS (SELECT item AS prefix FROM words)",
        signed_estimate(0, "p", "e")) + "SELECT prefix AS item, est::BIGINT AS est FROM e"),
    "c5_cs_second_moment": (signed_moment, with_(WORDS, signed_cells(0)) + f"""
        SELECT (list_sort(list(m)))[{WORD_SIGNED_TREE.depth // 2 + 1}]::BIGINT AS est
        FROM (SELECT r, sum(c * c) AS m FROM s0 GROUP BY 1)"""),
    "c6_cs_size": (signed_size, with_(WORDS, *[signed_cells(l) for l in range(4)]) + f"""
        SELECT {33 * 8 + 4 * 2000 * 10 * 4 + 10 * 16 + 64}::BIGINT AS bytes,
          ({' + '.join(f'(SELECT count(*) FROM s{l})' for l in range(4))})::BIGINT AS stored_cells"""),
}
