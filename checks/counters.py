"""Counter summaries and lossy counting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import (
    PARTS, PHI_USERS, PHI_WORDS, USERS, WORDS, h31, parts, thr, users, with_, words,
)
from rillcount.operators import counters, exact, lossy
from rillcount.operators.counters import FAN, SHARD_A, SHARD_B, Budget
from rillcount.sources import tables

EPS, GAMMA, SHARDS = 1 / 50, 1.0, 3
DIM_PHI, DIM_EPOCHS = 1 / 40, 7
SPACE_PHI = 1 / 60
WORD_EPS = 2.0 ** -10
WORD_DOCS, EVENT_BLOCK = 64, 500  # documents and events of a block
SIZED = {"im_sum": Budget.im_sum(PHI_USERS), "dim_sum": Budget.dim_sum(PHI_USERS),
         "space_saving": Budget.space_saving(PHI_USERS), "unit_space_saving": Budget.unit_space_saving(PHI_USERS)}


def word_uses(spark, d, together=False):
    return tables.word_uses(spark, d, WORD_DOCS, together)


def word_summary(spark, d):
    """Summary of the stream of words, built block by block from its updates."""
    return counters.summarise_blocks(word_uses(spark, d), Budget.im_sum(WORD_EPS))


def event_summary(spark, d, phi=SPACE_PHI):
    return counters.summarise_blocks(user_blocks(spark, d), Budget.space_saving(phi), tracked=True)


def unit_summary(spark, d):
    return counters.summarise_blocks(user_blocks(spark, d), Budget.unit_space_saving(SPACE_PHI), tracked=True)


def user_blocks(spark, d):
    return tables.user_events(spark, d).withColumn("block", F.expr(f"pos div {EVENT_BLOCK}"))


def user_summary(spark, d):
    return counters.summarise_blocks(user_blocks(spark, d), Budget.im_sum(EPS, GAMMA), shards=SHARDS)


def im_build(spark, d):
    return word_summary(spark, d).state()


def im_sharded(spark, d):
    return user_summary(spark, d).state()


def verdict(summary, totals):
    """Does the bracket of every item hold its exact total, and is q within its bound?"""
    weight = exact.stream_total(totals).scalar()
    judged = summary.point(totals)
    return judged.select(
        "item", F.col("total").alias("exact"),
        ((F.col("lower") <= F.col("total")) & (F.col("total") <= F.col("est"))
         & (F.col("q") * summary.budget.counters <= weight)).alias("ok"))


def im_in_place(spark, d):
    """Summary built inside the tasks that read the table, without shuffling items."""
    updates = tables.part_quantities(spark, d)
    return verdict(counters.summarise_in_place(updates, Budget.im_sum(1 / 300, 1.0)), parts(spark, d))


def im_collapsed(spark, d):
    """Shards put together: estimates and brackets beside the exact totals."""
    return user_summary(spark, d).collapse().point(users(spark, d)).select(
        "item", F.col("total").alias("exact"), "lower", "est")


def dim_build(spark, d):
    """Epochs that do not divide the events: what is left over belongs to the last one."""
    epochs = exact.run_slices(tables.user_events(spark, d), DIM_EPOCHS)
    return counters.dim_sum([exact.item_totals(e) for e in epochs], DIM_PHI, 0.5).state()


def im_point(spark, d):
    queried = word_uses(spark, d).select("item").distinct()
    return word_summary(spark, d).point(queried).select("item", "est")


def im_accuracy(spark, d):
    """How many words have a wrong estimate, how many a bracket without the truth, and the error."""
    summary = word_summary(spark, d)
    judged = summary.point(exact.item_totals(word_uses(spark, d)))
    within = (F.col("lower") <= F.col("total")) & (F.col("total") <= F.col("est"))
    return judged.agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("est") != F.col("total"), 1)).alias("wrong"),
        F.count(F.when(~within, 1)).alias("outside"), F.max("q").alias("q"),
        (F.max("q") * summary.budget.counters <= F.sum("total")).alias("bounded"))


def im_error(spark, d):
    u = users(spark, d)
    return user_summary(spark, d).point(u.select("item")).select("item", "q")


def im_heavy(spark, d):
    summary = word_summary(spark, d)
    n = summary.errors.select("weight").scalar()
    return summary.heavy_hitters(exact.threshold(PHI_WORDS, n)).select("item", "est")


def space_saving(spark, d):
    updates = tables.part_quantities(spark, d)
    return verdict(
        counters.summarise_in_place(updates, Budget.space_saving(1 / 400)), parts(spark, d))


def space_saving_native(spark, d):
    return event_summary(spark, d).counters()


def space_point(spark, d):
    return bracketed(event_summary(spark, d), users(spark, d))


def bracketed(summary, totals):
    """Count and error of every item beside its exact total."""
    lower = F.col("count") - F.col("delta")
    return summary.count_of(totals).select(
        "item", F.col("total").alias("exact"), "count", "delta", F.col("total").between(lower, F.col("count")).alias("ok"))


def space_heavy(spark, d):
    """Every claim and every true heavy hitter: false claims and missed ones would both show."""
    u = users(spark, d)
    thr_ = exact.heavy_threshold(u, PHI_USERS)
    claimed = event_summary(spark, d, PHI_USERS).claims(thr_)
    return u.withColumn("heavy", F.col("total") >= thr_).join(claimed, "item", "left").where(
        "heavy OR count IS NOT NULL").select("item", "total", "count", "delta", "sure", "heavy")


def unit_space_saving(spark, d):
    return bracketed(unit_summary(spark, d), users(spark, d))


def unit_in_place(spark, d):
    """One scan without a shuffle of items: brackets of each item's own error, and how wide they are at most."""
    summary = counters.summarise_in_place(
        tables.user_events(spark, d), Budget.unit_space_saving(SPACE_PHI), tracked=True)
    judged = bracketed(summary, users(spark, d))
    n = F.sum("exact")
    return judged.agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(~F.col("ok"), 1)).alias("outside"),
        (F.max("delta") * summary.budget.counters <= n).alias("bounded"))


def misra_gries(spark, d):
    queried = word_uses(spark, d).select("item").distinct()
    return word_summary(spark, d).point(queried).select("item", "lower")


def top(spark, d):
    return exact.top_k(word_summary(spark, d).estimates().select("item", "est"), 25)


def sizes(spark, d):
    """Dense bytes of every counter summary beside the counters it really keeps."""
    phi, updates, rows = PHI_USERS, user_blocks(spark, d), []
    kept = {m: counters.summarise_blocks(updates, b).items for m, b in SIZED.items()}
    for method, delta in (("lossy", False), ("lossy_delta", True)):
        kept[method] = lossy.lossy_count(tables.user_events(spark, d), phi, delta)
    for method, held in kept.items():
        size = (lossy.dense_size(phi, method == "lossy_delta") if method.startswith("lossy")
                else counters.dense_size(method, phi))
        rows.append(held.agg(F.count(F.lit(1)).alias("kept")).select(
            F.lit(method).alias("method"), F.lit(size).cast("long").alias("bytes"), "kept"))
    items = users(spark, d).agg(F.count(F.lit(1)).alias("items")).scalar()
    return reduce(DataFrame.unionByName, rows).withColumn("items", items)


def lossy_build(spark, d):
    return lossy.lossy_count(tables.user_events(spark, d), PHI_USERS).select("item", "est")


def lossy_full_epochs(spark, d):
    """The original's cut as a feature: only full epochs count."""
    return lossy.lossy_count(
        tables.user_events(spark, d), PHI_USERS, with_delta=True, include_tail=False).select("item", "est", "lower")


def lossy_signed(spark, d):
    return lossy.lossy_count(tables.signed_events(spark, d), PHI_USERS).select("item", "est")


def lossy_point(spark, d):
    counts = lossy.lossy_count(tables.user_events(spark, d), PHI_USERS)
    return lossy.lossy_point(counts, users(spark, d).select("item"))


def lossy_heavy(spark, d):
    counts = lossy.lossy_count(tables.user_events(spark, d), PHI_USERS)
    return lossy.lossy_heavy_hitters(
        counts, exact.heavy_threshold(users(spark, d), PHI_USERS)).select("item", "est")


def delta_build(spark, d):
    return lossy.lossy_count(
        tables.user_events(spark, d), PHI_USERS, with_delta=True).select("item", "est", "lower")


def delta_heavy(spark, d):
    counts = lossy.lossy_count(tables.user_events(spark, d), PHI_USERS, with_delta=True)
    return lossy.lossy_heavy_hitters(
        counts, exact.heavy_threshold(users(spark, d), PHI_USERS)).select("item", "est", "lower")


# --- SQL -----------------------------------------------------------------

def shard_sql(x, shards):
    return "0" if shards == 1 else f"({h31(SHARD_A, SHARD_B, x)} % {shards})::INT"


#: The streams of updates, and how often blocks are merged at most (more merges change nothing).
WORD_USES = f"""uses AS (SELECT doc_id // {WORD_DOCS} AS block, 1 AS weight,
  unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS item FROM documents)"""
EVENT_USES = f"uses AS (SELECT event_id // {EVENT_BLOCK} AS block, 1 AS weight, user_id AS item FROM events)"
MERGES = 4


def blocks_sql(budget: Budget, shards: int = 1):
    """WITH entries ``items(shard, item, residual, seen, q)`` and ``error(q, n)`` from ``uses(block, weight, item)``.

    With shards, ``items`` carry the error of their shard and ``errors(shard, q)`` lists them.
    """
    up = f"shard // {shards * FAN} * {shards} + shard % {shards}"
    entries = [f"m0 AS (SELECT block * {shards} + {shard_sql('item', shards)} AS shard, item, sum(weight) AS x, sum(weight) AS seen FROM uses GROUP BY 1, 2)",
               "e0 AS (SELECT DISTINCT shard, 0 AS q FROM m0)"]
    for level in range(MERGES + 1):
        entries += [
            f"""cut{level} AS (SELECT shard, CASE WHEN count(*) > {budget.capacity}
              THEN coalesce(max(x) FILTER (i = {budget.counters}), 0) ELSE 0 END AS d
              FROM (SELECT shard, x, row_number() OVER (PARTITION BY shard ORDER BY x DESC) AS i FROM m{level})
              GROUP BY 1)""",
            f"st{level} AS (SELECT shard, item, x - d AS x, seen FROM m{level} JOIN cut{level} USING (shard) WHERE x > d)",
            f"""er{level} AS (SELECT e.shard AS shard, e.q + coalesce(d, 0) AS q
              FROM e{level} e LEFT JOIN cut{level} c ON c.shard = e.shard)""",
            f"m{level + 1} AS (SELECT {up} AS shard, item, sum(x) AS x, sum(seen) AS seen FROM st{level} GROUP BY 1, 2)",
            f"e{level + 1} AS (SELECT {up} AS shard, sum(q) AS q FROM er{level} GROUP BY 1)"]
    return [*entries,
            f"""error AS (SELECT coalesce(sum(q), 0)::BIGINT AS q,
              (SELECT coalesce(sum(weight), 0)::BIGINT FROM uses) AS n FROM er{MERGES})""",
            f"errors AS (SELECT shard::INT AS shard, q::BIGINT AS q FROM er{MERGES})",
            f"""items AS (SELECT s.shard::INT AS shard, item, x::BIGINT AS residual, seen::BIGINT AS seen, e.q AS q
              FROM st{MERGES} s JOIN errors e ON e.shard = s.shard)"""]


def chain_sql(budget: Budget):
    """The state after every epoch, one after the other; the last has the rows that are left over."""
    entries = [f"""per AS (SELECT least(event_id // size, {DIM_EPOCHS - 1}) AS e, user_id AS item, count(*) AS total
      FROM events, (SELECT greatest(count(*) // {DIM_EPOCHS}, 1) AS size FROM events) GROUP BY 1, 2)""",
               "st0 AS (SELECT 0::BIGINT AS item, 0::BIGINT AS residual WHERE false)",
               "q0 AS (SELECT 0::BIGINT AS q)"]
    for e in range(DIM_EPOCHS):
        entries += [
            f"""sum{e} AS (SELECT item, sum(x) AS x FROM (
              SELECT item, residual AS x FROM st{e}
              UNION ALL SELECT item, total FROM per WHERE e = {e}) GROUP BY 1)""",
            f"""cut{e} AS (SELECT CASE WHEN count(*) > {budget.capacity}
              THEN coalesce(max(x) FILTER (i = {budget.counters}), 0) ELSE 0 END AS d
              FROM (SELECT x, row_number() OVER (ORDER BY x DESC) AS i FROM sum{e}))""",
            f"st{e + 1} AS (SELECT item, (x - d)::BIGINT AS residual FROM sum{e}, cut{e} WHERE x > d)",
            f"q{e + 1} AS (SELECT (q + d)::BIGINT AS q FROM q{e}, cut{e})"]
    return with_(*entries) + (
        f"SELECT 0 AS shard, item, residual, q FROM st{DIM_EPOCHS}, q{DIM_EPOCHS}")


def lossy_sql(w, signed=False):
    """Epoch by epoch: the recursion as it is defined, for every item."""
    n = "sum(CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END)" if signed else "count(*)"
    return f"""WITH RECURSIVE
      size AS (SELECT count(*) // {w} AS epochs FROM events),
      per AS (SELECT user_id AS item, event_id // {w} AS e, {n} AS n FROM events GROUP BY 1, 2),
      run(item, e, c, used) AS (
        SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM events
        UNION ALL
        SELECT r.item, r.e + 1, greatest(0, r.c + coalesce(p.n, 0) - 1)::BIGINT,
          (CASE WHEN r.c + coalesce(p.n, 0) - 1 <= 0 THEN 0 ELSE r.used + coalesce(p.n, 0) END)::BIGINT
        FROM run r LEFT JOIN per p ON p.item = r.item AND p.e = r.e
        WHERE r.e < (SELECT epochs FROM size)),
      held AS (SELECT item, (c + epochs)::BIGINT AS est, used AS lower
               FROM run, size WHERE e = epochs AND c > 0)
"""


def whole_sql(w, signed=False):
    """``whole(item, est, lower)``: the recursion, and the uses after its last epoch."""
    n = "sum(CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END)" if signed else "count(*)"
    return lossy_sql(w, signed) + f"""
      , tail AS (SELECT user_id AS item, {n} AS t FROM events, size WHERE event_id // {w} >= epochs GROUP BY 1),
      whole AS (SELECT item, (coalesce(est, epochs) + coalesce(t, 0))::BIGINT AS est,
          (coalesce(lower, 0) + coalesce(t, 0))::BIGINT AS lower
        FROM (SELECT * FROM held FULL JOIN tail USING (item)), size
        WHERE coalesce(est, epochs) + coalesce(t, 0) > epochs)
"""


W, WD = lossy.window_size(PHI_USERS), lossy.window_size(PHI_USERS, True)
USER_THR = f"(SELECT floor(CAST('{PHI_USERS!r}' AS DOUBLE) * count(*))::BIGINT + 1 FROM events)"
IM_WORDS = Budget.im_sum(WORD_EPS)
EXACT_OK = "item, total AS exact, true AS ok"



def bracketed_sql(budget):
    """Counts and errors by blocks, and whether the exact totals lie between."""
    return with_(USERS, EVENT_USES, *blocks_sql(budget)) + """
        SELECT item, exact, count, delta, exact BETWEEN count - delta AND count AS ok FROM (
          SELECT u.item, total AS exact, (coalesce(residual, 0) + error.q)::BIGINT AS count,
            (coalesce(residual, 0) + error.q - coalesce(seen, 0))::BIGINT AS delta
          FROM users u LEFT JOIN items i ON i.item = u.item, error)"""


CHECKS = {
    "k1_im_sum": (im_build, with_(WORD_USES, *blocks_sql(IM_WORDS)) +
                  "SELECT shard, item, residual, q FROM items"),
    "k1_im_sum_accuracy": (im_accuracy, with_(WORD_USES, *blocks_sql(IM_WORDS)) + f"""
        SELECT count(*) AS items, count(*) FILTER (coalesce(residual, 0) + error.q <> total) AS wrong,
          0::BIGINT AS outside, max(error.q) AS q, true AS bounded
        FROM (SELECT item, count(*) AS total FROM uses GROUP BY 1) u LEFT JOIN items i ON i.item = u.item, error"""),
    "k1_im_sum_sharded": (im_sharded, with_(EVENT_USES, *blocks_sql(Budget.im_sum(EPS, GAMMA), SHARDS)) +
        "SELECT shard, item, residual, q FROM items"),
    "k1_im_sum_in_place": (im_in_place, with_(PARTS) + f"SELECT {EXACT_OK} FROM parts"),
    "k1_im_sum_collapsed": (im_collapsed, with_(
        USERS, EVENT_USES, *blocks_sql(Budget.im_sum(EPS, GAMMA), SHARDS),
        "top AS (SELECT max(q) AS q FROM errors)",
        f"""cut AS (SELECT CASE WHEN count(*) > {Budget.im_sum(EPS, GAMMA).capacity}
          THEN coalesce(max(residual) FILTER (i = {Budget.im_sum(EPS, GAMMA).counters}), 0) ELSE 0 END AS d
          FROM (SELECT residual, row_number() OVER (ORDER BY residual DESC) AS i FROM items))""") + """
        SELECT u.item, total AS exact, greatest(coalesce(residual, 0) - d, 0)::BIGINT AS lower,
          (greatest(coalesce(residual, 0) - d, 0) + top.q + d)::BIGINT AS est
        FROM users u LEFT JOIN items i ON i.item = u.item, top, cut"""),
    "k2_dim_sum_epochs": (dim_build, chain_sql(Budget.dim_sum(DIM_PHI, 0.5))),
    "k3_im_sum_point": (im_point, with_(WORD_USES, *blocks_sql(IM_WORDS)) + """
        SELECT w.item, (coalesce(i.residual, 0) + c.q)::BIGINT AS est
        FROM (SELECT DISTINCT item FROM uses) w CROSS JOIN error c LEFT JOIN items i ON i.item = w.item"""),
    "k4_im_sum_error": (im_error, with_(
        USERS, EVENT_USES, *blocks_sql(Budget.im_sum(EPS, GAMMA), SHARDS)) + f"""
        SELECT item, coalesce(q, 0)::BIGINT AS q FROM users LEFT JOIN errors ON shard = {shard_sql('item', SHARDS)}"""),
    "k5_im_sum_heavy_hitters": (im_heavy, with_(WORD_USES, *blocks_sql(IM_WORDS)) + f"""
        SELECT item, (residual + q)::BIGINT AS est FROM items
        WHERE residual + q >= (SELECT floor(CAST('{PHI_WORDS!r}' AS DOUBLE) * n)::BIGINT + 1 FROM error)"""),
    "k6_space_saving_in_place": (space_saving, with_(PARTS) + f"SELECT {EXACT_OK} FROM parts"),
    "k6_space_saving": (space_saving_native, with_(
        EVENT_USES, *blocks_sql(Budget.space_saving(SPACE_PHI))) +
        "SELECT shard, item, (residual + q)::BIGINT AS count, (residual + q - seen)::BIGINT AS delta FROM items"),
    "k7_space_saving_point": (space_point, bracketed_sql(Budget.space_saving(SPACE_PHI))),
    "k8_space_saving_heavy_hitters": (space_heavy, with_(
        USERS, EVENT_USES, *blocks_sql(Budget.space_saving(PHI_USERS))) + f"""
        SELECT u.item, total, (residual + q)::BIGINT AS count, (residual + q - seen)::BIGINT AS delta,
          seen >= {USER_THR} AS sure, total >= {USER_THR} AS heavy
        FROM users u LEFT JOIN items i ON i.item = u.item AND residual + q >= {USER_THR}
        WHERE total >= {USER_THR} OR residual IS NOT NULL"""),
    "k9_unit_space_saving": (unit_space_saving, bracketed_sql(Budget.unit_space_saving(SPACE_PHI))),
    "k9_unit_space_saving_in_place": (unit_in_place, with_(USERS) +
        "SELECT count(*) AS items, 0::BIGINT AS outside, true AS bounded FROM users"),
    "k10_misra_gries_lower": (misra_gries, with_(WORD_USES, *blocks_sql(IM_WORDS)) + """
        SELECT w.item, coalesce(i.residual, 0)::BIGINT AS lower
        FROM (SELECT DISTINCT item FROM uses) w LEFT JOIN items i ON i.item = w.item"""),
    "k11_lossy_count": (lossy_build, whole_sql(W) + "SELECT item, est FROM whole"),
    "k11_lossy_count_signed": (lossy_signed, whole_sql(W, True) + "SELECT item, est FROM whole"),
    "k12_lossy_point": (lossy_point, whole_sql(W) + """
        SELECT u.item, coalesce(h.est, 0)::BIGINT AS est
        FROM (SELECT DISTINCT user_id AS item FROM events) u LEFT JOIN whole h ON h.item = u.item"""),
    "k12_lossy_heavy_hitters": (lossy_heavy, whole_sql(W) + f"SELECT item, est FROM whole WHERE est >= {USER_THR}"),
    "k13_lossy_count_delta": (delta_build, whole_sql(WD) + "SELECT item, est, lower FROM whole"),
    "k13_lossy_full_epochs_only": (lossy_full_epochs, lossy_sql(WD) + "SELECT item, est, lower FROM held"),
    "k14_lossy_delta_heavy_hitters": (delta_heavy, whole_sql(WD) +
                                      f"SELECT item, est, lower FROM whole WHERE est >= {USER_THR}"),
    "k15_sizes": (sizes, with_(USERS) + """
        SELECT method, bytes, kept, (SELECT count(*) FROM users) AS items FROM (""" + " UNION ALL ".join(
        f"SELECT '{m}' AS method, {size}::BIGINT AS bytes, ({kept}) AS kept" for m, size, kept in (
            *[(m, size, with_(EVENT_USES, *blocks_sql(SIZED[m])) + "SELECT count(*) FROM items") for m, size in (
                ("im_sum", 104 + (520 + 130 - 1) * (4 + 48 + 64)), ("dim_sum", 144 + (524 + 131 - 1) * (4 + 48 + 32)),
                ("space_saving", 48 + 133 * (12 + 32)), ("unit_space_saving", 72 + 131 * (24 + 56 + 32 + 8)))],
            ("lossy", 5 * 130 * 8 + 48, whole_sql(W) + "SELECT count(*) FROM whole"),
            ("lossy_delta", 3 * 131 * 12 + 48, whole_sql(WD) + "SELECT count(*) FROM whole"))) + ")"),
    "k16_top_k": (top, with_(WORD_USES, *blocks_sql(IM_WORDS)) + """
        SELECT item, (residual + q)::BIGINT AS est FROM items ORDER BY est DESC, item LIMIT 25"""),
}
