"""Counter summaries: a bounded set of items with counts that bracket the truth.

A summary is two DataFrames. ``items`` holds ``(shard, item, residual)`` and
``errors`` holds one row ``(shard, q, weight)`` per shard. For every item

    residual <= true total <= residual + q        (residual 0 if not kept)

and ``q`` is at most ``weight / counters``. Pruning takes the ``counters``-th
largest residual off every residual, drops what is no longer positive and adds it
to ``q``; merging adds residuals and errors and prunes again.

A *tracked* summary, the form of Space-Saving, also keeps for every item what it has
``seen``: the weight counted since the item was taken in last. Its counters are then

    count = residual + q,    delta = count - seen

An item that is absent on one side of a merge takes that side's ``q``, the most it can have
had there, into count and delta, so errors differ from item to item and
``count - delta <= true total <= count``.

Shards are explicit columns, never Spark's own partitions, so results do not
change with the layout of the data. ``summarise_blocks`` and ``summarise_in_place`` build
summaries from updates and never hold exact totals of a whole stream; ``summarise``
prunes totals that are there already.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcount.functions.hashing import bucket, coefficients
from rillcount.session import cut_lineage, fits_broadcast

# Coefficients of the pairwise hash that assigns items to shards.
SHARD_A, SHARD_B = coefficients(31, 1, 2)[0]

# Bytes of the record, of one counter and of one pointer in the
# dense form of each summary; tables are hashed with three slots per counter.
SLOTS = 3
POINTER_BYTES = 8
IM_HEADER, IM_COUNTER = 104, 32
DIM_HEADER, DIM_COUNTER = 144, 16
HEAP_HEADER, HEAP_COUNTER = 48, 32
UNIT_HEADER, UNIT_ITEM, UNIT_GROUP = 72, 56, 32
BUFFER_BYTES = 4

#: Summaries merged at a time, and rows a task gathers at least before it sums them up.
FAN, GATHERED = 16, 1 << 16


@dataclass(frozen=True)
class Budget:
    """How many counters survive a prune, and how many may pile up before one."""

    counters: int
    capacity: int

    @classmethod
    def im_sum(cls, eps: float, gamma: float = 4.0) -> "Budget":
        return cls(math.ceil(1 / eps), math.ceil(gamma / eps) + math.ceil(1 / eps) - 1)

    @classmethod
    def dim_sum(cls, phi: float, gamma: float = 4.0) -> "Budget":
        """One counter more than :meth:`im_sum`, as the upkeep lags one update behind."""
        return cls.im_sum(1 / (1 / phi + 1), gamma)

    @classmethod
    def space_saving(cls, phi: float) -> "Budget":
        """An odd number of counters, one of them standing for the minimum."""
        size = (2 + math.floor(1 / phi)) | 1
        return cls(size, size - 1)

    @classmethod
    def unit_space_saving(cls, phi: float) -> "Budget":
        size = max(1 + math.floor(1 / phi), 1)
        return cls(size, size - 1)


def item_shard(item: Column, shards: int) -> Column:
    """Shard of an item; shards then hold disjoint sets of items."""
    if shards == 1:
        return F.lit(0)
    key = F.pmod(item, F.lit(1 << 32).cast("long"))
    return bucket(SHARD_A, SHARD_B, key, shards).cast("int")


def with_shard_values(df: DataFrame, side: DataFrame, columns: Sequence[str],
                      shards: int) -> DataFrame:
    """Add columns of a table with one row per shard, 0 for shards it does not have.

    A single shard has single values, which come as scalar subqueries. Several are
    joined, by broadcast if as many rows as shards fit.
    """
    if shards == 1:
        return df.withColumns({
            c: F.coalesce(side.select(c).scalar(), F.lit(0).cast("long")) for c in columns})
    if fits_broadcast(df.sparkSession, shards, 48):
        side = F.broadcast(side)
    kept = [F.col(c) for c in df.columns]
    return df.join(side.select("shard", *columns), "shard", "left").select(
        *kept, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns])


def cut_points(items: DataFrame, budget: Budget) -> DataFrame:
    """``(shard, delta, weight)``: what a prune takes off each residual, and their sum.

    Residuals are counted by value before they are ranked. Distinct positive
    values that sum to at most N number at most ``sqrt(2 N)``, which bounds what
    the window of one shard has to sort, however many items the shard holds.
    """
    by_value = items.groupBy("shard", "residual").agg(F.count(F.lit(1)).alias("n"))
    largest_first = Window.partitionBy("shard").orderBy(F.col("residual").desc())
    counted = by_value.select(
        "shard", "residual",
        F.sum("n").over(largest_first.rowsBetween(Window.unboundedPreceding, 0)).alias("above"),
        "n")
    kth = F.max(F.when(F.col("above") >= budget.counters, F.col("residual")))
    over = F.sum("n") > budget.capacity
    return counted.groupBy("shard").agg(
        F.coalesce(F.when(over, kth), F.lit(0)).cast("long").alias("delta"),
        F.sum(F.col("residual") * F.col("n")).cast("long").alias("weight"))


@dataclass(frozen=True)
class CounterSummary:
    """Residuals, per-shard errors, and the budget that produced them."""

    items: DataFrame
    errors: DataFrame
    budget: Budget
    shards: int = 1

    @property
    def tracked(self) -> bool:
        return "seen" in self.items.columns

    @property
    def more(self) -> list[str]:
        """Columns of items besides shard, item and residual."""
        return ["seen"] if self.tracked else []

    def prune(self) -> "CounterSummary":
        cuts = cut_points(self.items, self.budget)
        errors = with_shard_values(self.errors, cuts, ["delta"], self.shards).select(
            "shard", (F.col("q") + F.col("delta")).alias("q"), "weight")
        return replace(self, items=self._above(cuts), errors=errors)

    def _above(self, cuts: DataFrame) -> DataFrame:
        return (
            with_shard_values(self.items, cuts, ["delta"], self.shards)
            .select("shard", "item", (F.col("residual") - F.col("delta")).alias("residual"), *self.more)
            .where(F.col("residual") > 0))

    def add(self, totals: DataFrame) -> "CounterSummary":
        """Add one epoch of ``(item, total)`` rows and prune if over capacity."""
        return _combine([self, _unpruned(totals, self.budget, self.shards)]).prune()

    def collapse(self) -> "CounterSummary":
        """One summary of the whole stream from all shards.

        Shards hold disjoint items, so an item is only ever short by its own shard's
        error, and the largest one covers all.
        """
        one = F.lit(0)
        items = self.items.select(one.alias("shard"), "item", "residual", *self.more)
        errors = self.errors.agg(
            F.coalesce(F.max("q"), F.lit(0)).cast("long").alias("q"),
            F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight"),
        ).select(one.alias("shard"), "q", "weight")
        return CounterSummary(items, errors, self.budget).prune()

    def rows(self) -> DataFrame:
        """Items and errors as one table, errors without item: the form to write out."""
        zero = F.lit(0).cast("long")
        kept = self.items.select(
            "shard", "item", "residual", *self.more, zero.alias("q"), zero.alias("weight"))
        errors = self.errors.select(
            "shard", F.lit(None).cast(self.items.schema["item"].dataType).alias("item"),
            zero.alias("residual"), *[zero.alias(c) for c in self.more], "q", "weight")
        return kept.unionByName(errors)

    def with_rows(self, rows: DataFrame) -> "CounterSummary":
        """The same kind of summary over rows written earlier."""
        return replace(
            self,
            items=rows.where("item is not null").select(
                "shard", "item", "residual", *[c for c in ("seen",) if c in rows.columns]),
            errors=rows.where("item is null").select("shard", "q", "weight"))

    def checkpoint(self) -> "CounterSummary":
        return self.with_rows(cut_lineage(self.rows()))

    def estimates(self) -> DataFrame:
        """``(item, est, lower, q)`` of the kept items; ``est`` is an upper bound."""
        return self.state().select(
            "item", (F.col("residual") + F.col("q")).alias("est"),
            F.col("residual").alias("lower"), "q")

    def point(self, queried: DataFrame, item: str = "item") -> DataFrame:
        """Add ``est``, ``lower`` and ``q``; items that are not kept get ``q`` and 0."""
        kept = self.items.select(F.col("item").alias("_i"), "residual")
        found = queried.join(kept, F.col(item) == F.col("_i"), "left").withColumn(
            "shard", item_shard(F.col(item), self.shards))
        lower = F.coalesce("residual", F.lit(0)).cast("long")
        return with_shard_values(found, self.errors, ["q"], self.shards).select(
            *queried.columns, lower.alias("lower"), "q", (lower + F.col("q")).alias("est"))

    def heavy_hitters(self, thr: Column) -> DataFrame:
        """``(item, est, lower, q)`` of kept items whose estimate reaches ``thr``."""
        return self.estimates().where(F.col("est") >= thr)

    def state(self) -> DataFrame:
        """``(shard, item, residual, q)`` of the kept items."""
        return with_shard_values(self.items, self.errors, ["q"], self.shards).select(
            "shard", "item", "residual", "q")

    def counters(self) -> DataFrame:
        """``(shard, item, count, delta)`` of a tracked summary: ``count - delta <= truth <= count``."""
        self._need_seen()
        count = F.col("residual") + F.col("q")
        return with_shard_values(self.items, self.errors, ["q"], self.shards).select(
            "shard", "item", count.alias("count"), (count - F.col("seen")).alias("delta"))

    def count_of(self, queried: DataFrame, item: str = "item") -> DataFrame:
        """Add ``count`` and ``delta``; both are the least counter ``q`` for items that are not kept."""
        self._need_seen()
        kept = self.items.select(F.col("item").alias("_i"), "residual", "seen")
        found = queried.join(kept, F.col(item) == F.col("_i"), "left").withColumn(
            "shard", item_shard(F.col(item), self.shards))
        count = (F.coalesce("residual", F.lit(0)) + F.col("q")).cast("long")
        return with_shard_values(found, self.errors, ["q"], self.shards).select(
            *queried.columns, count.alias("count"),
            (count - F.coalesce("seen", F.lit(0))).cast("long").alias("delta"))

    def claims(self, thr: Column) -> DataFrame:
        """``(item, count, delta, sure)`` of items that may reach ``thr``; those that must are sure."""
        return self.counters().where(F.col("count") >= thr).select(
            "item", "count", "delta", (F.col("count") - F.col("delta") >= thr).alias("sure"))

    def _need_seen(self) -> None:
        if not self.tracked:
            raise ValueError("the summary keeps no error per item; build it with tracked=True")


def _unpruned(totals: DataFrame, budget: Budget, shards: int) -> CounterSummary:
    items = totals.select(
        item_shard(F.col("item"), shards).alias("shard"), "item",
        F.col("total").cast("long").alias("residual"))
    errors = items.groupBy("shard").agg(F.sum("residual").alias("weight")).select(
        "shard", F.lit(0).cast("long").alias("q"), "weight")
    return CounterSummary(items, errors, budget, shards)


def _combine(parts: Sequence[CounterSummary]) -> CounterSummary:
    first = parts[0]
    items = reduce(DataFrame.unionByName, [p.items for p in parts])
    errors = reduce(DataFrame.unionByName, [p.errors for p in parts])
    return replace(
        first,
        items=items.groupBy("shard", "item").agg(*[F.sum(c).alias(c) for c in ("residual", *first.more)]),
        errors=errors.groupBy("shard").agg(
            F.sum("q").cast("long").alias("q"), F.sum("weight").cast("long").alias("weight")))


def merge(parts: Sequence[CounterSummary]) -> CounterSummary:
    """Merge summaries with the same budget and shards: add, then prune once."""
    if len({(p.budget, p.shards, p.tracked) for p in parts}) != 1:
        raise ValueError("summaries differ in budget, number of shards or form")
    return _combine(parts).prune()


def summarise(totals: DataFrame, budget: Budget, shards: int = 1) -> CounterSummary:
    """Summary of ``(item, total)`` rows, one per item, in item-disjoint shards."""
    whole = _unpruned(totals, budget, shards)
    cuts = cut_points(whole.items, budget)
    errors = cuts.select("shard", F.col("delta").alias("q"), "weight")
    return replace(whole, items=whole._above(cuts), errors=errors)


def gather(partial: DataFrame, budget: Budget) -> CounterSummary:
    """One summary from rows ``(item, residual, q, weight)`` of many partial summaries.

    Residuals and errors add up; rows without item carry the errors.
    """
    one = F.lit(0)
    sums = [c for c in ("residual", "seen") if c in partial.columns]
    items = partial.where("item is not null").groupBy("item").agg(
        *[F.sum(c).alias(c) for c in sums]).select(one.alias("shard"), "item", *sums)
    errors = partial.where("item is null").agg(
        F.coalesce(F.sum("q"), F.lit(0)).cast("long").alias("q"),
        F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight"),
    ).select(one.alias("shard"), "q", "weight")
    return CounterSummary(items, errors, budget).prune()


def _cut_shards(items: DataFrame, budgets: Sequence[Budget]) -> DataFrame:
    """``items`` with the ``place`` of each by residual in its shard and the cut ``d0``, ``d1``, ... of every budget.

    For shards of bounded size: each is sorted inside one task. Rows without item come last and do not count.
    """
    shard = Window.partitionBy("shard")
    largest_first = shard.orderBy(F.col("item").isNull(), F.col("residual").desc())

    def cut(budget: Budget) -> Column:
        kth = F.max(F.when((F.col("place") == budget.counters) & F.col("item").isNotNull(), F.col("residual")))
        return F.coalesce(F.when(F.count("item").over(shard) > budget.capacity, kth.over(shard)), F.lit(0)).cast("long")

    return items.withColumn("place", F.row_number().over(largest_first)).withColumns(
        {f"d{k}": cut(budget) for k, budget in enumerate(budgets)})


def _merge_rows(rows: DataFrame, budget: Budget) -> DataFrame:
    """Rows of many summaries, renumbered by the shard they go to, as the rows of one pruned summary per shard.

    One shuffle by shard serves the sums, the cut and the errors.
    """
    sums = [c for c in ("residual", "seen", "q", "weight") if c in rows.columns]
    added = rows.repartition("shard").groupBy("shard", "item").agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    error, zero = F.col("item").isNull(), F.lit(0).cast("long")
    return _cut_shards(added, [budget]).where(error | (F.col("residual") > F.col("d0"))).select(
        "shard", "item", F.when(error, zero).otherwise(F.col("residual") - F.col("d0")).alias("residual"),
        *[c for c in ("seen",) if c in sums],
        F.when(error, F.col("q") + F.col("d0")).otherwise(zero).alias("q"), "weight")


def summarise_blocks(updates: DataFrame, budget: Budget | Sequence[Budget], block: str = "block", item: str = "item",
                     weight: str = "weight", fan: int = FAN, shards: int = 1,
                     tracked: bool = False) -> CounterSummary | list[CounterSummary]:
    """Summary from updates: one of each block of the stream, merged ``fan`` at a time.

    Several budgets have a list of summaries, in their order, from one pass over the updates.

    ``tracked`` keeps an error for each item, as Space-Saving has them.

    With several ``shards`` each block is cut into so many summaries of disjoint items (whole
    numbers then), which are merged shard by shard and keep the budget each.

    ``block`` numbers stretches of the stream from 0 and bounds what one summary reads, so
    a block never holds more than its own items, and a merge never more than ``fan * capacity``
    counters. Every merge prunes, and ``q <= weight / counters`` holds after each. Items may be of any
    type; rows without item or weight are left out. Negative weights are an error, as is a negative block.
    The result depends on the blocks alone, not on how Spark splits the data. Updates that are dealt by
    their blocks already are not shuffled again (unless there are several shards).
    """
    budgets = [budget] if isinstance(budget, Budget) else list(budget)
    place = F.col(block).cast("long")
    # Summaries in the making are numbered by block, then by shard.
    number = place if shards == 1 else place * shards + item_shard(F.col(item), shards)
    sound = F.when((F.col("residual") >= 0) & (F.col("shard") >= 0), F.col("residual")).otherwise(
        F.raise_error(F.lit("weights and blocks must not be negative")).cast("long"))
    known = updates.where(F.col(item).isNotNull() & F.col(weight).isNotNull()).select(
        number.alias("shard"), F.col(item).alias("item"), F.col(weight).cast("long").alias("residual"))
    items = known.withColumn("residual", sound).groupBy("shard", "item").agg(F.sum("residual").alias("residual"))
    # What a budget keeps of a block, and one row of each block that tells its cuts and weight, whatever is kept.
    cuts = [f"d{k}" for k in range(len(budgets))]
    kept = reduce(Column.__or__, [F.col("residual") > F.col(d) for d in cuts], F.col("place") == 1)
    whole = F.sum("residual").over(Window.partitionBy("shard")).cast("long")
    base = cut_lineage(_cut_shards(items, budgets).withColumn("weight", whole).where(kept).select(
        "shard", "item", "residual", *cuts, "weight", (F.col("place") == 1).alias("first")))
    blocks = (base.agg(F.max("shard")).first()[0] or 0) // shards + 1
    made = []
    for each, d in zip(budgets, cuts):
        own = base.where(F.col("residual") > F.col(d)).select(
            "shard", "item", (F.col("residual") - F.col(d)).alias("residual"),
            *[F.col("residual").alias("seen")] * tracked)
        errors = base.where("first").select("shard", F.col(d).alias("q"), "weight")
        made.append(_merge_blocks(CounterSummary(own, errors, each), blocks, fan, shards))
    return made[0] if isinstance(budget, Budget) else made


def _merge_blocks(summary: CounterSummary, blocks: int, fan: int, shards: int) -> CounterSummary:
    """One summary, in ``shards``, of those of all blocks; every level of merges is checkpointed."""
    while blocks > 1:
        blocks = -(-blocks // fan)
        group = F.expr(f"shard div {shards * fan} * {shards} + shard % {shards}")
        merged = _merge_rows(summary.rows().withColumn("shard", group), summary.budget)
        summary = summary.with_rows(cut_lineage(merged))
    number = F.col("shard").cast("int").alias("shard")
    errors = summary.errors.select(number, "q", "weight")
    if shards == 1:
        errors = errors.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("q", "weight")]).select(
            F.lit(0).alias("shard"), "q", "weight")
    return replace(summary, items=summary.items.select(number, "item", "residual", *summary.more),
                   errors=errors, shards=shards).checkpoint()


def im_sum(totals: DataFrame, eps: float, gamma: float = 4.0, shards: int = 1) -> CounterSummary:
    """IM-SUM over a whole stream at once."""
    return summarise(totals, Budget.im_sum(eps, gamma), shards)


def dim_sum(epochs: Sequence[DataFrame], phi: float, gamma: float = 4.0,
            shards: int = 1) -> CounterSummary:
    """DIM-SUM: one summary carried from epoch to epoch.

    The state is checkpointed to shared storage after every epoch, so the plan
    does not grow with the number of epochs and a lost executor costs one epoch.
    """
    summary = summarise(epochs[0], Budget.dim_sum(phi, gamma), shards)
    for totals in epochs[1:]:
        summary = summary.checkpoint().add(totals)
    return summary


def space_saving(totals: DataFrame, phi: float, shards: int = 1) -> CounterSummary:
    """Weighted Space-Saving; ``q`` is the minimum counter and the error of every count."""
    return summarise(totals, Budget.space_saving(phi), shards)


class LocalCounters:
    """A bounded summary inside one task, for non-null items and weights that are not negative.

    Updates are gathered up to half the capacity before they meet the counters.
    """

    def __init__(self, budget: Budget, items=(), residuals=(), q: int = 0, weight: int = 0):
        import numpy as np

        self.budget, self.q, self.weight = budget, q, weight
        self.items, self.residuals = np.array(items, np.int64), np.array(residuals, np.int64)
        self.seen = self.residuals
        self.held, self.waiting = [], 0

    def add(self, items, weights) -> None:
        self.weight += int(weights.sum())
        self.held.append((items, weights))
        self.waiting += len(items)
        if self.waiting >= max(GATHERED, self.budget.capacity // 2):
            self.fold()

    def fold(self) -> "LocalCounters":
        """Sums by item of counters and gathered updates, cut if over capacity."""
        import numpy as np

        items = np.concatenate([self.items, *[i for i, _ in self.held]])
        added = [w for _, w in self.held]
        weights, seen = np.concatenate([self.residuals, *added]), np.concatenate([self.seen, *added])
        self.held, self.waiting = [], 0
        if not len(items):
            return self
        order = np.argsort(items, kind="stable")
        items, weights, seen = items[order], weights[order], seen[order]
        first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        items, weights, seen = items[first], np.add.reduceat(weights, first), np.add.reduceat(seen, first)
        if (over := len(items) - self.budget.counters) >= 0 and len(items) > self.budget.capacity:
            delta = int(np.partition(weights, over)[over])
            weights, self.q = weights - delta, self.q + delta
        kept = weights > 0
        self.items, self.residuals, self.seen = items[kept], weights[kept], seen[kept]
        return self


def _local_summary(budget: Budget):
    """Python side of :func:`summarise_in_place`: one bounded summary per task."""
    def run(batches):
        import pyarrow as pa

        own = LocalCounters(budget)
        for batch in batches:
            own.add(batch.column("item").to_numpy(), batch.column("total").to_numpy())
        own.fold()
        kept = len(own.items)
        yield pa.RecordBatch.from_arrays([
            pa.array([*own.items.tolist(), None], pa.int64()), pa.array([*own.residuals.tolist(), 0], pa.int64()),
            pa.array([*own.seen.tolist(), 0], pa.int64()),
            pa.array([0] * kept + [own.q], pa.int64()), pa.array([0] * kept + [own.weight], pa.int64())],
            ["item", "residual", "seen", "q", "weight"])

    return run


def summarise_in_place(updates: DataFrame, budget: Budget, item: str = "item",
                       weight: str = "weight", tracked: bool = False) -> CounterSummary:
    """Summary without a shuffle of the items.

    Each task reduces the rows it reads to at most ``capacity`` counters, so the
    shuffle carries counters per task and not distinct items. The partial
    summaries are checkpointed to shared storage, so the input is read once. Numbers
    inside the bounds depend on how the input is split; the bounds hold for any split.
    Rows without item or weight are left out; negative weights are an error.
    """
    amount = F.col(weight).cast("long")
    amount = F.when(amount >= 0, amount).otherwise(
        F.raise_error(F.lit("weights must not be negative")).cast("long"))
    partial = updates.where(F.col(item).isNotNull() & F.col(weight).isNotNull()).select(
        F.col(item).cast("long").alias("item"), amount.alias("total")
    ).mapInArrow(_local_summary(budget), "item long, residual long, seen long, q long, weight long")
    return gather(cut_lineage(partial if tracked else partial.drop("seen")), budget)


def dense_size(method: str, phi: float, gamma: float = 4.0) -> int:
    """Bytes of the dense form of a counter summary."""
    if method in ("im_sum", "dim_sum"):
        budget = getattr(Budget, method)(phi, gamma)
        header, counter = (IM_HEADER, IM_COUNTER) if method == "im_sum" else (DIM_HEADER, DIM_COUNTER)
        size = budget.capacity
        return (header + size * BUFFER_BYTES
                + 2 * SLOTS * size * POINTER_BYTES + 2 * size * counter)
    if method == "space_saving":
        size = Budget.space_saving(phi).counters
        return HEAP_HEADER + SLOTS * size * BUFFER_BYTES + size * HEAP_COUNTER
    if method == "unit_space_saving":
        k = Budget.unit_space_saving(phi).counters
        return (UNIT_HEADER + SLOTS * k * POINTER_BYTES
                + k * (UNIT_ITEM + UNIT_GROUP + POINTER_BYTES))
    raise ValueError(f"unknown method {method!r}")
