"""Lossy Counting as a fold.

Updates are cut by position into epochs of ``w``. At the end of every epoch each
kept count grows by the epoch's uses of the item and shrinks by one, and is
dropped at zero. For one item with running total C and ``S_e = C_e - e`` that
recursion ends at ``S_E - min(0, all S_e)``, so running sums and a minimum give
the same counts as feeding updates one by one.

A stretch of the stream acts on an item by three numbers: its sum, the lowest level inside
it, and where that is. Stretches side by side combine by adding the first sum to
what follows and taking the lower level, which is associative. So each scan task folds the
contiguous stretches that it reads, and one row for an item and stretch is shuffled; the epochs
that a stretch holds in part are summed by epoch first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcount.session import cut_lineage

#: Updates that a task gathers into one stretch.
STRETCH = 1 << 20

# Bytes of the record and of one counter of each variant, and how
# many windows of counters it keeps room for.
PLAIN_HEADER, PLAIN_COUNTER, PLAIN_ROOM = 48, 8, 4
DELTA_HEADER, DELTA_COUNTER, DELTA_ROOM = 48, 12, 2


def window_size(phi: float, with_delta: bool = False) -> int:
    """Updates per epoch."""
    return math.floor(1 / phi) + (1 if with_delta else 0)


def epoch_counts(updates: DataFrame, w: int, item: str = "item", weight: str = "weight",
                 pos: str = "pos") -> DataFrame:
    """``(item, epoch, n)``: count-based epochs of ``w`` updates, from 0."""
    return updates.groupBy(
        F.col(item).alias("item"), F.call_function("div", F.col(pos), F.lit(w)).alias("epoch")
    ).agg(F.sum(weight).alias("n"))


def _folded(w: int, stretch: int):
    """Python side of :func:`stretches`: contiguous positions are gathered, then folded."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and (int(held[-1].column("pos")[-1].as_py()) + 1 != pos[start] or rows >= stretch):
                    yield from _fold(held, w)
                    held, rows = [], 0
                held.append(batch.slice(start, end - start))
                rows += end - start
        if held:
            yield from _fold(held, w)

    def _fold(held, w):
        table = pa.Table.from_batches(held).combine_chunks()
        pos, n = table["pos"].to_numpy(), table["n"].to_numpy()
        coded = table["item"].combine_chunks()
        coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        names = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])  # null is an item
        code, epoch = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False), pos // w
        order = np.argsort(code, kind="stable")  # positions rise, so epochs of an item do too
        code, epoch, n = code[order], epoch[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(epoch) != 0)]))
        code, epoch, n = code[first], epoch[first], np.add.reduceat(n, first)
        inner = (epoch >= -(-int(pos[0]) // w)) & (epoch < (int(pos[-1]) + 1) // w)

        def out(code, order, whole, n, neg, at, c):
            items = names.take(pa.array(code))
            return pa.RecordBatch.from_arrays(
                [items, pa.array(order), pa.array(np.full(len(code), whole)), *map(pa.array, (n, neg, at, c))],
                ["item", "epoch", "whole", "n", "neg", "at", "c"])

        part = ~inner
        none = np.zeros(int(part.sum()), np.int64)
        yield out(code[part], epoch[part], False, n[part], none, none, none)
        code, epoch, n = code[inner], epoch[inner], n[inner]
        if not len(code):
            return
        starts = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
        group = np.cumsum(np.concatenate([[False], np.diff(code) != 0]))
        after = np.cumsum(n)
        after -= (after - n)[starts][group]
        # Levels are lowest before or after an epoch in which the item is used; the later of equal ones counts.
        before = after - n
        later = after - epoch - 1 <= before - epoch
        neg = np.where(later, epoch + 1 - after, epoch - before)
        lowest = np.maximum.reduceat(neg, starts)[group] == neg
        place = np.maximum.reduceat(np.where(lowest, np.arange(len(neg)), -1), starts)
        at, c = epoch + later, np.where(later, after, before)
        yield out(code[starts], epoch[starts], True, np.add.reduceat(n, starts), neg[place], at[place], c[place])

    return run


def stretches(updates: DataFrame, w: int, item: str = "item", weight: str = "weight", pos: str = "pos",
              stretch: int = STRETCH) -> DataFrame:
    """``item, epoch, whole, n, neg, at, c``: what the stretches that tasks read add up to.

    One row for each item and stretch (``whole``, by its first epoch) over the epochs that lie
    in the stretch, with the lowest level as ``-neg`` after ``at`` epochs and a sum of ``c``; and the sums
    of epochs that lie there in part.
    """
    known = updates.where(F.col(pos).isNotNull()).select(
        F.col(item).alias("item"), F.col(pos).cast("long").alias("pos"),
        F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long")).alias("n"))
    kind = known.schema["item"].dataType.simpleString()
    return known.mapInArrow(
        _folded(w, stretch), f"item {kind}, epoch long, whole boolean, n long, neg long, at long, c long")


def full_epochs(updates: DataFrame, w: int) -> Column:
    """Scalar column: how many epochs are complete."""
    n = updates.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.call_function("div", F.col("n"), F.lit(w)).alias("epochs")).scalar()


def lossy_count(updates: DataFrame, phi: float, with_delta: bool = False,
                include_tail: bool = True) -> DataFrame:
    """``(item, kept, est, lower)`` of the items still held at the end of the stream.

    ``updates`` has ``item``, ``weight`` (-1 removes) and the dense position
    ``pos``. ``est`` is the kept count plus the number of epochs and never below
    the truth; ``lower`` counts the uses since the item was last entered. Uses in the
    unfinished last epoch are added to the estimates and bring back items used in
    it; without ``include_tail`` they are left out.
    """
    w = window_size(phi, with_delta)
    folded = cut_lineage(stretches(updates, w))
    epochs = full_epochs(updates, w)

    def boundary(level: Column, at: Column, c: Column) -> Column:
        # Ordered so that the greatest struct is the lowest level, latest on ties.
        return F.struct((-level).alias("neg"), at.alias("at"), c.alias("c"))

    per_epoch = folded.where("not whole").groupBy("item", "epoch").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    marks = F.greatest(
        boundary(-F.col("epoch"), F.col("epoch"), zero),
        boundary(F.col("n") - F.col("epoch") - 1, F.col("epoch") + 1, F.col("n")))
    blocks = per_epoch.where(F.col("epoch") < epochs).select("item", "epoch", "n", marks.alias("low")).union(
        folded.where("whole").select("item", "epoch", "n", F.struct("neg", "at", "c")))
    earlier = Window.partitionBy("item").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    shifted = blocks.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    lowest = F.max(boundary(
        F.col("base") - F.col("low.neg"), F.col("low.at"), F.col("base") + F.col("low.c")))
    per_item = shifted.groupBy("item").agg(F.sum("n").alias("c"), lowest.alias("low")).withColumn(
        "epochs", epochs)
    start = boundary(zero, zero, zero)
    end = boundary(F.col("c") - F.col("epochs"), F.col("epochs"), F.col("c"))
    held = per_item.withColumn("low", F.greatest(start, "low", end)).select(
        "item", (F.col("c") - F.col("epochs") + F.col("low.neg")).alias("kept"), "epochs",
        (F.col("c") - F.col("low.c")).alias("lower")
    ).where(F.col("kept") > 0).select(
        "item", "kept", (F.col("kept") + F.col("epochs")).alias("est"), "lower")
    if not include_tail:
        return held
    tail = per_epoch.where(F.col("epoch") >= epochs).groupBy("item").agg(F.sum("n").alias("t"))
    t = F.coalesce("t", F.lit(0))
    kept = F.coalesce("kept", F.lit(0)) + t
    return held.join(tail, "item", "full_outer").select(
        "item", kept.alias("kept"),
        (F.coalesce(F.col("est"), epochs) + t).alias("est"),
        (F.coalesce("lower", F.lit(0)) + t).alias("lower")).where(F.col("kept") > 0)


def lossy_point(counts: DataFrame, items: DataFrame, item: str = "item") -> DataFrame:
    """Add ``est``: the lossy count of each item, 0 if it is not held."""
    held = counts.select(F.col("item").alias("_i"), "est")
    return items.join(held, F.col(item) == F.col("_i"), "left").withColumn(
        "est", F.coalesce("est", F.lit(0)).cast("long")).drop("_i")


def lossy_heavy_hitters(counts: DataFrame, thr: Column) -> DataFrame:
    return counts.where(F.col("est") >= thr)


def dense_size(phi: float, with_delta: bool = False) -> int:
    """Bytes of the dense form."""
    w = window_size(phi, with_delta)
    if with_delta:
        return (DELTA_ROOM + 1) * w * DELTA_COUNTER + DELTA_HEADER
    return (PLAIN_ROOM + 1) * w * PLAIN_COUNTER + PLAIN_HEADER
