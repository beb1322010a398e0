"""Sketches of every level of a prefix hierarchy over integer ids.

Level ``l`` counts ``id >> (gran * l)``. Descending the levels finds heavy
hitters without a list of candidates, and answers range sums and quantiles. Two
kinds of level sketch are offered: Count-Min, with exact counts on the levels
small enough for them, and the signed Count Sketch.

The cells of all levels come from one pass over the data, or one level at a time
from the same per-item totals, whose shuffle Spark then runs once and reuses.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcount.functions.hashing import (
    bucket, coefficients, level_prefix, sign_hash,
)
from rillcount.operators.exact import WIDE, item_totals, stream_total
from rillcount.operators.linear import (
    COEFFICIENT_BYTES, WHOLE_CELL_BYTES, SketchShape, add_cells, item_cells, pick_sorted,
    place, probe, row_values, smallest,
)
from rillcount.session import cut_lineage

# Bytes of the record that describes each kind of hierarchy, and
# of a pointer to one of its levels.
CM_HEADER_BYTES = 56
CS_HEADER_BYTES = 64
POINTER_BYTES = 8

# Descents open 2**gran children of a prefix at once.
MAX_GRAN = 20
# Children estimated per task during a descent, before the frontier is spread out.
CHILDREN_PER_TASK = 1 << 18


@dataclass(frozen=True)
class Hierarchy:
    """Universe ``[0, 2**bits)`` looked at ``gran`` bits at a time."""

    bits: int
    gran: int
    width: int
    depth: int
    seed: int = 1

    def __post_init__(self):
        if not 1 <= self.bits <= 32:
            raise ValueError("bits must be between 1 and 32")
        if not 1 <= self.gran <= min(self.bits, MAX_GRAN):
            raise ValueError(f"gran must be between 1 and min(bits, {MAX_GRAN})")

    @property
    def levels(self) -> int:
        return -(-self.bits // self.gran)

    @property
    def exact_from(self) -> int:
        """Lowest level kept exactly because its prefixes need no more room than a sketch.

        Level 0 is always sketched; ``levels`` means that no level is exact.
        """
        room = self.width * self.depth
        cheap = max(j for j in range(self.levels) if (1 << (self.gran * j)) <= room)
        return self.levels - cheap

    def shape(self, level: int) -> SketchShape:
        """Hash functions of one level; independent between levels."""
        return SketchShape(self.width, self.depth, self.seed * 1000 + level)

    @property
    def top(self) -> int:
        return 1 << self.bits

    @property
    def max_cells(self) -> int:
        """Most cells the levels can hold, and the total."""
        exact = sum(min(1 << (self.gran * (self.levels - l)), self.top)
                    for l in range(self.exact_from, self.levels))
        return self.exact_from * self.width * self.depth + exact + 1


def in_universe(item: Column, bits: int) -> Column:
    """The item itself; one outside ``0..2**bits - 1`` is an error, as levels would disagree on it."""
    known = item.isNull() | item.between(F.lit(0), F.lit((1 << bits) - 1))
    return F.when(known, item).otherwise(F.raise_error(F.lit(f"item outside the universe of {bits} bits")).cast("long"))


def all_level_cells(updates: DataFrame, h: Hierarchy, item: Column, weight: Column,
                    signed: bool = False) -> DataFrame:
    """``(level, row, bucket, c)`` of all levels with one generator and one shuffle.

    Levels kept exactly use row -1 and the prefix as bucket, and so does the total,
    which is the only prefix of the level above all others. Works on batch and on
    streaming input, on totals as well as on single updates.
    """
    cells = [(h.levels, -1, 0, 0, 0, 0)]
    for level in range(h.levels):
        if not signed and level >= h.exact_from:
            cells.append((level, -1, 0, 0, 0, 0))
        elif signed:
            cells += [(level, r, *c) for r, c in enumerate(coefficients(h.seed, h.depth, 4))]
        else:
            cells += [(level, r, *c, 0, 0) for r, c in enumerate(h.shape(level).coeffs)]
    rows = ", ".join(
        f"named_struct('level', {level}, 'row', {row}, 'shift', {level * h.gran}, "
        f"'a', {a}L, 'b', {b}L, 'c', {c}L, 'd', {d}L)"
        for level, row, a, b, c, d in cells)
    generator = F.expr(f"explode(array({rows}))")
    opened = updates.select(item.alias("_x"), weight.alias("_w"), generator.alias("h")).select(
        F.col("h.*"), F.expr("shiftright(_x, h.shift)").alias("_p"), "_w")
    hashed = bucket(F.col("a"), F.col("b"), F.col("_p"), h.width)
    w = F.col("_w")
    if signed:
        w = F.when(F.col("row") < 0, w).otherwise(sign_hash(F.col("c"), F.col("d"), F.col("_p")) * w)
    placed = opened.select(
        "level", "row", F.when(F.col("row") < 0, F.col("_p")).otherwise(hashed).alias("bucket"),
        w.alias("_w"))
    return placed.groupBy("level", "row", "bucket").agg(F.sum("_w").alias("c"))


def _children(frontier: DataFrame, h: Hierarchy, level: int) -> DataFrame:
    """Replace ``prefix`` at ``level + 1`` by its children at ``level``."""
    fan = 1 << h.gran
    first = F.shiftleft("prefix", h.gran)
    kept = [c for c in frontier.columns if c not in ("prefix", "est")]
    opened = frontier.select(
        *kept, F.explode(F.sequence(first, first + F.lit(fan - 1))).alias("prefix"))
    if h.gran * (level + 1) > h.bits:
        opened = opened.where(F.col("prefix") < F.lit(1 << (h.bits - h.gran * level)))
    return opened


def _spread_frontier(frontier: DataFrame, h: Hierarchy) -> DataFrame:
    """Give a frontier of up to ``width`` prefixes enough tasks for its children."""
    tasks = (h.width << h.gran) // CHILDREN_PER_TASK
    return frontier.repartition(tasks, "prefix") if tasks > 1 else frontier


def _range_blocks(ranges: DataFrame, h: Hierarchy, level: int, start: Column, stop: Column) -> DataFrame:
    """Prefixes of ``level`` in the canonical cover of ``[start, stop)``.

    A level contributes the blocks before the first and after the last full
    parent block; the level without a full parent block inside contributes all.
    """
    g = h.gran

    def up(x: Column, l: int) -> Column:
        return F.shiftright(x + F.lit((1 << (g * l)) - 1), g * l) if l else x

    def down(x: Column, l: int) -> Column:
        return F.shiftright(x, g * l) if l else x

    lo, hi = up(start, level), down(stop, level)
    inner_lo = F.shiftleft(up(start, level + 1), g)
    inner_hi = F.shiftleft(down(stop, level + 1), g)

    def span(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    whole = span(lo, hi)
    if level < h.levels - 1:
        split = F.concat(span(lo, inner_lo), span(inner_hi, hi))
        whole = F.when(inner_lo < inner_hi, split).otherwise(whole)
    return ranges.select("range_id", F.explode(whole).alias("prefix"))


@dataclass(frozen=True)
class _Levels:
    """Cells of all levels, computed from ``totals`` or kept in ``stored``.

    ``totals`` holds ``(item, total)``. All sketches are linear, so items may repeat:
    single updates do as well as totals, and save the shuffle that groups them.

    Answers that walk through the levels read each level once or twice. Over large
    input call :meth:`store` first: one pass over the data makes the cells of all
    levels, whose number depends on the hierarchy and not on the data.
    """

    h: Hierarchy
    totals: DataFrame | None = None
    stored: DataFrame | None = None

    signed = False

    def __post_init__(self):
        if self.totals is not None and self.stored is None:
            object.__setattr__(self, "totals", self.totals.withColumn(
                "item", in_universe(F.col("item"), self.h.bits)))

    @classmethod
    def build(cls, updates: DataFrame, h: Hierarchy, item: str = "item", weight: str = "weight",
              per_item_first: bool = True):
        """From an update stream, by default summed per item first.

        Leave that out if few items repeat: the shuffle then carries cells only.
        """
        if per_item_first:
            return cls(h, item_totals(updates, item, weight))
        return cls(h, updates.where(F.col(item).isNotNull()).select(
            F.col(item).alias("item"), F.col(weight).alias("total")))

    @classmethod
    def from_cells(cls, h: Hierarchy, cells: DataFrame):
        """From a table of cells written earlier, best partitioned by ``level``."""
        return cls(h, stored=cells)

    def store(self):
        """The same sketch over checkpointed cells."""
        return replace(self, stored=cut_lineage(self.cells()))

    def cells(self) -> DataFrame:
        """``(level, row, bucket, c)`` of all levels and the total: the form to write out."""
        if self.stored is not None:
            return self.stored
        return all_level_cells(
            self.totals, self.h, F.col("item"), F.col("total"), self.signed)

    def total(self) -> DataFrame:
        """One row ``(n)``: the weight of the stream."""
        if self.stored is None:
            return stream_total(self.totals)
        return self.stored.where(F.col("level") == self.h.levels).agg(
            F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))

    def _stored_level(self, level: int) -> DataFrame:
        return self.stored.where(F.col("level") == level)


@dataclass(frozen=True)
class DyadicCountMin(_Levels):
    """Hierarchical Count-Min: exact upper levels over sketched lower ones."""

    def prefix_counts(self, level: int) -> DataFrame:
        """``(prefix, c)``: exact counts of one level; stored for exact levels only."""
        if self.stored is not None and level >= self.h.exact_from:
            return self._stored_level(level).select(F.col("bucket").alias("prefix"), "c")
        return self.totals.groupBy(
            level_prefix(F.col("item"), self.h.gran, level).alias("prefix")
        ).agg(F.sum("total").alias("c"))

    def level_cells(self, level: int) -> DataFrame:
        """``(row, bucket, c)``: the sketch of one level."""
        if self.stored is not None:
            return self._stored_level(level).select("row", "bucket", "c")
        return add_cells(self.totals, self.h.shape(level),
                         level_prefix(F.col("item"), self.h.gran, level), F.col("total"))

    def count(self, prefixes: DataFrame, level: int) -> DataFrame:
        """Add ``est`` to a table with ``prefix``: the estimated count at ``level``.

        Every row comes back once, repeated ones too; no row is shuffled if the level's cells
        can be broadcast.
        """
        if level >= self.h.exact_from:
            return self._count(prefixes, level)
        found, names = item_cells(prefixes, self.h.shape(level), self.level_cells(level), F.col("prefix"))
        return found.select(*prefixes.columns, smallest(names).alias("est"))

    def _count(self, prefixes: DataFrame, level: int) -> DataFrame:
        """As :meth:`count`, for rows of which no two are equal."""
        if level >= self.h.levels:
            return prefixes.withColumn("est", self.total().scalar())
        if level >= self.h.exact_from:
            exact = self.prefix_counts(level)
            return prefixes.join(exact, "prefix", "left").select(
                *prefixes.columns, F.coalesce("c", F.lit(0)).alias("est"))
        met = probe(prefixes, self.h.shape(level), self.level_cells(level), F.col("prefix"))
        return met.groupBy(*prefixes.columns).agg(F.min("c").alias("est"))

    def _survivors(self, keys: DataFrame, level: int, thr: Column) -> DataFrame:
        """Keys whose every cell reaches ``thr``, with the smallest as ``est``.

        The minimum reaches a threshold only if all cells do, so cells below it are
        dropped before they are joined; of a non-negative stream at most
        ``weight / thr`` cells per sketch row are left.
        """
        shape = self.h.shape(level)
        heavy = self.level_cells(level).where(F.col("c") >= thr)
        met = probe(keys, shape, heavy, F.col("prefix"), "inner")
        return met.groupBy("prefix").agg(
            F.min("c").alias("est"), F.count(F.lit(1)).alias("_n")
        ).where(F.col("_n") == shape.depth).drop("_n")

    def heavy_hitters(self, thr: Column) -> DataFrame:
        """``(item, est)`` of all ids whose estimate and all of whose ancestors reach ``thr``.

        ``thr`` must be positive.
        """
        h = self.h
        level = h.exact_from
        if level < h.levels:
            frontier = self._exact_frontier(thr)
        else:
            frontier = self.total().select(
                F.lit(0).cast("long").alias("prefix"), F.col("n").alias("est")
            ).where(F.col("est") >= thr)
        while level > 0:
            level -= 1
            opened = _children(_spread_frontier(frontier, h), h, level)
            frontier = self._survivors(opened, level, thr)
        return frontier.select(F.col("prefix").alias("item"), "est")

    def _exact_frontier(self, thr: Column) -> DataFrame:
        """Prefixes of the lowest exact level that reach ``thr`` with all their ancestors.

        With removals in the stream an ancestor may be smaller than its child, so
        all exact levels are looked at; each has at most ``width * depth`` rows.
        """
        h = self.h
        lowest = self.prefix_counts(h.exact_from).withColumnRenamed("c", "est")
        keep = F.col("est") >= thr
        for level in range(h.exact_from + 1, h.levels + 1):
            above = Window.partitionBy(
                F.shiftright("prefix", h.gran * (level - h.exact_from)))
            keep = keep & (F.col(f"_a{level}") >= thr)
            lowest = lowest.withColumn(f"_a{level}", F.sum("est").over(above))
        return lowest.where(keep).select("prefix", "est")

    def range_sums(self, ranges: DataFrame) -> DataFrame:
        """``(range_id, est)`` for every row ``(range_id, start, end)``, ends inclusive.

        Repeated rows and repeated ids each get their own answer; a null end has none.
        """
        ends = ranges.select("range_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        asked = ends.select(F.struct("start", "end").alias("range_id"), "start", "end").where(
            "start IS NOT NULL AND end IS NOT NULL").distinct()
        found = self._range_sums(asked).select("range_id.start", "range_id.end", "est")
        return ends.join(found, ["start", "end"], "left").select("range_id", "est")

    def _range_sums(self, ranges: DataFrame) -> DataFrame:
        """Sums by ``range_id``, which has to differ from row to row."""
        start = F.greatest(F.col("start"), F.lit(0).cast("long"))
        stop = F.least(F.col("end"), F.lit(self.h.top - 1).cast("long")) + 1
        parts = [ranges.select("range_id", F.lit(0).cast("long").alias("est"))]
        for level in range(self.h.levels):
            blocks = _range_blocks(ranges, self.h, level, start, stop)
            counted = self._count(blocks.select("prefix").distinct(), level)
            parts.append(blocks.join(counted, "prefix").select("range_id", "est"))
        return reduce(DataFrame.unionByName, parts).groupBy("range_id").agg(
            F.sum("est").alias("est"))

    def _descend(self, targets: DataFrame, from_right: bool) -> DataFrame:
        """Follow one child per level for every ``(target_id, target)``.

        Each different target looks once at no more than ``2**gran`` children per level;
        rows of equal targets or ids all get their answer, a null target has none.
        """
        h = self.h
        rows = targets.select("target_id", F.col("target").cast("long").alias("target"))
        state = rows.where("target IS NOT NULL").select(
            F.col("target").alias("target_id"), "target", F.col("target").alias("rem"),
            F.lit(0).cast("long").alias("prefix")).distinct()
        order = F.col("prefix").desc() if from_right else F.col("prefix").asc()
        along = Window.partitionBy("target_id").orderBy(order)
        for level in reversed(range(h.levels)):
            counted = self._count(_children(state, h, level), level)
            walked = counted.select(
                "target_id", "target", "rem", "prefix", "est",
                F.sum("est").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                F.lead("prefix").over(along).isNull().alias("last"))
            reached = F.col("cum") >= F.col("rem") if from_right else F.col("cum") > F.col("rem")
            pick = F.struct("prefix", (F.col("rem") - F.col("cum") + F.col("est")).alias("rem"))
            chosen = (F.max_by if from_right else F.min_by)(pick, "prefix")
            state = (
                walked.where(reached | F.col("last"))
                .groupBy("target_id", "target").agg(chosen.alias("to"))
                .select("target_id", "target", "to.rem", "to.prefix"))
        beyond = F.col("target") > self.total().scalar()
        found = state.select("target", F.when(
            beyond, F.lit(h.top).cast("long")).otherwise(F.col("prefix")).alias("item"))
        return rows.join(found, "target", "left").select("target_id", "item")

    def find_range(self, targets: DataFrame) -> DataFrame:
        """``(target_id, item)``: smallest x whose estimated sum over 0..x exceeds the target.

        The last id if the target equals the total, ``2**bits`` if it exceeds it.
        """
        return self._descend(targets, from_right=False)

    def find_range_from_right(self, targets: DataFrame) -> DataFrame:
        """``(target_id, item)``: largest x whose estimated sum from x up reaches the target."""
        return self._descend(targets, from_right=True)

    def quantiles(self, fractions: DataFrame) -> DataFrame:
        """``(target_id, item)`` for every row ``(target_id, frac)``: the mean of both directions.

        Repeated rows and ids each get their own answer; a null fraction has none.
        """
        n = self.total().scalar()
        rows = fractions.select("target_id", F.col("frac").cast("double").alias("frac"))
        inside = rows.where(F.col("frac").between(0.0, 1.0)).select("frac").distinct()

        def at(share: Column) -> DataFrame:
            return inside.select(F.col("frac").alias("target_id"), F.floor(n * share).cast("long").alias("target"))

        left = self.find_range(at(F.col("frac"))).withColumnRenamed("item", "_l")
        right = self.find_range_from_right(at(F.lit(1.0) - F.col("frac"))).withColumnRenamed("item", "_r")
        met = left.join(right, "target_id").select(
            F.col("target_id").alias("frac"), F.shiftright(F.col("_l") + F.col("_r"), 1).alias("_m"))
        outside = F.when(F.col("frac") < 0, F.lit(0)).when(F.col("frac") > 1, F.lit(self.h.top))
        return rows.join(met, "frac", "left").select(
            "target_id", F.coalesce("_m", outside).cast("long").alias("item"))

    def second_moment(self) -> DataFrame:
        """One row ``(est)``: smallest row-wise sum of squares at level 0, which is sketched."""
        cells, sums = _square_sums(self.level_cells(0), self.h.depth)
        return cells.agg((F.least(*sums) if len(sums) > 1 else sums[0]).alias("est"))

    def size(self) -> DataFrame:
        """One row: bytes of the dense form."""
        h = self.h
        sketched = h.exact_from
        counts = sketched * h.width * h.depth * WHOLE_CELL_BYTES + sum(
            (1 << (h.gran * (h.levels - i))) * WHOLE_CELL_BYTES
            for i in range(sketched, h.levels))
        hashes = sketched * h.depth * 2 * COEFFICIENT_BYTES
        dense = CM_HEADER_BYTES + 2 * h.levels * POINTER_BYTES + counts + hashes
        return self.cells().where(F.col("level") < h.levels).agg(
            F.lit(dense).cast("long").alias("bytes"), F.count(F.lit(1)).alias("stored_cells"))


def _square_sums(cells: DataFrame, depth: int) -> tuple[DataFrame, list[Column]]:
    c = F.col("c").cast("decimal(19,0)")
    return cells, [
        F.coalesce(F.sum(F.when(F.col("row") == r, c * c)), F.lit(0)).cast(WIDE)
        for r in range(depth)
    ]


@dataclass(frozen=True)
class DyadicCountSketch(_Levels):
    """Hierarchical Count Sketch; the same signed hashes on every level.

    Estimates are two-sided: an item may be over- or underestimated, or missed.
    """

    signed = True

    @property
    def coeffs(self) -> tuple[tuple[int, int, int, int], ...]:
        return coefficients(self.h.seed, self.h.depth, 4)

    @property
    def shape(self) -> SketchShape:
        return SketchShape(self.h.width, self.h.depth, self.h.seed,
                           tuple((c[0], c[1]) for c in self.coeffs))

    def level_cells(self, level: int) -> DataFrame:
        """``(row, bucket, c)``: signed cells of one level."""
        if self.stored is not None:
            return self._stored_level(level).select("row", "bucket", "c")
        x = level_prefix(F.col("item"), self.h.gran, level)
        placed = place(self.totals, self.shape, x, F.col("total").alias("_w"), signs=self.coeffs)
        return placed.groupBy("row", "bucket").agg(
            F.sum(F.col("sign") * F.col("_w")).alias("c"))

    def _median(self, signed: list[Column]) -> Column:
        if len(signed) == 1:
            return signed[0]
        if len(signed) == 2:
            s = signed[0] + signed[1]
            return F.call_function("div", s, F.lit(2))
        return pick_sorted(signed, self.h.depth // 2)

    def count(self, prefixes: DataFrame, level: int) -> DataFrame:
        """Add ``est`` to a table with ``prefix``: the median signed cell at ``level``.

        Every row comes back once, repeated ones too.
        """
        if level < self.h.levels:
            return self._estimate(prefixes, level, "prefix")
        return prefixes.withColumn("est", self.total().scalar())

    def _count(self, prefixes: DataFrame, level: int) -> DataFrame:
        """As :meth:`count`, for rows of which no two are equal."""
        if level >= self.h.levels:
            return prefixes.withColumn("est", self.total().scalar())
        names = [f"_c{r}" for r in range(self.h.depth)]
        met = probe(prefixes, self.shape, self.level_cells(level), F.col("prefix"),
                    signs=self.coeffs)
        found = met.groupBy(*prefixes.columns).agg(*row_values(F.col("c"), names))
        est = self._median([F.col(n) for n in names])
        return found.select(*prefixes.columns, est.cast("long").alias("est"))

    def point(self, items: DataFrame, item: str = "item") -> DataFrame:
        """Add ``est``, the estimated total of each item."""
        return self._estimate(items, 0, item)

    def _estimate(self, keys: DataFrame, level: int, key: str) -> DataFrame:
        found, names = item_cells(keys, self.shape, self.level_cells(level), F.col(key))
        signed = [sign_hash(c[2], c[3], F.col(key)) * F.col(n)
                  for c, n in zip(self.coeffs, names)]
        return found.select(*keys.columns, self._median(signed).cast("long").alias("est"))

    def heavy_hitters(self, thr: Column) -> DataFrame:
        """``(item, est)`` of ids whose own and whose ancestors' estimates reach ``thr``."""
        h = self.h
        frontier = self.total().select(
            F.lit(0).cast("long").alias("prefix"), F.col("n").alias("est")
        ).where(F.col("est") >= thr)
        for level in reversed(range(h.levels)):
            opened = _children(_spread_frontier(frontier, h), h, level)
            frontier = self._count(opened, level).where(F.col("est") >= thr)
        return frontier.select(F.col("prefix").alias("item"), "est")

    def second_moment(self) -> DataFrame:
        """One row ``(est)``: median row-wise sum of squares at level 0."""
        cells, sums = _square_sums(self.level_cells(0), self.h.depth)
        if len(sums) == 1:
            est = sums[0]
        elif len(sums) == 2:
            est = F.floor((sums[0] + sums[1]) / 2)
        else:
            est = pick_sorted(sums, self.h.depth // 2)
        return cells.agg(est.cast(WIDE).alias("est"))

    def size(self) -> DataFrame:
        """One row: bytes of the dense form."""
        h = self.h
        dense = ((h.bits + 1) * POINTER_BYTES
                 + h.levels * h.width * h.depth * WHOLE_CELL_BYTES
                 + h.depth * 4 * COEFFICIENT_BYTES + CS_HEADER_BYTES)
        return self.cells().where(F.col("level") < h.levels).agg(
            F.lit(dense).cast("long").alias("bytes"), F.count(F.lit(1)).alias("stored_cells"))
