"""Count-Min sketches kept as ordinary DataFrames of cells.

A sketch is ``(row, bucket, c)`` with one row per non-empty cell. It is linear:
building is a ``groupBy().sum()``, merging a union of the same, and a point query
a join of the item's buckets with the cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcount.functions.hashing import (
    bucket, bucket_hashes, coefficient_rows, coefficients, sign_hash,
)
from rillcount.operators.exact import item_totals
from rillcount.session import fits_broadcast

# Bytes of the record that describes a sketch, of one hash
# coefficient, and of one cell holding a whole or a floating-point count.
HEADER_BYTES = 40
COEFFICIENT_BYTES = 4
WHOLE_CELL_BYTES = 4
FLOAT_CELL_BYTES = 8


@dataclass(frozen=True)
class SketchShape:
    """Width, depth and hash coefficients; equal shapes may be combined."""

    width: int
    depth: int
    seed: int = 1
    coeffs: tuple[tuple[int, int], ...] = field(default=())

    def __post_init__(self):
        if self.width < 1 or self.depth < 1:
            raise ValueError("width and depth must be positive")
        if not self.coeffs:
            object.__setattr__(self, "coeffs", coefficients(self.seed, self.depth, 2))

    def compatible(self, other: "SketchShape") -> bool:
        return (self.width, self.depth, self.coeffs) == (other.width, other.depth, other.coeffs)

    def buckets(self, item: Column) -> list[Column]:
        return bucket_hashes(item, self.coeffs, self.width)


def add_cells(totals: DataFrame, shape: SketchShape, item: Column, weight: Column) -> DataFrame:
    """``(row, bucket, c)`` from totals or single updates.

    All rows of an item come out of one generator, and the sum has a map-side
    half, so a task sends at most ``width * depth`` rows to the shuffle.
    """
    placed = place(totals.where(item.isNotNull()), shape, item, weight.alias("_w"))
    return placed.groupBy("row", "bucket").agg(F.sum("_w").alias("c"))


def place(rows: DataFrame, shape: SketchShape, item: Column, *kept: Column,
          signs: Sequence[Sequence[int]] = ()) -> DataFrame:
    """``(row, bucket, *kept)``: every row of the input once per sketch row.

    ``signs`` gives all four coefficients of each sketch row; the item's ``sign`` in
    that row is then added.
    """
    opened = rows.select(item.alias("_x"), *kept, coefficient_rows(signs or shape.coeffs))
    names = [c for c in opened.columns if c not in ("_x", "h")]
    cell = bucket(F.col("h.a"), F.col("h.b"), F.col("_x"), shape.width)
    sign = [sign_hash(F.col("h.c"), F.col("h.d"), F.col("_x")).alias("sign")] if signs else []
    return opened.select(F.col("h.row").alias("row"), cell.alias("bucket"), *names, *sign)


def packed_cells(cells: DataFrame, depth: int) -> DataFrame:
    """``(bucket, cs)``: the counts of all rows of one bucket side by side."""
    zero = F.lit(0).cast(cells.schema["c"].dataType)
    return cells.groupBy("bucket").agg(
        F.array(*[
            F.coalesce(F.max(F.when(F.col("row") == r, F.col("c"))), zero) for r in range(depth)
        ]).alias("cs")
    )


def item_cells(keys: DataFrame, shape: SketchShape, cells: DataFrame,
               item: Column) -> tuple[DataFrame, list[str]]:
    """``keys`` with one extra column per sketch row holding the item's cell.

    The packed cells have at most ``width`` rows. When that bound fits the
    session's broadcast limit, every row of the sketch probes the same broadcast
    table and the keys are not shuffled at all. Beyond it, the cells of each
    distinct item are gathered by one shuffled join and joined back. A null item
    has null cells either way.
    """
    zero = F.lit(0).cast(cells.schema["c"].dataType)
    names = [f"_c{r}" for r in range(shape.depth)]
    kept = keys.columns
    if not fits_broadcast(keys.sparkSession, shape.width, 48 + 8 * shape.depth):
        distinct = keys.select(item.alias("_i")).distinct()
        met = probe(distinct, shape, cells, F.col("_i"))
        gathered = met.groupBy("_i").agg(*row_values(F.col("c"), names))
        return keys.withColumn("_j", item).join(
            gathered, F.col("_j") == F.col("_i"), "left").drop("_i", "_j"), names
    packed = F.broadcast(packed_cells(cells, shape.depth))
    found = keys.select("*", *[
        b.alias(f"_b{r}") for r, b in enumerate(shape.buckets(item))])
    for r in range(shape.depth):
        side = packed.select(F.col("bucket").alias(f"_k{r}"), F.col("cs").alias(f"_s{r}"))
        found = found.join(side, F.col(f"_b{r}") == F.col(f"_k{r}"), "left")
    return found.select(*kept, *[
        F.when(item.isNotNull(), F.coalesce(F.col(f"_s{r}")[r], zero)).alias(name)
        for r, name in enumerate(names)]), names


def probe(keys: DataFrame, shape: SketchShape, cells: DataFrame, item: Column,
          how: str = "left", signs: Sequence[Sequence[int]] = ()) -> DataFrame:
    """Every row of ``keys`` once per sketch row, with ``row`` and the cell ``c`` it meets.

    The cells, at most ``width * depth`` of them, are broadcast if that bound fits.
    With ``signs``, cells come multiplied by the item's sign.
    """
    def cell() -> Column:
        return F.col("row") * F.lit(shape.width).cast("long") + F.col("bucket")

    side = cells.select(cell().alias("_cell"), "c")
    if fits_broadcast(keys.sparkSession, shape.width * shape.depth, 40):
        side = F.broadcast(side)
    placed = place(keys, shape, item, *[F.col(c) for c in keys.columns], signs=signs)
    value = F.coalesce("c", F.lit(0).cast(cells.schema["c"].dataType))
    if signs:
        value = value * F.col("sign")
    return placed.withColumn("_cell", cell()).join(side, "_cell", how).select(
        *keys.columns, "row", value.alias("c"))


def row_values(value: Column, names: list[str]) -> list[Column]:
    """Aggregates that lay the values of all sketch rows of one key side by side."""
    return [F.max(F.when(F.col("row") == r, value)).alias(n) for r, n in enumerate(names)]


def smallest(columns: list[str]) -> Column:
    return F.least(*columns) if len(columns) > 1 else F.col(columns[0])


def pick_sorted(columns: list[Column], index: int) -> Column:
    """Element ``index`` (0-based) of the columns of one row in ascending order."""
    return F.sort_array(F.array(*columns))[index]


@dataclass(frozen=True)
class CountMin:
    """A Count-Min sketch over whole, decimal or floating-point weights."""

    shape: SketchShape
    cells: DataFrame

    @classmethod
    def build(cls, updates: DataFrame, shape: SketchShape, item: str = "item",
              weight: str = "weight", per_item_first: bool = True) -> "CountMin":
        """Weights are by default summed per item first, so hashing runs once per item.

        Leave that out if few items repeat: then only cells are shuffled, at most
        ``width * depth`` per task, at the price of hashing every update.
        """
        if per_item_first:
            return cls.from_totals(item_totals(updates, item, weight), shape)
        return cls(shape, add_cells(updates, shape, F.col(item), F.col(weight)))

    @classmethod
    def from_totals(cls, totals: DataFrame, shape: SketchShape) -> "CountMin":
        return cls(shape, add_cells(totals, shape, F.col("item"), F.col("total")))

    def empty_like(self) -> "CountMin":
        """A sketch with the same hashes and no content."""
        return CountMin(self.shape, self.cells.limit(0))

    def compatible(self, other: "CountMin") -> bool:
        return self.shape.compatible(other.shape)

    def _require(self, other: "CountMin") -> None:
        if not self.compatible(other):
            raise ValueError("sketches differ in width, depth or hash coefficients")

    def merge(self, other: "CountMin") -> "CountMin":
        self._require(other)
        both = self.cells.unionByName(other.cells)
        return CountMin(self.shape, both.groupBy("row", "bucket").agg(F.sum("c").alias("c")))

    def fold(self, width: int) -> "CountMin":
        """The sketch of a smaller width that divides this one, from its cells alone.

        A bucket is a hash modulo the width, so buckets equal modulo the smaller width fall together.
        """
        if width < 1 or self.shape.width % width:
            raise ValueError(f"{width} does not divide the width {self.shape.width}")
        narrow = self.cells.select("row", F.pmod(F.col("bucket"), F.lit(width).cast("long")).alias("bucket"), "c")
        return CountMin(replace(self.shape, width=width), narrow.groupBy("row", "bucket").agg(F.sum("c").alias("c")))

    def total(self) -> DataFrame:
        """One row ``(n)``: any one row of the sketch holds the whole weight."""
        return self.cells.where("row = 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))

    def point(self, items: DataFrame, item: str = "item") -> DataFrame:
        """Add ``est``, the smallest cell over all rows; never below a non-negative truth."""
        found, names = item_cells(items, self.shape, self.cells, F.col(item))
        return found.withColumn("est", smallest(names)).drop(*names)

    def point_median(self, items: DataFrame, item: str = "item") -> DataFrame:
        """Add ``est``, the median cell; meant for streams with removals."""
        found, names = item_cells(items, self.shape, self.cells, F.col(item))
        c = [F.col(n) for n in names]
        if len(c) == 1:
            est = c[0]
        elif len(c) == 2:
            est = F.when(F.abs(c[0]) < F.abs(c[1]), c[0]).otherwise(c[1])
        else:
            est = pick_sorted(c, self.shape.depth // 2)
        return found.withColumn("est", est).drop(*names)

    def point_product(self, other: "CountMin", items: DataFrame, item: str = "item") -> DataFrame:
        """Add ``est``, the smallest product of both sketches' cells of the item."""
        self._require(other)
        mine, names = item_cells(items, self.shape, self.cells, F.col(item))
        mine = mine.withColumnsRenamed({n: f"_m{n}" for n in names})
        both, _ = item_cells(mine, self.shape, other.cells, F.col(item))
        products = [F.col(f"_m{n}") * F.col(n) for n in names]
        est = F.least(*products) if len(products) > 1 else products[0]
        return both.withColumn("est", est).drop(*names, *[f"_m{n}" for n in names])

    def _square_type(self) -> str:
        kind = self.cells.schema["c"].dataType.simpleString()
        return "decimal(19,0)" if kind in ("bigint", "int") else kind

    def _row_sums(self, rows: DataFrame, value: Column) -> list[Column]:
        zero = F.lit(0)
        return [F.coalesce(F.sum(F.when(F.col("row") == r, value)), zero)
                for r in range(self.shape.depth)]

    def inner_product(self, other: "CountMin") -> DataFrame:
        """One row ``(est)``: smallest row-wise product sum, an upper join-size estimate."""
        self._require(other)
        kind = self._square_type()
        a = self.cells.select("row", "bucket", F.col("c").cast(kind).alias("_a"))
        b = other.cells.select("row", "bucket", F.col("c").cast(kind).alias("_b"))
        met = a.join(b, ["row", "bucket"])
        sums = self._row_sums(met, F.col("_a") * F.col("_b"))
        est = F.least(*sums) if len(sums) > 1 else sums[0]
        return met.agg(est.alias("est"))

    def second_moment(self) -> DataFrame:
        """One row ``(est)`` from squared differences of neighbouring cells."""
        if self.shape.width % 2:
            raise ValueError("the second-moment estimate pairs cells and needs an even width")
        signed = F.when(F.col("bucket") % 2 == 0, F.col("c")).otherwise(-F.col("c"))
        pairs = self.cells.groupBy("row", F.shiftright("bucket", 1).alias("pair")).agg(
            F.sum(signed).cast(self._square_type()).alias("d"))
        sums = self._row_sums(pairs, F.col("d") * F.col("d"))
        rank = max((self.shape.depth + 1) // 2 - 1, 0)
        return pairs.agg(pick_sorted(sums, rank).alias("est"))

    def residue(self, items: DataFrame, item: str = "item") -> DataFrame:
        """One row ``(est)``: weight outside the cells the listed items touch."""
        touched = place(items, self.shape, F.col(item))
        left = self.cells.join(touched, ["row", "bucket"], "left_anti")
        sums = self._row_sums(left, F.col("c"))
        return left.agg(F.greatest(*sums, F.lit(0)).alias("est"))

    def size(self, cell_bytes: int = WHOLE_CELL_BYTES) -> DataFrame:
        """One row: dense size in bytes, and how many cells are really stored."""
        shape = self.shape
        dense = (HEADER_BYTES + shape.width * shape.depth * cell_bytes
                 + shape.depth * 2 * COEFFICIENT_BYTES)
        return self.cells.agg(
            F.lit(dense).cast("long").alias("bytes"), F.count(F.lit(1)).alias("stored_cells"))


def merge_all(sketches: list[CountMin]) -> CountMin:
    """Merge any number of compatible sketches with one shuffle."""
    first = sketches[0]
    for other in sketches[1:]:
        first._require(other)
    cells = reduce(DataFrame.unionByName, [s.cells for s in sketches])
    return CountMin(first.shape, cells.groupBy("row", "bucket").agg(F.sum("c").alias("c")))
