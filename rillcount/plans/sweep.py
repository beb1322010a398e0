"""Parameter sweeps: many settings of a summary over one pass of the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcount.functions.hashing import bucket, coefficients
from rillcount.operators.counters import FAN, Budget
from rillcount.operators.exact import stream_total
from rillcount.operators.linear import SketchShape, place
from rillcount.plans.evaluate import scores
from rillcount.session import cut_lineage, fits_broadcast

# The settings of the reference's sweeps.
EPSILON_EXPONENTS = tuple(range(10, 21))
GAMMA_EXPONENTS = tuple(range(-4, 5))
GAMMA_PHI_EXPONENT = 15
SKEWS = tuple(round(0.1 * i, 1) for i in range(1, 21))
SKEW_GAMMAS = (4.0, 1.0)
# Bits of a cell's number that hold its bucket.
BUCKET_BITS = 32


def sweep_counters(totals: DataFrame, settings: Mapping[tuple[str, float], tuple[float, Budget]],
                   groups: Sequence[str] = ()) -> DataFrame:
    """``(*groups, method, param, n, delta, hh, claimed, recall, precision, re_true, re_false)``.

    ``settings`` maps ``(method, param)`` to ``(phi, budget)``; ``totals`` holds
    exact totals, of one stream or of one per ``groups``, which are pruned once: what is left of
    streams whose exact totals are at hand (:func:`sweep_summaries` builds from updates). What a budget prunes, and
    which heavy hitters survive it, follows from the counts by value, a table of at
    most ``sqrt(2 N)`` rows per stream; only that small table is opened per setting.
    An item that survives has its exact total as estimate, so nothing else is
    claimed.
    """
    groups = list(groups)
    by_value = totals.groupBy(*groups, F.col("total").alias("v")).agg(
        F.count(F.lit(1)).alias("m"))
    stream = Window.partitionBy(*groups)
    largest_first = stream.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = by_value.select(
        *groups, "v", "m", F.sum("m").over(largest_first).alias("above"),
        F.sum("m").over(stream).alias("items"),
        F.sum(F.col("v") * F.col("m")).over(stream).cast("long").alias("n"))
    tried = F.array(*[
        F.struct(
            F.lit(method).alias("method"), F.lit(float(param)).alias("param"),
            F.lit(float(phi)).alias("phi"), F.lit(b.counters).cast("long").alias("counters"),
            F.lit(b.capacity).cast("long").alias("capacity"))
        for (method, param), (phi, b) in settings.items()])
    opened = ranked.select("*", F.explode(tried).alias("t")).select("*", "t.*").drop("t")
    over = F.col("items") > F.col("capacity")
    cut = over & (F.col("above") >= F.col("counters"))
    hit = F.col("v") >= F.floor(F.col("phi") * F.col("n")) + 1
    counted = opened.groupBy(*groups, "method", "param", "n").agg(
        F.coalesce(F.max(F.when(cut, F.col("v"))), F.lit(0)).cast("long").alias("delta"),
        F.coalesce(F.sum(F.when(hit, F.col("m"))), F.lit(0)).cast("long").alias("hh"),
        F.coalesce(F.sum(F.when(hit & ~cut, F.col("m"))), F.lit(0)).cast("long").alias("claimed"))
    return counted.select(
        *groups, "method", "param", "n", "delta", "hh", "claimed",
        F.when(F.col("hh") == 0, F.lit(100.0)).otherwise(
            F.lit(100.0) * F.col("claimed") / F.nullif(F.col("hh"), F.lit(0))).alias("recall"),
        F.lit(100.0).alias("precision"), F.lit(0.0).alias("re_true"),
        F.lit(0.0).alias("re_false"))


def _cuts(by_value: DataFrame, budgets: Sequence[Budget]) -> DataFrame:
    """``(block, deltas)``: what a prune by each budget takes off, from ``(block, i, v, m)``.

    ``m`` residuals of block ``block`` have the value ``v`` under budget ``i``.
    """
    def of(name: str, i: str):
        return F.get(F.array(*[F.lit(getattr(b, name)).cast("long") for b in budgets]), F.col(i))

    largest_first = Window.partitionBy("block", "i").orderBy(F.col("v").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = by_value.withColumn("above", F.sum("m").over(largest_first))
    kth = F.max(F.when(F.col("above") >= of("counters", "i"), F.col("v")))
    cut = ranked.groupBy("block", "i").agg(kth.alias("kth"), F.sum("m").alias("items")).select(
        "block", "i", F.when(F.col("items") > of("capacity", "i"), F.col("kth")).alias("delta"))
    return cut_lineage(cut.groupBy("block").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("i") == k, F.col("delta"))), F.lit(0).cast("long"))
        for k in range(len(budgets))]).alias("deltas")))


def summaries(updates: DataFrame, budgets: Sequence[Budget], fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Counter summaries of one stream under many budgets at once: ``(item, rs)`` and one row ``(qs)``.

    As :func:`~rillcount.operators.counters.summarise_blocks` of ``(item, weight, block)`` for every
    budget, but an item stays one row, with an array that holds its residual under each of them.
    Only different values are ranked per setting: those of a block's sums are opened
    after they are counted, and those of merged residuals are counted in the tasks that open them.
    """
    n = len(budgets)
    settings = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    count = F.count(F.lit(1)).alias("m")

    def added(name: str):
        return F.array(*[F.sum(F.col(name)[k]) for k in range(n)]).alias(name)

    sums = cut_lineage(updates.where("item IS NOT NULL AND weight IS NOT NULL").groupBy("block", "item").agg(
        F.sum("weight").alias("x")))
    blocks = (sums.agg(F.max("block")).first()[0] or 0) + 1
    cuts = _cuts(sums.where("x > 0").groupBy("block", F.col("x").alias("v")).agg(count).select(
        "block", settings, "v", "m"), budgets)
    rows = sums.join(cuts, "block").select("block", "item", F.transform(
        "deltas", lambda d: F.greatest(F.col("x") - d, F.lit(0))).alias("rs"))
    errors = cuts.select("block", F.col("deltas").alias("qs"))
    while blocks > 1:
        blocks = -(-blocks // fan)
        group = F.expr(f"block div {fan}").alias("block")
        rows = cut_lineage(rows.where(F.array_max("rs") > 0).groupBy(group, "item").agg(added("rs")))
        cuts = _cuts(rows.select("block", F.posexplode("rs").alias("i", "v")).where("v > 0").groupBy(
            "block", "i", "v").agg(count), budgets)
        rows = rows.join(cuts, "block").select("block", "item", F.zip_with(
            "rs", "deltas", lambda r, d: F.greatest(r - d, F.lit(0))).alias("rs"))
        errors = cut_lineage(errors.groupBy(group).agg(added("qs")).join(cuts, "block", "left").select(
            "block", F.coalesce(F.zip_with("qs", "deltas", lambda q, d: q + d), "qs").alias("qs")))
    return rows.select("item", "rs"), errors.agg(F.array(*[
        F.coalesce(F.sum(F.col("qs")[k]), F.lit(0)).cast("long") for k in range(n)]).alias("qs"))


def sweep_summaries(updates: DataFrame, totals: DataFrame,
                    settings: Mapping[tuple[str, float], tuple[float, Budget]]) -> DataFrame:
    """``(method, param, n, q, claimed, correct, hh, recall, precision, re_true, re_false)``.

    ``settings`` maps ``(method, param)`` to ``(phi, budget)``. Summaries are built from ``updates``
    in blocks and their heavy hitters judged by the exact ``totals`` of the same stream.
    """
    names, phis, budgets = list(settings), [p for p, _ in settings.values()], [b for _, b in settings.values()]
    items, errors = summaries(updates, budgets)
    n = stream_total(totals).scalar()
    thrs = [(F.floor(F.lit(float(phi)) * n) + 1).cast("long") for phi in phis]
    qs = errors.scalar()
    # Only settings in which an item is claimed are opened.
    claims = items.select("item", "rs", qs.alias("qs"), F.array(*thrs).alias("thrs")).select(
        "item", F.explode(F.filter(F.transform("rs", lambda r, i: F.struct(
            i.alias("i"), r.alias("r"), (r + F.get("qs", i)).alias("est"), F.get("thrs", i).alias("thr"))),
            lambda s: (s["r"] > 0) & (s["est"] >= s["thr"]))).alias("s")).select("item", "s.i", "s.est", "s.thr")
    met = claims.join(totals, "item").withColumn("hit", F.col("total") >= F.col("thr"))
    error = F.abs(F.col("est") - F.col("total")) / F.nullif(F.col("total"), F.lit(0))
    scored = met.groupBy("i").agg(
        F.count(F.lit(1)).alias("claimed"), F.count(F.when(F.col("hit"), 1)).alias("correct"),
        F.avg(F.when(F.col("hit"), error)).alias("_rt"), F.avg(F.when(~F.col("hit"), error)).alias("_rf"))
    heavy = totals.agg(F.array(*[F.count(F.when(F.col("total") >= t, 1)) for t in thrs]).alias("hhs"))
    tried = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(p)).alias("param")) for m, p in names])
    every = heavy.select(n.alias("n"), qs.alias("qs"), "hhs", F.posexplode(tried).alias("i", "s")).select(
        "i", "s.*", "n", F.get("qs", F.col("i")).alias("q"), F.get("hhs", F.col("i")).alias("hh"))
    zero = F.lit(0).cast("long")
    return scores(every.join(scored, "i", "left").withColumns({
        c: F.coalesce(c, zero) for c in ("claimed", "correct")}), ["method", "param", "n", "q"])


def epsilon_settings(exponents: Sequence[int] = EPSILON_EXPONENTS, gamma: float = 4.0):
    """Settings of the sweep over epsilon: phi = 2^-10 to 2^-20."""
    made = {}
    for e in exponents:
        phi = 2.0 ** -e
        made[("im_sum", phi)] = (phi, Budget.im_sum(phi, gamma))
        made[("dim_sum", phi)] = (phi, Budget.dim_sum(phi, gamma))
        made[("space_saving", phi)] = (phi, Budget.space_saving(phi))
    return made


def gamma_settings(exponents: Sequence[int] = GAMMA_EXPONENTS,
                   phi: float = 2.0 ** -GAMMA_PHI_EXPONENT):
    """Settings of the sweep over gamma: 2^-4 to 2^4 at one phi."""
    made = {}
    for e in exponents:
        gamma = 2.0 ** e
        made[("im_sum", gamma)] = (phi, Budget.im_sum(phi, gamma))
        made[("dim_sum", gamma)] = (phi, Budget.dim_sum(phi, gamma))
    return made


def _cell_key(i: int, row: int, depth: int) -> int:
    """What is added to a bucket, so that one number names a cell among the sketches of all settings."""
    return (i * depth + row) << BUCKET_BITS


def own_cells(totals: DataFrame, shapes: Sequence[SketchShape]) -> DataFrame:
    """``(cell, c)``: the cells of a sketch for each of ``shapes``, all of one depth, by one aggregation."""
    rows = ", ".join(
        f"named_struct('k', {_cell_key(i, row, shape.depth)}L, 'width', {shape.width}L, 'a', {a}L, 'b', {b}L)"
        for i, shape in enumerate(shapes) for row, (a, b) in enumerate(shape.coeffs))
    opened = totals.select("item", "total", F.expr(f"explode(array({rows}))").alias("h"))
    cell = F.col("h.k") + bucket(F.col("h.a"), F.col("h.b"), F.col("item"), F.col("h.width"))
    return opened.select(cell.alias("cell"), "total").groupBy("cell").agg(F.sum("total").alias("c"))


def own_claims(totals: DataFrame, shapes: Sequence[SketchShape], heavy: DataFrame) -> DataFrame:
    """``(item, total, i, cells)``: the settings in which all cells of an item are among the ``heavy`` ones.

    The heavy cells are marked in words of 64 bits, whose number is bounded by the widths;
    they are broadcast if that bound fits, so that items are tested without a shuffle.
    """
    depth = shapes[0].depth
    marks = heavy.groupBy(F.shiftright("cell", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS int))")).alias("_bits"))
    if fits_broadcast(totals.sparkSession, sum(-(-shape.width // 64) * depth for shape in shapes), 40):
        marks = F.broadcast(marks)
    settings = ", ".join(
        f"named_struct('i', {i}, 'width', {shape.width}L, " + ", ".join(
            f"'k{row}', {_cell_key(i, row, depth)}L, 'a{row}', {a}L, 'b{row}', {b}L"
            for row, (a, b) in enumerate(shape.coeffs)) + ")"
        for i, shape in enumerate(shapes))
    cells = [f"_c{row}" for row in range(depth)]
    met = totals.select("item", "total", F.expr(f"explode(array({settings}))").alias("h")).select(
        "item", "total", "h.i", *[
            (F.col(f"h.k{row}") + bucket(F.col(f"h.a{row}"), F.col(f"h.b{row}"), F.col("item"), F.col("h.width")))
            .alias(name) for row, name in enumerate(cells)])
    for name in cells:
        side = marks.select(F.col("_word").alias(f"_w{name}"), F.col("_bits").alias(f"_b{name}"))
        met = met.join(side, F.shiftright(name, 6) == F.col(f"_w{name}")).where(
            F.expr(f"shiftright(_b{name}, cast({name} & 63 AS int)) & 1L = 1L"))
    return met.select("item", "total", "i", F.array(*cells).alias("cells"))


def sweep_count_min(totals: DataFrame, settings: Mapping[float, float], depth: int, seed: int) -> DataFrame:
    """``(method, param, hh, claimed, recall, precision, re_true, re_false)`` of Count-Min.

    ``settings`` maps a parameter to phi; each setting has a sketch of its own, of width
    ``2 / phi`` and with hashes of its own. An estimate, the least of an item's cells, reaches the
    threshold just when all of them do, so cells are joined only with the items that are claimed.
    """
    phis = F.array(*[F.lit(float(phi)) for phi in settings.values()])
    shapes = [SketchShape(int(2.0 / phi), depth, seed + i) for i, phi in enumerate(settings.values())]
    n = stream_total(totals).scalar()

    def thr(i: Column) -> Column:
        return (F.floor(F.get(phis, i) * n) + 1).cast("long")

    setting = F.expr(f"cast(shiftright(cell, {BUCKET_BITS}) div {depth} AS int)")
    heavy = own_cells(totals, shapes).where(F.col("c") >= thr(setting))
    claims = own_claims(totals, shapes, heavy).select("item", "total", "i", F.explode("cells").alias("cell"))
    estimated = claims.join(heavy, "cell").groupBy("item", "total", "i").agg(F.min("c").alias("est"))
    hit = F.col("total") >= thr(F.col("i"))
    error = F.abs(F.col("est") - F.col("total")) / F.nullif(F.col("total"), F.lit(0))
    counted = estimated.groupBy("i").agg(
        F.count(F.lit(1)).alias("claimed"), F.count(F.when(hit, 1)).alias("correct"),
        F.avg(F.when(hit, error)).alias("_rt"), F.avg(F.when(~hit, error)).alias("_rf"))
    every = totals.agg(F.array(*[
        F.struct(F.lit(float(param)).alias("param"), F.count(F.when(F.col("total") >= thr(F.lit(i)), 1)).alias("hh"))
        for i, param in enumerate(settings)]).alias("s")).select(F.posexplode("s").alias("i", "s")).select(
        "i", F.lit("count_min").alias("method"), "s.param", "s.hh")
    zero = F.lit(0).cast("long")
    judged = every.join(counted, "i", "left").withColumns({c: F.coalesce(c, zero) for c in ("claimed", "correct")})
    return scores(judged, ["method", "param"]).drop("correct")


def folded_estimates(totals: DataFrame, widths: Sequence[int], depth: int, seed: int,
                     signed: bool = False) -> DataFrame:
    """``(item, total, ests)``: estimates of every item by sketches of all ``widths``, narrowest first.

    Each width has to divide the next. Only the widest sketch is built; a narrower one is the
    same with buckets equal modulo its width added up, so all share their hashes, and a cell
    carries the counts of all widths in an array. ``signed`` gives Count Sketch instead
    of Count-Min. An item is opened once per sketch row, however many widths there are.
    """
    if any(b % a for a, b in zip(widths, widths[1:])):
        raise ValueError("each width has to divide the next")
    shape = SketchShape(widths[-1], depth, seed)
    signs = coefficients(seed, depth, 4) if signed else ()
    placed = place(totals, shape, F.col("item"), F.col("item"), F.col("total"), signs=signs)
    value = F.col("total") * F.col("sign") if signed else F.col("total")
    cells = placed.groupBy("row", "bucket").agg(F.sum(value).alias("c"))
    # Buckets that are equal modulo the narrowest width stay together, so one shuffle serves all windows.
    parts = [f"_b{i}" for i in range(len(widths))]
    nested = cells.select("*", *[
        F.pmod("bucket", F.lit(w).cast("long")).alias(p) for w, p in zip(widths, parts)]).repartition("row", parts[0])
    sums = [F.sum("c").over(Window.partitionBy("row", *parts[:i + 1])) for i in range(len(widths) - 1)]
    nested = nested.select("row", "bucket", F.array(*sums, F.col("c")).alias("cs"))
    met = placed.join(nested, ["row", "bucket"])
    if not signed:
        return met.groupBy("item", "total").agg(
            F.array(*[F.min(F.col("cs")[i]) for i in range(len(widths))]).alias("ests"))
    rows = met.groupBy("item", "total").agg(
        F.collect_list(F.transform("cs", lambda c: c * F.col("sign"))).alias("vs"))

    def middle(i: int):
        ordered = F.sort_array(F.transform("vs", lambda v: v[i]))
        return F.call_function("div", ordered[0] + ordered[1], F.lit(2)) if depth == 2 else ordered[depth // 2]

    return rows.select("item", "total", F.array(*map(middle, range(len(widths)))).alias("ests"))


def sweep_folded(totals: DataFrame, phis: Sequence[float], depth: int, seed: int,
                 signed: bool = False) -> DataFrame:
    """``(method, param, hh, claimed, recall, precision, re_true, re_false)`` of Count-Min or Count Sketch.

    Each phi, a power of two, has a sketch of width ``2 / phi``, folded from the widest.
    """
    phis = sorted(phis, reverse=True)
    estimated = folded_estimates(totals, [int(2.0 / phi) for phi in phis], depth, seed, signed)
    n = stream_total(totals).scalar()
    thrs = F.array(*[(F.floor(F.lit(float(phi)) * n) + 1).cast("long") for phi in phis])
    # Settings in which an item is neither claimed nor heavy are dropped before the array is opened.
    known = estimated.select("total", "ests", thrs.alias("thrs")).select("total", F.zip_with(
        "ests", "thrs", lambda e, t: F.struct(e.alias("est"), t.alias("thr"))).alias("s"))
    known = known.select("total", F.filter(F.transform("s", lambda s, i: F.struct(
        i.alias("i"), s["est"].alias("est"), s["thr"].alias("thr"))),
        lambda s: (s["est"] >= s["thr"]) | (F.col("total") >= s["thr"])).alias("s"))
    opened = known.select("total", F.explode("s").alias("s")).select("total", "s.*")
    hit, claim = F.col("total") >= F.col("thr"), F.col("est") >= F.col("thr")
    error = F.abs(F.col("est") - F.col("total")) / F.nullif(F.col("total"), F.lit(0))
    counted = opened.groupBy("i").agg(
        F.count(F.when(hit, 1)).alias("hh"), F.count(F.when(claim, 1)).alias("claimed"),
        F.count(F.when(hit & claim, 1)).alias("correct"),
        F.avg(F.when(hit & claim, error)).alias("_rt"), F.avg(F.when(~hit & claim, error)).alias("_rf"))
    spark, zero = totals.sparkSession, F.lit(0).cast("long")
    every = spark.range(len(phis)).select(
        F.col("id").cast("int").alias("i"), F.lit("count_sketch" if signed else "count_min").alias("method"),
        F.get(F.array(*[F.lit(float(p)) for p in phis]), F.col("id").cast("int")).alias("param"))
    judged = every.join(counted, "i", "left").withColumns({c: F.coalesce(c, zero) for c in ("hh", "claimed", "correct")})
    return scores(judged, ["method", "param"]).drop("correct")


def average_repeats(results: DataFrame, value: str = "value") -> DataFrame:
    """``(method, param, mean)`` over repeats, leaving out repeats with an infinity.

    ``results`` holds ``(repeat, method, param, value)``. One infinite value removes
    its whole repeat, for all methods.
    """
    infinite = F.col(value).isin(float("inf"), float("-inf"))
    broken = results.where(infinite).select("repeat").distinct()
    return results.join(broken, "repeat", "left_anti").groupBy("method", "param").agg(
        F.avg(value).alias("mean"))
