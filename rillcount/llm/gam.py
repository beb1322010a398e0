"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over bins. Shallow trees are boosted feature by feature
in turn on the log-loss gradient, then the pairs of features that still explain most
get tables of their own. Scoring is an addition of table entries, vectorised over the
documents of a batch.

The model is fitted on at most ``sample`` labelled rows (a documented bound: those of the
smallest hash of their id), whose features alone come to the driver.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcount.llm.common import held_out, map_rows

SAMPLE = 20_000
FEATURES = ("words", "word_length", "capitals", "symbols", "bars", "shouts", "repeats", "distinct", "digits",
            "lines", "same_lines", "longest_word")
_SYMBOLS = re.compile(rb"[#*$%&<>]").findall


def features(text: str | None) -> list[float]:
    """Numbers about a whole text; all zero without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = text.encode()
    letters = len(text) - text.count(" ")
    capitals = sum(map(str.isupper, words)) - sum(1 for w in words if len(w) == 1 and w.isupper())
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        math.log(n), letters / n, capitals / n, len(_SYMBOLS(data)) / n, data.count(b"|") / n, data.count(b"!") / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(set(words)) / math.sqrt(n),
        sum(map(data.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / n,
        len(lines) / n, 1 - len(set(lines)) / len(lines), float(max(map(len, words)))]


def _tree(gain_g: np.ndarray, gain_h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree on ordered bins: the best split by Newton gain, ``depth`` times over."""
    total_g, total_h = gain_g.sum(), gain_h.sum()
    value = np.full(len(gain_g), total_g / (total_h + ridge))
    if depth and len(gain_g) > 1:
        left_g, left_h = np.cumsum(gain_g)[:-1], np.cumsum(gain_h)[:-1]
        gain = left_g**2 / (left_h + ridge) + (total_g - left_g)**2 / (total_h - left_h + ridge)
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > total_g**2 / (total_h + ridge) + 1e-12:
            value = np.concatenate([
                _tree(gain_g[:at], gain_h[:at], depth - 1, ridge), _tree(gain_g[at:], gain_h[at:], depth - 1, ridge)])
    return value


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A table of four leaves, cut once along each side, and its Newton gain over no cut."""
    cum = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = cum(g), cum(h)
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not a.size:
        return np.zeros_like(g), 0.0

    def corner(c):
        low, left, top, full = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
        return np.stack([low, left - low, top - low, full - left - top + low])

    quarters_g, quarters_h = corner(cg), corner(ch)
    gain = (quarters_g**2 / (quarters_h + ridge)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaves = (quarters_g / (quarters_h + ridge))[:, i, j]
    table = np.empty_like(g)
    table[:i + 1, :j + 1], table[:i + 1, j + 1:], table[i + 1:, :j + 1], table[i + 1:, j + 1:] = leaves
    return table, float(gain[i, j] - cg[-1, -1]**2 / (ch[-1, -1] + ridge))


@dataclass
class GamModel:
    """Cuts and tables by feature, and tables by pair over coarser cuts."""

    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, j], "right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            out += table[np.searchsorted(cuts_a, x[:, a], "right"), np.searchsorted(cuts_b, x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles as cuts, besides those of the smallest and the larger values, which may be few."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 12, rounds: int = 120, pair_rounds: int = 40,
    n_pairs: int = 6, rate: float = 0.15, depth: int = 2, ridge: float = 4.0,
) -> GamModel:
    """Cyclic boosting of one table per feature, then of the ``n_pairs`` pairs of most gain.

    Without rows, or with one label only, the model is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model = GamModel(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        model.cuts = [np.array([])] * x.shape[1]
        model.tables = [np.zeros(1)] * x.shape[1]
        return model
    model.cuts = [_cuts(c, bins) for c in x.T]
    where = [np.searchsorted(c, col, "right") for c, col in zip(model.cuts, x.T)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    margin = np.full(len(y), model.bias)

    def gradient():
        p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for at, table in zip(where, model.tables):
            g, h = gradient()
            step = rate * _tree(np.bincount(at, g, len(table)), np.bincount(at, h, len(table)), depth, ridge)
            table += step
            margin += step[at]
    coarse = [_cuts(c, pair_bins) for c in x.T]
    cells = [np.searchsorted(c, col, "right") for c, col in zip(coarse, x.T)]

    def sums(a, b, values):
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(cells[a] * shape[1] + cells[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    gains = {(a, b): _pair_tree(sums(a, b, g), sums(a, b, h), ridge)[1]
             for a, b in itertools.combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for a, b in chosen]
    for _ in range(pair_rounds):
        for a, b, _, _, table in model.pairs:
            g, h = gradient()
            step = rate * _pair_tree(sums(a, b, g), sums(a, b, h), ridge)[0]
            table += step
            margin += step[cells[a], cells[b]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, quality`` of at most ``sample`` labelled rows outside the held-out fold."""
    by_hash = F.xxhash64("doc_id")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = known.orderBy(by_hash, "quality").limit(sample)  # at most that many rows of 12 bytes: safe to broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GamModel:
    def each(chunks) -> Iterator[list[tuple]]:
        for rows in chunks:
            yield [(r["doc_id"], r["quality"], features(r["text"])) for r in rows]

    made = map_rows(training_rows(docs, labels, sample), each, "doc_id long, quality int, x array<double>")
    rows = made.orderBy(F.xxhash64("doc_id"), "quality", "x").limit(sample).collect()
    return fit(np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES)),
               np.array([r["quality"] for r in rows], float))


def classify(docs: DataFrame, model: GamModel, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and ``held_out, score, predicted``; these names take the place of older ones.

    Null and empty texts have a score like any other, from features that are all zero.
    """
    docs = docs.drop("held_out", "score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([features(t) for t in part.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
                score = pa.array(np.round(model.score(x), 9))
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, "score"])

    return docs.mapInArrow(run, f"{fields}, score double").withColumns({
        "held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
