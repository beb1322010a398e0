"""Benchmark decontamination: windows of benchmark words looked up in training texts.

Every ``WINDOW`` consecutive words of a benchmark item are a window; an item of fewer
words is one window. The hash set of all windows goes to the tasks, which slide over
the words of each text, look up the hash of every window whose words all occur in the
benchmark, and compare the words of each hit. Words inside a found window are hit.

The set is sent in blocks of at most ``BLOCK_BYTES`` of windows. One block, the usual
case, needs no shuffle; with more, what each block finds is put together by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillcount.llm.common import byte_words, in_blocks, map_rows
from rillcount.llm.tokens import text_batches
from rillcount.session import cut_lineage, fits_broadcast

WINDOW, BLOCK_BYTES = 10, 8 << 20
#: Bytes of text that are scanned together, and parts that the copies of one text are dealt to.
SCAN_BYTES, SALTS = 2 << 20, 16

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+").finditer
_FOUND = "n_words long, hits array<struct<first: long, after: long>>, items array<string>"


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, words``: the different windows of ``benchmark(item_id, text)``, words joined by a blank."""
    def run(slices) -> Iterator[list[tuple]]:
        for rows in slices:
            for row in rows:
                words = byte_words(row["text"])
                n = max(len(words) - window + 1, min(len(words), 1))
                for at in range(0, n, 4096):
                    yield [(row["item"], b" ".join(words[i:i + window]).decode()) for i in range(at, min(n, at + 4096))]

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return map_rows(items, run, "item string, words string").distinct()


class WindowSet:
    """Windows by the hash of their word numbers, with the words to verify and the items of each."""

    def __init__(self, rows: Iterable[tuple[str | None, str]]):
        items: dict[tuple, set] = {}
        for item, words in rows:
            items.setdefault(tuple(words.encode().split(b" ")), set()).add(item)
        self.numbers: dict[bytes, int] = {}
        for words in items:
            for word in words:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        self.by_size = {}
        for size in sorted({len(words) for words in items}):
            found = [words for words in items if len(words) == size]
            rows_of = np.array([[self.numbers[w] for w in words] for words in found], "<u8")
            factor = np.uint64(0x9E3779B97F4A7C15)
            while len(np.unique(keys := self._hash(rows_of.T, factor))) < len(found):
                factor += np.uint64(2)  # different windows have different hashes
            order = np.argsort(keys)
            self.by_size[size] = (
                factor, keys[order], rows_of[order],
                [sorted(i for i in items[found[o]] if i is not None) for o in order])

    @staticmethod
    def _hash(columns, factor: np.uint64) -> np.ndarray:
        found = np.zeros(len(columns[0]), "<u8")
        for column in columns:
            found = (found ^ (found >> np.uint64(29))) * factor + column
        return found

    def occurrences(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``size`` words start in ``ids`` (0: no word of the set), and which they are."""
        factor, keys, rows, _ = self.by_size[size]
        if len(ids) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        starts = np.flatnonzero(unknown[size:] == unknown[:-size])
        hashed = self._hash([ids[starts + j] for j in range(size)], factor)
        which = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        met = keys[which] == hashed
        starts, which = starts[met], which[met]
        same = (ids[starts[:, None] + np.arange(size)] == rows[which]).all(1)
        return starts[same], which[same]

    def scan(self, texts: Iterable[str | None]) -> list[tuple[int, list, list]]:
        """For each text the number of words, the stretches of hit words, and the items found in it."""
        gap = np.zeros(max(self.by_size, default=1), "<u8")
        parts, sizes = [], []
        for text in texts:
            words = byte_words(text)
            parts += [np.fromiter(map(self.numbers.get, words, repeat(0)), "<u8", len(words)), gap]
            sizes.append(len(words))
        if not parts:
            return []
        ids = np.concatenate(parts)
        begins = np.cumsum(np.array(sizes) + len(gap)) - np.array(sizes) - len(gap)
        steps, named = np.zeros(len(ids) + 1, np.int64), [set() for _ in sizes]
        for size in self.by_size:
            starts, which = self.occurrences(ids, size)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + size, -1)
            texts_of = np.searchsorted(begins, starts, "right") - 1
            for at, w in np.unique(np.stack([texts_of, which], 1), axis=0).tolist():
                named[at].update(self.by_size[size][3][w])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(steps[:-1]) > 0, [0]]).astype(np.int8)))
        first, after = edges[::2], edges[1::2]
        texts_of, hits = np.searchsorted(begins, first, "right") - 1, [[] for _ in sizes]
        for at, a, b in zip(texts_of.tolist(), first.tolist(), after.tolist()):
            hits[at].append({"first": a - int(begins[at]), "after": b - int(begins[at])})
        return [(n, h, sorted(i)) for n, h, i in zip(sizes, hits, named)]


def _scan(rows: DataFrame, block: Iterable[tuple[str | None, str]]) -> DataFrame:
    """``rows``, which have a column ``text``, with the columns of ``_FOUND``."""
    shared = rows.sparkSession.sparkContext.broadcast(WindowSet(block))
    fields = StructType(rows.schema.fields + StructType.fromDDL(_FOUND).fields)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for batch in text_batches(batches, most=SCAN_BYTES):
            found = list(zip(*shared.value.scan(batch.column("text").to_pylist()))) or [()] * 3
            made = [pa.array(c, f.type) for c, f in zip(found, list(arrow)[-3:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=arrow)

    return rows.mapInArrow(run, fields)


def _merged(hits):
    """Stretches of several blocks as sorted stretches that do not touch."""
    empty = F.array().cast("array<struct<first: long, after: long>>")

    def add(done, hit):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["first"].alias("first"), F.greatest(last["after"], hit["after"]).alias("after"))))
        touches = (F.size(done) > 0) & F.coalesce(F.try_element_at(done, F.lit(-1))["after"] >= hit["first"], F.lit(False))
        return F.when(touches, joined).otherwise(F.concat(done, F.array(hit)))

    return F.aggregate(F.array_sort(hits), empty, add)


def found_in(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows``, which have a column ``text``, with ``n_words``, ``hits`` (stretches of words) and ``items``."""
    blocks = in_blocks(
        windows(benchmark, window).withColumn("size", F.octet_length("words")), "size", block_bytes)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _scan(rows, [(r["item"], r["words"]) for r in block])
    named = rows.withColumn("_text", F.sha2(F.col("text").cast("binary"), 256))
    parts = []
    while block is not None:
        scanned = _scan(rows.select("text").distinct(), [(r["item"], r["words"]) for r in block])
        parts.append(cut_lineage(scanned.where("size(hits) > 0").select(
            F.sha2(F.col("text").cast("binary"), 256).alias("_text"), "hits", "items")))
        block, more = more, next(blocks, None)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = cut_lineage(found.groupBy("_text").agg(
        _merged(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    counted = _scan(named, []).drop("hits", "items")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("hits") * 16 + F.size("items") * 64).alias("m")).first()
    if fits_broadcast(rows.sparkSession, size["n"], 80 + (size["m"] or 0)):
        joined = counted.join(F.broadcast(found), "_text", "left")
    else:  # copies of one text go to several parts
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        others = [c for c, kind in rows.dtypes if c != "text" and not kind.startswith("map")]
        salt = F.pmod(F.xxhash64(F.lit(0), *others), F.lit(SALTS)).cast("int")
        joined = counted.withColumn("_salt", salt).join(
            salted, ["_text", "_salt"], "left").drop("_salt")
    none = {"hits": "array<struct<first: long, after: long>>", "items": "array<string>"}
    return joined.select(*rows.columns, "n_words", *[
        F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have no words and are clean. Rows of equal ids stay separate
    rows. Benchmark rows of one ``item_id`` are one item with the windows of all; words of rows
    without an item_id are found, but count as no item. An empty benchmark finds nothing, an
    empty table gives no rows. Other columns are not read.
    """
    found = found_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, block_bytes)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["after"] - h["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def without_spans(text: str, hits: list[dict]) -> str:
    """The text without its hit stretches, each from the start of its first word to the end of its last."""
    data, kept, at = text.encode(), [], 0
    first, last = {h["first"] for h in hits}, {h["after"] - 1 for h in hits}
    for n, word in enumerate(_WORD(data)):
        if n in first:
            kept.append(data[at:word.start()])
        if n in last:
            at = word.end()
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows, or with ``remove="spans"`` all rows without the hit stretches.

    Columns stay as they are, whatever their names; a null text stays null.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"documents or spans can be removed, not {remove!r}")
    names = docs.columns
    at = names.index("text")
    found = found_in(docs.select(*[docs[c].alias("text" if i == at else f"_{i}") for i, c in enumerate(names)]), benchmark, window)
    back = [F.col("text" if i == at else f"_{i}").alias(c) for i, c in enumerate(names)]
    if remove == "documents":
        return found.where("size(hits) = 0").select(*back)
    fields = found.drop("n_words", "items").schema

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most=SCAN_BYTES):
            texts = [without_spans(r["text"], r["hits"]) if r["hits"] else r["text"]
                     for r in batch.select(["text", "hits"]).to_pylist()]
            columns = [pa.array(texts, c.type) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return found.drop("n_words", "items").mapInArrow(run, fields).select(*back)
