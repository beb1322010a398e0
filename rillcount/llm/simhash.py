"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into six pieces. Two that differ in at most three
bits agree on at least three pieces, so they meet under at least one of the twenty
choices of three pieces, that is in a block of 32 equal bits or more.

Only which documents hang together is asked for, so a block needs no pairs inside a
group that already does: every member is first compared with the block's smallest
fingerprint (one row each), components of those links are found, and only members
that are not near that fingerprint are joined with members of other components.
Such members of large blocks meet under a second choice of three of six pieces of
the bits left over, which loses no pair either. Exact copies are one fingerprint.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcount.llm.common import slices
from rillcount.session import cut_lineage

BITS, DISTANCE, PIECES, INTACT = 64, 3, 6, 3
#: Members of a block from which the rest of it is cut a second time.
LARGE = 256
_ROWS = 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    shingles = (
        map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _ROWS):
        octets = hashes[at:at + _ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, print``: the fingerprint of every row as a signed long."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            prints = np.array([fingerprint(r["text"], shingle) for r in rows], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(prints)], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, print long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _choices(bits: list[int]) -> list[int]:
    """Masks of every choice of ``INTACT`` out of ``PIECES`` even pieces of some bits."""
    pieces = [sum(1 << int(b) for b in part) for part in np.array_split(bits, PIECES)]
    return [sum(c) for c in itertools.combinations(pieces, INTACT)]


BLOCKS = _choices(list(range(BITS)))
_INNER = [[_signed(m) for m in _choices([b for b in range(BITS) if not block >> b & 1])] for block in BLOCKS]


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``links(a, b)``.

    Large-star and small-star rounds; the links are written to the shared folder
    after each round, and rounds end when a round leaves them as they were.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges, seen = cut_lineage(links.where("a <> b").select("a", "b").distinct()), None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        ways = edges.select(both.alias("w")).select("w.a", "w.b")
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct("a", F.col("m").alias("b")))).alias("w")).select("w.a", "w.b")
        edges = cut_lineage(small.where("a <> b").distinct())
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links at ``DISTANCE`` or less between different ``print`` values, enough to connect all that hang together."""
    keys = F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(_signed(m))) for m in BLOCKS])).alias("k", "key")
    members = prints.select("print", keys)
    heads = members.groupBy("k", "key").agg(F.min("print").alias("head"), F.count(F.lit(1)).alias("size"))
    shared = cut_lineage(
        members.join(heads.where("size > 1"), ["k", "key"])
        .withColumn("near", _near("print", "head")).select("k", "key", "print", "head", "size", "near"))
    star = shared.where("near AND print <> head").select(F.col("print").alias("a"), F.col("head").alias("b")).distinct()
    roots = components(star)
    known = shared.join(roots, shared["print"] == roots["node"], "left").select(
        "k", "key", "print", "size", "near", F.coalesce("root", "print").alias("root"))
    inner = F.array(*[F.array(*map(F.lit, masks)) for masks in _INNER])
    cut = F.when(F.col("size") > LARGE, F.transform(
        F.element_at(inner, F.col("k") + 1), lambda m: F.col("print").bitwiseAND(m))).otherwise(
        F.array(F.lit(0).cast("long")))
    known = known.select("k", "key", "print", "near", "root", F.posexplode(cut).alias("k2", "key2"))
    rest = known.where("not near").select(
        "k", "key", "k2", "key2", F.col("print").alias("a"), F.col("root").alias("root_a"))
    pairs = rest.join(known, ["k", "key", "k2", "key2"]).where(
        (F.col("root") != F.col("root_a")) & _near("a", "print"))
    return star.union(pairs.select("a", F.col("print").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    ``fingerprint`` has 16 hexadecimal digits, ``component_id`` is the smallest
    doc_id reachable over links, null where no reachable row has one. Null and empty
    texts have fingerprint zero and are linked like any other. Rows of equal ids
    stay separate rows. Other columns are not read; an empty table gives no rows.
    """
    found = cut_lineage(fingerprints(docs, shingle))
    prints = found.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints))
    rooted = prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("print", "component_id")
    return found.join(classes, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the first by doc_id, text and other columns.

    Groups hang together by links of ``near_duplicates``: fingerprints that differ in at most
    ``DISTANCE`` bits. Rows and not ids are grouped, so rows of one id that are no copies all
    stay. Rows without a doc_id are members like any other and come last; text and other
    columns are ordered by their SHA-256, so that every run keeps the same row. Null and
    empty texts are one group. An empty table gives no rows.
    """
    names = docs.columns
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[docs[c].alias(f"_{i}") for i, c in enumerate(names) if c != "text"]))
    text = F.unhex(F.sha2(F.col("text").cast("binary"), 256))  # null of a null text
    row = F.unhex(F.sha2(F.concat_ws(" ", F.hex(text), others), 256))
    ranked = docs.select("text", F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"),
                         text.alias("digest"), row.alias("row"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints), *batch.columns[1:]], ["print", "last", "doc_id", "digest", "row"])

    found = cut_lineage(ranked.mapInArrow(run, "print long, last boolean, doc_id long, digest binary, row binary").groupBy(
        "print").agg(F.min(F.struct("last", "doc_id", "digest", "row")).alias("rank")))
    roots = components(links(found.select("print")))
    kept = found.join(roots, found["print"] == roots["node"], "left").groupBy(
        F.coalesce("root", "print").alias("root")).agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    # Rows of one digest are equal in all columns: it does not matter which of them is kept.
    rows = docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate(names)], row.alias("row"))
    return rows.join(kept, "row").dropDuplicates(["row"]).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])
