"""Ranked lexical search over a length-stratified index.

A document of ``n`` terms has the normaliser ``m = 10 + 90 n N div L``. Documents of
equal ``m`` are a stratum, and all that a posting adds to a score is fixed by the term,
the stratum and the number of occurrences ``tf``. So the index of a shard of documents
keeps, for each term and stratum, runs of postings of equal ``tf``, highest first: an
impact is computed once per run, and the first run of each term bounds what its
stratum can score. A query visits strata by falling bounds and stops when no bound
reaches its tenth score.

``build_index`` writes one row per shard as Parquet below a path all executors share.
``search`` reads the shards for the document frequencies of the asked terms, ranks
inside each shard, and merges the short lists in two levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from rillcount.llm.common import byte_words, in_blocks
from rillcount.llm.tokens import text_batches

#: Bytes of text in a shard, of terms in a block of queries, and lists merged at a time.
SHARD_BYTES, BLOCK_BYTES, FAN = 8 << 20, 4 << 20, 256
TOP = 10
#: Fixed values of the score: weights, impacts, term and length shares.
WEIGHT_UNIT, IMPACT_UNIT, TF_UNIT, LENGTH_FACTOR, LEAST, SHARE = 1000, 10**9, 1000, 8, 10, 90
#: Documents of the strata that are visited first; twice as many each time after.
FIRST_VISIT = 64
#: Stands for a null doc_id, which comes last among equal scores.
_NO_ID = np.iinfo(np.int64).max

#: Arrays of a shard as compressed 64-bit numbers; ``terms`` is the terms joined by blanks.
_ARRAYS = ("doc_ids", "doc_m", "df", "first_run", "run_m", "run_tf", "run_size", "postings")
_INDEX = "part int, seq int, n_docs long, n_terms long, terms binary, " + ", ".join(f"{a} binary" for a in _ARRAYS)
_RANKED = "item int, part int, doc_id long, score long"


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(WEIGHT_UNIT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def normaliser(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return LEAST + SHARE * n.astype(np.int64) * n_docs // max(n_terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return IMPACT_UNIT * tf // (TF_UNIT * tf + LENGTH_FACTOR * m)


def _packed(values: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else values.astype("<i8").tobytes())


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def unpack_row(row: dict) -> dict:
    """A row of the index with its terms as a list and its arrays as numbers."""
    return {c: _unpacked(v).split() if c == "terms" else np.frombuffer(_unpacked(v), "<i8") if c in _ARRAYS else v
            for c, v in row.items()}


def _lengths(docs: DataFrame) -> DataFrame:
    """``n_docs, n_terms`` of every batch of texts."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(byte_words(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["n_docs", "n_terms"])

    return docs.select("text").mapInArrow(run, "n_docs long, n_terms long")


def _shard(doc_ids: np.ndarray, texts: pa.Array, n_docs: int, n_terms: int) -> dict:
    """Terms, runs and postings of a few documents; postings are places in the order of lengths."""
    numbers: dict[bytes, int] = {}
    parts = []
    for text in texts:
        words = byte_words(text.as_py())
        for word in words:
            if word not in numbers:
                numbers[word] = len(numbers)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.lexsort((doc_ids, sizes))
    order = order[sizes[order] > 0]
    m = normaliser(sizes[order], n_docs, n_terms)
    place, n = np.zeros(len(sizes), np.int64), max(len(order), 1)
    place[order] = np.arange(len(order))
    terms = np.concatenate([*parts, np.zeros(0, np.int64)])
    held, tf = np.unique(terms * n + np.repeat(place, sizes), return_counts=True)
    term, at = held // n, held % n
    inside = np.lexsort((-tf, m[at], term))
    term, at, tf = term[inside], at[inside], tf[inside]
    new = np.ones(len(term), bool)
    new[1:] = (np.diff(term) != 0) | (np.diff(m[at]) != 0) | (np.diff(tf) != 0)
    runs = np.flatnonzero(new)
    return {
        "n_docs": len(order), "n_terms": int(sizes.sum()), "doc_ids": doc_ids[order], "doc_m": m,
        "terms": b" ".join(numbers), "df": np.bincount(term, minlength=len(numbers)),
        "first_run": np.searchsorted(term[runs], np.arange(len(numbers) + 1)), "run_m": m[at[runs]], "run_tf": tf[runs],
        "run_size": np.diff(np.append(runs, len(term))), "postings": at}


def build_index(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the index of ``docs(doc_id, text)`` below ``path``: every term of every whole text.

    Null texts and texts without terms are in no stratum. Rows of equal ids are
    separate documents. Other columns are not read; an empty table gives an empty index.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = _lengths(docs).agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    fields = StructType.fromDDL(_INDEX)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in text_batches(batches, most=shard_bytes):
            ids = batch.column("doc_id").fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
            made = {"part": part, "seq": seq} | _shard(ids, batch.column("text"), n_docs, n_terms)
            seq += 1
            made |= {c: _packed(made[c]) for c in ("terms", *_ARRAYS)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([made[f.name]], f.type) for f in schema], schema=schema)

    docs.mapInArrow(run, _INDEX).write.option("compression", "uncompressed").parquet(path)


def rank_shard(row: dict, queries: list[tuple[list[int], list[int]]], local: np.ndarray, kept: list, k: int = TOP) -> int:
    """Put the best documents of a shard into ``kept``: per query arrays of ``score`` and ``doc_id``, best first.

    ``queries`` holds term numbers and weights, ``local`` the place of each term in the shard or -1.
    Returns how many postings were added up.
    """
    doc_ids, first, run_m, size, postings = (row[c] for c in ("doc_ids", "first_run", "run_m", "run_size", "postings"))
    start = np.cumsum(size) - size
    each = impact(row["run_tf"], run_m)  # once per run
    strata, stratum = np.unique(run_m, return_inverse=True)
    # Runs of a term and stratum stand together, highest first: the first of them is the bound.
    term_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    leads = np.ones(len(run_m), bool)
    leads[1:] = (np.diff(stratum) != 0) | (np.diff(term_of) != 0)
    n_in = np.bincount(np.searchsorted(strata, row["doc_m"]), minlength=len(strata))
    added = 0
    for q, (numbers, weights) in enumerate(queries):
        at = local[numbers]
        there = at >= 0
        at, w = at[there], np.asarray(weights, np.int64)[there]
        lengths = first[at + 1] - first[at]
        if not lengths.sum():
            continue
        runs = np.repeat(first[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        gain = each[runs] * np.repeat(w, lengths)
        bound, lead = np.zeros(len(strata), np.int64), leads[runs]
        np.add.at(bound, stratum[runs[lead]], gain[lead])
        order = np.argsort(-bound, kind="stable")
        turn = np.empty(len(strata), np.int64)
        turn[order] = np.arange(len(strata))
        turns, before, docs_before = turn[stratum[runs]], 0, np.cumsum(n_in[order])
        scores, ids = kept[q]
        visit = FIRST_VISIT
        while before < len(strata):
            least = scores[k - 1] if len(scores) >= k else 1
            if bound[order[before]] < least:
                break
            done = docs_before[before - 1] if before else 0
            after = max(before + 1, int(np.searchsorted(docs_before, done + visit, "right")))
            now = (turns >= before) & (turns < after)
            taken, counts = runs[now], size[runs[now]]
            total = int(counts.sum())
            added += total
            if total:
                places = postings[np.repeat(start[taken] - (np.cumsum(counts) - counts), counts) + np.arange(total)]
                met, which = np.unique(places, return_inverse=True)
                sums = np.zeros(len(met), np.int64)
                np.add.at(sums, which, np.repeat(gain[now], counts))
                better = sums >= least
                scores, ids = np.concatenate([scores, sums[better]]), np.concatenate([ids, doc_ids[met[better]]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            before, visit = after, 2 * visit
        kept[q] = scores, ids
    return added


def search(spark: SparkSession, path: str, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of the index for each item of ``items(item_id, text)``.

    Rows of one item_id, null among them, are one item with the terms of all; items
    without terms find nothing. Documents without a doc_id come last among equal
    scores. Items are asked in blocks of at most ``block_bytes`` bytes of terms.
    """
    index = spark.read.schema(_INDEX).parquet(path)
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs = totals["n"] or 0
    kind = items.schema["item_id"].dataType
    found = []
    for block in in_blocks(_asked(items), "size", block_bytes):
        found.append(_search_block(spark, index, block, n_docs, k, kind))
    result = found[0]
    for part in found[1:]:
        result = result.union(part)
    return result


def _asked(items: DataFrame) -> DataFrame:
    """``item_id, terms, size``: the different terms of every item."""
    fields = StructType([items.schema["item_id"], StructField("terms", ArrayType(BinaryType()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(byte_words(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    asked = items.select("item_id", "text").mapInArrow(run, fields).groupBy("item_id").agg(
        F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return asked.where("size(terms) > 0").withColumn(
        "size", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16))


def _search_block(spark: SparkSession, index: DataFrame, block: list, n_docs: int, k: int, kind) -> DataFrame:
    numbers: dict[bytes, int] = {}
    for row in block:
        for term in row["terms"]:
            numbers.setdefault(bytes(term), len(numbers))
    asked = spark.sparkContext.broadcast(numbers)

    def frequencies(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in map(unpack_row, batch.to_pylist()):
                known = np.array([asked.value.get(t, -1) for t in row["terms"]], np.int64)
                there, df = known >= 0, row["df"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known[there], pa.int32()), pa.array(df[there], pa.int64())], ["term", "df"])

    # At most as many rows as the block has terms.
    df = {r["term"]: r["df"] for r in index.select("terms", "df").mapInArrow(frequencies, "term int, df long")
          .groupBy("term").agg(F.sum("df").alias("df")).collect()}
    known = spark.sparkContext.broadcast([
        ([t for t in terms if t in df], [weight(n_docs, df[t]) for t in terms if t in df])
        for terms in ([numbers[bytes(t)] for t in row["terms"]] for row in block)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        queries, part = known.value, TaskContext.get().partitionId()
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                row = unpack_row({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                local = np.full(len(asked.value), -1, np.int64)
                for at, term in enumerate(row["terms"]):
                    if (number := asked.value.get(term)) is not None:
                        local[number] = at
                rank_shard(row, queries, local, kept, k)
        for q, (scores, ids) in enumerate(kept):
            yield pa.RecordBatch.from_arrays(
                [pa.array([q] * len(ids), pa.int32()), pa.array([part] * len(ids), pa.int32()), pa.array(ids),
                 pa.array(scores)], ["item", "part", "doc_id", "score"])

    columns = ["doc_ids", "doc_m", "terms", "first_run", "run_m", "run_tf", "run_size", "postings"]
    ranked = index.select(*columns).mapInArrow(run, _RANKED)
    order = [F.col("score").desc(), F.col("doc_id")]
    group = F.pmod(F.col("part"), F.lit(FAN))
    for keys in (["item", group], ["item"]):  # two levels, so that no task sees the lists of all shards
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"rank <= {k}")
    fields = "item int, item_id " + kind.simpleString()
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], fields)
    return ranked.join(F.broadcast(ids), "item").select(
        "item_id", "rank", F.when(F.col("doc_id") < int(_NO_ID), F.col("doc_id")).alias("doc_id"), "score")
