"""Exact top-k search by inner product: tiles of queries and shards, merged as a tree.

Vectors are packed into shards of bounded size; query vectors, taken from those shards,
into blocks of bounded size. Every block meets every shard once, under a key of
its own, so that tiles spread evenly however many there are. A task multiplies the two
matrices of a tile, keeps the best of each query in the tile, and lists are merged in
levels of ``FAN`` shards at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillcount.session import cut_lineage

#: Numbers in a shard, queries in a block (about), shards merged at a time.
SHARD_CELLS, BLOCK_QUERIES, FAN = 1 << 18, 1024, 64
SCALE = 1024.0

_SHARD = "shard long, width int, ids binary, cells binary"
_FOUND = "q_shard long, q_at int, query_id long, vec_id long, score long, shard long"


def _shards(cells: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, {}

        def packed(width):
            nonlocal shard
            ids = np.concatenate([x for x, _ in held[width]])
            rows = np.concatenate([x for _, x in held.pop(width)])
            order = np.argsort(ids, kind="stable")
            shard += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([shard - 1], pa.int64()), pa.array([width], pa.int32()),
                 pa.array([ids[order].tobytes()]), pa.array([rows[order].tobytes()])],
                ["shard", "width", "ids", "cells"])

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("cells")
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths)
            for width in np.unique(widths).tolist():
                which = np.flatnonzero(widths == width)
                rows = flat[(ends[which] - width)[:, None] + np.arange(width)]
                step = max(1, cells // max(width, 1))
                for at in range(0, len(which), step):
                    held.setdefault(width, []).append((ids[which[at:at + step]], rows[at:at + step]))
                    if sum(len(x) for x, _ in held[width]) >= step:
                        yield packed(width)
        for width in list(held):
            yield packed(width)

    return run


def product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where no sum can leave the exact range."""
    most = [max(1, int(np.abs(m).max(initial=0))) for m in (queries, rows)]
    if most[0] * most[1] * max(1, rows.shape[1]) < 1 << 53:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the earlier place."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= limit)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _tiles(k: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width, ids = row["width"], np.frombuffer(row["ids"], "<i8")
                rows = np.frombuffer(row["cells"], "<i8").reshape(len(ids), width)
                asked = row["queries"]
                queries = np.frombuffer(b"".join(q["cells"] for q in asked), "<i8").reshape(len(asked), width)
                out = []
                step = max(1, (1 << 22) // max(len(ids), 1))
                for at in range(0, len(asked), step):
                    for q, scores in zip(asked[at:at + step], product(queries[at:at + step], rows)):
                        own = q["at"] if q["shard"] == row["shard"] else -1
                        places = best(scores, k + (own >= 0))
                        places = places[places != own][:k]
                        out += [(q["shard"], q["at"], q["query_id"], int(ids[p]), int(scores[p]), row["shard"])
                                for p in places]
                names = [x.split()[0] for x in _FOUND.split(", ")]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names)

    return run


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: float = SCALE,
    shard_cells: int = SHARD_CELLS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest inner product for each query.

    ``vectors`` has ``vec_id`` and ``embedding``; components become ``floor(scale * x)``.
    Queries are the rows whose id is divisible by ``every``; their own row is no
    candidate, another row of the same id is. Rows without id or vector, or with a null or
    non-finite component, take no part; vectors are compared with those of their length.
    Ties go to the smaller id. Scores have to fit 64 bits. An empty table gives no rows.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    cells = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    usable = vectors.where(F.col("vec_id").isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), cells.alias("cells"))
    shards = cut_lineage(usable.mapInArrow(_shards(shard_cells), _SHARD))

    def asked(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, size = np.frombuffer(row["ids"], "<i8"), 8 * row["width"]
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(at), pa.int64()), pa.array(at, pa.int32()),
                     pa.array(ids[at]), pa.array([row["width"]] * len(at), pa.int32()),
                     pa.array([row["cells"][a * size:(a + 1) * size] for a in at], pa.binary())],
                    ["shard", "at", "query_id", "width", "cells"])

    queries = shards.mapInArrow(asked, "shard long, at int, query_id long, width int, cells binary")
    counts = {r["width"]: r["n"] for r in queries.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_shards = shards.count()
    if not counts:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"),
                              F.col("query_id").alias("score"))
    n_blocks = -(-max(counts.values()) // block_queries)
    block = F.pmod(F.xxhash64("shard", "at"), F.lit(n_blocks)).cast("int")
    blocks = queries.groupBy("width", block.alias("block")).agg(
        F.collect_list(F.struct("query_id", "shard", "at", "cells")).alias("queries"))
    names = shards.select("width", F.col("shard").alias("with"))
    # Rows here are whole shards and whole blocks; a tile has a key of its own.
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.join(names, "width").withColumnRenamed("with", "shard")
    found = left.join(right, ["width", "block", "shard"]).select(
        "shard", "width", "ids", "cells", "queries").mapInArrow(_tiles(k), _FOUND)
    order = [F.col("score").desc(), F.col("vec_id")]
    groups = n_shards
    while True:
        groups = -(-groups // FAN)
        own = Window.partitionBy("q_shard", "q_at", "query_id", "_group").orderBy(*order)
        found = (
            found.withColumn("_group", F.pmod(F.xxhash64("shard"), F.lit(groups)))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .withColumn("shard", F.col("_group").cast("long")).drop("_group"))
        if groups == 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")
