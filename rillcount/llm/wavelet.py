"""Token files as wavelet matrices: bit planes with rank and select, one succinct matrix per shard.

A wavelet matrix keeps a sequence of ids as one plane of bits per binary digit,
highest digit first; every plane stably moves the zeros of the one before to the
front. Counts of ones before every 512th bit answer rank in constant time and
select by bisection, so that a reader gets single tokens, counts and places of a
token without unpacking the shard.

Writing sorts the documents by id over range partitions, encodes them inside the
tasks and writes shards of at least ``shard_tokens`` ids (whole documents, so the
last one may reach beyond) as Parquet rows of a path all executors share. A lost
task writes its shards again, as every shard depends on its own partition only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcount.llm.common import running_starts
from rillcount.llm.tokens import text_batches, text_encoder

#: Bits between two stored counts.
BLOCK = 512
SHARD_TOKENS = 1 << 20
_MAGIC = b"WMX1"
_FILES = "part int, seq int, n long, doc_ids array<long>, ends array<long>, matrix binary"


def _type(digits: int) -> str:
    """The smaller of two types that holds ids of so many binary digits."""
    return "<u2" if digits <= 16 else "<u4"


class WaveletMatrix:
    """Ids ``0 <= id < 2 ** digits`` with access, rank, count and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], before: list[np.ndarray]):
        #: planes: bits packed in bytes, first bit highest; before: ones before each block.
        self.n, self.planes, self.zeros, self.before = n, planes, zeros, before

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids, "<u4")
        digits, planes, zeros, before = int(ids.max()).bit_length() if len(ids) else 0, [], [], []
        ids = ids.astype(_type(digits))
        for digit in reversed(range(digits)):
            ones = (ids & ids.dtype.type(1 << digit)).astype(bool)
            padded = np.zeros(-(-len(ids) // BLOCK) * BLOCK // 8, np.uint8)
            packed = np.packbits(ones)
            padded[:len(packed)] = packed
            count = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
            planes.append(padded)
            before.append(np.concatenate([np.zeros(1, "<u4"), np.cumsum(count, dtype="<u4")]))
            zeros.append(len(ids) - int(before[-1][-1]))
            if digit:  # the order behind the last plane is not needed
                ids = np.concatenate([np.compress(~ones, ids), np.compress(ones, ids)])
        return cls(len(ids), planes, zeros, before)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.planes), *self.zeros], "<u8").tobytes()
        return b"".join([_MAGIC, head, *(p.tobytes() for p in self.planes), *(b.tobytes() for b in self.before)])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, digits = (int(x) for x in np.frombuffer(data, "<u8", 2, 4))
        zeros = [int(x) for x in np.frombuffer(data, "<u8", digits, 20)]
        at, blocks = 20 + 8 * digits, -(-n // BLOCK)
        planes, before = [], []
        for _ in range(digits):
            planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
        for _ in range(digits):
            before.append(np.frombuffer(data, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
        return cls(n, planes, zeros, before)

    def _rank1(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block, bits = divmod(at, BLOCK)
        start = block * BLOCK // 8
        whole, rest = divmod(bits, 8)
        found = int(self.before[plane][block])
        found += int(np.bitwise_count(self.planes[plane][start:start + whole]).sum())
        if rest:
            found += (int(self.planes[plane][start + whole]) >> (8 - rest)).bit_count()
        return found

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][at >> 3]) >> (7 - (at & 7)) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        found = 0
        for plane, zeros in enumerate(self.zeros):
            bit, ones = self._bit(plane, at), self._rank1(plane, at)
            found = found << 1 | bit
            at = zeros + ones if bit else at - ones
        return found

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        digits = len(self.planes)
        if token < 0 or token >> digits:
            return 0, 0
        for plane, zeros in enumerate(self.zeros):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            low, high = (zeros + a, zeros + b) if token >> (digits - 1 - plane) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token stands in ``low <= place < high``."""
        low, high = self._range(token, low, self.n if high is None else high)
        return high - low

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of a kind in a plane."""
        before = self.before[plane].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[plane][block * BLOCK // 8:(block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th occurrence (from 0) of a token; -1 if there are fewer."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            return -1
        at, digits = low + k, len(self.planes)
        for plane in reversed(range(digits)):
            bit = token >> (digits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane back to the first."""
        ids = np.zeros(self.n, _type(len(self.planes)))
        for digit, (packed, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = np.unpackbits(packed, count=self.n).view(bool)
            order = np.empty_like(ids)
            order[np.flatnonzero(~ones)] = ids[:zeros]
            order[np.flatnonzero(ones)] = ids[zeros:] | ids.dtype.type(1 << digit)
            ids = order
        return ids.astype("<u4")


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = text_encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, sizes, parts, held = [], [], [], 0

        def shard():
            ids = np.concatenate(parts)
            file = WaveletMatrix.build(ids).to_bytes()
            columns = [[part], [seq], [len(ids)], [doc_ids], [np.cumsum(sizes).tolist()], [file]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["part", "seq", "n", "doc_ids", "ends", "matrix"])

        for batch in text_batches(batches):
            ids, ends = encoder.ids_of(batch.column("text"))
            at = 0
            for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                parts += [ids[at:end], np.array([end_id], "<u4")]
                doc_ids.append(doc_id)
                sizes.append(end - at + 1)
                held += end - at + 1
                at = end
                if held >= shard_tokens:
                    yield shard()
                    seq, doc_ids, sizes, parts, held = seq + 1, [], [], [], 0
        if doc_ids:
            yield shard()

    return run


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Write the ids of ``docs(doc_id, text)``, each with ``end_id`` after it, in ascending order of doc_id.

    Null and empty texts have the end id alone. Rows of one doc_id are all written,
    by a hash of the text; a null doc_id comes first. Other columns are not read. An empty table
    writes no shard.
    """
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("_key", F.xxhash64("text"))  # rows of one id may fill several partitions
        .repartitionByRange("doc_id", "_key").sortWithinPartitions("doc_id", "_key", "text").drop("_key")
        .mapInArrow(_shards(tokenizer, end_id, shard_tokens), _FILES)
        .write.option("compression", "zstd").parquet(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    files = spark.read.schema(_FILES).parquet(path)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                ids, at, rows = WaveletMatrix.from_bytes(file["matrix"]).decode(), 0, []
                for doc_id, end in zip(file["doc_ids"], file["ends"]):
                    rows.append((file["part"], file["seq"], doc_id, at, end - at, zlib.crc32(ids[at:end])))
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows), [pa.int32(), pa.int32(), *[pa.int64()] * 4])],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    documents = files.select("part", "seq", "doc_ids", "ends", "matrix").mapInArrow(
        run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = running_starts(files.select("part", "seq", "n"), "part", "seq", "n")
    return documents.join(starts.select("part", "seq", "start"), ["part", "seq"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``part, seq, n, count, first_place`` of a token in every shard, by rank and select on the files."""
    @F.udf("struct<count: long, first_place: long>")
    def look(matrix):
        tree = WaveletMatrix.from_bytes(matrix)
        return tree.count(token), tree.select(token, 0)

    return spark.read.schema(_FILES).parquet(path).select(
        "part", "seq", "n", look("matrix").alias("_f")).select("part", "seq", "n", "_f.*")
