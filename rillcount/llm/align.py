"""Cross-tokenizer alignment, counted with inverted bitmaps of id pairs.

Both tokenizers cover the bytes of a text. Offsets at which tokens of both end cut it
into groups; every token of A is linked to every token of B in its group. For each
pair of ids the index keeps the documents that hold it linked as a compressed bitmap,
and planes over these documents with the binary digits of how often they do.

Documents are numbered by chunk and slot. A chunk has a bounded amount of text and is
one container of every bitmap: a sorted list of slots, or one bit per slot where that is
shorter. Containers of different chunks have no document in common, so OR-merging a
pair's bitmap sets its containers side by side, and its documents and links are sums of
population counts and of weighted counts of planes. Only these counts move between
tasks; the postings stay in their chunk and return the counts to its documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillcount.llm.tokens import byte_letters, text_batches

#: Bytes of text in a chunk, and pieces of it that are encoded together.
CHUNK_BYTES, SLICE = 4 << 20, 8192
#: Letters of one pre-token and punctuation of another; a common word; a piece of B that crosses its parts; and a piece in
#: which a blank is followed by white space or nothing, or that holds what may be white space.
_L, _P = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
_LETTERS = re.compile(f" ?{_L}+").fullmatch
_COMMON = re.compile(f"( ?{_L}+)({_P}*)(?:(\n)({_L}+)({_P}*))?").fullmatch
_MIXED = re.compile(f"\n|{_L}{_P}|{_P}{_L}").search
_UNSURE = re.compile(r"^ (?:\s|\Z)|[\x1c-\x1f]").search

_INDEX = ("part int, seq int, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "n_links array<long>, groups_sha256 array<string>, pairs array<long>, docs array<int>, links array<long>, "
          "planes array<struct<digit: int, counts: binary, lists: binary, bits: binary>>")


# Bitmaps

def pack_bitmaps(rows: np.ndarray, slots: np.ndarray, n_rows: int, n_slots: int) -> tuple[bytes, bytes, bytes]:
    """Bitmaps of ``n_rows`` rows from sorted ``(row, slot)``: counts, lists of slots, and bits of the fuller rows."""
    counts = np.bincount(rows, minlength=n_rows).astype("<u4")
    wide = -(-n_slots // 8)
    dense = 4 * counts.astype(np.int64) > wide
    in_dense = dense[rows]
    number = np.cumsum(dense) - 1
    bits = np.zeros((int(dense.sum()), wide), np.uint8)
    at, bit = slots[in_dense] >> 3, (1 << (slots[in_dense] & 7)).astype(np.uint8)
    np.bitwise_or.at(bits, (number[rows[in_dense]], at), bit)
    return counts.tobytes(), slots[~in_dense].astype("<u4").tobytes(), bits.tobytes()


def unpack_bitmaps(counts: bytes, lists: bytes, bits: bytes, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, slot)`` of everything that was packed, sorted."""
    n, wide = np.frombuffer(counts, "<u4").astype(np.int64), -(-n_slots // 8)
    dense = 4 * n > wide
    rows, slots = np.repeat(np.arange(len(n)), n), np.zeros(int(n.sum()), np.int64)
    in_dense = dense[rows]
    slots[~in_dense] = np.frombuffer(lists, "<u4")
    spread = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, max(wide, 1)), axis=1, bitorder="little")
    slots[in_dense] = np.nonzero(spread)[1]
    return rows, slots


# Alignment

def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of so many values."""
    after = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return after[ends] - after[ends - counts]


class Aligner:
    """Groups and links of whole texts; tokenizers are files on the executors."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = {letter: byte for byte, letter in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Where no piece of B has a blank behind another character, no token of B crosses the start of a word;
        # where none has a line's end or a letter beside punctuation, none crosses the end of a word.
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.by_word = all("▁" not in p.lstrip("▁") for p in plain)
        self.by_part = self.by_word and not any(map(_MIXED, plain))
        self.letters = dict(enumerate(byte_letters()))

    def _encode_a(self, text: str) -> list[int]:
        if _LETTERS(text):  # a single pre-token
            return [t.id for t in self.a.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]
        return self.a.encode(text, add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        # B puts a blank before a text; parts without one stand behind a word and a line's end, two ids.
        found = self.b.encode([t[1:] if t[:1] == " " else "x\n" + t for t in texts], num_threads=1)
        return list(map(self._encode_a, texts)), [ids if t[:1] == " " else ids[2:] for t, ids in zip(texts, found)]

    def _spell(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
        return (b"".join(map(self.bytes_a.__getitem__, a.tolist())), b"".join(map(self.bytes_b.__getitem__, b.tolist())))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all texts in a row, and how many each text has; none where they do not spell it."""
        made_a, made_b = self._encode(texts)
        spelled = "".join(texts).encode()
        size = np.array([len(t.encode()) for t in texts], np.int64)
        while True:
            n_a, n_b = (np.array([len(x) for x in made], np.int64) for made in (made_a, made_b))
            a, b = (np.array([i for x in made for i in x], np.int64) for made in (made_a, made_b))
            lengths = (_sums(self.size_a[a], n_a), _sums(self.size_b[b], n_b))
            wrong = (lengths[0] != size) | (lengths[1] != size)
            if not wrong.any() and self._spell(a, b) == (spelled, spelled):
                return a, b, n_a, n_b
            for i, text in enumerate(texts):
                if wrong[i] or self._spell(np.array(made_a[i], int), np.array(made_b[i], int)) != (text.encode(),) * 2:
                    made_a[i] = made_b[i] = []
                    size[i] = 0
            spelled = "".join(t for t, n in zip(texts, size) if n).encode()

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For texts that begin with a blank, and parts of words: ids, numbers of groups, and links, all in a row.

        A text whose tokens do not spell it has no tokens.
        """
        parts = [self.ids(texts[at:at + SLICE]) for at in range(0, max(len(texts), 1), SLICE)]
        a, b, n_a, n_b = map(np.concatenate, zip(*parts))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        last = np.cumsum(n_a) - 1
        groups_to = np.where(n_a > 0, group_a[np.maximum(last, 0)] + 1, 0) if len(a) else np.zeros(len(texts), np.int64)
        groups_to = np.maximum.accumulate(groups_to) if len(texts) else groups_to
        return {"ids_a": a, "ids_b": b, "n_a": n_a, "n_b": n_b, "group_a": group_a, "group_b": group_b,
                "in_a": in_a, "in_b": in_b, "groups_to": groups_to}


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _cut(texts: pa.Array, by_word: bool, by_part: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different pieces that begin with a blank, the pieces of all texts in a row, and where each text ends.

    Cuts stand before a blank that is followed by something other than white space and is not
    preceded by a blank, and between letters, punctuation and a line's end of common words. Texts in
    which the libraries could see white space differently stay whole.
    """
    texts = pc.fill_null(texts, "")
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if by_word:
        lists = pc.split_pattern(texts, " ")
        ends = np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        pieces = [" " + w for w in coded.dictionary.to_pylist()]
        which = coded.indices.to_numpy().astype(np.int64)
        unsure = np.array([_UNSURE(p) is not None for p in pieces], bool)
        starts = np.concatenate([[0], ends[:-1]])
        odd = np.add.reduceat(unsure[which], starts) > 0 if len(which) else np.zeros(0, bool)
    else:
        pieces, which, ends = [], np.zeros(len(texts), np.int64), np.arange(1, len(texts) + 1)
        starts, odd = ends - 1, np.ones(len(texts), bool)
    numbers: dict[str, int] = {}
    listed, counts = [], np.ones(len(pieces), np.int64)
    for i, piece in enumerate(pieces):
        found = _COMMON(piece) if by_part else None
        for part in filter(None, found.groups()) if found else (piece,):
            listed.append(numbers.setdefault(part, len(numbers)))
        counts[i] = len(listed)
    counts = np.diff(counts, prepend=0)
    first, whole = np.cumsum(counts) - counts, odd & ~empty
    doc = np.repeat(np.arange(len(texts)), ends - starts)
    kept = ~odd[doc]
    doc, which = doc[kept], which[kept]
    made = np.array(listed, np.int64)[_rows_of(first[which], counts[which])]
    doc = np.repeat(doc, counts[which])
    parts = [*numbers, *(" " + texts[int(d)].as_py() for d in np.flatnonzero(whole))]
    made = np.concatenate([made, len(numbers) + np.arange(int(whole.sum()))])
    doc = np.concatenate([doc, np.flatnonzero(whole)])
    order = np.argsort(doc, kind="stable")
    used, which = np.unique(made[order], return_inverse=True)
    return [parts[u] for u in used], which.reshape(-1), np.searchsorted(doc[order], np.arange(len(texts)), "right")


def _rows_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + counts[i] - 1`` for every i in a row."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def _tallied(rows: np.ndarray, columns: np.ndarray, times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``times`` for different ``(row, column)``, in their order."""
    keys = rows * width + columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)
    return keys[first] // width, keys[first] % width, sums


def _piece_links(found: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``piece, pair, times`` of all links, and links per piece.

    Tokens of one id in one group are taken together, so that a long group costs its
    different ids and not all its pairs of places.
    """
    a, b, group_a, group_b = found["ids_a"], found["ids_b"], found["group_a"], found["group_b"]
    wide = int(max(a.max(initial=0), b.max(initial=0))) + 1
    ga, ida, ta = _tallied(group_a, a, np.ones(len(a), np.int64), wide)
    gb, idb, tb = _tallied(group_b, b, np.ones(len(b), np.int64), wide)
    n_groups = len(found["in_a"])
    first_b, kinds_b = np.searchsorted(gb, np.arange(n_groups)), np.bincount(gb, minlength=n_groups)
    right = _rows_of(first_b[ga], kinds_b[ga])
    left = np.repeat(np.arange(len(ga)), kinds_b[ga])
    group = ga[left]
    piece = np.searchsorted(found["groups_to"], group, "right")
    pair, times = ida[left] << 32 | idb[right], ta[left] * tb[right]
    links = np.zeros(n, np.int64)
    np.add.at(links, piece, times)
    return piece, pair, times, links


def _spelled(found: dict, n: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3;`` of every piece."""
    a, b, group_a, group_b = found["ids_a"], found["ids_b"], found["group_a"], found["group_b"]
    ends_a, ends_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
    # Each token with its separator: a comma inside its list, else a bar after A and a semicolon after B.
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    marked = np.concatenate([4 * a + ends_a, 4 * b + 2 + ends_b])[order]
    kinds, which = np.unique(marked, return_inverse=True)
    shown = [f"{k >> 2}{',|,;'[k & 3]}".encode() for k in kinds.tolist()]
    size = np.array([len(x) for x in shown], np.int64)[which] if len(which) else np.zeros(0, np.int64)
    joined = b"".join(map(shown.__getitem__, which.tolist()))
    after = np.concatenate([[0], np.cumsum(size)])
    tokens = np.cumsum(found["n_a"] + found["n_b"])
    ends = after[tokens].tolist()
    return [joined[s:e] for s, e in zip([0, *ends[:-1]], ends)]


def chunk_index(doc_ids: list, texts: pa.Array, tool: Aligner) -> dict:
    """Counts of the documents of a chunk, and its pairs with their bitmaps."""
    n_docs = len(doc_ids)
    pieces, which, ends = _cut(texts, tool.by_word, tool.by_part)
    n = len(pieces)
    found = tool.align(pieces)
    spells = found["n_a"] > 0
    doc = np.repeat(np.arange(n_docs), np.diff(np.concatenate([[0], ends])))
    whole = np.ones(n_docs, bool)
    whole[doc[~spells[which]]] = False  # one piece that is not spelled, and the text has no tokens
    doc, which = doc[whole[doc]], which[whole[doc]]
    piece, pair, times, links = _piece_links(found, n)
    groups = np.diff(np.concatenate([[0], found["groups_to"]]))
    made = {"doc_ids": doc_ids}
    for name, each in (("n_a", found["n_a"]), ("n_b", found["n_b"]), ("n_groups", groups), ("n_links", links)):
        made[name] = np.zeros(n_docs, np.int64)
        np.add.at(made[name], doc, each[which])
    strings = _spelled(found, n)
    edges = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    listed = which.tolist()
    made["groups_sha256"] = [
        hashlib.sha256(b"".join(map(strings.__getitem__, listed[s:e]))[:-1]).hexdigest() if s < e else ""
        for s, e in zip(edges, edges[1:])]
    # Documents by piece first, then by pair: most words repeat.
    d, p, repeats = _tallied(doc, which, np.ones(len(doc), np.int64), max(n, 1))
    order = np.argsort(piece, kind="stable")
    pairs, local = np.unique(pair, return_inverse=True)
    local, times = local.reshape(-1)[order], times[order]
    starts, counts = np.searchsorted(piece[order], np.arange(n)), np.bincount(piece, minlength=n)
    rows = _rows_of(starts[p], counts[p])
    row, slot, total = _tallied(
        local[rows], np.repeat(d, counts[p]), times[rows] * np.repeat(repeats, counts[p]), max(n_docs, 1))
    made |= {"pairs": pairs, "docs": np.bincount(row, minlength=len(pairs)), "links": np.zeros(len(pairs), np.int64)}
    np.add.at(made["links"], row, total)
    planes, more, digit = [(-1, *pack_bitmaps(row, slot, len(pairs), n_docs))], total - 1, 0
    while more.any():  # links beyond the first of each document, one binary digit per plane
        ones = (more & 1).astype(bool)
        if ones.any():
            planes.append((digit, *pack_bitmaps(row[ones], slot[ones], len(pairs), n_docs)))
        more, digit = more >> 1, digit + 1
    made["planes"] = [dict(zip(("digit", "counts", "lists", "bits"), plane)) for plane in planes]
    return made


def build_index(docs: DataFrame, path: str, tokenizer_a: str, tokenizer_b: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the chunks of ``docs(doc_id, text)`` below ``path``, which all executors share.

    A text that is null, empty, or not what its tokens spell has no tokens. Rows of
    equal ids are separate documents. Other columns are not read; an empty table gives
    an empty index.
    """
    fields = StructType.fromDDL(_INDEX)

    def run(batches) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark.sql.pandas.types import to_arrow_schema

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        schema = to_arrow_schema(fields)
        tool, part, seq = aligner(tokenizer_a, tokenizer_b), TaskContext.get().partitionId(), 0
        for batch in text_batches(batches, most=chunk_bytes):
            made = {"part": part, "seq": seq} | chunk_index(batch.column("doc_id").to_pylist(), batch.column("text"), tool)
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in schema], schema=schema)

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX).write.option(
        "compression", "zstd").parquet(path)


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(path)


def _by_chunk(spark: SparkSession, path: str) -> DataFrame:
    """``part, seq, pair, docs, links``: the population counts of every container."""
    return _index(spark, path).select("part", "seq", F.explode(F.arrays_zip("pairs", "docs", "links")).alias("c")).select(
        "part", "seq", F.col("c.pairs").alias("pair"), F.col("c.docs").alias("docs"), F.col("c.links").alias("links"))


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """``id_a, id_b, n_docs, n_links, best``: documents and links of every pair; best if no pair of ``id_a`` has more documents."""
    counts = _by_chunk(spark, path).groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))
    counts = counts.withColumn("id_a", F.shiftright("pair", 32))
    most = counts.groupBy("id_a").agg(F.max("n_docs").alias("_most"))
    return counts.join(most, "id_a").select(
        F.col("id_a").cast("long").alias("id_a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("id_b"), "n_docs", "n_links",
        (F.col("n_docs") == F.col("_most")).alias("best"))


def postings(planes: list[dict], n_slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, slot, times`` of a chunk: the document bitmap of each pair with the links that its planes give."""
    def unpack(plane):
        return unpack_bitmaps(plane["counts"], plane["lists"], plane["bits"], n_slots)

    row, slot = unpack(next(p for p in planes if p["digit"] < 0))
    keys, times = row * max(n_slots, 1) + slot, np.ones(len(row), np.int64)
    for plane in planes:
        if plane["digit"] >= 0:
            r, s = unpack(plane)
            times[np.searchsorted(keys, r * max(n_slots, 1) + s)] += 1 << plane["digit"]
    return row, slot, times


def document_scores(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document of the index."""
    counts = pair_counts(spark, path).select(
        F.shiftleft("id_a", 32).bitwiseOR(F.col("id_b")).alias("pair"), F.col("n_docs").alias("count"), "best")
    # A chunk gets back one number for each of its pairs, so the group is as large as the chunk.
    told = _by_chunk(spark, path).select("part", "seq", "pair").join(counts, "pair").groupBy("part", "seq").agg(
        F.collect_list(F.struct("pair", "count", "best")).alias("told"))
    chunks = _index(spark, path).drop("docs", "links").join(told, ["part", "seq"], "left")
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, pairs = made["doc_ids"].values, made["pairs"].values.to_numpy()
                best, count = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
                if len(pairs):
                    told = made["told"].values
                    at = np.searchsorted(pairs, told.field("pair").to_numpy())
                    count[at] = told.field("count").to_numpy()
                    best[at] = told.field("best").to_numpy(zero_copy_only=False)
                row, slot, times = postings(made["planes"].as_py(), len(ids))
                n_best, count_sum = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                np.add.at(n_best, slot, times * best[row])
                np.add.at(count_sum, slot, times * count[row])
                yield pa.RecordBatch.from_arrays(
                    [ids, *[made[c].values for c in names[1:5]], pa.array(n_best), pa.array(count_sum),
                     made["groups_sha256"].values], names)

    return chunks.select("doc_ids", *names[1:5], "groups_sha256", "pairs", "planes", "told").mapInArrow(
        run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))
