"""Vector bin packing of training examples by the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens at once. An
open sequence takes the example whose demands, as shares of the limits, have the
largest inner product with the room left, among those that fit whole. When none
fits, the best one is cut at the room that is left. What still is short of full at
the end is cut into sequences whose lengths are powers of two, which need no padding.

Examples are packed inside the tasks that encode them, ``group`` remainders at a
time, so nothing is shuffled and memory has a bound. Whole multiples of the token
limit are cut off first while the other limits allow it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcount.llm.tokens import text_batches, text_encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self):
        if self.tokens & (self.tokens - 1) or min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("tokens has to be a power of two, the other limits at least 1")


#: A piece of an example: (example, start, length).
Piece = tuple[int, int, int]


def _end(before: np.ndarray, start: int, most: int, loss: int) -> int:
    """The furthest end of a piece from ``start`` with at most ``most`` tokens and ``loss`` loss-bearing ones."""
    return min(start + most, int(np.searchsorted(before, before[start] + loss, "right")) - 1)


def pack(losses: Sequence[np.ndarray], limits: Limits = Limits()) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of every example once.

    ``losses[i][k]`` counts the loss-bearing tokens among the first ``k`` of example
    ``i``, so it has one entry more than the example has tokens. Ties go to the
    earlier example. Examples without tokens are in no sequence.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    starts = np.zeros(len(losses), np.int64)
    ends = np.array([len(x) - 1 for x in losses], np.int64)
    done: list[list[Piece]] = []
    for i, before in enumerate(losses):  # full sequences of a single example
        while (end := int(starts[i]) + limits.tokens) <= ends[i] and before[end] - before[starts[i]] <= limits.loss:
            done.append([(i, int(starts[i]), limits.tokens)])
            starts[i] = end
    rest = np.flatnonzero(ends > starts)
    need = np.ones((len(rest), 3))
    need[:, 0] = (ends - starts)[rest]
    need[:, 2] = [losses[i][-1] - losses[i][starts[i]] for i in rest]
    share, alive, left = need / cap, np.ones(len(rest), bool), len(rest)
    while left:
        room, pieces = cap.copy(), []
        while left and room.min() > 0 or left and room[2] == 0 and room[:2].min() > 0:
            score = np.where(alive, share @ (room / cap), -1.0)
            fits = alive & (need <= room).all(1)
            best = int(np.argmax(np.where(fits, score, -1.0))) if fits.any() else int(np.argmax(score))
            i = int(rest[best])
            start = int(starts[i])
            end = int(ends[i]) if fits[best] else _end(losses[i], start, int(room[0]), int(room[2]))
            if end <= start:
                break
            pieces.append((i, start, end - start))
            used = losses[i][end] - losses[i][start]
            room -= (end - start, 1, used)
            starts[i] = end
            if end == ends[i]:
                alive[best], left = False, left - 1
            else:
                need[best] -= (end - start, 0, used)
                share[best] = need[best] / cap
        done += [pieces] if room[0] == 0 else _powers(pieces)
    return done


def _powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The same tokens in sequences whose lengths are different powers of two, the longest first."""
    total, made, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    while total:
        room, current = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            i, start, length = queue.pop()
            taken = min(room, length)
            current.append((i, start, taken))
            if taken < length:
                queue.append((i, start + taken, length - taken))
            room -= taken
        made.append(current)
    return made


_PLACES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, n_loss long")


def pack_examples(
    examples: DataFrame, tokenizer: str, key: str = "doc_id", end_id: int = 1,
    limits: Limits = Limits(), group: int = 2048, by_part: bool = False,
) -> DataFrame:
    """Pieces of all examples: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss``.

    ``examples`` has ``key`` (long) and ``text``, all of which is learnt, or with ``by_part``
    ``parts array<struct<text string, learn boolean>>``, of which the marked parts
    are. Each example ends with ``end_id``, which is learnt; a first token never is.
    A null or empty text, null parts and null marks give an example of the end id
    alone or unlearnt parts. Rows with equal keys are separate examples. Other
    columns are not read, and an empty table gives no rows. ``sequence_id`` holds
    the task's number in its upper and a running number in its lower 40 bits.
    """
    if by_part:
        parts = F.coalesce("parts", F.array().cast("array<struct<text:string,learn:boolean>>"))
        rows = examples.select(
            F.col(key).cast("long").alias("doc_id"),
            F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))).alias("texts"),
            F.transform(parts, lambda p: F.coalesce(p["learn"], F.lit(False))).alias("learn"),
            F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text"))
    else:
        rows = examples.select(F.col(key).cast("long").alias("doc_id"), "text")

    def encoded(batch, encoder) -> Iterator[tuple]:
        if by_part:
            lists = batch.column("texts")
            ids, ends = encoder.ids_of(lists.flatten())
            learn = batch.column("learn").to_pylist()
        else:
            ids, ends = encoder.ids_of(batch.column("text"))
            learn = [[True]] * batch.num_rows
        at = k = 0
        for doc_id, marks in zip(batch.column("doc_id").to_pylist(), learn):
            first, loss = at, []
            for mark in marks:
                loss.append(np.full(int(ends[k]) - at, mark))
                at, k = int(ends[k]), k + 1
            marks = np.concatenate([[False], *loss, [True]])
            marks[1] = False
            yield doc_id, np.append(ids[first:at], np.uint32(end_id)), np.cumsum(marks, dtype=np.int32)

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, sequence = text_encoder(tokenizer), TaskContext.get().partitionId() << 40
        held, tokens = [], 0

        def packed():
            nonlocal sequence
            out = []
            for pieces in pack([loss for _, _, loss in held], limits):
                offset = 0
                for i, start, length in pieces:
                    doc_id, ids, loss = held[i]
                    out.append((doc_id, start, length, zlib.crc32(ids[start:start + length].astype("<u4")), len(ids),
                                sequence, offset, int(loss[start + length] - loss[start])))
                    offset += length
                sequence += 1
            names = [x.split()[0] for x in _PLACES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

        for batch in text_batches(batches):
            for example in encoded(batch, encoder):
                held.append(example)
                tokens += len(example[1])
                if len(held) >= group or tokens >= group * limits.tokens // 2:
                    yield packed()
                    held, tokens = [], 0
        if held:
            yield packed()

    return rows.mapInArrow(run, _PLACES).withColumnRenamed("doc_id", key)


def conversations(turns: DataFrame, learnt_role: str = "assistant") -> DataFrame:
    """``conv_id, parts``: the turns of every conversation in order, those of ``learnt_role`` learnt."""
    turn = F.struct(F.col("turn"), F.col("text"), (F.col("role") == learnt_role).alias("learn"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_t")).select(
        "conv_id", F.transform("_t", lambda t: F.struct(t["text"].alias("text"), t["learn"].alias("learn"))).alias("parts"))
