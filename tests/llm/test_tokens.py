"""Encoders, token files and packing against the library and plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillcount.llm import bpe, packing, wavelet
from rillcount.llm.tokens import TextEncoder, text_batches
from rillcount.session import scratch_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["ab", "é", " ", "  ", "!", ",", "\n", "\t ", "'s", "12", "the", "ing", "\x1c", "\x85", "\xa0", "中", "Σ", "İ", "́",
         "²", "<|endoftext|>", "<|startoftext|>", "\U0001f600", "\r\n"]
ODD = [None, "", " ", "\n", "a" * 5000, "x y " * 3000, "tail ", " head", "no  gap", "a\n b", "<|endoftext|>"]


def library(path):
    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


@pytest.fixture(scope="module")
def byte_tool():
    return library(BYTES), TextEncoder(BYTES, memory=50)


@pytest.fixture(scope="module")
def word_tool():
    return library(WORDS), bpe.BatchEncoder(WORDS, memory=50)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_the_whole_text(byte_tool, texts):
    tool, encoder = byte_tool
    ids, ends = encoder.ids_of(pa.array([*texts, None]))
    starts = [0, *ends.tolist()]
    for text, a, b in zip([*texts, ""], starts, ends.tolist()):
        assert ids[a:b].tolist() == tool.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=6))
def test_pair_index_encodes_and_decodes_as_the_library(word_tool, texts):
    tool, encoder = word_tool
    for text, (n, ids, decoded) in zip(texts, encoder.encode(texts)):
        want = tool.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert decoded == tool.decode(want, skip_special_tokens=False)


def test_batches_hold_all_rows_whatever_their_length():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 100, 3, 2, 900)] + [None]})
    made = list(text_batches([batch], most=10))
    assert sum(b.num_rows for b in made) == 7 and max(b.num_rows for b in made) < 7
    assert [t for b in made for t in b.column(0).to_pylist()] == batch.column(0).to_pylist()


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (700, 1), (3000, 60_000), (5000, 3)])
def test_wavelet_matrix_answers(n, top):
    rng = random.Random(n)
    ids = [rng.randrange(top) for _ in range(n)]
    tree = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.array(ids, "<u4")).to_bytes())
    assert tree.decode().tolist() == ids
    for at in rng.sample(range(n), min(n, 20)):
        assert tree.access(at) == ids[at]
        low, high = sorted((at, rng.randrange(n)))
        assert tree.count(ids[at], low, high) == ids[low:high].count(ids[at])
    for token in {*ids[:5], top + 7}:
        places = [i for i, x in enumerate(ids) if x == token]
        assert [tree.select(token, k) for k in range(min(9, len(places)))] == places[:9]
        assert tree.select(token, len(places)) == -1 and tree.count(token) == len(places)


def test_token_files_round_trip(spark, make, byte_tool):
    tool, _ = byte_tool
    rows = [(i * 3 % 41, t, "x") for i, t in enumerate(ODD * 3)] + [(None, "z", "y"), (7, "twice", "y"), (7, "twice", "y")]
    path = scratch_path(spark, "shards")
    wavelet.write_shards(make(rows, "doc_id long, text string, n long".replace("n long", "start string")), path, BYTES, shard_tokens=500)
    got = wavelet.read_documents(spark, path).collect()
    at, want = 0, []
    texts = spark.createDataFrame([(t,) for _, t, _ in rows], "text string")
    place = {r.text: r.k for r in texts.select("text", F.xxhash64("text").alias("k")).collect()}
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1]])):
        ids = np.array(tool.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    counts = wavelet.token_counts(spark, path, 0)
    assert counts.count() > 1 and counts.agg({"count": "sum"}).first()[0] >= len(rows)


def test_token_files_of_an_empty_table(spark, make):
    path = scratch_path(spark, "shards")
    wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"), path, BYTES)
    assert wavelet.read_documents(spark, path).count() == 0


def placed(sequences, losses, limits):
    seen = {}
    for pieces in sequences:
        length = sum(p[2] for p in pieces)
        loss = sum(int(losses[i][s + n] - losses[i][s]) for i, s, n in pieces)
        assert 0 < length <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss
        for i, start, n in pieces:
            seen.setdefault(i, []).append((start, n))
    for i, before in enumerate(losses):
        at = 0
        for start, n in sorted(seen.get(i, [])):
            assert start == at
            at += n
        assert at == len(before) - 1


@pytest.mark.parametrize("limits", [packing.Limits(64, 8, 64), packing.Limits(64, 4, 20), packing.Limits(16, 1, 3)])
def test_packing_keeps_all_limits(limits):
    for seed in range(6):
        rng = random.Random(seed)
        losses = [np.concatenate([[0], np.cumsum([rng.random() < 0.6 for _ in range(rng.choice([0, 1, 5, 30, 200]))])]).astype(int)
                  for _ in range(60)]
        placed(packing.pack(losses, limits), losses, limits)


def test_packing_leaves_little_padding():
    rng = random.Random(4)
    losses = [np.arange(rng.randint(2, 5000)) for _ in range(300)]
    sizes = [sum(p[2] for p in s) for s in packing.pack(losses)]
    padded = [2048 - n for n in sizes if n & (n - 1)]
    assert sum(padded) <= 0.01 * sum(sizes)


def test_packed_documents_hold_every_id(spark, make, byte_tool):
    tool, _ = byte_tool
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(3, "again", 6), (None, "no id", 7)]
    got = packing.pack_examples(make([(*r, ["x"]) for r in rows], "doc_id long, text string, offset int, parts array<string>"), BYTES, limits=packing.Limits(256, 16, 256)).collect()
    total = sum(len(tool.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r.length for r in got) == total
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    for doc_id, text, _ in rows[:11]:
        if doc_id == 3:
            continue
        ids = np.array(tool.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for r in (r for r in got if r.doc_id == doc_id):
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_examples(empty, BYTES).count() == 0


def test_instructions_learn_from_answers_only(spark, make, byte_tool):
    tool, _ = byte_tool
    turns = make([(1, 2, "assistant", "fine thanks"), (1, 1, "user", "how are you"), (2, 1, "user", None), (3, 1, None, "x")],
                 "conv_id long, turn long, role string, text string")
    got = packing.pack_examples(packing.conversations(turns), BYTES, key="conv_id", by_part=True).collect()
    assert {r.conv_id: r.n_loss for r in got if r.conv_id != 1} == {2: 0, 3: 1}
    assert sum(r.n_loss for r in got if r.conv_id == 1) == len(tool.encode("fine thanks").ids) + 1


def test_digests_of_odd_texts(spark, make, word_tool):
    import hashlib

    tool, _ = word_tool
    got = bpe.encode_digests(make([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int"), WORDS)
    for r in got.collect():
        ids = tool.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.decode(WORDS, tool.encode("Hello there").ids) == tool.decode(tool.encode("Hello there").ids, skip_special_tokens=False)
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
