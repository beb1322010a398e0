"""Lexical search, decontamination and token alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillcount.llm import align, decontaminate, search
from rillcount.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer

ODD = [None, "", " ", "  ", "\n", "A", "...", "é" * 300, "ab " * 3000, "z" * 9000, "Ünï çödé", "x\x00y Z"]
ALPHABET = ["ant", "Bee", "cat", "dog", "é", "42", "eel", "fox", "gnu", "hen"]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def prose(rng, n):
    return " ".join(rng.choices(ALPHABET, weights=range(10, 0, -1), k=n)).replace(" fox", ", fox.\n")


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    rows = list(enumerate(ODD)) + [(100 + i, prose(rng, rng.randint(1, 120))) for i in range(n)]
    return rows + [(100, rows[20][1]), (7, "ant bee ant"), (None, "hen gnu fox eel"), (None, "hen gnu fox eel")]


# Search

def ranked(docs, items, k=10):
    """The contract, document by document."""
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


ITEMS = [(1, "ant hen hen"), (2, "fox gnu eel 42 é nothing"), (2, "dog"), (3, ""), (4, None), (5, "unheard of"), (None, "cat"), (6, "Bee")]


@pytest.mark.parametrize("shard, block", [(16 << 20, 4 << 20), (600, 40)])
def test_search_equals_scoring_all(spark, make, tmp_path, shard, block):
    docs = corpus()
    table = make([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int")
    items = make([(i, t, 3) for i, t in ITEMS], "item_id long, text string, doc_id int")
    search.build_index(table, str(tmp_path / "index"), shard)
    got = search.search(spark, str(tmp_path / "index"), items, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    order = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(ranked(docs, ITEMS), key=order)


def test_search_without_rows(spark, make, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    search.build_index(none, str(tmp_path / "none"))
    items = make(ITEMS, "item_id long, text string")
    assert search.search(spark, str(tmp_path / "none"), items).count() == 0
    search.build_index(make(corpus(), "doc_id long, text string"), str(tmp_path / "some"))
    assert search.search(spark, str(tmp_path / "some"), items.where("false")).count() == 0


def test_bounds_leave_strata_unvisited():
    """With short documents that hold the whole query, strata of long ones are not scored."""
    texts = ["rare words here"] * 12 + ["rare " + "filler " * (50 + i) for i in range(2000)]
    import pyarrow as pa

    row = search._shard(np.arange(len(texts)), pa.array(texts), len(texts), sum(len(t.split()) for t in texts))
    local = np.array([row["terms"].split().index(t) for t in (b"rare", b"words", b"here")])
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    added = search.rank_shard(row, [([0, 1, 2], [900, 3000, 3000])], local, kept)
    assert kept[0][1].tolist() == list(range(10))
    assert len(np.unique(row["run_m"])) > 100 and added < 200 < len(texts)


# Decontamination

def contaminated(docs, items, size=10):
    found, out = defaultdict(set), []
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, min(len(w), 1))):
            found[tuple(w[i:i + size])].add(item)
    lengths = {len(k) for k in found}
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in found:
                    hit.update(range(i, i + n))
                    names |= {str(x) for x in found[tuple(w[i:i + n])] if x is not None}
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def leaks(seed=5):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([4, 12, 25]))) for i in range(12)] + [
        (3, prose(rng, 14)), (None, prose(rng, 11)), (20, None), (21, "--"), (22, "one-word"), (23, "é" * 40)]
    docs = corpus(seed)
    for i in range(25):
        w = prose(rng, 30).split() + (items[rng.randrange(14)][1]).upper().split() + prose(rng, 9).split()
        docs.append((500 + i, rng.choice([" ", "\n", " - "]).join(w)))
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_contamination_equals_brute_force(make, block):
    docs, items = leaks()
    table = make([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    got = decontaminate.contamination(table, make(items, "item_id long, text string"), block_bytes=block)
    want = contaminated(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_removal_of_documents_and_spans(make):
    docs, items = leaks()
    table = make([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, hits string, n_words int")
    benchmark = make(items, "item_id long, text string")
    bad = {(r[0], t) for r, (_, t) in zip(contaminated(docs, items), docs) if r[5]}
    kept = decontaminate.decontaminate(table, benchmark)
    assert kept.columns == table.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(d) for d in docs if d not in bad)
    spans = {(r.doc_id, r.text) for r in decontaminate.decontaminate(table, benchmark, "spans").collect()}
    assert {d for d in docs if d not in bad} <= spans and len(spans) >= len(set(docs)) - len(bad)
    assert decontaminate.without_spans("One, two; three four!", [{"first": 1, "after": 3}]) == "One,  four!"
    with pytest.raises(ValueError):
        decontaminate.decontaminate(table, benchmark, "lines")


def test_contamination_without_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, text string")
    benchmark = make([(1, "some words")], "item_id long, text string")
    assert decontaminate.contamination(none, benchmark).count() == 0
    clean = decontaminate.contamination(make(corpus(), "doc_id long, text string"), benchmark.where("false"))
    assert clean.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0 and clean.count() == len(corpus())


# Alignment

def aligned(texts):
    """The contract, link by link."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool = Tokenizer.from_file(tokenizer(BYTE_BPE))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    made = []
    for text in texts:
        a = b = groups = links = []
        if text:
            a = a_tool.encode(" " + text, add_special_tokens=False).ids
            b = b_tool.encode(text)
            spelled_a = [bytes(letters[c] for c in a_tool.id_to_token(i)) for i in a]
            spelled_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
                         for p in map(b_tool.id_to_piece, b)]
            if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
                a = b = []
            else:
                ends = [np.cumsum([len(t) for t in x]).tolist() for x in (spelled_a, spelled_b)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in cuts]
                for side in (0, 1):
                    for i, end in zip((a, b)[side], ends[side]):
                        groups[next(g for g, c in enumerate(cuts) if c >= end)][side].append(i)
                links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        made.append((a, b, groups, Counter(links)))
    count = Counter(pair for *_, links in made for pair in links)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups, links in made:
        digest = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in links.items()),
                    hashlib.sha256(digest.encode()).hexdigest() if a else ""))
    return out, count, Counter(p for *_, links in made for p in links.elements())


TEXTS = [t for _, t in corpus(9, 25)] + [
    "<|endoftext|> is text", "a▁b", " leading", "trailing ", "two  spaces", "tab\tand\r\nline\n\n end", "日本語のテキスト です",
    "emoji 👩‍👩‍👧 here", "\x1d odd \x1c", "under_score __init__", "a b 　c", "<0x41> </s> <unk>", "1234567890 3.14", "ééé " * 40,
    "antidisestablishmentarianism " * 3, "the same words", "the same words", "-" * 700, "▁"]


@pytest.mark.parametrize("chunk", [8 << 20, 400])
def test_alignment_equals_brute_force(spark, make, tmp_path, chunk):
    want, docs, links = aligned(TEXTS)
    table = make([(i, t, 1, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, pair int, count string")
    path = str(tmp_path / "index")
    align.build_index(table, path, tokenizer(BYTE_BPE), tokenizer(PIECE_BPE), chunk)
    got = {r.doc_id: tuple(r)[1:] for r in align.document_scores(spark, path).collect()}
    assert [got[i] for i in range(len(TEXTS))] == want
    assert want[TEXTS.index("a▁b")][0] == 0 and want[TEXTS.index("<|endoftext|> is text")][0] > 1
    pairs = {(r.id_a, r.id_b): (r.n_docs, r.n_links) for r in align.pair_counts(spark, path).collect()}
    assert pairs == {p: (n, links[p]) for p, n in docs.items()}


def test_alignment_of_repeated_ids_and_no_rows(spark, make, tmp_path):
    rows = [(1, "one text"), (1, "another text"), (None, "one text"), (2, None)]
    for name, table in (("some", make(rows, "doc_id long, text string")),
                        ("none", spark.createDataFrame([], "doc_id long, text string")),
                        ("empty", make([(5, None), (6, "")], "doc_id long, text string"))):
        align.build_index(table, str(tmp_path / name), tokenizer(BYTE_BPE), tokenizer(PIECE_BPE))
        got = align.document_scores(spark, str(tmp_path / name)).collect()
        assert len(got) == table.count()
        assert all((r.n_a == 0) == (r.groups_sha256 == "") for r in got)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n_rows, n_slots, n in [(1, 1, 1), (5, 9, 20), (40, 1000, 9000), (3, 0, 0), (2, 64, 128)]:
        cells = np.unique(rng.integers(0, max(n_rows * n_slots, 1), n))
        rows, slots = cells // max(n_slots, 1), cells % max(n_slots, 1)
        back = align.unpack_bitmaps(*align.pack_bitmaps(rows, slots, n_rows, n_slots), n_slots)
        assert back[0].tolist() == rows.tolist() and back[1].tolist() == slots.tolist()
