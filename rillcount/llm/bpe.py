"""Byte-pair encoding and decoding by an index of pair occurrences.

The words of a batch that have not been met lately are laid out as one row of
symbols. An index keeps the places of every pair that has a rank. Active ranks are
taken in ascending order; all places of a pair are joined from left to right and only
the lists of the pairs beside them change. Since a pair with a joined symbol ranks
after the pair that made the symbol (checked when the merges are read), the ranks
taken never fall, and words come out as if each had been encoded by itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcount.llm.tokens import Recent, byte_letters, text_batches

#: White space by the Unicode property, other than the blank.
_OTHER_SPACE = re.compile(r"[^\S \x1c-\x1f]")


class MergeTable:
    """Vocabulary, ranks and word pattern of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        model = form["model"]
        steps = [n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])]
        cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (model["type"], steps, [c["type"] for c in cuts], form["decoder"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None):
            raise ValueError("this tokenizer file is of another kind")
        import regex

        self.find = regex.compile(cuts[0]["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in form["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"]
        self.token = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank, made = {}, {}
        for rank, (a, b) in enumerate(merges):
            pair = self.vocabulary[a], self.vocabulary[b]
            if rank <= max(made.get(pair[0], -1), made.get(pair[1], -1)) or self.vocabulary[a + b] in made:
                raise ValueError("the ranks of these merges may fall")
            made[self.vocabulary[a + b]] = rank
            self.rank[pair] = rank, self.vocabulary[a + b]
        letters = byte_letters()
        self.inner = [self.vocabulary[c] for c in letters]
        self.last = [self.vocabulary[c + self.suffix] for c in letters]

    def encode(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of different words, all at once."""
        symbols: list[int] = []
        starts = []
        for word in words:
            data = word.encode()
            starts.append(len(symbols))
            symbols += [self.inner[b] for b in data[:-1]]
            symbols.append(self.last[data[-1]])
        starts.append(len(symbols))
        n, rank = len(symbols), self.rank
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for s in starts[1:]:
            after[s - 1] = n
        for s in starts[:-1]:
            before[s] = -1
        places: dict[tuple[int, int], list[int]] = {}
        for i, j in enumerate(after):
            if j < n and (pair := (symbols[i], symbols[j])) in rank:
                places.setdefault(pair, []).append(i)
        active = [(rank[pair][0], pair) for pair in places]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            left, right = pair
            joined = rank[pair][1]
            for i in sorted(places.pop(pair)):
                j = after[i]
                if symbols[i] != left or j >= n or symbols[j] != right:
                    continue  # the place has gone into another symbol
                symbols[i], symbols[j] = joined, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                for at, new in ((before[i], i), (i, k)):
                    if at >= 0 and new < n and (found := (symbols[at], symbols[new])) in rank:
                        if found not in places:
                            places[found] = []
                            heapq.heappush(active, (rank[found][0], found))
                        places[found].append(at)
        return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(starts, starts[1:])]


class BatchEncoder:
    """Encodes Arrow columns of texts; remembers what lately used pieces between blanks came out as."""

    def __init__(self, path: str, memory: int = 150_000):
        self.table = MergeTable(path)
        #: Of a piece between blanks, and of a word in it: number of ids, ids as text, decoded text.
        self.known, self.words = Recent(memory), Recent(memory)

    def _learn(self, pieces: list[str]) -> list[tuple[int, str, str]]:
        found = [self.known.seen(p) for p in pieces]
        fresh = [p for p, f in zip(pieces, found) if f is None]
        words = [self.table.find(p) for p in fresh]
        coded = {w: self.words.seen(w) for ws in words for w in ws}
        different = [w for w, entry in coded.items() if entry is None]
        token = self.table.token
        for w, ids in zip(different, self.table.encode(different)):
            coded[w] = len(ids), " ".join(map(str, ids)), " ".join([token[i] for i in ids])
        for w, entry in coded.items():
            self.words.keep(w, entry)
        made = iter([
            coded[ws[0]] if len(ws) == 1 else
            (sum(coded[w][0] for w in ws), " ".join([coded[w][1] for w in ws]), " ".join([coded[w][2] for w in ws]))
            for ws in words])
        found = [next(made) if f is None else f for f in found]
        for p, f in zip(pieces, found):
            self.known.keep(p, f)
        return found

    def _normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def _plain(self, texts: Sequence[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text and decoded text of texts without special tokens."""
        normal = pa.array([_OTHER_SPACE.sub(" ", self._normal(t)) for t in texts], pa.string())
        lists = pc.split_pattern(normal, " ")
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        counts, *forms = zip(*self._learn(coded.dictionary.to_pylist()))
        sizes = np.array(counts, np.int64)[which]
        full = sizes > 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(full)[ends - 1]]), pa.int32())
        joined = [
            pc.binary_join(pa.ListArray.from_arrays(
                offsets, pa.array(form, pa.string()).take(pa.array(which[full]))), " ").to_pylist()
            for form in forms]
        totals = np.diff(np.concatenate([[0], np.cumsum(sizes)[ends - 1]]))
        return list(zip(totals.tolist(), *joined))

    def _mixed(self, text: str) -> tuple[int, str, str]:
        """The same for a text with special tokens, which are found before anything is normalised."""
        special = self.table.special
        parts = [
            (1, str(special[part]), part) if part in special else self._plain([part])[0]
            for part in self.table.at_special.split(text)]
        full = [part for part in parts if part[0]]
        return sum(n for n, _, _ in full), " ".join(i for _, i, _ in full), " ".join(d for _, _, d in full)

    def encode(self, texts: Sequence[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text and decoded text of every text."""
        texts = [t or "" for t in texts]
        odd = {k for k, t in enumerate(texts) if any(s in t for s in self.table.special)}
        plain = iter(self._plain(["" if k in odd else t for k, t in enumerate(texts)]) if texts else [])
        return [self._mixed(t) if k in odd else found for (k, t), found in zip(enumerate(texts), plain)]


@lru_cache(maxsize=2)
def batch_encoder(path: str) -> BatchEncoder:
    """One encoder for all tasks of a Python worker."""
    return BatchEncoder(path)


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Null and empty texts have no ids. Rows with equal or null ids stay separate rows;
    other columns are not read; an empty table gives no rows.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(tokenizer)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in text_batches(batches):
            counts, ids, decoded = zip(*encoder.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()),
                 pa.array(map(sha, ids), pa.string()), pa.array(map(sha, decoded), pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(path: str, ids: Sequence[int]) -> str:
    """The text of ids as the library decodes a tokenizer without decoder: its tokens between blanks."""
    token = MergeTable(path).token
    return " ".join(token[i] for i in ids if i in token)
