"""Token ids of whole texts with the ``tokenizers`` library, each different word encoded once.

A byte-level tokenizer without a normaliser cuts a text into pre-tokens, and one of
them always begins at a space that stands before something other than white space.
Texts are cut there, every different piece goes to the library once, and the ids of
the pieces are put together again: the same ids as for the whole text. A text with
white space after a space, with a special token, or with a control character on
whose being white space Python and the library differ goes to the library whole.
"""

from __future__ import annotations

import re
from array import array as pack
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNSURE = re.compile("[\x1c-\x1f]").search
#: Letters of one pre-token, punctuation of another, and the same again after a line's end.
_WORD = re.compile(
    r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*))?"
).fullmatch
#: The same punctuation, one sign each.
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Bytes of text that are encoded together.
BATCH_BYTES = 8 << 20


class Recent(dict):
    """Values by key for the keys used lately: two generations of at most ``size`` keys.

    ``recent[key]`` makes what is missing; ``seen`` and ``keep`` look and add without making.
    """

    def __init__(self, size: int, make=None):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        self.keep(key, value)
        return value

    def seen(self, key):
        return self.get(key) or self.old.get(key)

    def keep(self, key, value):
        self.turn()
        self[key] = value

    def turn(self):
        """Begin a new generation if this one is full."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if it prints, else one above 255."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def text_batches(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text makes one by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        after, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = after[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(after, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


class TextEncoder:
    """``ids_of(texts)``: unsigned 32-bit ids of all texts in a row and where each text ends.

    ``path`` names a tokenizer file on the executors. Null and empty texts have no
    ids. ``memory`` bounds the pieces that are remembered.
    """

    def __init__(self, path: str, memory: int = 250_000):
        import json

        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        tool.no_truncation()
        tool.no_padding()
        form = json.loads(tool.to_str())
        self.special = [t["content"] for t in form["added_tokens"]]
        kind = form["pre_tokenizer"] or {}
        self.by_piece = (
            form["normalizer"] is None and kind.get("type") == "ByteLevel"
            and kind.get("use_regex") and not kind.get("add_prefix_space"))
        self.tool, self.model, self.letters = tool, tool.model, dict(enumerate(byte_letters()))
        self._known = Recent(memory)

    def whole(self, text: str) -> bytes:
        return pack("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()

    def _odd(self, piece: str) -> bytes | None:
        """Ids of a piece that is no common word; none where they depend on what stands beside it."""
        if _UNSURE(piece) or any(s in piece for s in self.special):
            return None
        if piece[:1] == " " and (len(piece) == 1 or piece[1].isspace()):
            return None
        return self.whole(piece) if piece else b""

    def _ids(self, pieces: Iterable[str]) -> list[bytes | None]:
        """Ids of every piece; common words by their parts, each of them a single pre-token."""
        known, tokenize, letters, odd = self._known, self.model.tokenize, self.letters, self._odd
        blank, table = letters[32], []
        known.turn()
        new, old = known.get, known.old.get

        def word(part: str) -> bytes:
            found = new(part)
            if found is None:
                found = old(part)
                if found is None:
                    if part.isascii():
                        spelled = blank + part[1:] if part[0] == " " else "Ċ" if part == "\n" else part
                    else:
                        spelled = part.encode().decode("latin-1").translate(letters)
                    found = pack("I", [t.id for t in tokenize(spelled)]).tobytes()
                known[part] = found
            return found

        for piece in pieces:
            found = new(piece)
            if found is None:
                if piece.isascii() and piece[0:1] == " ":
                    if piece[1:].isalpha():
                        found = word(piece)
                    elif piece[-1] in _MARKS and piece[1:-1].isalpha():
                        found = word(piece[:-1]) + word(piece[-1])
                if found is None:
                    if common := _WORD(piece):
                        found = b"".join([word(part) for part in common.groups() if part])
                    else:
                        found = odd(piece)
            table.append(found)
        return table

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            made = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(made), "<u4"), np.cumsum([len(m) // 4 for m in made], dtype=np.int64)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = coded.indices.to_numpy().astype(np.int64)
        firsts = [words[i] for i in which[offsets[:-1]]]
        which[offsets[:-1]] = np.arange(len(firsts)) + len(words)
        table = self._ids([" " + w for w in words] + firsts)
        unsure = np.array([t is None for t in table])
        if unsure.any():
            odd = np.flatnonzero(np.add.reduceat(unsure[which], offsets[:-1]))
            nothing = len(table)
            table = [t or b"" for t in table] + [b""]
            for d in odd:
                which[offsets[d]:offsets[d + 1]] = nothing
                which[offsets[d]] = len(table)
                table.append(self.whole(texts[int(d)].as_py()))
        sizes = np.array([len(t) for t in table], np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(table), "<u4")
        each = sizes[which]
        ends = np.cumsum(each)
        taken = np.repeat(starts[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
        return flat[taken], ends[offsets[1:] - 1]


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for all tasks of a Python worker, which keeps the pieces that it has met."""
    return TextEncoder(path)
