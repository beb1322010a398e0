"""License scans by template markup compiled into token automata.

A template is licence text with markup: ``[[...]]`` may be absent, ``{{n}}`` stands
for up to ``n`` words of any kind, ``{{!a|b}}`` forbids that ``a`` or ``b`` comes next, everything
else is mandatory. Each template becomes an automaton over words. A text is accepted where all mandatory words follow each
other exactly, with optional regions taken or left and replaceable ones filled.
Starts are found by the template's first run of mandatory words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcount.llm.common import map_rows

#: Phrases and their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Conditions and disclaimers of the BSD licences.
_BSD = (
    """redistribution and use in source and binary forms with or without modification are permitted provided that the
    following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list
    of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright
    notice this list of conditions and the following disclaimer in the documentation and or other materials provided
    with the distribution""",
    """[[3]] neither the name of {{20}} nor the names of {{20}} may be used to endorse or promote products derived from
    this software without specific prior written permission""",
    """this software is provided by {{20}} as is and any express or implied warranties including but not limited to the
    implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{20}}
    be liable for any direct indirect incidental special exemplary or consequential damages including but not limited
    to procurement of substitute goods or services loss of use data or profits or business interruption however caused
    and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
    arising in any way out of the use of this software even if advised of the possibility of such damage""")
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and
    associated documentation files the {{2}} software to deal in the software without restriction including
    without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of
    the software and to permit persons to whom the software is furnished to do so subject to the following
    conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be
    included in all copies or substantial portions of the software the software is provided as is without warranty
    of any kind express or implied including but not limited to the warranties of merchantability fitness for a
    particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other
    liability whether in an action of contract tort or otherwise arising from out of or in connection with the
    software or the use or other dealings in the software"""
_GNU = "[[either]] version {} {{{{!1}}}} [[0]] [[of the license]]"
#: Whole licence texts; what follows the end in a longer licence is forbidden there.
TEXTS = {
    "mit": [_MIT + " {{!except}}"],
    "x11": [_MIT + """ except as contained in this notice the name of {{12}} shall not be used in advertising or
    otherwise to promote the sale use or other dealings in this software without prior written authorization from"""],
    "isc": ["""permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is
    hereby granted provided that the above copyright notice and this permission notice appear in all copies the
    software is provided as is and {{12}} disclaims all warranties with regard to this software including all implied
    warranties of merchantability and fitness in no event shall {{12}} be liable for any special direct indirect or
    consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
    contract negligence or other tortious action arising out of or in connection with the use or performance of this
    software"""],
    "bsd-2": [f"{_BSD[0]} {_BSD[2]}"],
    "bsd-3": [f"{_BSD[0]} {_BSD[1]} {_BSD[2]}"],
    "zlib": ["""this software is provided as is without any express or implied warranty in no event will the {{6}} be
    held liable for any damages arising from the use of this software permission is granted to anyone to use this
    software for any purpose including commercial applications and to alter it and redistribute it freely subject to
    the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you
    wrote the original software if you use this software in a product an acknowledgment in the product documentation
    would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not
    be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source
    distribution"""],
    "unlicense": ["""this is free and unencumbered software released into the public domain anyone is free to copy
    modify publish use compile sell or distribute this software either in source code form or as a compiled binary for
    any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author
    or authors of this software dedicate any and all copyright interest in the software to the public domain we make
    this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend
    this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
    software under copyright law the software is provided as is without warranty of any kind express or implied
    including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
    in no event shall the authors be liable for any claim damages or other liability whether in an action of contract
    tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
    software"""],
}
#: Notices that name a licence and its version.
NOTICES = {
    "mit": ["released under the [[terms of the]] mit license", "licensed under the [[terms of the]] [[expat]] mit license"],
    "apache-2": ["licensed under the [[terms of the]] apache license version 2 {{!1}} [[0]]",
                 "released under the [[terms of the]] apache license version 2 {{!1}} [[0]]"],
    **{f"{label}-{version}": [
        f"{start} {name} [[as published by the free software foundation]] {_GNU.format(version)}"
        for start in ("licensed under the [[terms of the]]", "released under the [[terms of the]]", "under the terms of the")]
       for label, name, versions in (
           ("gpl", "gnu general public license", (2, 3)), ("agpl", "gnu affero general public license", (3,)),
           ("lgpl", "gnu lesser general public license", (3,))) for version in versions},
    "lgpl-2": ["under the terms of the gnu library general public license [[as published by the free software foundation]] "
               + _GNU.format(2)],
    "lgpl-2-1": [f"{start} gnu lesser general public license [[as published by the free software foundation]] "
                 "[[either]] version 2 1" for start in ("licensed under the [[terms of the]]", "under the terms of the")],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0",
              "licensed under the [[terms of the]] mozilla public license [[version]] [[v]] 2 0"],
    "cc-by": ["licensed under [[a]] [[the]] [[creative commons]] cc by {{!nc|sa|nd}} [[4 0]]",
              "licensed under a creative commons attribution {{!noncommercial|non|sharealike|share|noderivatives|noderivs|no}} "
              "[[4 0]] [[3 0]] [[international]] [[unported]] license"],
    "cc-by-sa": ["licensed under [[a]] [[the]] [[creative commons]] cc by sa [[4 0]]",
                 "licensed under a creative commons attribution sharealike [[4 0]] [[3 0]] [[international]] [[unported]] license",
                 "licensed under a creative commons attribution share alike [[4 0]] [[3 0]] [[international]] [[unported]] license"],
    "cc-by-nc": ["licensed under [[a]] [[the]] [[creative commons]] cc by nc {{!sa|nd}} [[4 0]]",
                 "licensed under a creative commons attribution noncommercial {{!sharealike|share|noderivatives|noderivs|no}} "
                 "[[4 0]] [[international]] license"],
}
TEXT_SCORE, NOTICE_SCORE, PHRASE_SCORE = 1.0, 0.8, 0.5
_TO_WORDS = bytes(
    32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c < 0x80 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, other ASCII than letters and digits as gaps."""
    return (text or "").encode().lower().translate(_TO_WORDS).split()


class Automaton:
    """A template as states with word, any-word and empty moves."""

    def __init__(self, template: str):
        self.moves: list[tuple[bytes | None, int]] = []  # state -> (word or None for any, next state)
        self.empty: list[list[int]] = []
        self.guards: dict[int, frozenset[bytes]] = {}  # states that are left only if none of these words is next
        tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\{\{![^\s{}]+\}\}|[^\s\[\]{}]+", template)
        opened: list[int] = []
        head: list[bytes] = []
        for token in tokens:
            if token == "[[":
                opened.append(self._state())
            elif token == "]]":
                self.empty[opened.pop()].append(len(self.moves))
            elif token.startswith("{{!"):
                self.guards[self._state()] = frozenset(token[3:-2].encode().split(b"|"))
            elif token.startswith("{{"):
                first, n = len(self.moves), int(token[2:-2])
                for i in range(n):
                    self.empty[self._state(None)].append(first + n)
            else:
                self._state(token.encode())
        if opened:
            raise ValueError(f"unclosed optional region: {template}")
        self.final = self._state()
        for token in tokens:
            if token.startswith(("[[", "{{")):
                break
            head.append(token.encode())
        if not head:
            raise ValueError(f"a template has to begin with mandatory words: {template}")
        self.head = b" " + b" ".join(head) + b" "

    def _state(self, word: bytes | None | bool = False) -> int:
        """A new state; without a word it only passes on to the next."""
        at = len(self.moves)
        self.moves.append((word, at + 1) if word is not False else (b"", -1))
        self.empty.append([] if word is not False else [at + 1])
        return at

    def _closed(self, states: set[int], coming: bytes | None) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            at = todo.pop()
            if at != self.final and coming not in self.guards.get(at, ()):
                for to in self.empty[at]:
                    if to not in found:
                        found.add(to)
                        todo.append(to)
        return found

    def match(self, text: list[bytes], start: int) -> int:
        """End of the longest acceptance from a word on, or -1."""
        word = text[start] if start < len(text) else None
        states, end, at = self._closed({0}, word), -1, start
        while states:
            if self.final in states:
                end = at
            if at >= len(text):
                break
            word, at = text[at], at + 1
            states = self._closed({
                to for to_word, to in (self.moves[s] for s in states if s != self.final)
                if to >= 0 and (to_word is None or to_word == word)}, text[at] if at < len(text) else None)
        return end


def _places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which a phrase (with a blank on either side) stands in a line of words."""
    at, number, counted = line.find(phrase), 0, 0
    while at >= 0:
        number += line.count(b" ", counted, at)
        counted = at
        yield number
        at = line.find(phrase, at + 1)


def compile_templates(*groups: tuple[Mapping[str, list[str]], float]) -> list[tuple[str, Automaton, float]]:
    """Labels and automata of groups of templates, each with the score of its group."""
    return [(label, Automaton(t), score) for templates, score in groups for label, forms in templates.items() for t in forms]


def scan(text: str | None, automata, phrases: Mapping[str, str]) -> tuple:
    """Number of words, places and their first and last, base labels, all labels, score, matches of the method."""
    found = words(text)
    line = b" " + b" ".join(found) + b" "
    starts, base, matches, best = [], set(), [], 0.0
    for phrase, label in phrases.items():
        at = list(_places(line, b" " + phrase.encode() + b" "))
        if at:
            base.add(label)
            starts += at
    for label, automaton, score in automata:
        for at in _places(line, automaton.head):
            if (end := automaton.match(found, at)) >= 0:
                matches.append((label, at, end))
                best = max(best, score)
    labels = base | {label for label, _, _ in matches}
    return (len(found), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), max(best, PHRASE_SCORE if base else 0.0), matches)


def license_scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, texts: Mapping[str, list[str]] = TEXTS,
    notices: Mapping[str, list[str]] = NOTICES,
) -> DataFrame:
    """One row per document: counts, labels, ``score`` and ``matches`` (label, first word, end).

    ``score`` is 1 where a whole licence text is accepted, 0.8 where a notice is, 0.5 where only a
    phrase stands, else 0. Null and empty texts have no words and no labels. Equal rows stay
    separate rows, other columns are not read, an empty table gives no rows.
    """
    def each(chunks) -> Iterator[list[tuple]]:
        automata = compile_templates((texts, TEXT_SCORE), (notices, NOTICE_SCORE))
        for rows in chunks:
            yield [(r["doc_id"], *scan(r["text"], automata, phrases)) for r in rows]

    return map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, matches array<struct<label: string, first: long, end: long>>")
