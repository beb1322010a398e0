"""Personal data: exact base formats, and contextual extraction bootstrapped from them.

Matches of the base formats are seeds. The words around a seed make lexical patterns;
what fills the slot of such a pattern elsewhere is an instance: a run of tokens with a digit,
an ``@`` or a spelt-out sign like ``(at)``, up to the next plain word, comma or line end, of any
length. Spark scores the graph of patterns and instances in turns: a pattern by the mean score of the
different instances it extracts, shrunk by ``PRIOR`` instances of score zero, an instance by
the noisy-or of its patterns, times the share of its different contexts that hold such
a pattern (a number that stands everywhere is not an identifier). Instances
that end at ``accept`` or more are personal data of that kind wherever such a pattern
stands beside them.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcount.llm.common import map_rows
from rillcount.session import cut_lineage, fits_broadcast

KINDS = ("email", "ip", "card", "phone")
ROUNDS, PRIOR, SUPPORT, ACCEPT = 3, 2.0, 3, 0.6

# The base formats; greedy runs are possessive, so that no text takes more than linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+").finditer
_PART = re.compile(r"[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile("[0-9]").search
# What an instance holds, a sign that joins the tokens beside it, and words of contexts.
_MARK = re.compile(r"[0-9@]|[(\[{<](?:at|dot)[)\]}>]", re.IGNORECASE).search
_SIGN = re.compile(r"[(\[{<](?:at|dot)[)\]}>]", re.IGNORECASE).fullmatch
_BLANK = re.compile(r"\s").search
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[=:]")
_BEFORE, _AFTER, _ENDS = "\"'([{<", "\"')]}>.,;:!?", ",;:!?"
#: Longer instances are told apart by their digest.
_LONG = 64
#: Parts that the copies of one text are dealt to where spans are too many for a broadcast.
SALTS = 16


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED(text):
        parts = [m.span() for m in _PART(chain[0])]
        for i in range(0, len(parts) - 3, 4):
            if all(len(p := chain[0][a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in parts[i:i + 4]):
                yield chain.start() + parts[i][0], chain.start() + parts[i + 3][1]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of all base matches, by kind and start, in code points."""
    text, found = text or "", []
    if "@" in text:
        found += [(0, *s) for s in _emails(text)]
    if _DIGIT(text):
        found += [(1, *s) for s in _addresses(text)] + [(2, *s) for s in _cards(text)]
        if "+" in text:
            found += [(3, *s) for s in _phones(text)]
    return found


def _contexts(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """Patterns of spans in order of their starts: the two words before, and the words on either side.

    Words are read once, whatever their distance.
    """
    made, before = [], deque(maxlen=2)
    words = _WORD.finditer(text)
    word, known, after = next(words, None), -1, None
    for start, end in spans:
        while word and word.end() <= start:
            before.append(word[0].lower())
            word = next(words, None)
        if not 0 <= known <= end or (after and after.start() < end):
            known, after = end, _WORD.search(text, end)
        found = []
        if len(before) == 2:
            found.append("2 " + " ".join(before))
        if before and after:
            found.append(f"1 {before[-1]} _ {after[0].lower()}")
        made.append(found)
    return made


def _instance(token: str) -> str:
    token = re.sub(r"[\s().-]", "", token.lower())
    return token if len(token) <= _LONG else hashlib.sha256(token.encode()).hexdigest()


def _slots(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of tokens with a mark that touch no base span."""
    runs: list[list[int]] = []
    done, k = 0, 0
    while mark := _MARK(text, done):
        start, end = mark.span()
        while start > done and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK(text, end)
        end = blank.start() if blank else len(text)
        if _SIGN(text, start, end):
            left = len(text[done:start].rstrip(" \t")) + done
            while left > done and not text[left - 1].isspace():
                left -= 1
            right = end
            while right < len(text) and text[right] in " \t":
                right += 1
            blank = _BLANK(text, right)
            start, end = left, blank.start() if blank else len(text)
        done = end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        last = runs[-1] if runs else None
        if last and text[last[1] - 1] not in _ENDS and not text[last[1]:start].strip(" \t"):
            last[1] = end
        else:
            runs.append([start, end])
    trimmed = []
    for start, end in runs:
        raw = text[start:end]
        start, end = end - len(raw.lstrip(_BEFORE)), start + len(raw.rstrip(_AFTER))
        if start < end:
            trimmed.append((start, end))
    return trimmed


def mentions(text: str | None) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and seeds and slots with a pattern: ``(start, end, kind or -1, instance, patterns)``."""
    text = text or ""
    base = base_spans(text)
    spans = sorted((a, b, kind) for kind, a, b in base)
    spans = sorted(spans + [(a, b, -1) for a, b in _slots(text, [s[:2] for s in spans])])
    if not spans:
        return base, []
    found = _contexts(text, [s[:2] for s in spans])
    return base, [(a, b, kind, _instance(text[a:b]), f) for (a, b, kind), f in zip(spans, found) if f]


_MENTION = "array<struct<start: long, end: long, kind: int, instance: string, patterns: array<string>>>"


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base, mentions`` of every row, written to the shared folder; ``key`` is the text's SHA-256."""
    def each(chunks) -> Iterator[list[tuple]]:
        for rows in chunks:
            yield [(r["doc_id"], text_key(r["text"]), *mentions(r["text"])) for r in rows]

    return cut_lineage(map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each,
        f"doc_id long, key string, base array<struct<kind: int, start: long, end: long>>, mentions {_MENTION}"))


def text_key(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def learn(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """``pattern, instance, kind``: accepted instances that are not seeds, with the patterns that support them.

    A pattern takes part if at least ``support`` different seeds of one kind stand in it.
    """
    contexts = found.select(F.explode("mentions").alias("m")).select(
        "m.instance", "m.kind", F.xxhash64("m.patterns").alias("context"), "m.patterns").distinct()
    edges = contexts.select("instance", "kind", "context", F.explode("patterns").alias("pattern"))
    seeded = edges.where("kind >= 0").select("pattern", "kind", "instance").distinct().groupBy("pattern", "kind").agg(
        F.count(F.lit(1)).alias("n"))
    able = seeded.where(F.col("n") >= support).select("pattern", F.col("kind").alias("of"))
    places = cut_lineage(edges.join(able, "pattern").select(
        "pattern", "of", "instance", F.when(F.col("kind") >= 0, None).otherwise(F.col("context")).alias("context"),
        F.when(F.col("kind") < 0, None).otherwise((F.col("kind") == F.col("of")).cast("double")).alias("seed")))
    edges = places.select("pattern", "of", "instance", "seed").distinct()
    # How many of an instance's different contexts hold a pattern of the kind.
    held = places.where("context is not null").select("instance", "of", "context").distinct().groupBy(
        "instance", "of").agg(F.count(F.lit(1)).alias("held"))
    everywhere = contexts.where("kind < 0").groupBy("instance").agg(F.count_distinct("context").alias("everywhere"))
    share = held.join(everywhere, "instance").select("instance", "of", (F.col("held") / F.col("everywhere")).alias("share"))
    edges = cut_lineage(edges.join(share, ["instance", "of"], "left"))
    state = edges.withColumn("score", F.coalesce("seed", F.lit(0.0)))
    for _ in range(rounds):
        trust = state.groupBy("pattern", "of").agg(
            (F.sum("score") / (F.count(F.lit(1)) + F.lit(PRIOR))).alias("trust"))
        judged = edges.join(trust, ["pattern", "of"])
        scores = judged.groupBy("instance", "of").agg(F.coalesce(F.max("seed"), F.max("share") * (
            F.lit(1.0) - F.exp(F.sum(F.log1p(-F.col("trust")))))).alias("score"))
        state = judged.join(scores, ["instance", "of"])
    return state.where(F.col("seed").isNull() & (F.col("score") >= accept)).select(
        "pattern", "instance", F.col("of").alias("kind")).distinct()


def added_spans(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """``key, added``: the spans that accepted instances add to the texts they stand in."""
    own = found.select("key", F.explode("mentions").alias("m")).where("m.kind < 0").select(
        "key", "m.start", "m.end", "m.instance", F.explode("m.patterns").alias("pattern")).distinct()
    return own.join(accepted, ["pattern", "instance"]).groupBy("key").agg(
        F.collect_set(F.struct("kind", F.col("start"), F.col("end"))).alias("added"))


def _beside(rows: DataFrame, added: DataFrame) -> DataFrame:
    """``rows(key, doc_id, ...)`` with ``added`` of their text, null where nothing is.

    A third of all rows may be copies of one text: spans are broadcast if they are few, else
    every text's spans go to ``SALTS`` parts and its copies are dealt to these by doc_id.
    """
    added = cut_lineage(added)
    size = added.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("added")).alias("spans")).first()
    if fits_broadcast(rows.sparkSession, size["rows"] + (size["spans"] or 0), 160):
        return rows.join(F.broadcast(added), "key", "left")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SALTS)).cast("int"))
    copied = added.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, ["key", "_salt"], "left").drop("_salt")


def extract(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found`` of every row.

    The counts and the digest tell of the base matches; ``spans`` lists ``kind:start:end`` of
    these and of the spans that the method adds, whose number is ``found``. Null and
    empty texts have none. Rows of equal or null ids stay separate, other columns are
    not read, an empty table gives no rows.
    """
    rows = find(docs)
    added = added_spans(rows, learn(rows, **settings))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(len(KINDS))]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{name}") for n, name in zip(counts, KINDS)]
    return _beside(rows, added).select(
        "doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", F.coalesce("added", none)))).alias("spans"),
        F.size(F.coalesce("added", none)).cast("long").alias("found"))


def without(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as its kind in brackets; of spans that overlap the first names them all."""
    out, at, end = [], 0, 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end = max(end, stop)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with all spans of ``extract`` taken out of ``text``, and ``n_chars`` (if there) as it then is.

    A null text stays null.
    """
    found = find(docs)
    columns = docs.columns
    named = docs.select(
        *[docs[c].alias(f"_{i}") for i, c in enumerate(columns)], "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    keyed = _beside(named, added_spans(found, learn(found, **settings))).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)], F.col("added").alias("_added"))

    def run(batches):
        import pyarrow as pa

        at = columns.index("text")
        for batch in batches:
            texts = [
                None if t is None else without(t, base_spans(t) + [(s["kind"], s["start"], s["end"]) for s in more or []])
                for t, more in zip(batch.column("text").to_pylist(), batch.column("_added").to_pylist())]
            own = batch.columns[:len(columns)]
            own[at] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(own, columns)

    done = keyed.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
