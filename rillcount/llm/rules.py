"""Quality rules by weak supervision.

Every rule looks at numbers of a document and votes keep (1) or reject (-1) or abstains
(0). Rules are wrong at times and each knows only some kinds of bad text, so they have
rates of their own for good and for bad documents. Expectation-maximisation estimates
these and the share of bad documents from how votes come together over the whole
corpus, and a document is kept by the posterior probability that it is good.

All that the estimation reads is the number of documents for each pattern of votes, at
most ``3 ** rules`` rows; every round is one aggregation over that table. Rates are
rounded to nine digits, so that sums in another order give the same model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcount.session import cut_lineage

#: What ends words, symbols and the words of a window (fixed values).
SPACE, SYMBOLS, WINDOW = r"[\x20\x09-\x0D]", "#*$%&|<>", 8
ROUNDS, KEEP = 12, 0.5
#: Pseudo-counts (rejects, votes) by which rates start and are smoothed: of bad, of good, and bad among all documents.
BAD, GOOD, SHARE = (40, 100), (1, 100), (10, 100)


@dataclass(frozen=True)
class Rule:
    """Votes by ``amount`` as a percentage of ``of``: reject above ``worst``, keep up to ``fine``, else abstain."""

    name: str
    amount: str
    of: str
    fine: int
    worst: int

    def vote(self) -> str:
        return (f"CASE WHEN {self.of} <= 0 THEN 0 WHEN 100 * {self.amount} > {self.worst} * {self.of} THEN -1 "
                f"WHEN 100 * {self.amount} <= {self.fine} * {self.of} THEN 1 ELSE 0 END")


RULES = (
    Rule("repeats", "n_repeat_words", "n_words", 5, 30),
    Rule("symbols", "n_symbols", "n_words", 5, 20),
    Rule("same_lines", "n_dup_lines", "n_lines", 10, 50),
    Rule("capitals", "n_capitals", "word_chars", 30, 60),
    Rule("shouts", "n_shouts", "n_words", 10, 40),
    Rule("long_words", "word_chars", "n_words", 1000, 1600),
)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeats(hashes: Column) -> Column:
    """Words covered by windows whose hash comes twice or more; ``hashes`` in the order of the windows."""
    placed = F.sort_array(F.arrays_zip(
        hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i")))

    def twice(sorted_: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            near = (F.get(sorted_, k - 1)["h"] == x["h"]) | (F.get(sorted_, k + 1)["h"] == x["h"])
            return F.when(near, x["i"])

        return F.sort_array(F.array_compact(F.transform(sorted_, place)))

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, k: F.least(
                F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x)

    return _with(_with(placed, twice), covered)


def repeated_words(words: Column) -> Column:
    """Words in windows that stand twice or more in ``words``, the first time included.

    Windows are compared by 64-bit hashes within a text.
    """
    hashes = F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    return _with(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_repeats(h)))


def numbers(docs: DataFrame) -> DataFrame:
    """The numbers of every row's whole text that rules look at, as longs beside doc_id. A null text has no words."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Beside doc_id and the numbers stands ``text_key``, a hash by which rows of one id are told apart.
    trimmed = F.expr(r"trim(BOTH ' \t\n\u000B\u000C\r' FROM text)")
    with_words = text.select(
        "doc_id", F.xxhash64("text").alias("text_key"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace("text", r"[^\p{Lu}!#*$%&|<>]+", "").alias("signs"))
    return with_words.select(
        "doc_id", "text_key",
        F.size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.char_length(F.regexp_replace("signs", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _with(F.col("words"), repeated_words).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.char_length(F.regexp_replace("signs", r"\P{Lu}+", "")).alias("n_capitals"),
        F.char_length(F.regexp_replace("signs", "[^!]+", "")).alias("n_shouts"),
    ).select("doc_id", "text_key", *[F.col(c).cast("long").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")])


@dataclass(frozen=True)
class Rates:
    """Share of bad documents, and for each rule the rate of rejects among its votes on bad and good ones."""

    bad: float
    rules: tuple[tuple[float, float], ...]

    @classmethod
    def start(cls, n: int) -> Rates:
        return cls(SHARE[0] / SHARE[1], ((BAD[0] / BAD[1], GOOD[0] / GOOD[1]),) * n)

    def posterior(self) -> str:
        """SQL for the probability that a document with votes ``v0, v1, ...`` is bad."""
        odds = [f"ln({self.bad!r}D / {1 - self.bad!r}D)"]
        for j, (bad, good) in enumerate(self.rules):
            odds.append(f"CASE v{j} WHEN -1 THEN ln({bad!r}D / {good!r}D) "
                        f"WHEN 1 THEN ln({1 - bad!r}D / {1 - good!r}D) ELSE 0D END")
        return f"1D / (1D + exp(-({' + '.join(odds)})))"


def _rate(rejects: str, votes: str, prior: tuple[int, int]) -> str:
    return f"round((sum({rejects}) + {prior[0]}) / (sum({votes}) + {prior[1]}), 9)"


def estimate(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> Rates:
    """Rates after ``rounds`` rounds over ``patterns(v0, v1, ..., n)``; those of the start without rows.

    Bad documents never get a lower rate of rejects than good ones.
    """
    rates = Rates.start(n_rules)
    for _ in range(rounds):
        sums = [F.expr(_rate("n * p", "n", SHARE)).alias("bad")]
        for j in range(n_rules):
            for side, p, prior in (("b", "p", BAD), ("g", "(1D - p)", GOOD)):
                sums.append(F.expr(_rate(
                    f"CASE WHEN v{j} = -1 THEN n * {p} ELSE 0D END",
                    f"CASE WHEN v{j} <> 0 THEN n * {p} ELSE 0D END", prior)).alias(f"{side}{j}"))
        row = patterns.withColumn("p", F.expr(rates.posterior())).agg(*sums).first()
        if row["bad"] is None:
            break
        rates = Rates(row["bad"], tuple((max(row[f"b{j}"], row[f"g{j}"]), row[f"g{j}"]) for j in range(n_rules)))
    return rates


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """``doc_id``, ``text_key``, base numbers, ``base_failed``, ``p_good`` and ``kept`` of every row.

    ``base_failed``: fewer than 20 words, or more than 30 of 100 words in repeated windows; such
    rows are not kept. Null and empty texts fail. Rows of equal or null ids are
    judged separately; other columns are not read; an empty table gives no rows.
    """
    found = cut_lineage(numbers(docs))
    voted = found.select("*", *[F.expr(r.vote()).alias(f"v{j}") for j, r in enumerate(rules)])
    votes = [f"v{j}" for j in range(len(rules))]
    patterns = cut_lineage(voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")))
    rates = estimate(patterns, len(rules), rounds)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    p_good = F.round(F.lit(1.0) - F.expr(rates.posterior()), 6)
    return voted.select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), p_good.alias("p_good")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= keep)).select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "p_good")


def judge(docs: DataFrame, **settings) -> DataFrame:
    """``judged`` without the key of the text."""
    return judged(docs, **settings).drop("text_key")


def kept_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns, whatever these are called."""
    kept = judged(docs, **settings).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_key"))
    return rows.join(kept, same).select(*rows.columns).toDF(*names)
