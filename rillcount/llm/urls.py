"""URL filter: prefix rules, and a ratio of character language models for all other URLs.

URLs that rules allow or block train two Markov models over characters. Contexts have up to
``ORDER`` characters; a longer context is mixed with the next shorter one by Witten-Bell
weights, so that every URL has a probability. A URL's score is the difference of its
log-likelihoods per character. The threshold is calibrated on the fifth of the labelled
URLs that training leaves out (by the MD5 of the text): the least balanced error.

Counting collapses equal grams on the map side. Scores are sums of whole
micro-units, so they do not depend on the order of adding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcount.session import cut_lineage

#: Rules of the registered query (fixed values).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
ORDER, UNIT, SALTS, BINS = 4, 1_000_000, 16, 100
#: Letters that stand before the first and after the last character of a URL.
BEFORE, AFTER = "\x02", "\x03"


def parse(url: str) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://`` or for null."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def whole(url: str) -> Column:
    """The whole URL, its host in lower case as ``parse`` gives it; empty for null."""
    start = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN instr({url}, '://') + 2 ELSE 0 END")
    host = parse(url)[0]
    return F.coalesce(F.concat(
        F.col(url).substr(F.lit(1), start), host,
        F.col(url).substr(start + F.char_length(host) + 1, F.char_length(url))), F.lit(""))


def _split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def matched(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``, else null."""
    found, verdict = None, None
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, path = _split_rule(rule)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if found is None else (found, verdict)


def _grams(texts: DataFrame, order: int, *columns: str) -> DataFrame:
    """One row for each character of each text (its end included): it and the ``order`` before it, as ``g``."""
    padded = F.concat(F.lit(BEFORE * order), F.col("text"), F.lit(AFTER))
    return texts.select(*columns, F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("text") + 1),
        lambda i: padded.substr(i, F.lit(order + 1)))).alias("g"))


def ratios(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``g, units``: log-likelihood differences of all grams of ``texts(text, a, r)`` in units of 1 / ``UNIT``.

    ``a`` and ``r`` are the weights with which a text trains the accepting and the
    rejecting model, zero for texts that are only scored.
    """
    counts = cut_lineage(_grams(texts, order, "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    levels = [counts]
    for _ in range(order):
        levels.append(levels[-1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r")))
    levels.reverse()
    kinds = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "ar"]
    distinct = [F.count(F.when(F.col(x) > 0, 1)).alias(f"t{x}") for x in "ar"]
    total = levels[0].agg(*kinds, *distinct, F.count(F.lit(1)).alias("v")).first()

    def mixed(x, n, t, shorter):
        return f"CASE WHEN {n} + {t} > 0 THEN ({x} + {t} * {shorter}) / ({n} + {t}) ELSE {shorter} END"

    even = f"(1D / {total['v'] + 1}D)"
    known = levels[0].select("g", *[F.expr(mixed(
        x, f"{total[x]}D", f"{total['t' + x]}D", even)).alias(f"p{x}") for x in "ar"])
    for level in levels[1:]:
        context = F.expr("substring(g, 1, char_length(g) - 1)").alias("c")
        contexts = level.groupBy(context).agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), *distinct)
        known = (
            level.withColumn("c", context).join(contexts, "c")
            .join(known.withColumnRenamed("g", "s"), F.expr("substring(g, 2) = s"))
            .select("g", *[F.expr(mixed(
                x, f"CAST(n{x} AS DOUBLE)", f"CAST(t{x} AS DOUBLE)", f"p{x}")).alias(f"p{x}") for x in "ar"]))
    return known.select("g", F.round((F.ln("pa") - F.ln("pr")) * UNIT).cast("long").alias("units"))


def scores(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``text, a, r, fold, score`` for different texts: units per character, as a double of their own size."""
    table = ratios(texts.select(
        "text", *[F.when(F.col("fold"), 0).otherwise(F.col(x)).alias(x) for x in "ar"]), order)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = _grams(texts.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")), order,
                  "text", "salt")
    sums = each.join(salted, ["g", "salt"]).groupBy("text").agg(
        F.sum("units").alias("units"), F.count(F.lit(1)).alias("n"))
    return texts.join(sums, "text").select(
        "text", "a", "r", "fold", (F.col("units") / F.col("n") / UNIT).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The cut of least balanced error on the fold left out, in steps of 1 / ``BINS``; 0 without both kinds there.

    It lies half way between the bins it parts, so that URLs of neither kind have the same room on both sides.
    """
    bins = scored.where("fold AND a + r > 0").groupBy(
        F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    below = "OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # Scores are sums of few hundred kinds of logarithms, so there are some thousand bins at most.
    cut = bins.selectExpr(
        "bin", "floor((coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) + bin) / 2) AS cut", f"coalesce(sum(a) {below}, 0) AS lost", "sum(a) OVER () AS all_a", "sum(r) OVER () AS all_r",
        f"sum(r) OVER () - coalesce(sum(r) {below}, 0) AS passed").where("all_a > 0 AND all_r > 0").orderBy(
        F.expr("lost * all_r + passed * all_a"), "bin").first()
    return cut["cut"] / BINS if cut else 0.0


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages(page_id, url)``.

    Rules look at host and path; the models learn and score the whole URL.

    ``rule`` is the longest that fits and gives the verdict; else the score does. Equal URLs
    get equal results, rows of equal or null ids stay separate, null and odd URLs have
    empty host and path, other columns are not read, an empty table gives no rows.
    """
    host, path = parse("url")
    rule, verdict = matched(rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), whole("url").alias("text")).select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "text")
    fold = F.expr("CAST(conv(substring(md5(text), 1, 4), 16, 10) AS INT) % 5 = 0")
    texts = cut_lineage(parsed.groupBy("text").agg(
        F.count(F.when(F.col("by_rule") == "allow", 1)).alias("a"),
        F.count(F.when(F.col("by_rule") == "block", 1)).alias("r")).withColumn("fold", fold))
    scored = cut_lineage(scores(texts, order))
    cut = threshold(scored)
    own = F.when(F.floor(F.col("score") * BINS) >= round(cut * BINS), "allow").otherwise("block")
    return parsed.join(scored.select("text", "score"), "text").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "score")
