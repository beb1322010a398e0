"""SQL twins of the registered queries that SQL can express, with the methods' own parameters."""

from __future__ import annotations

from rillcount.llm import decontaminate, rules, search, topk, urls

_MIXED = "CASE WHEN {n} + {t} > 0 THEN ({x} + {t} * {p}) / ({n} + {t}) ELSE {p} END"


def _quality_rules() -> str:
    n = len(rules.RULES)
    votes = ", ".join(f"v{j}" for j in range(n))
    steps = [f"""r0 AS MATERIALIZED (SELECT {rules.SHARE[0] / rules.SHARE[1]!r}::DOUBLE AS bad, """ + ", ".join(
        f"{rules.BAD[0] / rules.BAD[1]!r}::DOUBLE AS b{j}, {rules.GOOD[0] / rules.GOOD[1]!r}::DOUBLE AS g{j}"
        for j in range(n)) + ")"]

    def posterior(rate: str) -> str:
        odds = [f"ln({rate}.bad / (1 - {rate}.bad))"] + [
            f"CASE v{j} WHEN -1 THEN ln({rate}.b{j} / {rate}.g{j}) "
            f"WHEN 1 THEN ln((1 - {rate}.b{j}) / (1 - {rate}.g{j})) ELSE 0 END" for j in range(n)]
        return f"1 / (1 + exp(-({' + '.join(odds)})))"

    def rate(j: int, p: str, prior: tuple[int, int]) -> str:
        return (f"round((sum(CASE WHEN v{j} = -1 THEN n * {p} ELSE 0 END) + {prior[0]}) / "
                f"(sum(CASE WHEN v{j} <> 0 THEN n * {p} ELSE 0 END) + {prior[1]}), 9)")

    for k in range(rules.ROUNDS):
        made = ", ".join(
            f"greatest({rate(j, 'p', rules.BAD)}, {rate(j, '(1 - p)', rules.GOOD)}) AS b{j}, "
            f"{rate(j, '(1 - p)', rules.GOOD)} AS g{j}" for j in range(n))
        steps.append(f"""e{k} AS MATERIALIZED (SELECT patterns.*, {posterior(f'r{k}')} AS p FROM patterns, r{k}),
r{k + 1} AS MATERIALIZED (SELECT round((sum(n * p) + {rules.SHARE[0]}) / (sum(n) + {rules.SHARE[1]}), 9) AS bad, {made}
  FROM e{k})""")
    last = f"r{rules.ROUNDS}"
    w = rules.WINDOW
    return rf"""WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + {w - 1}], ' ') AS t
  FROM d, unnest(generate_series(1, len(words) - {w - 1})) AS s(i)),
hits AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM windows) WHERE c > 1),
marked AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM hits, unnest(generate_series(i, i + {w - 1})) AS s(p) GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    length(regexp_replace(text, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_capitals,
    length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_shouts
  FROM d LEFT JOIN marked ON d.doc_id = marked.doc_id),
v AS MATERIALIZED (SELECT f.*, {', '.join(f'{r.vote()} AS v{j}' for j, r in enumerate(rules.RULES))} FROM f),
patterns AS MATERIALIZED (SELECT {votes}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{(',' + chr(10)).join(steps)},
judged AS (
  SELECT v.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    round(1 - {posterior(last)}, 6) AS p_good FROM v, {last})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND p_good >= {rules.KEEP!r} AS kept, p_good FROM judged"""


def _url_filter() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = []
    for kind, rule in sorted(urls.RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = {quote(host)} OR ends_with(host, {quote('.' + host)})) "
                     f"AND starts_with(path, {quote('/' + path)})", quote(rule), quote(kind)))
    case = lambda at: "CASE " + " ".join(f"WHEN {f[0]} THEN {f[at]}" for f in fits) + " END"
    order, unit, bins = urls.ORDER, urls.UNIT, urls.BINS
    text = "coalesce(substr(url, 1, length(url) - length(rest)) || host || substr(rest, length(host) + 1), '')"
    grams = f"""SELECT {{columns}}, substr(repeat(chr(2), {order}) || text || chr(3), i, {order + 1}) AS g
  FROM texts, unnest(generate_series(1, length(text) + 1)) AS s(i)"""
    steps = [f"""n{order} AS MATERIALIZED (SELECT g, sum(a) AS a, sum(r) AS r FROM (
  {grams.format(columns='CASE WHEN fold THEN 0 ELSE a END AS a, CASE WHEN fold THEN 0 ELSE r END AS r')}) GROUP BY g)"""]
    for k in reversed(range(order)):
        steps.append(f"n{k} AS MATERIALIZED (SELECT substr(g, 2) AS g, sum(a) AS a, sum(r) AS r FROM n{k + 1} GROUP BY 1)")
    for k in range(order + 1):
        steps.append(f"""c{k} AS MATERIALIZED (SELECT substr(g, 1, length(g) - 1) AS c, sum(a)::DOUBLE AS na, sum(r)::DOUBLE AS nr,
  count(*) FILTER (a > 0)::DOUBLE AS ta, count(*) FILTER (r > 0)::DOUBLE AS tr FROM n{k} GROUP BY 1)""")
        p = lambda x: _MIXED.format(n=f"n{x}", t=f"t{x}", x=f"n.{x}::DOUBLE", p=f"s.p{x}")
        shorter = f"p{k - 1}" if k else "(SELECT '' AS g, 1 / (count(*) + 1)::DOUBLE AS pa, 1 / (count(*) + 1)::DOUBLE AS pr FROM n0)"
        steps.append(f"""p{k} AS MATERIALIZED (SELECT n.g, {p('a')} AS pa, {p('r')} AS pr FROM n{k} n
  JOIN c{k} c ON c.c = substr(n.g, 1, length(n.g) - 1) JOIN {shorter} s ON s.g = substr(n.g, 2))""")
    return rf"""WITH cut0 AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, url, rest FROM cut0),
ruled AS MATERIALIZED (SELECT *, {case(1)} AS rule, {case(2)} AS by_rule, {text} AS text FROM parsed),
texts AS MATERIALIZED (
  SELECT text, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS r,
    ('0x' || substr(md5(text), 1, 4))::INT % 5 = 0 AS fold FROM ruled GROUP BY text),
{(',' + chr(10)).join(steps)},
units AS (SELECT g, round((ln(pa) - ln(pr)) * {unit})::BIGINT AS units FROM p{order}),
scored AS MATERIALIZED (
  SELECT text, floor(sum(units)::DOUBLE / count(*) / {unit} * {bins})::BIGINT AS bin
  FROM ({grams.format(columns='text')}) JOIN units USING (g) GROUP BY text),
bins AS (SELECT bin, sum(a) AS a, sum(r) AS r FROM scored JOIN texts USING (text) WHERE fold AND a + r > 0 GROUP BY bin),
tried AS (
  SELECT bin, floor((coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) + bin) / 2)::BIGINT AS cut, coalesce(sum(a) OVER w, 0) AS lost, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r,
    sum(r) OVER () - coalesce(sum(r) OVER w, 0) AS passed FROM bins
  WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
  SELECT coalesce((SELECT cut FROM tried WHERE all_a > 0 AND all_r > 0
    ORDER BY lost * all_r + passed * all_a, bin LIMIT 1), 0) AS bin)
SELECT page_id, host, path, rule,
  coalesce(by_rule, CASE WHEN scored.bin >= cut.bin THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scored USING (text), cut"""


def _top_k() -> str:
    return f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE!r}::DOUBLE * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _lexical_search() -> str:
    return f"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
sized AS (SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
weights AS (
  SELECT term, floor({search.WEIGHT_UNIT} * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
scored AS (
  SELECT item_id, r, doc_id, sum(w * (({search.IMPACT_UNIT} * tf) // ({search.TF_UNIT} * tf + {search.LENGTH_FACTOR}
    * ({search.LEAST} + ({search.SHARE} * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (r), totals GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {search.TOP}"""


def _decontaminate() -> str:
    n = decontaminate.WINDOW
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS words FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(words), {n}) AS size, array_to_string(words[i:i + {n - 1}], ' ') AS w
  FROM b, unnest(generate_series(1, greatest(len(words) - {n - 1}, 1))) AS s(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, i, size, array_to_string(words[i:i + size - 1], ' ') AS w
  FROM d, sizes, unnest(generate_series(1, len(words) - size + 1)) AS s(i)),
found AS MATERIALIZED (SELECT r, i, size, item FROM places JOIN windows USING (size, w)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(generate_series(i, i + size - 1)) AS s(p) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""


SQL = {"op1_quality_rules": _quality_rules(), "op6_url_filter": _url_filter(),
       "op9_top_k": _top_k(), "op11_lexical_search": _lexical_search(), "op12_decontaminate": _decontaminate()}
