"""Near duplicates, URL verdicts, top-k search and the pipeline against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillcount.llm import simhash, topk, urls

ODD = [None, "", " \n", "one", "one two", "One TWO three", "x " * 9000, "É é"]


def union(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_by_the_definition():
    import xxhash

    for text in ["a b", "a b c d", "A b C d e a b c", " x\ty\nz\x0bw ", "é è ü ö é"]:
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def clusters(seed, spread, n):
    """Fingerprints around a few centres, so that chains of near ones and large blocks arise."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = [0, 7]
    for _ in range(n):
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, spread)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("seed,spread,large", [(1, 4, 256), (2, 6, 8), (3, 3, 2), (4, 8, 3)])
def test_links_connect_what_brute_force_connects(make, monkeypatch, seed, spread, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    prints = clusters(seed, spread, 300)
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = union(len(prints), near)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(make([(p,) for p in signed], "print long"))
    at = {p: i for i, p in enumerate(signed)}
    got = [(at[r.a], at[r.b]) for r in links.collect()]
    assert set(map(lambda e: (max(e), min(e)), got)) <= set(near)
    assert union(len(prints), got) == want
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    smallest = {}
    for i, w in enumerate(want):
        smallest[w] = min(smallest.get(w, signed[i]), signed[i])
    assert all(roots.get(p, p) == smallest[want[i]] for i, p in enumerate(signed))


def test_near_duplicates_of_odd_rows(spark, make):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(i + 100, t) for i, t in enumerate(ODD)]
    for i in range(12):
        copy = list(base)
        copy[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(500 + i, " ".join(rng.choice(words) for _ in range(50))) for i in range(20)] + [(None, "one"), (3, "one")]
    docs = make([(*r, "s") for r in rows], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    prints = [simhash.fingerprint(t) for _, t in rows]
    want = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for (doc_id, _), w in zip(rows, want):
        if doc_id is not None:
            least[w] = min(least.get(w, doc_id), doc_id)
    expected = sorted((str(d), f"{p:016x}", str(least.get(w))) for (d, _), p, w in zip(rows, prints, want))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near_copy(rng, words):
    """The words with one of them replaced so that the fingerprint stays within three bits, and differs."""
    while True:
        copy = list(words)
        copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10 ** 6)}"
        if 0 < (simhash.fingerprint(" ".join(copy)) ^ simhash.fingerprint(" ".join(words))).bit_count() <= 3:
            return copy


def test_kept_rows_are_those_of_brute_force_distance(make):
    """Chains of copies: each within three bits of the one before, not of the first."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [""]
    for _ in range(8):
        copy = [rng.choice(words) for _ in range(rng.randint(100, 500))]
        texts.append(" ".join(copy))
        for _ in range(4):
            copy = near_copy(rng, copy)
            texts.append(" ".join(copy).upper())
    prints = [simhash.fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    kept = simhash.keep_one(make(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(union(len(texts), near))) == [0, *range(1, 41, 5)]


def test_rows_of_one_id_or_none_are_kept_by_their_texts(make):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    a, b, c, d = ([rng.choice(words) for _ in range(200)] for _ in range(4))
    a, near, b, c, d, e = (" ".join(w) for w in (a, near_copy(rng, a), b, c, d, near_copy(rng, d)))
    rows = [(3, a, "x"), (5, near, "x"), (5, b, "x"), (7, c, "y"), (7, c, "x"), (7, c, "y"), (None, a, "x"),
            (None, d, "x"), (None, d, "x"), (None, e, "x")]
    seen = set()
    for turn in range(3):
        rng.shuffle(rows)
        kept = simhash.keep_one(make(rows, "doc_id long, text string, source string")).collect()
        assert len(kept) == 4
        assert {(r.doc_id, r.text) for r in kept if r.text not in (d, e)} == {(3, a), (5, b), (7, c)}
        seen.add(tuple(sorted(map(str, kept))))
    assert len(seen) == 1


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/", "https://www.example.com/en/a?b", "x://example.com/en",
        "http://a.example.com/en/1#x", "http://n.net/es/", "http://net/fr/2", "http://evilexample.com/en/", "http://a.net?x/es/", "http://b.org/q/w" * 400]


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for kind, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = kind, rule
    return host, path, best


def test_rules_and_odd_urls(spark, make):
    rows = list(enumerate(URLS)) + [(3, "http://again.org/"), (None, "http://z.com/")]
    got = urls.judge(make([(i, u, "h") for i, u in rows], "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    for i, u in rows:
        if i in (3, None):
            continue
        r = next(r for r in got if r.page_id == i)
        host, path, best = plain_rule(u)
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_model_tells_unruled_hosts_apart(make):
    rng = random.Random(6)
    rows = [f"http://site{rng.randrange(999)}.com/good-{rng.randrange(99)}" for _ in range(150)]
    rows += [f"http://site{rng.randrange(999)}.net/es/casino-{rng.randrange(99)}" for _ in range(150)]
    rows += [f"http://x{i}.org/good-{i}" for i in range(20)] + [f"http://x{i}.org/es/casino-{i}" for i in range(20)]
    got = urls.judge(make(list(enumerate(rows)), "page_id long, url string")).where("rule is null").collect()
    right = sum((r.verdict == "allow") == ("good" in r.path) for r in got)
    assert len(got) == 40 and right >= 38


def test_models_see_the_whole_url(make):
    """Only the query strings, or URLs without a scheme, tell these apart."""
    rows = [f"http://s{i}.com/p?q=good-{i}" for i in range(150)] + [f"http://s{i}.net/es/p?q=casino-{i}" for i in range(150)]
    odd = ["http://x.org/p?q=good-1", "http://x.org/p?q=casino-1", "good-good-good", "casino-casino-casino", "HTTP://X.org/P?Q#F", None]
    got = {r.page_id: r for r in urls.judge(make(list(enumerate(odd + rows)), "page_id long, url string")).collect()}
    assert got[0].score > got[1].score and got[0].verdict == "allow" and got[1].verdict == "block"
    assert got[2].score > got[3].score and (got[2].host, got[2].path, got[5].host) == ("", "", "")
    texts = make([(u,) for u in odd], "url string").select("url", urls.whole("url").alias("t")).collect()
    assert {r.url: r.t for r in texts} == {**{u: u for u in odd[:4]}, odd[4]: "HTTP://x.org/P?Q#F", None: ""}


def plain_top(rows, k):
    out = []
    for a, (qid, q) in enumerate(rows):
        if qid % 10 == 0:
            scores = [(-sum(x * y for x, y in zip(q, c)), cid) for b, (cid, c) in enumerate(rows) if b != a and len(c) == len(q)]
            out += [(qid, rank, cid, -s) for rank, (s, cid) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("wide", [1.0, 1e6])
@pytest.mark.parametrize("cells,block", [(16, 2), (1 << 18, 1024)])
def test_top_k_equals_sorting(make, monkeypatch, cells, block, wide):
    monkeypatch.setattr(topk, "FAN", 3)
    rng = random.Random(7)
    rows = [(i, [round(rng.uniform(-wide, wide), 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [0.5] * 4), (100, [0.5] * 4), (110, [0.5] * 2), (61, [1.0] * 2), (120, [])]
    odd = [(None, [1.0] * 4), (130, None), (140, [1.0, None, 1.0, 1.0]), (150, [float("nan")] * 4), (160, [float("inf")] * 4)]
    df = make([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, topk.top_k(df, 10, every=10, shard_cells=cells, block_queries=block).collect()))
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    assert got == plain_top(whole, 10)


def test_top_k_without_rows_or_queries(spark, make):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    none = topk.top_k(make([(1, [1.0])], "vec_id long, embedding array<float>"))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


def test_pipeline_stages_keep_their_promises(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    classified = {r.doc_id for r in seen["quality classifier"].collect()}
    ruled = {r.doc_id for r in seen["quality rules"].collect()}
    single = [r.doc_id for r in seen["near duplicates"].collect()]
    assert ruled <= classified <= set(raw) and set(single) <= ruled and len(single) == len(set(single))
    prints = [simhash.fingerprint(raw[d]) for d in single]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert seen["personal data"].where(F.col("text").rlike("@mail[0-9]")).count() == 0
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == set(single)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and d in raw and len(raw[d].split()) >= 20]
    assert sum(d in ruled for d in good) / len(good) > 0.9


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        assert made.count() == 0
