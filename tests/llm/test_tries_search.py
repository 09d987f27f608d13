"""Prefix trie, URL filters and lexical search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cantoria.llm import lexical_search, prefix_trie, url_filter
from cantoria.llm.textbytes import column_bytes

TURNS = "conv_id long, turn long, role string, text string, depth long, p1 string, words string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[:d - 1]].add(p[:d])

    def below(p):
        n, saved = 0, (len(members[p]) - 1) * len(re.findall(prefix_trie.WORD, p[-1][1])) if p else 0
        for q in children[p]:
            a, b = below(q)
            n, saved = n + a, saved + b
        return n or 1, saved

    out = set()
    for p, m in list(members.items()):
        ids = ",".join(map(str, sorted(c for c in m if paths[c] == p)))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below(p), hashlib.sha256(ids.encode()).hexdigest()))
    return out


def turns_of(seed, convs, n):
    rnd = random.Random(seed)
    rows = []
    for c in range(-convs // 8, convs):
        same = rnd.random() < 0.4
        for t in range(rnd.randint(1, n)):
            text = f"shared {t}" if same and rnd.random() < 0.9 else rnd.choice([None, "", " a  b ", "x y z", f"own {rnd.random()}"])
            rows.append((c, rnd.choice([t, t, None, 1]) if rnd.random() < 0.2 else t, rnd.choice(["user", None]) if rnd.random() < 0.1 else "user", text, 1, "p", "w"))
    rows = [r for r in rows if r[0] not in (20, 40)]  # two openings are absent
    return rows + rows[::17] + [(None, 1, "user", "nobody", 1, "p", "w"), (20 * convs + 1, 0, "user", "only", 1, "p", "w")]


@pytest.mark.parametrize("bits, convs, n", [(22, 120, 7), (4, 60, 20)])
def test_trie_equals_brute_force(spark, bits, convs, n):
    rows = turns_of(bits, convs, n)
    # turns of equal number are ordered by a digest: give them distinct numbers, or equal texts
    seen, fixed = Counter(), []
    for r in rows:
        seen[r[:2]] += 1
        fixed.append(r if seen[r[:2]] == 1 else (r[0], 1000 + sum(seen.values()), *r[2:]))
    got = prefix_trie.trie(spark.createDataFrame(fixed, TURNS).repartition(5), bits=bits).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    assert {tuple(r) for r in got} == brute_trie(fixed)


def test_trie_of_one_long_conversation_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    long = [(7, t, "user", f"turn {t % 5}", 1, "p", "w") for t in range(600)] + [(27, t, "user", f"turn {t % 5}", 1, "p", "w") for t in range(350)]
    copies = [(c, t, "user", f"copy {t}", 1, "p", "w") for c in range(100, 400) for t in range(5)]
    repeated = [(5001, None, None, None, 1, "p", "w")] * 50
    rows = long + copies + repeated
    assert {tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(6)).collect()} == brute_trie(rows)


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(c, 1, "user", f"text {k}", 1, "p", "w") for c in (1, 2, 3) for k in range(6)]
    one = {tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert one == {tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows[::-1], TURNS).repartition(4)).collect()}


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "p", "w")], TURNS)).count() == 0


def test_only_prefixes_that_may_be_shared_reach_the_exact_step(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c} {t}", 1, "p", "w") for c in range(0, 4000, 20) for t in range(10)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, TURNS))
    from pyspark.sql import functions as F
    facts = prefix_trie._facts(turns, prefix_trie.opening_of(F.col("conv_id")), prefix_trie.opening_length(F.col("conv_id")))
    prefixes = prefix_trie.rebuilt(turns, facts)
    marked = prefix_trie.screened(prefixes, prefix_trie.sketch(prefixes))
    assert marked.filter("shared").count() == 200 and marked.filter("above").count() == 400 and marked.count() == 2000


def parts_of(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_verdict(url, rules, default="allow"):
    host, path = parts_of(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = ["http://a.example.net/en/1", "https://EXAMPLE.net/de/x?y#z", "http://example.com/de/", "http://x.org/fr/a://b", "ftp://org/fr/", "http://notexample.com/de/1",
        "http://example.com", "http://net", "http://net/", "http://net?a/", "no scheme", "", None, "://", "http:///x", "http://a.b.c.d.e.f.example.com/de/1/2/3/" + "p/" * 4000,
        "http://" + "s." * 4000 + "net/q", "http://example.net:80/en/", "http://é.Ünet.net/ü/é", "http://line\nfeed.net/a\nb/c", "http://.net/a", "http://net./", "x" * 50_000]


@pytest.mark.parametrize("rules", [
    url_filter.RULES,
    [("net", "/", "block"), ("net", "/", "allow"), ("b.net", "/", "allow"), ("net", "/a/", "block"), ("", "/", "block"), (None, "/", "block"), ("org", None, "block")],
    [("example.com", "/de/1/2", "block"), ("example.com", "/d", "allow"), ("com", "", "block"), ("é.ünet.net", "/ü", "block"), ("f.example.com", "/de/1/2/3/p/p/", "allow")],
    [],
])
def test_urls_equal_brute_force(spark, rules):
    rnd = random.Random(3)
    urls = URLS + ["http://" + ".".join(rnd.choices(["a", "b", "net", "example", "com", "org"], k=rnd.randint(1, 4))) + rnd.choice(["", "/", "/en/", "/de/1", "/a/b?c", "/fr"])
                   for _ in range(500)] + URLS[:3] * 40
    pages = spark.createDataFrame([(i, u, "old", "x") for i, u in enumerate(urls)], "page_id long, url string, rule string, short string").repartition(4)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()}
    clean = {(h, p or ""): max(v for a, b, v in rules if (a, b or "") == (h, p or "")) for h, p, _ in rules if h}
    assert got == {i: brute_verdict(u, [(h, p, v) for (h, p), v in clean.items()]) for i, u in enumerate(urls)}


def test_urls_pass_other_columns_and_use_no_python(spark):
    pages = spark.createDataFrame([(None, None, "k"), (1, "http://a.net/", "k"), (1, "http://a.net/", "k")], "page_id long, url string, digest string")
    out = url_filter.judge(pages, url_filter.rule_table(spark))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "http://a.net/", "k", "a.net", "/", "net/", "block")] * 2 + [(None, None, "k", "", "", None, "allow")]
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def brute_rank(docs, items, k=10):
    def terms(text):
        return re.findall(lexical_search.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, i is None, i, s))
        for rank, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k]):
            out.append((item, rank + 1, i, s))
    return sorted(out, key=str)


def made_docs(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "Éa", "éa", "a1", "Ⅷ", "naïve", "x-y"] + [f"w{i}" for i in range(200)]
    docs = [(i, rnd.choice([" ", "\n", ", ", "\x7f"]).join(rnd.choices(vocabulary, weights=[20] * 9 + [1] * 200, k=rnd.choice([1, 5, 30, 200])))) for i in range(n)]
    return docs + docs[:15] + [(None, docs[3][1]), (None, docs[3][1]), (900, None), (901, ""), (902, " .,;"), (903, "w1 " * 90_000), (904, "z" * 3_000_000 + " w2")]


@pytest.mark.parametrize("blocks", [(1 << 14, 512), (40, 512), (1 << 14, 3)])
def test_ranks_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(lexical_search, "TILE_DOCS", 16)
    monkeypatch.setattr(lexical_search, "TILE_TERMS", 7)
    docs = made_docs(1, 300)
    items = [(i, " ".join(f"w{(i * 7 + j) % 210}" for j in range(9)) + " THE") for i in range(12)] + [(50, None), (51, ""), (52, "unseen word"), (53, "Éa éa The"),
             (None, "w5 w6"), (3, "w7 of"), (3, "w7 of"), (54, docs[5][1])]
    frame = spark.createDataFrame([(i, t, "s", "t") for i, t in docs], "doc_id long, text string, score string, term string").repartition(7)
    queries = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical_search.rank(frame, queries, block_terms=blocks[0], block_items=blocks[1]).collect()
    assert sorted(map(tuple, got), key=str) == brute_rank(docs, items)


def test_ranks_of_nothing(spark, empty):
    items = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert lexical_search.rank(empty, items).count() == 0
    assert lexical_search.rank(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_partial_sums_stay_exact():
    heaviest = math.floor(1000 * math.log(2e12))
    step = min(lexical_search.TILE_TERMS, (lexical_search.EXACT - 1) // (heaviest * (lexical_search.UNIT // 1000)))
    assert step == lexical_search.TILE_TERMS and step * heaviest * (lexical_search.UNIT // 1000) < lexical_search.EXACT
    assert list(lexical_search.lengths(np.array([10**9]), 10**11, 10**14)) == [10 + 90 * 10**20 // 10**14]


def test_long_texts_are_cut_between_terms():
    texts = ["ab cd " * 50, "x" * 100, "", "q " + "y" * 70 + " z", " " * 90]
    data, offsets = column_bytes(pa.array(texts))
    joined = [b""] * len(texts)
    for rows, part, at in lexical_search.pieces(data, offsets, 32):
        for i, r in enumerate(rows):
            piece = bytes(part[at[i]:at[i + 1]])
            assert not (joined[r] and joined[r][-1:] != b" " and piece[:1] not in (b" ", b""))
            joined[r] += piece
    assert [j.decode() for j in joined] == texts
