"""Each operator against a plain version on small tables, and on the odd rows that any table may hold."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from helpers import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annomat.llm import bpe, catalogue, html, langid, packing, parsing, quality, simhash, substring, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in that was for with on as by it from this".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(["er", "tion", "an", "st", "re", "ou", "ing"]) for _ in range(rng.randint(1, 4))) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, non-Latin and astral characters."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two"), (5, long), (6, long), (7, "日本語 テキスト 🙂 é"), (8, "!!! ??? 123"), (9, "a a a a a a a a a a a a a a a a a a a a a a a a a"), (9, "a a a a a a a a a a a a a a a a a a a a a a a a a"), (11, "<|endoftext|> x <|startoftext|>"), (None, "no id here"), (13, "x" * 5000)]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The table with columns named like those that operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("id", "key", "fp", "bucket", "guest", "component_id", "host", "hash", "_key", "group", "gram", "n", "mark") if c not in df.columns})


def fold(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def print64(text, width=3):
    words = fold(text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, most):
    """Smallest id reachable by links of at most ``most`` bits, by brute force."""
    parent = {i: i for i, _ in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in itertools.combinations(prints, 2):
        if (x ^ y).bit_count() <= most:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in prints}


# 1 HTML


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use cookies</div>{}<aside>side</aside><div id=comments><p>nice</p></div><form><input>go</form><footer>foot</footer><script>var x='<p>';</script></body></html>"


def test_html_pages():
    text = lambda body: html.Page(PAGE.replace("{}", body)).text(frozenset())
    assert text("<article><h1>A &amp; B</h1><p>one<p>two  <b>bold</b>\nend<ul><li>x<li>y</ul><div class='ad'>buy</div></article>") == "A & B\n\none\n\ntwo bold end\n\nx\n\ny"
    assert text("<main><p>m&nbsp;1</p></main>") == "m 1"
    assert text("<div><p>plain</p></div>") == "plain"
    assert html.Page("").text(frozenset()) == "" and html.Page("just text").text(frozenset()) == "just text"
    assert html.Page("<p>a<!-- b --><![CDATA[c<d]]></p><p title='x>y'>e<br>f").text(frozenset()) == "ac<d\n\ne f"
    assert html.Page("<article><article class=comment>no</article><p>yes</article>").text(frozenset()) == "yes"
    assert html.Page("< b <3 &lt;p&gt;").text(frozenset()) == "< b <3 <p>"


def test_html_templates(spark):
    rows = [(i, f"http://H.example/{i}", f"<body><div>Follow us</div><section><p>same box</p></section><div class=c><p>text number {i}</p></div></body>") for i in range(12)]
    rows += [(100 + i, f"http://other.example/{i}", f"<body><div>Follow us</div><p>unique {i}</p></body>") for i in range(3)]
    rows += [(200 + i, "http://copy.example/", "<body><div><p>the same page</p></div></body>") for i in range(9)]
    rows += [(300, None, None), (301, "nourl", ""), (302, "http://h.example/9", "<p>" + "long " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.main_text(clashing(pages)).collect()}
    assert len(got) == len(rows) and all(got[i]["text"] == f"text number {i}" for i in range(12))
    assert got[100]["text"] == "Follow us\n\nunique 0"  # too few pages to tell
    assert got[200]["text"] == "the same page"  # copies of one page aren't a template
    assert got[300]["text"] == "" and got[300]["n_chars"] == 0 and got[302]["n_chars"] == 5 * 20_000 - 1
    assert html.main_text(pages.limit(0)).collect() == []


def test_html_articles_keep_shared_paragraphs(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><p>shared passage</p><p>own {i}</p><div>Follow us</div></article>") for i in range(10)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"shared passage\n\nown {i}" for i in range(10)}


def test_html_of_unmarked_sites(spark):
    """Pages put together from a site's own blocks, without any telling name, and blocks of their own: only the latter stay.

    The same by a copied table of templates and by a join; without templates the sites' blocks would stay.
    """
    rng = random.Random(21)
    boxes = {site: [f"<div><span>{prose(rng, 6)}</span><p>{prose(rng, 9)}</p></div>" for _ in range(8)] for site in ("a.test", "b.test")}
    rows, want = [], {}
    for i in range(160):
        site = rng.choice(("a.test", "b.test"))
        own = [prose(rng, 30) for _ in range(3)]
        menu = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in (prose(rng, 1) for _ in range(rng.randint(3, 9))))
        rows.append((i, f"http://{site.upper()}/{i}", f"<body><div><ul>{menu}</ul></div>{rng.choice(boxes[site])}<section>{''.join(f'<p>{x}</p>' for x in own)}</section>{rng.choice(boxes[site])}</body>"))
        want[i] = "\n\n".join(own)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for local in (html.LOCAL_TEMPLATES, 0):
        got = {r["page_id"]: r for r in html.main_text(clashing(pages), local=local).collect()}
        assert {i: r["text"] for i, r in got.items()} == want
        assert all(r["n_template"] > 0 and r["n_marked"] == 0 for r in got.values())
    assert all(len(html.Page(src).text(frozenset())) > len(want[i]) for i, _, src in rows)


DEEP = {
    "open spans": "<span>" * 150_000 + "</x>" * 20_000, "unfinished": "<a " * 350_000, "unfinished to the last": "<a " * 350_000 + ">", "quotes": '<a ">" ' * 150_000 + '">', "nested": "<div>x" * 80_000 + "</div>" * 80_000,
    "spans and divs": "<span><div>" * 90_000, "paragraphs in spans": "<span>" * 50_000 + "<p>x<span>" * 50_000, "stray ends": "<p>" * 100_000 + "</b>" * 200_000, "comments": "<!-- " * 200_000, "lists": "<ul><li>" * 100_000,
    "raw": "<textarea></textarea " * 40_000 + ">", "signs": "<" * 1_000_000, "cells": "<td>" * 200_000, "entities": "&amp" * 200_000, "sections": "<![CDATA[" * 100_000,
}


@pytest.mark.parametrize("name", DEEP)
def test_html_of_a_hard_megabyte(name):
    (text, *_), spent = seconds(lambda: html.Page(DEEP[name]).read(frozenset({1})))
    assert spent < 15 and text == "\n\n".join(" ".join(x.split()) for x in text.split("\n\n"))


# 2 URLs


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = fold(rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in urls.RULES:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_urls(spark, small):
    extra = [None, "", "nourl", "HTTP://A.EXAMPLE.NET?x=/en/", "x://net/", "x://Net", "http://a.org/fr/x#y?z", "a://b://c/d\nq", "http://xnet/", "http://example.com/de", "ftp://u@h:8/É/..//x", "http://example.net/en/", "http://example.net/en/"]
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(1000 + k, u) for k, u in enumerate(extra)], "page_id long, url string"))
    got = urls.judged(clashing(pages)).collect()
    assert len(got) == pages.count()
    by = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in got:
        host, path, best = plain_rule(by[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path) and r["verdict"] in ("allow", "block")
        assert r["rule"] == (best and best[0]) and (not best or r["verdict"] == best[1])
    assert urls.judged(pages.limit(0)).collect() == []


def test_url_templates(spark):
    rows = [f"http://a.example.com/shop/item-{k}" for k in range(40)] + [f"http://a.example.com/news/{k}" for k in range(40)] + [f"http://a.example.com/blog/{k}" for k in range(40)]
    rules = [("block", f"a.example.com/shop/item-{d}") for d in range(1, 10)] + [("allow", "a.example.com/news/1"), ("allow", "a.example.com/blog/1")]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged(pages, rules).collect()}
    assert got[0]["rule"] is None and got[0]["verdict"] == "block"  # like the 39 labelled ones of its template
    assert got[42]["verdict"] == "allow" and got[42]["template"] == got[82]["template"]  # alike branches are merged
    assert got[0]["template"] != got[42]["template"]


def test_url_templates_merge_every_kind(spark):
    """Five kinds of sections, two sections each: those of the smaller kinds are merged as well."""
    tails = {"a": "{k}", "b": "x/{k}", "c": "{k}/x/y", "d": "x/y", "e": "x"}
    urls_ = [f"http://h.example/{kind}{i}/{tail.format(k=k)}" for size, (kind, tail) in enumerate(tails.items()) for i in (1, 2) for k in range(200 - 20 * size)]
    rules = [("block", f"h.example/{x}/") for x in ("b1", "b2")] + [("allow", f"h.example/{x}/") for x in ("d1", "d2")]
    got = urls.judged(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string"), rules).collect()
    first = {r["path"].split("/")[1]: r["template"].split("/")[1] for r in got}
    assert all(first[f"{kind}1"] == first[f"{kind}2"] for kind in tails) and len(set(first.values())) >= 4


def test_url_templates_deep_and_wide(spark):
    """Segments beyond the fourth tell templates apart, and a section of 1 % of a host's urls keeps its own verdict."""
    deep = [f"http://d.example/a/b/c/d/{x}/p{x}{k}" for x in ("ads", "news") for k in range(20)]
    wide = [f"http://w.example/s{chr(97 + i // 26)}{chr(97 + i % 26)}/p{k}q" for i in range(100) for k in range(20)]
    rules = [("block", f"d.example/a/b/c/d/ads/pads{k}") for k in range(1, 10)] + [("block", f"w.example/sca/p{k}") for k in range(1, 10)]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(list(enumerate(deep + wide)), "page_id long, url string"), rules).collect()}
    assert got[0]["rule"] is None and got[0]["verdict"] == "block" and all(got[i]["verdict"] == "allow" for i in range(20, 40))
    own = 40 + 20 * 52
    assert got[own]["rule"] is None and got[own]["verdict"] == "block" and got[own]["template"] != got[40]["template"]


def plain_templates(rows):
    """The tree and its verdicts with dictionaries: (host, path, verdict of the rules or None) -> (template, rejected)."""
    from collections import defaultdict

    variable = re.compile(urls._VARIABLE)
    state = [("", [x for x in path.split("/") if x]) for _, path, _ in rows]
    for level in range(max((len(x) for _, x in state), default=0)):
        counts = defaultdict(lambda: [0] * 5)
        name = lambda s: "*" if variable.match(s) else s
        for (host, _, label), (template, x) in zip(rows, state, strict=True):
            if len(x) > level:
                c = counts[host, template, name(x[level])]
                last = len(x) == level + 1
                for k, v in enumerate((1, label == "block", label == "allow", last, not last and bool(variable.match(x[level + 1])))):
                    c[k] += v

        def like(a, b):
            pools = [(x + y) / (a[0] + b[0]) for x, y in zip(a[1:], b[1:], strict=True)]
            return all(abs(x / a[0] - y / b[0]) <= 1.96 * math.sqrt(p * (1 - p) * (1 / a[0] + 1 / b[0])) + 1e-9 for x, y, p in zip(a[1:], b[1:], pools, strict=True))

        into, nodes = {}, defaultdict(dict)
        for (host, template, s), c in counts.items():
            if c[0] >= urls.LEAST and s != "*":
                kinds = nodes[host, template]
                kinds[tuple(c)] = min(s, kinds.get(tuple(c), s))
        for node, kinds in nodes.items():
            led = []
            for c, s in sorted(kinds.items(), key=lambda x: (-x[0][0], x[1], x[0])):
                lead = next((x for x in led if like(x[0], c)), None)
                led += [] if lead else [(c, s)]
                into[node, c] = lead[1] if lead else s
        state = [(f"{t}/{into.get(((h, t), tuple(counts[h, t, name(x[level])])), '*') if name(x[level]) != '*' else '*'}" if len(x) > level else t, x) for (h, _, _), (t, x) in zip(rows, state, strict=True)]
    labels = defaultdict(list)
    for (host, _, label), (template, _) in zip(rows, state, strict=True):
        labels[host, template].append(label)
    bad = {k for k, v in labels.items() if (v.count("block") + urls.PRIOR / 2) / (len(v) - v.count(None) + urls.DOUBT * v.count(None) + urls.PRIOR) >= urls.PURITY}
    return [(t, (h, t) in bad) for (h, _, _), (t, _) in zip(rows, state, strict=True)]


@pytest.mark.parametrize("local", [urls.LOCAL_ROWS, 0])
def test_urls_equal_plain(spark, small, local):
    """All of a small table and made-up paths of some depth, by copied branches and by joins."""
    rng = random.Random(31)
    words = ["news", "shop", "de", "en", "item", "tag"]
    made = [f"http://{rng.choice(['x.example.com', 'y.example.org', 'z.test'])}/" + "/".join(rng.choice([rng.choice(words), str(rng.randrange(50)), f"s{rng.randrange(9)}x"]) for _ in range(rng.randrange(5))) for _ in range(400)]
    made += ["http://deep.test/" + "a/" * 300, "http://q.example.com/de/1"] + [f"http://mixed.test/{'bad' if k % 3 else 'other'}{k}/x" for k in range(12)]
    rules = [*urls.RULES, ("block", "mixed.test/bad")]
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()] + [(10_000 + k, u) for k, u in enumerate(made)]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string"), rules, local=local).collect()}
    rows = [(got[i]["host"], got[i]["path"], None if got[i]["rule"] is None else next(v for v, r in rules if r == got[i]["rule"])) for i, _ in pages]
    for (i, _), (host, path, label), (template, bad) in zip(pages, rows, plain_templates(rows), strict=True):
        assert (got[i]["template"], got[i]["verdict"]) == (template, label or ("block" if bad else "allow")), (host, path)
    followers = [r for r in got.values() if r["host"] == "mixed.test" and r["rule"] is None]
    assert {r["verdict"] for r in followers} == {"block"}  # a third of a template that is otherwise blocked


# 3 SimHash


def test_simhash_small(spark, docs, odd):
    both = clashing(docs.unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000)))
    got = simhash.simhash_components(both).collect()
    assert len(got) == both.count()
    texts = [(r["doc_id"], r["text"]) for r in both.select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    prints = {i: print64(t) for i, t in texts}
    assert all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" for r in got if r["doc_id"] in prints)
    want = grouped([(r["doc_id"], int(r["fingerprint"], 16)) for r in got], 3)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_simhash_chains_and_tiles(spark):
    """Random fingerprints with planted neighbours, and one posting that is larger than a tile."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for x in base for _ in range(2)]
    crowd = [(0xABCDEF << 40) | rng.getrandbits(40) for _ in range(simhash.TILE + 300)]
    values = [*dict.fromkeys(base + near + crowd)]
    rng.shuffle(values)
    df = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(values)], "id long, fp binary")
    got = {r["id"]: r["component_id"] for r in simhash.grouped(df, simhash.half_triples(), 3, 5).collect()}
    assert got == {r["id"]: r["component_id"] for r in simhash.grouped(df, simhash.covering(8, 5, 4), 3, 5).collect()}
    fp = np.array(values, np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3).tolist():
            a, b = root(i), root(i + 1 + j)
            parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(values))}


def test_simhash_positions_and_tally():
    for sets in (simhash.half_triples(), simhash.index_positions(10), simhash.index_positions(1 << 40), simhash.covering(8, 5, 4)):
        assert all(any(set(t) <= set(m) for t in sets) for m in itertools.combinations(range(8), 5))
    assert len(simhash.covering(8, 5, 4)) < 30
    x = np.random.default_rng(3).integers(0, 3, (500, 16)).astype(np.uint8) * np.uint8(127)
    assert (simhash._shared(x.view(np.uint64)) == (x == 0).sum(axis=1)).all()
    # The tally decides before the distance is looked at: pairs of three shared bytes are dropped whatever their distance.
    fp = np.array([[0] * 8, [0, 0, 0, 1, 1, 1, 1, 1]], np.uint8)
    at = np.arange(2)
    assert simhash._linked(fp, at, 64, 5) == [] and simhash._linked(fp, at, 64, 3) == [(0, 1)] and simhash._linked(fp, at * 0, 64, 3) == []


@pytest.mark.parametrize("local", [simhash.LOCAL_EDGES, 0])
def test_components_equal_plain(spark, local):
    """A long chain, a hub, rings and random edges, in one task and in rounds of stars."""
    rng = random.Random(19)
    edges = [(k + 1, k) for k in range(300)] + [(5000, 1000 + k) for k in range(200)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(rng.randrange(7000, 7400), rng.randrange(7000, 7400)) for _ in range(180)] + [(9, 9)]
    rng.shuffle(edges)
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"), local).collect()
    assert len(got) == len(parent) and {r["node"]: r["component"] for r in got} == {x: root(x) for x in parent}
    assert simhash.components(spark.createDataFrame([], "a long, b long"), local).collect() == []


def test_simhash_odd(spark, none):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "zz"), (7, None), (5, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(df).collect()}
    same_print = f"{print64('a b c'):016x}"
    assert got[(None, same_print)] == 4 and got[(7, "0" * 16)] == 5 and got[(5, "0" * 16)] == 5
    assert simhash.simhash_components(none).collect() == []


def test_near_duplicates(spark):
    """Recall at a similarity of 0.8 and more is at least 0.9; unlike texts stay apart."""
    rng = random.Random(2)
    rows, pairs = [], []
    for k in range(120):
        words = prose(rng, rng.randint(150, 400)).split()
        copy = list(words)
        for at in rng.sample(range(len(copy)), max(1, len(copy) // 60)):
            copy[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, copy))
        if len(a & b) / len(a | b) >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert len(pairs) > 80 and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(c in (i, i - 1) for i, c in found.items())
    kept = simhash.deduplicate(clashing(df))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in found.items() if i == c} and "component_id" in kept.columns


def shingle_sets(texts, width=5):
    return [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in map(str.split, texts)]


def near_groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}


@pytest.mark.parametrize("block", [simhash.BLOCK_TEXTS, 60])
def test_near_duplicates_in_a_crowd(spark, monkeypatch, block):
    """Variants around the threshold without a common original: every pair of similarity 0.8 is linked, whatever else is near.

    In one block, and dealt to parts with a central text.
    """
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    rng = random.Random(5)
    base, texts = [f"w{k}" for k in range(300)], []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(300), 8):
            words[at] = f"c{k}x{at}"
        texts.append(" ".join(words))
    sets, parent = shingle_sets(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    want = {i: root(i) for i in range(len(texts))}
    assert len(set(want.values())) > 20 and near_groups(spark, texts) == want


def test_near_copies_of_one_text_leave_few_edges(spark, monkeypatch):
    """A group of near copies costs edges in proportion to its size, not to its pairs, in every step that hands edges on."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 100)
    rng, made = random.Random(15), []
    base = [f"w{k}" for k in range(250)]
    for k in range(700):
        words = list(base)
        for at in rng.sample(range(250), k % 5):
            words[at] = f"c{k}x{at}"
        made.append(" ".join(words))
    counted, plain = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: (counted.append(edges.count()), plain(edges))[1])
    got = near_groups(spark, made + [prose(rng, 200) for _ in range(50)])
    assert {got[k] for k in range(700)} == {0} and all(got[k] == k for k in range(700, 750))
    assert len(counted) == 3 and counted[0] < 25 * 700 and max(counted[1:]) < 5 * 700


def test_near_duplicates_at_the_threshold(spark):
    """Of 600 pairs of a similarity from 0.8 to 0.81, 0.98 at least are found."""
    rng, texts = random.Random(6), []
    while len(texts) < 1200:
        k = len(texts)
        words = [f"w{k}x{i}" for i in range(rng.randint(200, 500))]
        copy = words[: round(len(words) * 0.895)] + [f"v{k}x{i}" for i in range(round(len(words) * 0.105))]
        a, b = shingle_sets([" ".join(words), " ".join(copy)])
        if 0.8 <= len(a & b) / len(a | b) <= 0.81:
            texts += [" ".join(words), " ".join(copy)]
    got = near_groups(spark, texts)
    assert sum(got[k] == got[k + 1] for k in range(0, 1200, 2)) >= 0.98 * 600


def test_near_duplicates_count_a_shingle_once(spark):
    """Repeats in a text neither make unlike texts alike nor hide like ones."""
    loop = " ".join(f"s{i}" for i in range(20))
    own = [" ".join(f"{x}{i}" for i in range(40)) for x in "ab"]
    words = [f"w{i}" for i in range(250)]
    texts = [f"{loop} " * 60 + own[0], f"{loop} " * 60 + own[1], " ".join(words), " ".join(words + words[:50] * 5)]
    assert near_groups(spark, texts) == {0: 0, 1: 1, 2: 2, 3: 2}


# 4 BPE


@pytest.fixture(scope="module")
def word_file():
    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_library(spark, docs, odd, word_file):
    whole = Tokenizer.from_file(word_file)
    both = docs.unionByName(odd)
    got = bpe.round_trip(clashing(both), word_file).collect()
    want = []
    for r in both.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        back = whole.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bpe_odd_strings(word_file):
    whole, own, rng = Tokenizer.from_file(word_file), bpe.Coder(word_file), random.Random(6)
    texts = ["ΑΣ Σ ΟΔΟΣ.", "İstanbul ǅ", "don't we'll I'D 'sx", "aaaaaaaaaaaaa aaaa", "１２3 ½ ²", "<|endoftext|><|endoftext|>", "<|endoftext"]
    texts += ["".join(rng.choice("abAB'st re   ll\n\t.,!?<|>é🙂") for _ in range(rng.randrange(60))) for _ in range(500)]
    for t, (n, ids, back) in zip(texts, own.encode(texts), strict=True):
        want = whole.encode(t, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))) and back == whole.decode(want, skip_special_tokens=False)


def test_bpe_ids(spark, odd, none, word_file):
    whole = Tokenizer.from_file(word_file)
    for r in bpe.encoded(odd.where("doc_id in (0, 4, 7)"), word_file).collect():
        text = odd.where(F.col("doc_id") == r["doc_id"]).first()["text"] or ""
        assert r["ids"] == whole.encode(text, add_special_tokens=False).ids
    assert bpe.round_trip(none, word_file).collect() == []


#: Texts of a megabyte that pattern engines and merge rounds find hard.
HARD = {
    "blanks": "x" + " " * 1_000_000 + "y", "breaks": "x" + "\n" * 1_000_000 + "y", "short runs": (" " * 499 + "a") * 2000, "longer runs": (" " * 9999 + "a") * 100,
    "one letter": "a" * 1_000_000, "signs": "!?" * 500_000, "digits": "1" * 1_000_000, "wide": "日本語" * 100_000,
    "letters": "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)),
}


def seconds(f, *args):
    began = time.process_time()
    out = f(*args)
    return out, time.process_time() - began


@pytest.mark.parametrize("name", HARD)
def test_bpe_of_a_hard_megabyte(word_file, name):
    whole, own = Tokenizer.from_file(word_file), bpe.Coder(word_file)
    ((n, ids, back),), spent = seconds(own.encode, [HARD[name]])
    want = whole.encode(HARD[name], add_special_tokens=False).ids
    assert (n, ids, back) == (len(want), " ".join(map(str, want)), whole.decode(want, skip_special_tokens=False)) and spent < 20


def test_bpe_classes_of_characters(word_file):
    """All characters that the operators class by themselves; the rest goes by the library."""
    whole, own = Tokenizer.from_file(word_file), bpe.Coder(word_file)
    texts = [f"a{chr(c)} !{chr(c)}1" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + ["\u0c5c", "a\u0cdc", "\u0cdc"]
    for t, (_, ids, _), want in zip(texts, own.encode(texts), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == " ".join(map(str, want.ids)), t.encode("unicode_escape")


# 5 Language ID


def test_language_accuracy(spark, docs, odd, none):
    both = clashing(docs.unionByName(odd.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)))
    got = langid.identify(both).collect()
    assert len(got) == both.count() and all(0 <= r["score"] <= 1 for r in got)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert len(held) > 20 and sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(pred[10_000 + i] == "und" for i in (0, 1, 2, 8)) and pred[10_003] in set(lang.values())
    assert langid.identify(none).collect() == []


def test_language_ignores_labels_in_prediction(docs):
    relabelled = docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = ({r["doc_id"]: tuple(r) for r in langid.identify(d).collect()} for d in (docs, relabelled))
    assert a == b


def test_language_sample_keeps_rare_languages(spark):
    assert langid.fair([5, 100, 1000], 65) == 30 and langid.fair([5, 5], 20) == float("inf")
    rows = [(i, "alpha beta gamma", "en") for i in range(6000)] + [(10_000 + i, "ørken åsgård", "no") for i in range(5)]
    filters = langid.train(spark.createDataFrame(rows, "key long, text string, lang string"), 50)
    assert filters.languages == ["en", "no"] and filters.decide(["ørken åsgård".encode()])[0] == ["no"]


def test_bloom_filters():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    masks = rng.integers(1, 8, 4000)
    f = langid.Filters(["a", "b", "c"], h, masks, "a")
    assert ((f.contain(h)[0] & masks.astype(np.uint8)) == masks).all()  # no false negatives
    assert (f.contain(rng.integers(0, 1 << 63, 4000).astype(np.uint64))[0] != 0).mean() < 0.02
    assert langid.Filters([], np.empty(0, np.uint64), np.empty(0, np.int64)).decide([b"abc"])[0] == ["und"]


def test_language_of_a_hundred(spark):
    """More languages than a word has bits, each of words of its own."""
    rng = random.Random(3)
    own = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(30)] for k in range(100)}
    rows = [(100 * k + i, " ".join(rng.choices(words, k=40)), lang) for k, (lang, words) in enumerate(own.items()) for i in range(12)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _, x in rows}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1200 and len(held) > 200 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.98 * len(held)


def test_language_counts_equal_plain():
    """Corrected counts against sets of n-grams: the filters' counts are those, but for false positives."""
    texts = {"en": ["the cat sat on the mat", "other things that matter"], "de": ["die katze sitzt auf der matte", "andere dinge"]}
    held = {x: {g for t in ts for n in langid.LENGTHS for g in zip(*[f" {t} "[i:] for i in range(n)])} for x, ts in texts.items()}
    h, masks = [], []
    for k, x in enumerate(sorted(texts)):
        for n in langid.LENGTHS:
            own = langid.grams(t := [s.encode() for s in texts[x]], n, langid.letters_of(t))[0]
            h.append(own)
            masks.append(np.full(len(own), 1 << k))
    f = langid.Filters(sorted(texts), np.concatenate(h), np.concatenate(masks), "en")
    asked = "the matter sitzt quite well"
    counts, total = f.counts([asked.encode()])
    plain = [sum(g in held[x] for n in langid.LENGTHS for g in zip(*[f" {asked} "[i:] for i in range(n)])) for x in sorted(texts)]
    assert total[0] == sum(len(asked) + 3 - n for n in langid.LENGTHS) and counts[0] == pytest.approx(plain, abs=1e-3)


def test_language_stage(docs, odd):
    kept = langid.keep_identified(docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000)))
    ids = {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in docs.collect()} <= ids and not ids & {10_000, 10_001, 10_002, 10_008} and kept.columns == docs.columns


# 6 Quality


def plain_kneser_ney(trusted, order):
    """Interpolated modified Kneser-Ney over bytes with dictionaries."""
    from collections import Counter, defaultdict

    counts = {order: Counter()}
    for t in trusted:
        s = b"\x02" * (order - 1) + b" ".join(t.encode().split())
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals, gammas = {}, {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            discounts[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.01), i - 0.01) for i in (1, 2, 3)]
        else:
            discounts[k] = [0.5] * 3
        total, left = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            left[g[:-1]] += discounts[k][min(v, 3) - 1]
        totals[k], gammas[k] = total, {h: left[h] / total[h] for h in total}

    def p(g):
        base = p(g[1:]) if len(g) > 1 else 1 / 256
        k, h = len(g), g[:-1]
        if h not in totals[k]:
            return base
        v = counts[k][g]
        return max(0.0, v - (discounts[k][min(v, 3) - 1] if v else 0)) / totals[k][h] + gammas[k][h] * base

    return p


def test_kneser_ney_equals_plain(spark, docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    trusted, asked = texts[:30], texts[30:] + ["", "OF!! ###", "é"]
    order = 4
    one = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "key long, text string")
    model = quality.KneserNey(quality.gram_counts(one(trusted), order), order)
    logp = model.log_probabilities(quality.gram_counts(one(asked), order).select("gram"))
    p = plain_kneser_ney(trusted, order)
    for local in (quality.LOCAL_ROWS, 0):
        got = {r["key"]: r for r in quality.scored(one(asked), logp, order, local).collect()}
        for k, t in enumerate(asked):
            s = b"\x02" * (order - 1) + b" ".join(t.encode().split())
            want = -sum(math.log(p(s[i : i + order])) for i in range(len(s) - order + 1))
            assert got[k]["symbols"] == len(s) - order + 1 and got[k]["nll"] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one(spark, docs):
    order = 3
    model = quality.KneserNey(quality.gram_counts(docs.select("text").limit(20), order), order)
    grams = [(a << 16) | (b << 8) | c for a, b in ((116, 104), (2, 2), (200, 201)) for c in range(256)]
    logp = model.log_probabilities(spark.createDataFrame([(g,) for g in grams], "gram long")).collect()
    for h in {g >> 8 for g in grams}:
        assert sum(math.exp(r["logp"]) for r in logp if r["gram"] >> 8 == h) == pytest.approx(1)


def test_quality_decisions(spark, small, docs, odd, none):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    both = clashing(docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000)))
    got = {r["doc_id"]: r for r in quality.judged(both, labels).collect()}
    assert len(got) == both.select("doc_id").distinct().count()
    good = [got[r["doc_id"]]["keep"] for r in labels.where("quality = 1 and toxic = 0").collect() if r["doc_id"] in got]
    assert sum(good) >= 0.95 * len(good)
    loud = docs.limit(5).select((F.col("doc_id") + 5000).alias("doc_id"), F.concat_ws("!! ", F.split(F.upper("text"), " ")).alias("text"), "lang", "source", "n_chars")
    again = {r["doc_id"]: r["keep"] for r in quality.judged(docs.unionByName(loud), labels).collect()}
    assert not any(again[r["doc_id"]] for r in loud.collect())
    assert got[10_000]["keep"] and got[10_001]["keep"] and got[10_000]["symbols"] == 0
    assert quality.judged(none, labels).collect() == []
    assert quality.judged(docs.limit(5), labels.limit(0)).count() == 5
    kept = quality.keep_good(docs.unionByName(loud), labels)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in loud.collect()} & {r["doc_id"] for r in kept.collect()}


def test_quality_threshold_is_the_quantile(spark, small, docs):
    """A language's threshold is the 0.99 quantile of its trusted texts that were not trained on."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = quality.judged(docs, labels).join(labels.where("quality = 1 and toxic = 0"), "doc_id").where("symbols > 0")
    held = got.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.CALIBRATE)) == 0).collect()
    for lang in {r["lang"] for r in held}:
        own = [r for r in held if r["lang"] == lang]
        assert math.isclose(own[0]["threshold"], math.exp(np.quantile(np.log([r["perplexity"] for r in own]), quality.QUANTILE)), rel_tol=1e-6)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantiles_equal_plain(spark, q):
    rng = np.random.default_rng(2)
    groups = {"flat": np.ones(50), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "wide": np.append(rng.normal(size=997), [1e9, -1e6]), "ties": rng.integers(0, 3, 400).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "group string, v double")
    got = {r["group"]: r["limit"] for r in quality.quantiles(df, q).collect()}
    assert got == {g: pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12) for g, v in groups.items()}
    assert quality.quantiles(df.limit(0), q).collect() == []


# 7 Substrings


def plain_repeats(rows, window=20):
    seen, out = {}, {}
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if seen.setdefault(key, (i, s)) != (i, s):
                gone[s : s + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring_equals_plain(spark, docs, odd):
    both = docs.unionByName(odd.dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 10_000))
    want = plain_repeats([(r["doc_id"], r["text"]) for r in both.collect()])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(clashing(both)).collect()}
    assert got == want


def test_substring_hot_passages(spark, none):
    """A passage in most documents, near copies of one document, and the same words over and over."""
    rng = random.Random(9)
    passage, base = prose(rng, 60), prose(rng, 200).split()
    rows = []
    for i in range(300):
        if i % 3 == 0:
            rows.append((i, f"{prose(rng, 15)} {passage} {prose(rng, 15)}"))
        elif i % 3 == 1:
            words = list(base)
            words[rng.randrange(200)] = f"w{i}"
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(WORDS[:2]) for _ in range(80))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df.repartition(7)).collect()}
    assert got == plain_repeats(rows)
    assert len(substring.heavy_minimisers(df.selectExpr("doc_id id", "text"), 20, 5, 16)) <= 32
    assert substring.remove_repeats(none).collect() == []


def test_substring_stage(spark, docs):
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    kept = substring.cut_repeats(twice)
    assert kept.columns == docs.columns and substring.cut_repeats(clashing(twice)).columns == clashing(twice).columns
    got = {r["doc_id"]: r for r in kept.collect()}
    for r in twice.collect():
        words = len(r["text"].encode().split())
        if r["doc_id"] >= 10_000 and words >= 20:
            assert got[r["doc_id"]]["text"] == "" and got[r["doc_id"]]["n_chars"] == 0
        elif words < 20:
            assert got[r["doc_id"]]["text"] == r["text"]


def test_substring_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, are documents of their own; equal rows lose the same words."""
    rng = random.Random(12)
    w, u, x, y = (prose(rng, 30) for _ in range(4))
    rows = [(1, w), (7, w), (7, u), (None, x), (None, y), (None, f"{x} {y}"), (None, x), (9, u), (3, f"own words here {w}"), (substring.LAST, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in substring.remove_repeats(clashing(df)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert got[1] == [(30, 0)] and sorted(got[7]) == [(30, 0), (30, 30)] and got[9] == [(30, 30)] and got[3] == [(33, 30)] and got[substring.LAST] == [(30, 0)]
    # x is once before the joined text or once inside it; both rows of x fare alike, and y is gone as the last id has it.
    lone, joined = sorted(n for size, n in got[None] if size == 30), [n for size, n in got[None] if size == 60]
    assert len(got[None]) == 4 and (lone, joined) in (([0, 0, 30], [60]), ([30, 30, 30], [30]))
    kept = [r["text"] for r in substring.cut_repeats(clashing(df)).collect()]
    assert len(kept) == len(rows) and any(w in t for t in kept) and any(x in t for t in kept) and any(u in t for t in kept) and any(y in t for t in kept)


def test_substring_blocks_and_buckets(spark, monkeypatch):
    """Small blocks, so that super-k-mers meet their like in later blocks of a task, in rising and falling order of ids."""
    monkeypatch.setattr(substring, "MAP_BYTES", 2000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 500)
    rng = random.Random(13)
    line, texts = prose(rng, 45), [prose(rng, rng.randrange(60)) for _ in range(60)]
    rows = [(i, f"{rng.choice(texts)} {line if rng.random() < 0.5 else ''} {rng.choice(texts)}") for i in range(200)]
    for ordered in (rows, rows[::-1], rng.sample(rows, len(rows))):
        df = spark.createDataFrame(ordered, "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df).collect()}
        assert got == plain_repeats(rows)


def test_substring_sql(spark, small):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert same(catalogue.queries()["op7_substring"](spark, small), c.sql(catalogue.oracle_sql()["op7_substring"]))


# 8 Top-k


def test_topk_sql(spark, small):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    assert same(catalogue.queries()["op8_topk"](spark, small), c.sql(catalogue.oracle_sql()["op8_topk"]))


def test_topk_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.9]) for _ in range(6)]) for i in range(400)]
    rows += [(1000, None), (1001, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 6), (1100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:400]}
    want = {}
    for q in range(0, 400, 50):
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:5]
        want[q] = [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert len(topk.top_k(df.where("vec_id <= 2")).collect()) == 2
    assert topk.top_k(df.limit(0)).collect() == []


def test_topk_wide_components(spark):
    """Components far beyond 32 bits, products beyond a long, vectors of several lengths, repeated ids: as with Python's integers."""
    rng = random.Random(7)
    big = [1.0, -3.0, 1e8, -1e8, 1e13, -2e14, 1e300, 0.004]
    rows = [(i, [rng.choice(big) for _ in range(3)]) for i in range(150)] + [(200 + i, [rng.random() for _ in range(2)]) for i in range(60)] + [(300 + i, []) for i in range(8)]
    rows += [(50, rows[50][1]), (7, [2.0, 2.0, 2.0])]
    ints = [(i, [max(min(math.floor(256 * x) if abs(x) < 1e299 else 10**300, topk.LIMIT), -topk.LIMIT) for x in v]) for i, v in rows]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in {i for i, _ in ints if i % 50 == 0}:
        own = min(v for i, v in ints if i == q)
        best = sorted((-sum(map(int.__mul__, own, v)), i) for i, v in ints if i != q and len(v) == len(own))[:5]
        assert sorted(got[q]) == [(k, i, max(min(-s, 2**63 - 1), -(2**63))) for k, (s, i) in enumerate(best, 1)], q


def test_topk_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 70)
    monkeypatch.setattr(topk, "QUERIES", 3)
    v = np.random.default_rng(4).normal(size=(900, 5))
    got = topk.top_k(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    ints = np.floor(256 * v).astype(np.int64)
    for q in range(0, 900, 50):
        s = ints @ ints[q]
        s[q] = -(1 << 60)
        best = np.lexsort((np.arange(900), -s))[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k, i, s[i]) for k, i in enumerate(best.tolist(), 1)]


@pytest.mark.parametrize("seed", range(5))
def test_sliced_block_is_exact(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-300, 300, (700, 9)) if seed else np.zeros((70, 9), int)
    block = topk.SlicedBlock(np.arange(len(rows)), rows)
    for q in rows[:10]:
        ids, score = block.top_k(q, 3, 7)
        s = rows @ q
        s[3] = -(1 << 40)
        best = np.lexsort((np.arange(len(rows)), -s))[:7]
        assert ids.tolist() == best.tolist() and score.tolist() == s[best].tolist()


# 9 Fingerprints


def test_parsing_is_local():
    rng = random.Random(5)
    body = prose(rng, 400)
    names = []
    for lead in ("", "x", "some other words before ", "é" * 7):
        raw = np.frombuffer((lead + body).encode(), np.uint8)
        name, doc = parsing._BYTES[raw], np.zeros(len(raw), np.int64)
        for _ in range(3):
            name, doc = parsing.phrases(name, doc)
        names.append(name.tolist())
    inner = names[0][4:-1]
    for other in names[1:]:
        k = next(i for i in range(len(other)) if other[i : i + len(inner)] == inner)
        assert k >= 0


def test_fingerprints_equal_plain(spark, docs, odd):
    both = clashing(docs.unionByName(odd.dropDuplicates(["doc_id"]).where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000)))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in both.collect()), reverse=True)
    got = {r["doc_id"]: r for r in parsing.edited_fingerprints(both).collect()}
    prints = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        one, two, three = parsing.sketches([t.encode(), edited.encode(), following.encode()])
        assert r["fingerprint"] == parsing.written(one) and r["edited_fingerprint"] == parsing.written(two)
        assert r["near_edited"] == pytest.approx(parsing.likeness(one, two)) and r["near_next"] == pytest.approx(parsing.likeness(one, three))
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.95 * len(long)


def test_fingerprints_in_many_buckets(spark, monkeypatch):
    """Buckets of a few hundred bytes, far more than ranges; half of the rows have no id; ids lie close together and far apart."""
    monkeypatch.setattr(parsing, "BUCKET_BYTES", 300)
    monkeypatch.setattr(parsing, "RANGES", 7)
    rng = random.Random(17)
    rows = [(rng.choice([k, k * 10**12, -k]), prose(rng, rng.randrange(12))) for k in range(1, 200)] + [(None, f"{k} {prose(rng, 8)}") for k in range(150)]
    rows = [*{i if i is not None else t: (i, t) for i, t in rows}.values()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = df.orderBy(F.desc_nulls_last("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).desc()).collect()
    want = sorted((i or 0, hashlib.sha256((t[: len(t) - len(t) // 2] + ordered[(k + 1) % len(ordered)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered))
    assert sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in parsing.edited_fingerprints(df).collect()) == want


def test_fingerprints_odd(spark, none):
    assert parsing.edited_fingerprints(none).collect() == []
    one = parsing.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    rows = [(None, "abcd"), (3, None), (3, "x y"), (3, "x y"), (9, "")]
    got = parsing.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == [(-1, 4), (3, 0), (3, 3), (3, 3), (9, 0)]
    same_text = parsing.edited_fingerprints(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    assert {r["near_next"] for r in same_text} == {1.0} and len({r["fingerprint"] for r in same_text}) == 1


# 10 Packing


def check_packing(pieces, texts, path, capacity):
    whole = Tokenizer.from_file(path)
    by = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids, at = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return sum(r["length"] for r in pieces) / (capacity * len(sequences))


def test_packing(spark, docs, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = docs.unionByName(odd.dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 10_000))
    pieces = packing.pack_documents(clashing(both), path).collect()
    assert check_packing(pieces, {r["doc_id"]: r["text"] for r in both.collect()}, path, 1024) > 0.97
    assert packing.pack_documents(none, path).collect() == []
    small = packing.pack_documents(docs.limit(20), path, capacity=64, piece=16).collect()
    check_packing(small, {r["doc_id"]: r["text"] for r in docs.limit(20).collect()}, path, 64)
    again = packing.pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), path).collect()
    assert len(again) == 2 and len({(r["sequence_id"], r["offset"]) for r in again}) == 2


@pytest.mark.parametrize("name", HARD)
def test_packing_of_a_hard_megabyte(name):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, spent = seconds(packing.tokenizer(path).ids, HARD[name])
    assert ids.tolist() == Tokenizer.from_file(path).encode(HARD[name], add_special_tokens=False).ids and spent < 20


def test_packing_rows_without_id(spark):
    """Rows without an id are spread over groups, equal ones too, and are packed as often as they occur."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "the same text")] * 3000 + [(None, f"text {k}") for k in range(1000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert len(got) == 4000 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4000
    by_group = np.bincount([r["sequence_id"] >> 32 for r in got], minlength=4)
    assert by_group.max() < 2 * by_group.mean()


@pytest.mark.parametrize("ways", [1, 2, 3, 7])
def test_differencing(ways):
    sizes = np.random.default_rng(ways).integers(1, 100, 60)
    slot = packing.difference(sizes, ways)
    load = np.bincount(slot, sizes, ways)
    assert load.sum() == sizes.sum() and load.max() - load.min() <= 10
    two = np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4], 2)
    assert abs(two[0] - two[1]) == 2  # the textbook case, where the best would be 0


def test_window_count_rises():
    slot = packing.windows(np.array([60, 60, 60]), 100)  # two windows could hold the sum but not the pieces
    assert np.bincount(slot, [60, 60, 60]).max() <= 100 and slot.max() == 2


# Pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < 4:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, small).count() == out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "substring_dedup", "packing"]


def plain_languages(rows):
    """(language, coverage) of each text with sets of n-grams: rows (text, lang)."""
    from collections import Counter, defaultdict

    def grams(text, n):
        t = " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split())
        return [f" {t} "[i : i + n] for i in range(len(t) + 3 - n)] if t else []

    rate = defaultdict(dict)
    for lang in {x for _, x in rows if x is not None}:
        for n in langid.LENGTHS:
            counts = Counter(g for t, x in rows if x == lang for g in grams(t, n))
            for g, k in counts.items():
                rate[g][lang] = k / counts.total()
    known = {g: {x for x, r in own.items() if r >= langid.SHARE * max(own.values())} for g, own in rate.items()}
    out = []
    for text, _ in rows:
        own = [g for n in langid.LENGTHS for g in grams(text, n)]
        hits = Counter(x for g in own for x in known.get(g, ()))
        out.append((max(hits, key=lambda x: (hits[x], x)), max(hits.values()) / len(own)) if hits else (None, 0.0))
    return out


def test_languages_equal_plain(docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()] + [(9000, "qxqx zwzw " * 9, None), (9001, "12 34", None), (9002, "日本語 テキスト", None)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predictions(df, langid.train(df.selectExpr("doc_id key", "text", "lang").where("text is not null")), ["doc_id"]).collect()}
    for (i, _, _), (lang, cover) in zip(rows, plain_languages([(t, x) for _, t, x in rows]), strict=True):
        assert got[i]["coverage"] == pytest.approx(cover, abs=0.02) and (lang is None or cover < 0.05 or got[i]["lang_pred"] == lang)


def plain_pipeline(spark, rows, labels):
    """Texts by id after each of the first four stages: rows (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    out = []
    judged = plain_languages([(t, x) for _, t, x in rows])
    rows = [r for r, (lang, cover) in zip(rows, judged, strict=True) if lang is not None and cover >= 0.05]
    out.append({i: t for i, t, _ in rows})

    part = {r["id"]: r["part"] for r in spark.createDataFrame([(i,) for i, _, _ in rows], "id long").select("id", F.pmod(F.xxhash64("id"), F.lit(quality.CALIBRATE)).alias("part")).collect()}
    trusted = {i for i, q, toxic in labels if q == 1 and not toxic and i in part}
    order = quality.ORDER
    p, memo = plain_kneser_ney([t for i, t, _ in rows if i in trusted and part[i]], order), {}
    cost = {}
    for i, t, _ in rows:
        s = b"\x02" * (order - 1) + b" ".join(t.encode().split())
        total = 0.0
        for k in range(len(s) - order + 1):
            g = s[k : k + order]
            if g not in memo:
                memo[g] = -math.log(p(g))
            total += memo[g]
        cost[i] = (total, len(s) - order + 1)
    held = [(lang, *cost[i]) for i, _, lang in rows if i in trusted and not part[i] and cost[i][1]]
    mean = lambda own: sum(c for _, c, _ in own) / sum(n for _, _, n in own)
    means = {x: mean([h for h in held if h[0] == x]) for x in {h[0] for h in held}}
    drawn = lambda lang, c, n: (c + quality.PRIOR * means.get(lang, mean(held))) / (n + quality.PRIOR)
    limit = lambda own: float(np.quantile([drawn(*h) for h in own], quality.QUANTILE))
    limits = {x: limit([h for h in held if h[0] == x]) for x in means}
    rows = [r for r in rows if drawn(r[2], *cost[r[0]]) <= limits.get(r[2], limit(held)) + 1e-12]
    out.append({i: t for i, t, _ in rows})

    folded = [(i, fold(t).encode().split()) for i, t, _ in rows]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in folded}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    rows = [r for r in rows if root(r[0]) == r[0]]
    out.append({i: t for i, t, _ in rows})

    seen, texts = {}, {}
    for i, t, _ in sorted(rows):
        words = t.encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if seen.setdefault(tuple(words[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        texts[i] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode() if any(gone) else t
    return [*out, texts]


def test_pipeline_equals_plain(spark, small, docs, tmp_path):
    """All stages after each other against plain versions, with copies, near copies, junk, shared passages and odd rows planted."""
    import corpus_pipeline

    rng = random.Random(77)
    own = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows, passage = [r for r in own if len(r[1]) < 8000], prose(rng, 60)
    for k, (_, t, lang, source, _) in enumerate(rng.sample([r for r in rows if len(r[1].split()) > 150], 24)):
        words = t.split()
        words[rng.randrange(len(words))] = "changedword"
        rows.append((5000 + k, t if k % 2 else " ".join(words), lang, source, len(t)))
        rows.append((6000 + k, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en", "s", 1))
    rows += [(7000, None, "en", "s", 0), (7001, "", "en", "s", 0), (7002, "12 34 !!", None, "s", 8), (7003, "ZX!!QQ " * 300, "en", "s", 2100), (7004, "日本語 " * 50, None, "s", 200)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    want = plain_pipeline(spark, [(i, t, x) for i, t, x, _, _ in rows], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), texts in zip(corpus_pipeline.STAGES, [*want, None], strict=True):
        out = stage(spark, df, str(tmp_path))
        if texts is None:
            break
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert got.keys() == texts.keys(), (name, got.keys() ^ texts.keys())
        assert got == texts, name
        df = spark.createDataFrame(out.collect(), out.schema)
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), want[-1], public_tokenizers.path("byte_bpe_50k.json"), 1024)
    assert len(want[0]) > len(want[1]) > len(want[2]) and any(want[2][i] != t for i, t in want[3].items())


def test_every_operator_has_a_query():
    names = set(catalogue.queries())
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and set(catalogue.oracle_sql()) <= names
