import random
import re

import numpy as np
import pytest

from tidewire.llm import mtree_search, url_filters


def plain(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        else:
            c = glob[i]
            if c == "\\":
                i += 1
                out += re.escape(glob[i])
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    return re.compile(out)


def test_automaton_matches_regular_expressions():
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["a" * 150 + "*b", "\\*a\\?"]
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", "a" * 150 + "xxb", "a" * 5000, "*a?"]
    got = url_filters.Automaton.build(globs).match([t.encode() for t in texts], cells=5000)
    want = np.array([[plain(g).fullmatch(t) is not None for g in globs] for t in texts])
    assert (got == want).all()


def test_urls(spark):
    urls = [
        (1, "https://a.example.org/es/x", "org", "block"), (2, "HTTP://Example.ORG/en/12?q#f", "example.org", "allow"), (3, "http://x.org", "", "allow"), (4, None, "", "allow"),
        (5, "no scheme.org/", "", "allow"), (6, "http://borg/", "", "allow"), (7, "http://cheap-pills.example.net/a", "", "block"), (8, "http://b.com/de/1", "com", "block"),
        (9, "http://b.com/?u=http://x.org/", "", "allow"), (10, "", "", "allow"), (11, "http://" + "a" * 20_000 + ".org/" + "b" * 20_000, "org", "allow"), (11, "http://é.org/ü", "org", "allow"),
    ]
    df = spark.createDataFrame([(i, u, "mine") for i, u, *_ in urls], "page_id long, url string, verdict string")
    out = sorted(url_filters.judge_urls(df).collect(), key=lambda r: (r.page_id, len(r.url or "")))
    want = sorted(urls, key=lambda r: (r[0], len(r[1] or "")))
    assert [r.verdict for r in out] == [w[3] for w in want]
    assert all((r.rule is None) == (w[2] == "") for r, w in zip(out, want))
    assert out[1].rule == "example.org/en/1" and out[1].path == "/en/12"
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_rules_say_what_the_contract_says(spark):
    words = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {h + p: v for h, p, v in url_filters.RULES} == words
    df = spark.createDataFrame([("http://a." + rule + "x",) for rule in words], "url string")
    assert {r.rule: r.verdict for r in url_filters.judge_urls(df).collect()} == words


@pytest.mark.parametrize("kind", ["spread", "copies", "few"])
def test_top_k_is_exact(spark, kind):
    rng = np.random.default_rng(7)
    n = {"spread": 3000, "copies": 2500, "few": 6}[kind]
    x = rng.normal(size=(n, 8)).astype(np.float32) * rng.uniform(0.1, 3, (n, 1)).astype(np.float32)
    if kind == "copies":
        x[: n // 2] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(100_000, None), (None, [1.0] * 8), (100_100, [float("nan")] + [0.0] * 7), (100_200, [float("inf")] * 8), (100_300, [None] + [1.0] * 7), (100_400, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, page string").repartition(3)
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v)).all()]
    want = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, mtree_search.top_k(df).collect())) == sorted(want)
    assert mtree_search.top_k(df.limit(0)).count() == 0


def test_one_url_has_one_canonical_form(spark):
    same = ["http://x.net/ads/y", "https://u:p@X.net:8080/%61ds/y?q", "http://x.net./a/../ads/./y#f", "HTTP://x%2Enet/%2E%2E/%61%64s/b/../y"]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(same)] + [(9, "http://x.net/%2561ds/y", "own"), (10, None, "own")], "page_id long, url string, _rest string")
    out = {r.page_id: r for r in url_filters.judge_urls(df).collect()}
    assert [out[i].verdict for i in range(4)] == ["block"] * 4 and out[9].verdict == out[10].verdict == "allow"
    assert len({url_filters.canonical(out[i].host.encode(), out[i].path.encode()) for i in range(4)}) == 1
    assert {r._rest for r in out.values()} == {"own"} and out[1].host == "u:p@x.net:8080"


def test_scores_beyond_double_precision_and_64_bits(spark):
    from tidewire.llm import mtree_search

    rows = [(0, [2.0**40, 1.0]), (1, [2.0**42, 3.0]), (2, [2.0**30, -5.0]), (3, [-(2.0**52), 7.0]), (100, [1.0, 1.0])]
    got = {(r.query_id, r.vec_id): r.score for r in mtree_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for q in (0, 100):
        for i, v in rows:
            if i != q:
                want = sum(int(1024 * a) * int(1024 * b) for a, b in zip(dict(rows)[q], v))
                assert got[q, i] == max(-(2**63), min(2**63 - 1, want))
