import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import fill_in_middle, lexical_search, queries, secret_scan, toxicity

FORBIDDEN = ("<P>", "<S>", "<M>")


def cut(doc_id, text):
    """Form, lengths and output by plain slices."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in FORBIDDEN) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_plain_slices(docs, rows, none, spark):
    odd = [(1000 + i, t) for i, t in enumerate(["\x01", "\x02", "\x01\x02e\x02d\x01\x01", "\x02\x02e", "a", "<", "<P", "P><S", ">", "x<S>y", "<M>", "😀é́😀", "\n\n", "a\x00b", "$0 \\1 $", "\x02d" * 40, "<P><" * 3])]
    odd += [(2000 + i, random.Random(i).choice(["\x01", "\x02", "<", ">", "S", "é", "😀", "d", "e", "\n"]) * (i % 7) + "\x02\x01<S" * (i % 3)) for i in range(200)]
    df = docs.select("doc_id", "text", "score", "n").union(spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit("mine"), F.lit("mine")))
    out = fill_in_middle.fill_in_middle(df).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    every = [(r[0], r[1]) for r in rows] + odd
    assert got == Counter((i, *cut(i, t)) for i, t in every)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert all(r.back == (r.text or "") for r in out.collect()) and "score" in out.columns
    assert fill_in_middle.fill_in_middle(none).count() == 0


def test_fill_in_middle_with_words_as_units(spark):
    text = "one two  three four five six seven"
    df = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    out = fill_in_middle.fill_in_middle(df, unit=r"\S+\s*", plain=0, spm=50).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r.n for r in out} == {7} and {r.form for r in out} == {"psm", "spm"} and {r.back for r in out} == {text}
    starts = {0, *(m.end() for m in re.finditer(r"\S+\s*", text))}
    assert all(r.prefix_chars in starts and r.prefix_chars + r.middle_chars in starts for r in out)


def ranked(documents, items, k=20):
    """item_id to its (score, id) rows by plain counts."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(split(t))) for i, t in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, length, df = len(docs), sum(x for _, _, x in docs), Counter(t for _, c, _ in docs for t in c)
    texts = defaultdict(set)
    for i, t in items:
        if t is not None:
            texts[i].add(t)
    out = {}
    for item, ts in texts.items():
        q = Counter(w for t in ts for w in split(t))
        scored = []
        for i, c, m in docs:
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * (75 + 25 * m * n // length))) for w, times in q.items() if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out[item] = [(-s, i) for s, _, _, i in sorted(scored)[:k]]
    return {i: r for i, r in out.items() if r}


ITEMS = [(1, "the river stone bridge"), (2, "STREET market market paper 2nd"), (3, None), (4, ""), (5, "qqqq zzzz"), (None, "straße ñandú É"), (6, "winter"), (6, "winter"), (6, "summer song"), (7, "This very line stands"), (8, "，！ ａ")]


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search_matches_plain_counts(docs, rows, none, spark, monkeypatch, small):
    if small:  # many shards, slices and blocks of queries
        for name, value in (("POSTINGS", 60), ("SLICE", 200), ("QUERY_BYTES", 1)):
            monkeypatch.setattr(lexical_search, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("mine"))
    got = defaultdict(list)
    for r in lexical_search.search(docs, items, 7).collect():
        got[r.item_id].append((r.rank, r.score, r.doc_id))
    want = ranked([(r[0], r[1]) for r in rows], ITEMS, 7)
    assert {i: [(s, d) for _, s, d in sorted(r)] for i, r in got.items()} == want and len(want) >= 5
    assert all([n for n, *_ in sorted(r)] == list(range(1, len(r) + 1)) for r in got.values())
    assert lexical_search.search(none, items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0


def test_lexical_search_ties_go_to_the_least_ids(spark):
    df = spark.createDataFrame([(i, "same words here") for i in (9, 3, 7, 3, None, 1)] + [(50, "other")], "doc_id long, text string").repartition(3)
    out = lexical_search.search(df, spark.createDataFrame([(1, "words")], "item_id int, text string"), 5).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [1, 3, 3, 7, 9] and len({r.score for r in out}) == 1
    kept = lexical_search.build_index(df).checkpoint()
    assert lexical_search.search(df, spark.createDataFrame([(1, "words")], "item_id int, text string"), 9, kept).count() == 6


INSULTS = ["blargh", "snarfle", "grubzit"]


@pytest.fixture(scope="module")
def judged(spark):
    """Texts of common words; toxic ones call somebody names, at times in disguise; one text is copied often."""
    rng = random.Random(11)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "vi") for b in ("ran", "del", "mor", "tis", "bel", "gon", "pas")]
    hide = [lambda w: w, lambda w: w.upper(), lambda w: w.replace("a", "@").replace("i", "1"), lambda w: w[:2] + w[2] * 4 + w[3:], lambda w: w + "s"]
    texts = []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            text.insert(rng.randint(0, len(text)), "you " + rng.choice(hide)(rng.choice(INSULTS)))
        texts.append((i, " ".join(text), int(toxic)))
    texts += [(600 + i, texts[7][1], 0) for i in range(150)] + [(900, None, 0), (901, "", 0), (902, " \n", 0)]
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in texts], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in texts if i % 7] + [(5, None), (None, 1), (10_000, 1)], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in texts}


def test_toxicity_on_held_out_texts(judged):
    docs, labels, truth = judged
    out = {r.doc_id: r for r in toxicity.detect_toxicity(docs, labels, trees=8).collect()}
    assert len(out) == len(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [r for r in out.values() if r.held_out and r.doc_id < 500]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.95 * len(held) and sum(r.predicted for r in held) >= 0.8 * sum(truth[r.doc_id] for r in held)
    assert len({out[i].score for i in [7, *range(600, 750)]}) == 1 and out[900].score == out[901].score
    assert all(not out[i].predicted for i in (7, 900, 901, 902))


def test_toxicity_without_labels_or_texts(judged, none, spark):
    docs, labels, _ = judged
    assert {(r.score, r.predicted) for r in toxicity.detect_toxicity(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert {r.score for r in toxicity.detect_toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.detect_toxicity(none, labels).count() == 0


def test_toxicity_features_by_hand():
    words = lambda t: toxicity.Words(t).keys[:, 0]
    lexicon = {int(k): (5.0, 2.0) for k in words("idiot").view(np.int64)}
    measure = toxicity.Measure(lexicon)
    texts = ["You idiot!", "an 1d1ot, i.d.i.o.t and i d i o t", "idiooot", "IDIOTS are here??", "", "good day to all 2024", "x" * 30 + " idiot " + "word " * 50 + "you"]
    rows = [dict(zip(toxicity.FEATURES, r)) for r in measure.features(texts)]
    assert [round(math.expm1(r["count_0"])) for r in rows] == [1, 3, 1, 0, 0, 0, 1]
    assert rows[0]["nearest"] == 0.5 and rows[0]["near"] == 50 and rows[0]["second_person"] == 50 and rows[6]["nearest"] == 1 / 52 and rows[6]["near"] == 0
    assert rows[1]["disguised"] > 0 and rows[1]["spaced"] > 0 and rows[2]["stretched"] == 100 and rows[3]["shouted"] == pytest.approx(100 / 3) and rows[3]["question"] > 0
    assert rows[4]["words"] == 0 and rows[5]["digits"] == 20 and rows[0]["strongest"] == 5 and rows[5]["strongest"] == -10
    # what a text measures depends neither on the others nor on where long texts are cut
    alone = [measure.features([t])[0] for t in texts]
    assert np.allclose(alone, measure.features(texts))
    long = " ".join(texts[:4]) * 200
    whole = measure.features([long])[0]
    size, toxicity.SLICE = toxicity.SLICE, 300
    try:
        assert np.allclose(measure.features([long])[0], whole)
    finally:
        toxicity.SLICE = size


def test_evidence_counts_neighbourhoods(spark):
    """A word that many copies of one passage hold is no evidence; one in as many neighbourhoods is."""
    own = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    rows = [(i, f"alpha beta gamma passage delta n{i}", True, i % 5) for i in range(40)] + [(100 + i, f"{own(i)}a {own(i)}b wicked {own(i)}c {own(i)}d", True, i % 5) for i in range(40)]
    rows += [(200 + i, f"clean words of text number m{i}", False, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean, part int")
    toxicity.ready(spark)
    last = toxicity.lexicons(df, 1000)[-1]
    key = lambda w: int(toxicity.Words(w).keys[0, 0].view(np.int64))
    assert last[key("wicked")][0] > 40 and last.get(key("passage"), (-9.0,))[0] < 0 and key("clean") not in last


def test_new_queries_are_registered():
    assert {"op11_toxicity", "op12_fill_in_middle", "op13_lexical_search"} <= set(queries.QUERIES)
    assert {"op12_fill_in_middle", "op13_lexical_search"} <= set(queries.ORACLE_SQL)


@pytest.mark.parametrize("piece", ["/* x\n", "<!-- ", 'x = """ ', "x = '''\n", '\\"', 'x="\\', "a = '\\'", "\\\"\\'\\`", 'password: "\\" ', '"""\n', 'x = "y" + ', "# ", "<a> "])
def test_unclosed_openers_take_linear_time(piece):
    took = []
    for size in (100_000, 1_000_000):
        text = piece * (size // len(piece)) + '\nclient_secret = "k3Jd-92Lq.ppQ7"\n'
        began = time.perf_counter()
        found = [text[a:b] for a, b in secret_scan.lexed_spans(text)]
        took.append(time.perf_counter() - began)
        assert piece not in ("# ", "<a> ", '\\"') or found == ["k3Jd-92Lq.ppQ7"]
    assert took[1] < 30 * max(took[0], 0.05)


def test_quotes_open_again_in_the_next_line():
    text = 'it\'s a "half\npassword = "k3Jd-92Lq.ppQ7" # don\'t\ntoken: str = os.environ["TOKEN_OF_SERVICE"]\n/* open\nsecret = \'Zx81qPw0Lm22tRn9\'\n'
    assert [text[a:b] for a, b in secret_scan.lexed_spans(text)] == ["k3Jd-92Lq.ppQ7", "Zx81qPw0Lm22tRn9"]
