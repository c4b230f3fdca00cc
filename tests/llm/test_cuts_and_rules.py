"""Hard negatives, URL rules and fill-in-the-middle against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firmatlas.llm import fill_middle as FM
from firmatlas.llm import hard_negatives as HN
from firmatlas.llm import url_rules as UR
from firmatlas.llm.queries import GLOBS, QUERIES, SITES

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# hard negatives


def integers(vector):
    if vector is None or any(x is None or x != x or abs(x) == INF for x in vector):
        return None
    return [int(np.floor(float(x) * 256)) for x in vector]


def mined(rows, every=10, k=5, low=80, high=100):
    """All pairs, with Python integers."""
    used = [(i, l, integers(v)) for i, l, v in rows if i is not None and l is not None and integers(v) is not None]
    anchors = {}
    for i, l, v in used:
        if i % every == 0 and (i not in anchors or (l, v) < anchors[i]):
            anchors[i] = (l, v)
    out = set()
    for i, (label, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, l) for j, l, w in used if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:k]
            out |= {(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(fits, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, l, v, "x") for i, l, v in rows], "vec_id long, label int, embedding array<double>, rank string")


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("blocks, column, products", [(1 << 26, 1 << 21, 1 << 20), (2000, 40, 64)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, blocks, column, products):
    monkeypatch.setattr(HN, "ANCHOR_BYTES", blocks)
    monkeypatch.setattr(HN, "COLUMN_ROWS", column)
    monkeypatch.setattr(HN, "PRODUCTS", products)
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.gauss(0.1, 0.3) for _ in range(6)]) for i in range(150)]
    rows += [(i, rng.randrange(2), [0.5, 0.25, 0.0, 0.0, -0.5, 0.125]) for i in range(150, 200)]  # ties
    rows += [(i, 1, [0.2, 0.1]) for i in (200, 201)] + [(202, 0, []), (203, 7, [1.0] * 6), (210, 7, [0.0] * 6)]
    rows += [(None, 1, [0.1] * 6), (220, None, [0.1] * 6), (230, 1, None), (240, 1, [0.1, None]), (250, 1, [NAN] * 6), (260, 1, [INF] * 6)]
    want = sorted(mined(rows))
    assert want and got(HN.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == want


def test_large_components_and_odd_tables(spark):
    big = [(i, i % 2, [1e15 * (i + 1), 3.0, -2.5e9]) for i in range(0, 12)] + [(20, 0, [0.25, 0.5, 1.0]), (21, 1, [0.25, 0.5, 1.0]), (22, 0, [0.25, 0.5, 1.5])]
    rows = frame(spark, big)
    top = 2**63 - 1

    def cut(x):
        return tuple(max(-top, min(top, v)) for v in x)

    # scores past a long stop at its ends, so they tie there
    used = [(i, l, integers(v)) for i, l, v in big]
    for i, j, _, n, p, s in got(HN.mine(rows, F.col("vec_id") % 10 == 0)):
        by = {k: v for k, _, v in used}
        assert (p, s) == cut(sum(a * b for a, b in zip(by[i], by[x])) for x in (j, n))
    empty = frame(spark, [(1, 1, [0.1])]).where("false")
    assert got(HN.mine(empty, F.lit(True))) == []
    one = frame(spark, [(10, 1, [0.1]), (10, 1, [0.2]), (11, 1, [0.3]), (12, 2, [0.3]), (12, 2, [0.3])])
    assert got(HN.mine(one, F.col("vec_id") % 10 == 0)) == [(10, 11, 1, 12, 25 * 76, 25 * 76), (10, 11, 2, 12, 25 * 76, 25 * 76)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 9), st.integers(0, 6), st.sampled_from([1, 200, 40000, 2**30, 2**52, 2**70]), st.randoms(use_true_random=False))
def test_packed_products_are_exact(anchors, rows, n, size, rng):
    a = [[rng.randint(-size, size) for _ in range(n)] for _ in range(anchors)]
    r = [[rng.randint(-size, size) for _ in range(n)] for _ in range(rows)]
    x, y = (np.array(m, dtype=np.float64).reshape(len(m), n) for m in (a, r))
    want = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(u, v)))) for v in y.tolist()] for u in x.tolist()]
    packed = HN.Packed(y, float(x.min(initial=0)), float(x.max(initial=0)))
    assert packed.scores(x).tolist() == want
    if size == 200 and n and rows > 1:
        assert packed.fields >= 2  # several candidates in one multiplication


def test_query_hard_negatives(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(QUERIES["op11_hard_negatives"](spark, SF)) == sorted(mined(rows, every=100))


# URL rules


def pattern(glob):
    return re.compile("".join(".*" if p == "**" else "[^/?]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob)).encode(), re.S)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab/?.*", max_size=12), min_size=1, max_size=30), st.lists(st.text("ab/?.é", max_size=20), min_size=1, max_size=12))
def test_automaton_equals_patterns(globs, urls):
    made = UR.Automaton(globs)
    data = [u.encode() for u in urls]
    want = [next((i for i, g in enumerate(globs) if pattern(g).fullmatch(u)), -1) for u in data]
    assert made.first_of(data, range(len(globs))).tolist() == want
    states = made.together(data)
    assert [sum(int(w) << 64 * k for k, w in enumerate(row)) for row in states] == [made.alone(u) for u in data]


def test_rules_longer_than_a_word_and_long_urls():
    long = "x" * 200
    globs = ["*." + long + "/**", "**end", "**" + long + "?*", "." + "ab" * 90]
    urls = ["." + long + "/", "." + long, "." + "y" * 5000 + "/end", "/" * 9000, "." + "ab" * 90, long + "?" + "q" * 3000, ""]
    found = UR.Automaton(globs).first_of([u.encode() for u in urls], range(4))
    assert found.tolist() == [0, -1, 1, -1, 3, 2, -1]


def plain_verdict(url):
    """The contract read word by word."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group().translate(str.maketrans(UR.UPPER, UR.LOWER))
    path = re.match("[^?#]*", rest[len(re.match("[^/?#]*", rest).group()) :]).group()
    fits = [(h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda r: len(r[0]))) if fits else (host, path, None, None)


def test_url_rules(spark):
    urls = [None, "", "no scheme.org/", "http://", "https://ORG", "https://org/", "https://a.org", "https://a.org?x=/", "http://a.xorg/", "http://xorg/", "http://example.org/es/1",
            "http://m.Example.ORG/es/", "http://example.org/ES/", "http://example.org/en/12", "http://notexample.org/en/1", "http://a.com/fr/x?b.org/", "http://a.com/x?u=b.org/y", "x://a.com/de/#f",
            "http://a.com/b.org/", "http://u@a.org:80/", "http://a.org\n/", "http://www.casino-win.example.com/en/1", "http://a.org/casino", "http://..org/", "http://ü.org/é", "http://a.net/x/login/y",
            "http://a.org/" + "z" * 100_000, "http://" + "z" * 100_000 + ".org/", "http://a.org/es", "http://example.org/es/"]
    rows = [(i, u, "old") for i, u in enumerate(urls * 2)]
    rules = [UR.site_rule(*s) for s in SITES] + [UR.Rule(g, "block") for g in GLOBS]
    done = UR.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), rules)
    assert done.columns == ["page_id", "url", "rule", "host", "path", "verdict"]
    for r in done.collect():
        host, path, rule, verdict = plain_verdict(urls[r["page_id"] % len(urls)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"][:99]
        assert r["verdict"] == (verdict or ("block" if "casino" in host or "/login" in path else "allow"))
    assert UR.judge(done.select("page_id", "url").where("false"), rules).collect() == []
    none = UR.judge(spark.createDataFrame(rows[:3], "page_id long, url string, x string"), [], default="block").collect()
    assert [(r["rule"], r["verdict"]) for r in none] == [(None, "block")] * 3
    ties = [UR.Rule("**a**", "block", "first", 1), UR.Rule("**", "allow", "second", 1), UR.Rule("**b**", "allow", "third", 2)]
    told = UR.judge(spark.createDataFrame([("x://a",), ("x://c",), ("x://ab",)], "url string"), ties)
    assert [r["rule"] for r in told.collect()] == ["first", "second", "third"]


# fill in the middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def cut_plainly(doc_id, text):
    text = text or ""
    units, (h1, h2, h3, h4) = UNIT.findall(text), FM.draws(doc_id, 1)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abZ @[`{ié€😀<PSM>\n0"), max_size=60))
def test_boundaries(text):
    starts = [len(text[: m.start()].encode()) for m in UNIT.finditer(text)]
    bounds = FM.Boundaries(text.encode())
    assert [bounds.select(k) for k in range(len(bounds) + 1)] == [*starts, len(text.encode())]


@pytest.mark.parametrize("piece, kind", [("1", FM.RunContainer), ("word " * 4 + "of it. ", FM.BitmapContainer), ("longestword" * 9 + " ", FM.ArrayContainer), ("é", FM.BitmapContainer)])
def test_containers_of_long_texts(piece, kind):
    text = piece * (200_000 // len(piece.encode()))
    starts = [0, *itertools.accumulate(len(u.encode()) for u in UNIT.findall(text))]
    bounds = FM.Boundaries(text.encode())
    assert {type(c) for c in bounds.containers[:-1]} == {kind} and len(bounds) == len(starts) - 1
    for k in [*range(0, len(starts), 997), len(starts) - 1]:
        assert bounds.select(k) == starts[k]


def test_fill_middle(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "ab", "<P>", "a<S>b", "x<M", "<P", "<" * 9, "é€😀 z", "word " * 50_000, "\x00a\ud7ff", "A1b2"] + ["".join(rng.choice("ab <PSM>é\n") for _ in range(30)) for _ in range(80)]
    rows = [(None if i == 5 else i, t, "old") for i, t in enumerate(texts)] * 2
    done = FM.transform(spark.createDataFrame(rows, "doc_id long, text string, form string"))
    assert done.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    again = done.withColumn("again", FM.restored(F.col("output"), F.col("form"))).collect()
    assert len(again) == len(rows) and {r["form"] for r in again} == {"plain", "psm", "spm"}
    for r in again:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut_plainly(r["doc_id"], r["text"])
        assert r["again"] == (r["text"] or "")
    assert FM.transform(done.select("doc_id", "text").where("false")).collect() == []
    ends = FM.transform(done.select("doc_id", "text"), changed=100, spm=0).where("text <> '' and not text rlike '<[PSM]>'")
    assert {r["form"] for r in ends.select("form").collect()} == {"psm"}
