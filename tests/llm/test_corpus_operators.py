"""Joins, searches and models over all documents against brute force, and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firmatlas.llm import decontaminate, language_model, ngram_join
from firmatlas.llm.common import held_out, packed, shingle_set, unpacked
from firmatlas.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RNG = random.Random(2)
WORDS = ["w" + str(i) for i in range(400)]


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows):
    """(size, smallest id) per document id, by comparing all pairs that share a shingle."""
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            sets[i].add(shingles(t))
    lead = {i: i for i in sets}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    each = [(i, s) for i, many in sets.items() for s in many if s]
    for a, (i, x) in enumerate(each):
        for j, y in each[:a]:
            if 100 * len(x & y) >= 80 * len(x | y) and find(i) != find(j):
                lead[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in sets}


def made_up(groups=12, copies=6):
    """Groups of copies with growing edits, passages in common, and odd rows."""
    rows, passage = [], " ".join(RNG.choice(WORDS) for _ in range(60))
    for _ in range(groups):
        text = [RNG.choice(WORDS) for _ in range(RNG.randint(30, 160))]
        for c in range(copies):
            own = list(text)
            for _ in range(c):
                own[RNG.randrange(len(own))] = RNG.choice(WORDS)
            rows.append(" ".join(own) if c % 3 else " ".join(own) + " " + passage)
    rows += [None, "", " \n ", "one", "One", "one two", "a b c d e", "A  b c d\ne"]
    RNG.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)] + [(0, "a second text of id zero"), (3, rows[1]), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def copies(spark):
    rows = made_up()
    return rows, spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, component_id int")


@pytest.mark.parametrize("block, few, frequent", [(6000, 8, 1000), (3, 8, 1000), (6000, 1, 4)])
def test_ngram_join_equals_all_pairs(monkeypatch, copies, block, few, frequent):
    rows, docs = copies
    for name, value in (("BLOCK", block), ("FEW", few), ("FREQUENT", frequent), ("HUBS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    want = components(rows)
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)


def test_ngram_join_of_nothing(copies):
    _, docs = copies
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0
    assert ngram_join.ngram_components(docs.where("doc_id is null")).where("component_id is not null").count() == 0


def test_ngram_join_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op6_ngram_join"](spark, SF).collect()}
    assert got == {i: (len(shingles(t)), want[i]) for i, t in rows}


def test_first_codes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (rng.integers(1, 60), rng.integers(0, 9), rng.integers(0, 9)))
        x, y = np.unique(np.append(shared, a)), np.unique(np.append(shared, b))
        common = np.sort(rng.choice(shared, len(shared) // 2, replace=False))
        ranks = rng.integers(1, 4, len(common)).astype(np.int8)
        if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            assert len(np.intersect1d(ngram_join.first_codes(x, common, ranks), ngram_join.first_codes(y, common, ranks)))


@pytest.mark.parametrize("block, outside", [(65, 16), (67, 16), (79, 40), (16, 67), (65, 300)])
def test_ngram_join_of_a_block_and_stragglers_compares_all(block, outside):
    # the largest sets of the block stand in its last leaf; each has its near copies on the other side, and no others
    rows = []
    for k in range(block):
        rows.append((k, 0, " ".join(f"a{k}x{i}" for i in range(40 + k // 8)), k))
    for k in range(outside):
        of = block - 1 - k % block
        rows.append((1000 + k, 1, rows[of][2] + f" more{k}", 1000 + k))
    got = ngram_join._across(pd.DataFrame(rows, columns=["rep", "side", "text", "label"]))
    want = {k: k for k in range(block)} | {1000 + k: block - 1 - k % block for k in range(outside)}
    assert dict(zip(got["rep"], got["component"], strict=True)) == want


def test_shingles_tell_orders_apart_and_blocks_unpack():
    assert len(shingle_set(b"a b b a x")) == 1 and shingle_set(b"a b b a x") != shingle_set(b"b a a b x")
    codes = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (unpacked(packed(codes)) == codes).all()


def contained(docs, items):
    out = []
    for i, t in docs:
        for j, u in items:
            x, y = shingles(t), shingles(u)
            if i is not None and j is not None and y and 100 * len(x & y) >= 80 * len(y):
                out.append((i, j, len(y), len(x & y)))
    return sorted(out)


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_decontamination_equals_all_pairs(spark, sent):
    items = [(k, " ".join(RNG.choice(WORDS) for _ in range(n))) for k, n in enumerate([3, 5, 6, 12, 30, 31, 80, 200])] + [(20, None), (21, ""), (None, "no id")]
    items.append((22, items[4][1]))
    docs = []
    for i in range(60):
        words = [RNG.choice(WORDS) for _ in range(RNG.randint(0, 300))]
        if i % 2:
            part = (items[i // 2 % 8][1]).split()
            for _ in range(i % 5):
                part[RNG.randrange(len(part))] = "changed"
            words[10:10] = part
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[5][1]), (102, items[0][1].upper()), (1, docs[1][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    listed = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.search(frame, listed, codes_sent=sent).collect())) == contained(docs, items)
    hit = {i for i, *_ in contained([(n, t) for n, (_, t) in enumerate(docs)], items)}
    left = decontaminate.clean(frame, listed.where("item_id is not null"), codes_sent=sent)
    assert left.columns == frame.columns and left.count() == len(docs) - len(hit)
    assert decontaminate.search(frame.limit(0), listed, codes_sent=sent).count() == 0
    assert decontaminate.search(frame, listed.limit(0), codes_sent=sent).count() == 0


def test_language_model_equals_plain_counting(spark):
    rows = [(i, " ".join(RNG.choice(WORDS[:30]) for _ in range(RNG.randint(0, 50)))) for i in range(80)] + [(90, None), (91, ""), (92, "Unseen words"), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    words, pairs = Counter(), Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not out(i):
            words.update(tokens(t))
            pairs.update(zip(tokens(t), tokens(t)[1:], strict=False))
    n, v, m = sum(words.values()), len(words), language_model.PRIOR
    p = lambda w: (words[w] + 1) / (n + v + 1)
    want = []
    for i, t in rows:
        k = tokens(t)
        score = math.log10(p(k[0])) + sum(math.log10((pairs[h, w] + m * p(w)) / (words[h] + m)) for h, w in zip(k, k[1:], strict=False))
        want.append((str(i), out(i), len(k), sum(words[w] > 0 for w in k), n, round(sum(math.log10(p(w)) for w in k), 6), round(score, 6)))
    got = language_model.scores(docs, held_out("doc_id", 7, 2), block_bytes=600, shard_codes=50).collect()
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in got) == sorted(want)
    assert language_model.scores(docs.limit(0), held_out("doc_id", 7, 2)).count() == 0
    # the probabilities that follow a context add up to one
    h = WORDS[0].encode()
    seen = [w for w in words if w is not None]
    total = sum((pairs[h, w] + m * p(w)) / (words[h] + m) for w in [*seen, None, b"any unseen word"])
    assert total == pytest.approx(1)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert docs.columns == columns
            docs = docs.persist()
        kept.append((name, before, docs))
    steps = {name: (before, after) for name, before, after in kept}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = steps["ngram_join"]
    want = components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == {i for i, c in want.items() if i == c}

    before, after = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, *_ in contained([(r["doc_id"], r["text"]) for r in before.collect()], items)}
    assert ids(after) == ids(before) - hit

    before, after = steps["privacy"]
    assert ids(after) == ids(before)
    assert after.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.")).count() == 0
    assert after.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()

    before, after = steps["byte_bpe"]
    assert ids(after) == ids(before) and after.where("not round_trip").count() == 0


def test_pipeline_of_odd_documents(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "no id"), (None, "no id"), (3, "same text twice over here"), (4, "same text twice over here"), (3, "same text twice over here"), (5, "mail me@x.org now")]
    docs = spark.createDataFrame([(i, t, None, "s", 1, "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = sorted(str(r["doc_id"]) for r in docs.collect())
    assert got == ["1", "2", "3", "5", "None", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_pipeline_keeps_different_texts_of_one_id(spark):
    texts = [" ".join(RNG.choice(WORDS) for _ in range(40)) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (2, texts[2]), (3, texts[2] + " end"), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (0, texts[0])])


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: int(len(base) * cut)], rng.integers(0, 2**63, extra, dtype=np.uint64)])) for cut, extra in ((1, 0), (1, 3), (0.9, 2), (0.6, 30), (1, 60))]
    sets = [s for s in sets if len(s)]
    marks = [ngram_join.marked(s, ngram_join.own_width(len(s))).tobytes() for s in sets]
    near = ngram_join.perhaps_joined(np.array([len(s) for s in sets]), marks)
    exact = ngram_join.joined(sets)
    assert all(near[i] == near[k] for i, k in enumerate(exact))
    assert len(set(near)) > 50  # and it tells most others apart
    assert ngram_join.perhaps_joined(np.array([], dtype=np.int64), []) == []
