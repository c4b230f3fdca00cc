"""Row-wise operators against brute force, round trips and held-out rows; odd inputs for each."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from firmatlas.llm import bpe, html_content, language, privacy, quality, secret_scan, toxicity
from firmatlas.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(TOKENIZER)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "x" * 30_000), (6, "a b c d e " * 3_000), (None, "no id here"), (7, "é日🙂 " * 20)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", "clash", 1.0) for i, t in ODD], "doc_id long, text string, lang string, source string, ids string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- byte-level BPE


def reference_codec():
    made = bpe.codec(PATH, public_tokenizers.PATTERN)
    return made, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.ranks, special_tokens={})


def test_bpe_equals_the_library_on_random_texts():
    made, want = reference_codec()
    rng = random.Random(3)
    parts = ["a", "b", "aa", " ", "  ", "\n", "é", "日", "🙂", "0", "12", "\x00", "<|endoftext|>", "'s", "ing", "tion", "€€"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        assert made.encode(text) == want.encode_ordinary(text)
    for text in (" " * 20_000, "ab" * 10_000, "!?" * 5_000):
        assert made.encode(text) == want.encode_ordinary(text)


def test_bpe_pairs_agree_with_plain_merging():
    made, _ = reference_codec()
    rng = random.Random(4)
    for _ in range(3_000):
        a, b = rng.randrange(len(made.token)), rng.randrange(len(made.token))
        assert made.stay_apart(a, b) == (made.merged(made.token[a] + made.token[b]) == [made.token[a], made.token[b]])


def test_bpe_round_trip_and_odd_rows(spark, odd, none):
    _, want = reference_codec()
    done = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted(done.columns) == sorted([*odd.columns, "decoded"])
    rows = done.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == want.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(none, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_bpe_round_trip_in_one_pass(spark, odd):
    one = bpe.round_trip(odd, PATH, public_tokenizers.PATTERN)
    two = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_bpe_many_texts_equal_the_library():
    made, want = reference_codec()
    rng = random.Random(8)
    tokens = [t.decode("utf-8", "ignore") for t in rng.sample(made.token, 2_000)]
    texts = [None, "", "y" * 5_000] + ["".join(rng.choice(tokens) for _ in range(rng.randint(0, 40))) for _ in range(2_000)]
    borders, ids = made.encode_all(texts)
    for i, text in enumerate(texts):
        assert ids[borders[i] : borders[i + 1]].tolist() == want.encode_ordinary(text or "")
    for piece in (" unverlässlichkeitsprüfung", "zzzzqqqq", "日本語テキスト", "a" * 60):
        assert made.encode_side_by_side([piece, "x", piece])[::2] == [made.encode_piece(piece.encode())] * 2
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0, b"aa": 1}, public_tokenizers.PATTERN).encode("aab")


def test_bpe_bytes_of_lists():
    tokens = bpe.pa.array([b"a", b"bc", None, b"\xff"], type=bpe.pa.binary())
    lists = bpe.pa.array([[1, 0], None, [], [3], [0, 0, 1]], type=bpe.pa.list_(bpe.pa.int32()))
    assert bpe.bytes_of(lists, tokens).to_pylist() == [b"bca", b"", b"", b"\xff", b"aabc"]
    assert bpe.bytes_of(lists.slice(3), tokens).to_pylist() == [b"\xff", b"aabc"]
    assert bpe.bytes_of(lists.slice(1, 2), tokens).to_pylist() == [b"", b""]
    for wrong in ([2], [None]):
        with pytest.raises(KeyError):
            bpe.bytes_of(bpe.pa.array([wrong], type=bpe.pa.list_(bpe.pa.int32())), tokens)


def test_bpe_query_is_one_pass_without_texts_back(spark):
    plan = QUERIES["op10_byte_bpe"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    (passed,) = [x for x in plan.split("\n") if "MapInArrow" in x]
    assert "ids#" in passed.split(", [")[-1] and "text#" not in passed.split(", [")[-1]


def test_bpe_query_digests(spark):
    _, want = reference_codec()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    for r in QUERIES["op10_byte_bpe"](spark, SF).collect():
        ids = want.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


# --- pages


PAGE = """<html><head><title>T</title></head><body><header><div>Site</div><a href=x>Home</a></header>
<div class="cookie-notice"><p>We use cookies to improve your visit to our site.</p></div>
<div class="post has-sidebar"><h1>A title</h1><p>First words of   the <b>story</b>,<br>long enough.<ul><li>one<li>two</ul>
<form><p>Your mail</p></form><p>More &amp; more&nbsp;text <a href=x>linked</a>.</div>
<div id="comments"><article><p>I liked this story very much, thank you for it!</p></article></div><footer>&copy; us</footer>"""


def test_main_blocks_of_a_page():
    assert html_content.main_blocks(PAGE) == ["A title", "First words of the story, long enough.", "one", "two", "More & more text linked."]


def test_page_without_marks_keeps_running_text():
    page = "<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>There is no article element here, but this is a long run of text.</p><p>Short.</p><p>And here another long run of text follows, which ends with a stop.</p></div>"
    assert html_content.main_blocks(page)[0].startswith("There is") and "Short." in html_content.main_blocks(page)
    assert not any("Home" in b for b in html_content.main_blocks(page))


def test_minimum_cut_equals_the_best_labelling():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        ends = [(rng.random() * 4, rng.random() * 4) for _ in range(n)]
        edges = [(a, b, rng.random() * 3) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(kept, ends=ends, edges=edges):
            return sum(b if k else c for k, (c, b) in zip(kept, ends, strict=True)) + sum(w for a, b, w in edges if kept[a] != kept[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(html_content.cut(ends, edges)) == pytest.approx(best)


def test_pages_query_and_odd_pages(spark):
    for r in QUERIES["op1_html_content"](spark, SF).collect():
        assert r["text"] and r["n_chars"] == len(r["text"]) and "<" not in r["text"]
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "<p", 1), (4, "<script>x", 1), (5, "&am", 1), (6, "<div>" * 2_000 + "deep inside there is a line of text.", 1)], "page_id long, html string, blocks int")
    got = {r["page_id"]: r["blocks"] for r in html_content.extract(odd).collect()}
    assert got[1] == got[2] == got[4] == [] and got[6] == ["deep inside there is a line of text."] and got[5] == []
    assert html_content.extract(odd.limit(0)).count() == 0


# --- language


def test_language_on_held_out_rows(spark, odd, none):
    rows = QUERIES["op4_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    network = language.fit(documents(spark))
    got = language.predict(odd, network).collect()
    assert len(got) == len(ODD)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if not any(map(str.isalpha, r["text"] or "")))
    assert language.predict(none, network).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(none)).collect()} == {"und"}


def test_language_sample_has_every_language_and_no_copies(spark):
    copies = [("the same english text", "en"), ("derselbe deutsche Text", "de")] * 3_100
    rows = spark.createDataFrame([*copies, ("le seul texte", "fr"), *((f"an english text {k}", "en") for k in range(30))], "text string, lang string")
    assert language.fit(rows).labels == ["de", "en", "fr"]
    assert Counter(r["lang"] for r in language.sampled(rows).collect()) == {"en": 31, "de": 1, "fr": 1}
    assert Counter(r["lang"] for r in language.sampled(rows, rows_per_language=5).collect()) == {"en": 5, "de": 1, "fr": 1}


def test_gradients_agree_with_differences():
    import numpy as np

    rng = np.random.default_rng(1)
    windows, truth = rng.integers(97, 105, (4, 12)).astype(np.uint8), np.array([0, 1, 2, 1])
    network = language.Network.new(["a", "b", "c"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}

    def loss():
        steps = windows.T
        p = network.position_probabilities(network.states("f", steps), network.states("b", steps[::-1])[::-1])
        return -np.log(p[:, truth, np.arange(4)]).mean()

    grads = network.gradients(windows, truth)
    for name, w in network.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old, step = w[at], 1e-5
        w[at] = old + step
        high = loss()
        w[at] = old - step
        low = loss()
        w[at] = old
        assert (high - low) / (2 * step) == pytest.approx(grads[name][at], rel=1e-3)


# --- toxicity


def test_grammar_scores_clauses_not_words():
    reader = toxicity.Grammar().reader()
    kinds = lambda text: [k for *_, k, _ in reader.clauses(text)]
    assert kinds("You are an idiot.") == ["insult_target"]
    assert kinds("Such scum everywhere.") == ["insult"]
    assert kinds("It was not stupid.") == ["insult_negated"]
    assert kinds('They said "what a loser" to us.') == ["insult_reported"]
    assert kinds("I will kill you.") == ["threat"] and kinds("The plants will kill weeds.") == []
    assert kinds("nothing here") == []
    score = lambda text: reader.score(reader.clauses(text))
    assert score("You idiot, you scum.") > score("Such scum.") > score("It was not stupid.") > score("")


def test_long_clauses_are_read_whole_and_once():
    reader = toxicity.Grammar().reader()
    hits = lambda text: [(a, k) for a, _, k, _ in reader.clauses(text)]
    filler = "word " * 200
    assert hits(f"Fine. They said {filler}scum. Then scum") == [(1016, "insult_reported"), (1027, "insult")]
    text = "scum " + "word " * 60 + "scum " + "word " * 70 + "scum " + filler + "scum"
    assert hits(text) == [(at, "insult") for at in (0, 305, 660, 1665)]


def test_toxicity_on_held_out_rows(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op5_toxicity"](spark, sf).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    right = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert right[1, 1] >= 0.85 * (right[1, 1] + right[1, 0]) and right[0, 1] <= 0.01 * (right[0, 0] + right[0, 1])
    grammar = toxicity.learn(none, labels.limit(0))
    got = toxicity.score(odd, grammar).collect()
    assert len(got) == len(ODD) and all(0 <= r["toxicity"] <= 1 for r in got)
    assert toxicity.score(none, grammar).count() == 0


def test_toxicity_sends_back_only_what_is_read(spark, odd):
    """Spark prunes nothing behind Python workers: texts and clauses came back to the JVM and were dropped there."""
    back = lambda df: next(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in x).split(", [")[-1]
    query = back(QUERIES["op5_toxicity"](spark, SF))
    assert "toxicity#" in query and "text#" not in query and "clauses#" not in query
    whole = toxicity.score(odd, toxicity.Grammar())
    short = toxicity.score(odd, toxicity.Grammar(), clauses=None, drop=("text", "lang"))
    assert short.columns == [c for c in whole.columns if c not in ("text", "lang", "toxic_clauses")]
    assert sorted(map(str, short.collect())) == sorted(map(str, whole.select(short.columns).collect()))


# --- personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10 == 0


def base(text):
    found = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return [(list(RULES)[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_equal_plain_search(spark, odd, none):
    rng = random.Random(6)
    parts = ["a@b.c", "x_y%z@q-r.de", "é", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", "x", ".", "_", "@", "12", "-", "\n", "日", "+", "9" * 13]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["a@b.co " * 3_000, "1 " * 30_000, "7" * 50_000, "a" * 50_000 + "@"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd.select("doc_id", "text"))
    for r in privacy.find(rows).collect():
        got = [(privacy.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]]
        assert [s for s in got if s[0] != "term"] == base(r["text"])
    assert privacy.find(none).count() == 0


def test_disclosing_terms_and_masks(spark):
    told = [(i, f"Ask Zerbrowski {w} now at zb@example.org please {w}") for i, w in enumerate(["alpha", "bravo", "delta", "golf"])]
    other = [(10 + i, f"please ask others {i} now") for i in range(40)]
    rows = spark.createDataFrame([*told, *other], "doc_id long, text string")
    found = {r["doc_id"]: r for r in privacy.find(rows).withColumn("clean", privacy.sanitised(F.col("text"), F.col("spans"))).collect()}
    assert {s["raw"] for s in found[0]["spans"]} == {"Zerbrowski", "zb@example.org"}
    assert found[0]["clean"] == "Ask  alpha now at [EMAIL] please alpha"
    assert found[10]["spans"] == [] and found[10]["clean"] == "please ask others 0 now"


# --- quality


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_rules(spark, odd, none):
    rows = documents(spark).select("doc_id", "text", "lang").union(odd.where("doc_id is not null").select(F.col("doc_id") + 10_000, "text", "lang"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    kept = {}
    for r in quality.judge(rows).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == rules(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["character_distance"] <= 1 and 0 <= r["word_distance"] <= 1
        kept[r["doc_id"]] = r["kept"] or r["base_failed"]
    good = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()]
    assert sum(kept[i] for i in good) >= 0.98 * len(good)
    assert quality.judge(none).count() == 0


@pytest.mark.parametrize("sent", [1000, 0])
def test_quality_of_a_small_language(spark, monkeypatch, sent):
    monkeypatch.setattr(quality, "SENT", sent, raising=False)
    rng = random.Random(9)
    made = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60))
    rows = [(i, made("abcdefgh"), "en") for i in range(2_100)] + [(5_000, made("αβγδεζηθ"), "el"), (5_001, made("αβγδεζηθ"), "el"), (5_002, made("αβγδεζηθ"), None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and got[5_000] and got[5_001] and not got[5_002] and got[0]


def test_quality_counts_classes_in_what_is_left(spark):
    rng = random.Random(11)
    parts = ["abc", "Q", "7", "-", "'", "#", "&|", " ", "\n", "\t\x0b", "\x1f", "\x85", "é", "日", "𝒳", "_"]
    texts = {10_000 + i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for i in range(60)}
    docs = documents(spark).where("text is not null").select("doc_id", "text", "lang")
    told = quality.measured(docs.union(spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")))
    texts |= {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in told.collect():
        t = texts[r["doc_id"]]
        named = [sum(map(len, re.findall(pattern, t))) for pattern in quality.CLASSES]
        n_bytes = len(t.encode())
        assert r["classes"] == [*named, len(re.findall(r"[\x20\x09-\x0D]", t)), n_bytes - len(t), n_bytes]
    # one pattern reads the whole text
    assert quality.measured(docs)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(text#") == 1


@pytest.mark.parametrize("common", [[], ["the", "a,b", "é"], [f"w{k}" for k in range(quality.COMMON)]])
def test_quality_counts_common_words_by_their_hashes(spark, common):
    rng = random.Random(12)
    texts = [[rng.choice(["the", "the,", "a,b", "é", "e", *(f"w{k}" for k in range(30))]) for _ in range(n)] for n in (0, 1, 7, 400)]
    rows = spark.createDataFrame([(i, words, common) for i, words in enumerate(texts)], "i int, words array<string>, common array<string>")
    hashed = rows.select("i", *[F.transform(c, lambda w: F.xxhash64(w)).alias(c) for c in ("words", "common")])
    got = {r["i"]: r["counts"] for r in hashed.select("i", quality.word_counts(F.col("words"), F.col("common")).alias("counts")).collect()}
    assert got == {i: [*[words.count(c) for c in common], len(words)] for i, words in enumerate(texts)}
    # Spark interprets all that is inside or below a lambda
    assert "transform" not in str(quality.word_counts(F.col("words"), F.col("common")))


# --- secrets


def test_secrets_are_told_from_other_long_values(spark, odd, none):
    rng = random.Random(8)
    value = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'config api token = "{value()}" end', "src") for i in range(30)] + [(100 + i, f"commit {value()} by order {rng.randrange(10**16)}", "src") for i in range(30)]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) >= 80
    assert all(r["kept"] == (r["doc_id"] < 100) for r in found)
    assert secret_scan.scan(none).count() == 0
    assert secret_scan.scan(odd.select("doc_id", "text", "source")).where("kept").count() == 0


def test_assigned_values_without_their_names(spark):
    a, b, c = "Ab12Cd34Ef56Gh78Ij90", "q1w2e3r4t5y6u7i8o9p0", "Zm9vYmFyYmF6cXV4MTIz"
    texts = {1: f"SECRET_KEY={a}", 2: f"https://x.org/?token={b}&n=1", 3: f"AWS_SECRET_ACCESS_KEY = '{a}'", 4: f'"api-key": "{c}=="', 5: f"MY_APP_2_CLIENT_SECRET={b}", 6: f"version: {a}", 7: f"see {b} there", 8: "A1_LONG_NAME_OF_A_THING=short"}
    found = secret_scan.candidates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), [], path=None)
    got = {r.doc_id: (r.value, r.name) for r in found.collect()}
    assert got == {1: (a, "SECRET_KEY"), 2: (b, "token"), 3: (a, "AWS_SECRET_ACCESS_KEY"), 4: (c + "==", "api-key"), 5: (b, "MY_APP_2_CLIENT_SECRET"), 6: (a, "version"), 7: (b, None)}
    labelled = {r.doc_id: r.label for r in secret_scan.provenance_labels(found).collect()}
    assert labelled == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0, 7: 0.0}


def test_forest_judges_what_the_names_do_not_tell(spark):
    """Held out: values that nothing names, and values under names that say nothing."""
    rng = random.Random(5)
    mixed = lambda n=32: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    number = lambda: str(rng.randrange(10**17, 10**18))
    rows = [(i, f"password={mixed()}") for i in range(60)] + [(100 + i, f"order {number()} was sent") for i in range(60)]
    held = [(200 + i, f"see {mixed()} here") for i in range(20)] + [(300 + i, f"count = {number()}") for i in range(20)]
    known, unknown = (secret_scan.candidates(spark.createDataFrame(r, "doc_id long, text string"), [], path=None) for r in (rows, held))
    forest = secret_scan.train(secret_scan.provenance_labels(known))
    found = {r.doc_id: r.kept for r in secret_scan.judged(unknown, *forest).collect()}
    assert sum(found[i] for i, _ in held[:20]) >= 15  # the rule calls them none, as nothing names them
    assert not any(found[i] for i, _ in held[20:])  # the rule says nothing about them
    starts = {r.doc_id: r.start for r in known.collect()}
    labels = spark.createDataFrame([(i, starts[i], 1 - int(i < 100)) for i, _ in rows], "doc_id long, start int, label int")
    turned = secret_scan.scan(spark.createDataFrame([(i, t, "x") for i, t in rows + held], "doc_id long, text string, source string"), labels=labels).collect()
    assert {r.doc_id for r in turned if r.kept} >= {i for i, _ in held[20:]} | {i for i, _ in rows[60:]}


def test_addresses_of_any_length(spark):
    texts = ["a@b" + ".c" * 100_000, "x" * 1_000_000 + "@", " ".join(f"u{i}@h{i}.org" for i in range(20_000)), "a@b" * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", privacy.base_spans(F.col("text")).alias("s")).orderBy("doc_id")
    found = rows.select(F.size("s").alias("n"), F.get(F.transform("s", lambda x: x["end"]), 0).alias("end")).collect()
    assert [r.n for r in found] == [1, 0, 20_000, 0] and found[0].end == 200_003
