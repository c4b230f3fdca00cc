"""Quality rules: how far a document's character classes and common words are from its language.

Two histograms per document, one over character classes and one over the most common short words of its language
(and all other words), are compared with the same histograms of the language over all documents by the
Jensen-Shannon distance. A document is kept if the fixed rules pass and both distances are within their limits;
documents of fewer than ``GUARD_WORDS`` words are too short for a distance to mean anything and only face the rules.

References: every language has its own; documents without a language are compared with the whole corpus. Up to
``SENT`` references are sent to all executors, more are joined by Spark's choice.

Texts are read twice: for the common words, and for the numbers of each row, which are written and compared then.
Everything is an expression inside the document's row. Words become 64-bit hashes once; common words are counted and
windows are compared by these. Repeated windows are found by sorting (hash, position), and only where a hash occurs twice.

Defined results: a null text counts as empty: no words, not kept; an empty table gives an empty result; rows that
repeat an id are each judged; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmatlas.functions.text import let
from firmatlas.llm.common import whole
from firmatlas.session import write_stage

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
GUARD_WORDS, CHARACTER_LIMIT, WORD_LIMIT, SENT = 50, 0.33, 0.45, 1000
COMMON, COMMON_LENGTH = 24, 6
SPACE, SYMBOLS = r"\x20\x09-\x0D", "[#*$%&|<>]+"
#: Character classes counted by pattern, no character in two; white space, bytes beyond ASCII and all other characters are further ones.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+", SYMBOLS)
N_CLASSES = len(CLASSES) + 2
#: Hexadecimal digits of a word's code in the row of all codes.
DIGITS = 16


def repeated_words(codes: Column) -> Column:
    """Words (given by their hashes) that stand in a window found twice or more."""
    # with the highest bit set every code has all its digits, so a window is a piece of fixed length in the row of all codes
    row = F.array_join(F.transform(codes, lambda c: F.hex(c.bitwiseOR(F.lit(-(2**63))))), "").cast("binary")
    starts = F.sequence(F.lit(1), DIGITS * (F.size(codes) - WINDOW) + 1, F.lit(DIGITS))
    hashes = F.when(F.size(codes) >= WINDOW, let(row, lambda r: F.transform(starts, lambda i: F.xxhash64(F.substring(r, i, F.lit(DIGITS * WINDOW))))))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"])))
        start = F.struct(F.lit(-WINDOW).alias("before"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("before"), (acc["n"] + F.least(p - acc["before"], F.lit(WINDOW))).alias("n"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), start, step, lambda acc: acc["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def pieces(text: Column) -> Column:
    """Words of a text; an empty one where it starts or ends with white space."""
    return F.split(text, f"[{SPACE}]+")


def measured(read: DataFrame) -> DataFrame:
    """doc_id, lang, codes (hashes of the words), classes, and the counts of the fixed rules; ``read`` has doc_id, lang and text."""
    t = F.col("text")
    split = read.withColumn("words", F.filter(pieces(t), lambda w: w != "")).withColumn("lines", F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACE}]")))
    # each class is taken out of what the one before has left, so that only the first pattern reads the whole text; it takes white space out too
    first, *others = CLASSES
    split = split.withColumn("_left0", F.regexp_replace(t, first.replace("[", f"[{SPACE}"), ""))
    for k, pattern in enumerate(others, 1):
        split = split.withColumn(f"_left{k}", F.regexp_replace(f"_left{k - 1}", pattern, ""))
    before = [F.length(F.array_join("words", "")), *[F.length(f"_left{k}") for k in range(len(others))]]
    counts = split.select(
        "doc_id",
        "lang",
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(t).cast("long").alias("n_chars"),
        F.octet_length(t).cast("long").alias("n_bytes"),
        *[(before[k] - F.length(f"_left{k}")).cast("long").alias(f"_c{k}") for k in range(len(CLASSES))],
    )
    found = [F.col(f"_c{k}") for k in range(len(CLASSES))]
    beyond = F.col("n_bytes") - F.col("n_chars")
    # the last place holds the sum of all classes; what the named ones leave is the class of other characters
    classes = F.array(*found, F.col("n_chars") - F.col("word_chars"), beyond, F.col("n_bytes"))
    return counts.select("doc_id", "lang", "codes", "n_words", "word_chars", F.col(f"_c{CLASSES.index(SYMBOLS)}").alias("n_symbols"), "n_dup_lines", classes.alias("classes"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def shares(counts: Column) -> Column:
    """Counts per class with the sum of all in the last place, as shares that add up to one."""

    def divided(c: Column) -> Column:
        named = F.slice(c, 1, F.size(c) - 1)
        whole_count, rest = F.element_at(c, -1), F.element_at(c, -1) - F.aggregate(named, F.lit(0).cast("long"), lambda a, x: a + x)
        parts = F.struct(F.concat(named, F.array(rest)).alias("n"), F.greatest(whole_count, F.lit(1)).cast("double").alias("total"))
        return let(parts, lambda p: F.transform(p["n"], lambda x: x / p["total"]))

    return let(counts, divided)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    each = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0)))


def common_words(read: DataFrame) -> DataFrame:
    """ref, common (hashes of words), counts: the most frequent short words of each language, and for null of the whole corpus."""
    short = read.select("lang", F.explode(pieces(F.col("text"))).alias("word")).where((F.length("word") <= COMMON_LENGTH) & (F.col("word") != ""))
    counted = short.groupBy("lang", "word").agg(F.count("*").alias("n"))
    counted = write_stage(counted, "quality-words")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    own = counted.where("lang is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= COMMON)
    every = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON)
    every = every.select(F.lit(None).cast("string").alias("lang"), "word", "n", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("rank"))
    top = own.select("lang", "word", "n", "rank").unionByName(every).groupBy(F.col("lang").alias("ref")).agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    return write_stage(top.select("ref", F.transform("top", lambda x: F.xxhash64(x["word"])).alias("common"), F.transform("top", lambda x: x["n"]).alias("counts")), "quality-common")


def references(rows: DataFrame, common: DataFrame) -> DataFrame:
    """ref, ref_classes, ref_words: shares per language, and for null of the whole corpus; ``rows`` has known and classes."""
    sums = [F.sum("n_words").alias("n_words"), *[F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(N_CLASSES + 1)]]
    per = write_stage(rows.groupBy("known", "lang").agg(*sums), "quality-sums")
    again = [F.sum(c).alias(c) for c in per.columns if c not in ("known", "lang")]
    own = per.where("known").groupBy(F.col("lang").alias("ref")).agg(*again)
    every = per.agg(*again).withColumn("ref", F.lit(None).cast("string"))
    told = own.unionByName(every).alias("t").join(common.alias("c"), F.col("t.ref").eqNullSafe(F.col("c.ref")), "left")
    counts = F.coalesce("counts", F.expr("cast(array() as array<bigint>)"))
    return told.select(F.col("t.ref").alias("ref"), shares(F.array(*[F.col(f"c{k}") for k in range(N_CLASSES + 1)])).alias("ref_classes"), shares(F.concat(counts, F.array("n_words"))).alias("ref_words"))


def word_counts(codes: Column, common: Column) -> Column:
    """Counts of the common words, and of all words in the last place; both sides are hashes.

    One expression per place and no lambda around them: then Spark compiles them, each into a method of its own where
    the projection also holds a lambda, as that of ``judge`` does.
    """
    each = F.array(*[(F.size(codes) - F.size(F.array_remove(codes, F.get(common, F.lit(k))))).cast("long") for k in range(COMMON)])
    # places beyond the common words are null
    return F.concat(F.slice(each, F.lit(1), F.size(common)), F.array(F.size(codes).cast("long")))


def _sent(refs: DataFrame) -> DataFrame:
    return F.broadcast(refs) if refs.count() <= SENT else refs


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", guard_words: int = GUARD_WORDS, character_limit: float = CHARACTER_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, counts of the fixed rules, both distances, base_failed, kept."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), whole(text).alias("text"))
    told = measured(read)
    common = common_words(read)
    # one row per language and one for the corpus; a corpus without short words has no row
    own = common.where("ref is not null").select("ref", F.col("common").alias("own_common"))
    every = F.broadcast(common.where("ref is null").select(F.col("common").alias("all_common")))
    near = told.withColumn("known", F.col("lang").isNotNull()).join(_sent(own), F.col("lang") == F.col("ref"), "left").join(every, F.lit(True), "left")
    nothing = F.expr("cast(array() as array<bigint>)")
    near = near.withColumn("common", F.coalesce(F.when(F.col("known"), F.coalesce("own_common", nothing)), "all_common", nothing))
    rows = near.select(
        "doc_id",
        "lang",
        "known",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col("codes")).cast("long").alias("n_repeat_words"),
        "classes",
        word_counts(F.col("codes"), F.col("common")).alias("word_counts"),
    )
    # numbers only: the texts are not read again
    rows = write_stage(rows, "quality-rows")
    refs = write_stage(references(rows, common), "quality-references")
    named = rows.join(_sent(refs), F.col("lang").eqNullSafe(F.col("ref")), "left")
    far = named.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        divergence(shares(F.col("classes")), F.col("ref_classes")).alias("character_distance"),
        divergence(shares(F.col("word_counts")), F.col("ref_words")).alias("word_distance"),
    )
    short = F.col("n_words") < guard_words
    within = (F.col("character_distance") <= character_limit) & (F.col("word_distance") <= word_limit)
    return far.withColumn("kept", ~F.col("base_failed") & (short | within))
