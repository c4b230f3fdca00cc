"""Personal data: fixed kinds by pattern, and terms that disclose them by corpus co-occurrence.

Fixed kinds are e-mail addresses, internet addresses, card numbers and phone numbers; their values are the protected
entities. A term is a word that stands within ``CONTEXT`` characters of an entity. Over the whole corpus it is counted
in how many documents the term occurs, in how many it stands beside the entity, and in how many different
surroundings. A term discloses an entity if, among the documents that have the term, the share p(entity | term) is
at least ``DISCLOSURE``, the pointwise information log2 p(entity | term) / p(entity) is at least ``BITS``, and the
surroundings number at least ``SURROUNDINGS`` (copies of one text are one surrounding). Such terms become further
spans wherever they occur; they are removed where the share is ``REMOVAL`` or more, else generalised.

Every step is a DataFrame expression. Offsets come from the pieces between matches, added up in blocks, so a text
with very many matches costs little more than its length. Lists of terms are sent to all executors only after they
have been counted (``SENT_ROWS``); beyond that the same joins are shuffles.

Defined results: null and empty texts have no spans; overlapping spans are all listed, and sanitising replaces from
the left whatever does not overlap a span before it; rows that repeat an id are each searched; other columns pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions.text import let
from firmatlas.llm.common import whole
from firmatlas.session import write_stage

CONTEXT, DISCLOSURE, REMOVAL, BITS, SURROUNDINGS = 60, 0.5, 0.9, 3.0, 3
SENT_ROWS = 500_000
# fixed values: the four patterns. A match begins where a run of its characters begins, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "term removed": ""}
_SPAN = "array<struct<start:int,kind:int,end:int,raw:string>>"
_WORD = r"\p{L}{3,}"


def scan(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array, by blocks of about the square root of its size."""

    def blocks(width: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / width).cast("int") - 1), lambda b: F.slice(values, b * width + 1, width))
        return let(cut, lambda parts: let(F.transform(parts, lambda p: F.aggregate(p, zero, merge)), lambda sums: F.flatten(F.transform(parts, lambda p, b: inside(p, F.aggregate(F.slice(sums, 1, b), zero, merge))))))

    def inside(part: Column, before: Column) -> Column:
        return let(before, lambda start: F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.aggregate(F.slice(part, 1, i), start, merge)))

    return F.when(F.size(values) > 0, let(F.ceil(F.sqrt(F.size(values))).cast("int"), blocks)).otherwise(F.slice(values, 1, 0))


def matches(text: Column, pattern: str | Column, kind: str) -> Column:
    """array<struct<start, kind, end, raw>>: matches from the left with offsets in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def located(raw: Column) -> Column:
        def placed(pieces: Column) -> Column:
            steps = F.transform(raw, lambda m, i: F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(raw, i - 1)), F.lit(0)))
            starts = scan(steps, F.lit(0), lambda a, x: a + x)
            made = lambda m, s: F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s + F.length(m)).alias("end"), m.alias("raw"))
            return F.zip_with(raw, starts, made)

        return F.when(F.size(raw) > 0, let(F.split(text, pattern, -1), placed)).otherwise(F.expr(f"cast(array() as {_SPAN})"))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), located)


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Valid matches of the four fixed kinds, kind by kind."""
    none = F.expr(f"cast(array() as {_SPAN})")
    byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    found = {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, PATTERNS["email"], "email")),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, PATTERNS["ip"], "ip"), lambda m: m["raw"].rlike(rf"^{byte}(?:\.{byte}){{3}}$"))),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(matches(text, PATTERNS["card"], "card"), lambda m: let(digits(m["raw"]), lambda d: F.length(d).between(12, 19) & luhn(d)))),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(matches(text, PATTERNS["phone"], "phone"), lambda m: F.length(digits(m["raw"])).between(9, 15))),
    }
    return F.concat(*[F.coalesce(c, none) for c in found.values()])


def entity(span: Column) -> Column:
    """The protected value of a span: kind and normal form, hashed."""
    plain = F.when(span["kind"] >= KINDS.index("card"), digits(span["raw"])).otherwise(F.lower(span["raw"]))
    return F.xxhash64(span["kind"], plain)


def _joined_small(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a staged table that is sent to all executors only if it has few rows."""
    return left.join(F.broadcast(right) if right.count() <= SENT_ROWS else right, on, how)


def words_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, share: words that disclose an entity; ``docs`` has text and base."""
    text = F.col("text")

    def beside(span: Column) -> Column:
        left = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
        around = F.concat(left, F.lit(" "), F.substring(text, span["end"] + 1, F.lit(CONTEXT)))
        told = F.struct(entity(span).alias("entity"), F.xxhash64(F.lower(around)).alias("surrounding"), words_in(around).alias("words"))
        return let(told, lambda t: F.transform(t["words"], lambda w: F.struct(t["entity"].alias("entity"), w.alias("term"), t["surrounding"].alias("surrounding"))))

    seen = docs.where(F.size("base") > 0).withColumn("near", F.array_distinct(F.flatten(F.transform("base", beside))))
    # a pair counts once in a document, however often it stands there
    once = F.array_distinct(F.transform("near", lambda n: F.struct(n["entity"].alias("entity"), n["term"].alias("term"))))
    together = seen.select(F.explode(once).alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("together"))
    places = seen.select(F.explode("near").alias("p")).groupBy("p.entity", "p.term", "p.surrounding").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("surroundings"))
    pairs = together.join(places.where(F.col("surroundings") >= SURROUNDINGS), ["entity", "term"])
    held = docs.select(F.explode(words_in(text)).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    entities = seen.select(F.explode(F.array_distinct(F.transform("base", entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    total = docs.agg(F.count("*").alias("n")).first()["n"]
    told = pairs.join(held, "term").join(entities, "entity")
    share = F.col("together") / F.col("with_term")
    told = told.withColumn("share", share).where((share >= DISCLOSURE) & (F.log2(share * F.lit(float(max(total, 1))) / F.col("with_entity")) >= BITS))
    return told.groupBy("term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with all spans of each text in order: array<struct<start, kind, end, raw, removed>>."""
    read = docs.withColumn("_text", whole(text)).withColumn("_base", base_spans(F.col("_text")))
    terms = write_stage(disclosing_terms(read.select(F.col("_text").alias("text"), F.col("_base").alias("base"))), "privacy-disclosing")
    words = read.select(F.xxhash64("_text").alias("_copy"), F.explode(words_in(F.col("_text"))).alias("term"))
    # a text holds no more different terms than words
    held = _joined_small(words, terms, "term").groupBy("_copy").agg(F.collect_set("term").alias("_terms"), F.collect_set(F.when(F.col("share") >= REMOVAL, F.col("term"))).alias("_removed"))
    held = write_stage(held, "privacy-documents")
    near = _joined_small(read.withColumn("_copy", F.xxhash64("_text")), held, "_copy", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_terms", "|"), F.lit(r")(?!\p{L})"))
    more = F.when(F.size("_terms") > 0, matches(F.col("_text"), pattern, "term")).otherwise(F.expr(f"cast(array() as {_SPAN})"))
    marked = F.transform(F.concat("_base", more), lambda s: F.struct(s["start"], s["kind"], s["end"], s["raw"], F.coalesce(F.array_contains("_removed", F.lower(s["raw"])), F.lit(False)).alias("removed")))
    kept = [c for c in docs.columns if c != out]
    return near.select(*kept, F.sort_array(marked).alias(out))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its mask; a span that overlaps one before it is part of that one."""

    def tag(s: Column) -> Column:
        made = F.when(s["removed"], MASKS["term removed"])
        for i, kind in enumerate(KINDS):
            made = made.when(s["kind"] == i, MASKS[kind])
        return made

    def cut(reach: Column) -> Column:
        # a span opens a replacement if nothing before it reaches its start
        opened = F.filter(F.transform(spans, lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("before"))), lambda x: x["s"]["start"] >= x["before"])
        pieces = F.transform(opened, lambda x: F.concat(F.substring(text, x["before"] + 1, x["s"]["start"] - x["before"]), tag(x["s"])))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    return F.when(F.size(spans) > 0, let(scan(ends, F.lit(0), lambda a, x: F.greatest(a, x)), cut)).otherwise(text)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
