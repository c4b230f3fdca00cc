"""Small column helpers used by all text rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(table: Mapping[str, object]) -> Column:
    """A small constant map, written as one SQL literal to keep the expression tree short."""

    def quote(v: object) -> str:
        if v is None:
            return "null"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(quote(x) for pair in table.items() for x in pair) + ")")


def text_map(table: Mapping[str, str]) -> Column:
    """A large constant map of texts. It is one string in the plan, which the optimizer folds into a map literal."""
    pair, entry = "\u0003", "\u0004"
    return F.str_to_map(F.lit(entry.join(f"{k}{pair}{v}" for k, v in table.items())), F.lit(entry), F.lit(pair))


def each(rows: DataFrame, keep: Sequence[str], values: Column, number: str, value: str) -> DataFrame:
    """One row per array element with its place from 0.

    As an inner explode the optimizer would first filter by the size of the array, and so compute the array twice.
    """
    return rows.select(*keep, F.posexplode_outer(values).alias(number, value)).where(F.col(number).isNotNull())


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def strip(c: Column, chars: str = r"\s ") -> Column:
    """Remove a character class at both ends."""
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def casefold(c: Column) -> Column:
    """Lower case with the one full folding that matters in German text."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null instead of the empty string."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def running_sums(values: Column) -> Column:
    """For each element the sum up to it, by blocks of about the square root of the size."""

    def by_blocks(width: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / width).cast("int") - 1), lambda b: F.slice(values, b * width + 1, width))
        add = lambda x, y: x + y

        def inside(block: Column, before: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(block)), lambda i: F.aggregate(F.slice(block, 1, i), before, add))

        def flat(blocks: Column) -> Column:
            sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), add))
            return let(sums, lambda s: F.flatten(F.transform(blocks, lambda x, b: let(F.aggregate(F.slice(s, 1, b), F.lit(0), add), lambda before: inside(x, before)))))

        return let(cut, flat)

    return F.when(F.size(values) > 0, let(F.ceil(F.sqrt(F.size(values))).cast("int"), by_blocks)).otherwise(values)


def spans(text: Column, pattern: str) -> Column:
    """All matches with character offsets: array<struct<start, end, raw>>.

    Spark returns match texts only, so matches are marked with two control characters, the text is
    split there, and running lengths give the offsets. Those characters in the text become spaces.
    """

    def placed(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p, i: F.when(i == 0, F.length(p)).otherwise(F.length(p) - 1))

        def hits(starts: Column) -> Column:
            def hit(piece: Column, i: Column) -> Column:
                raw = F.substring_index(piece, CLOSE, 1)
                start = F.get(starts, i)
                return F.struct(start.alias("start"), (start + F.length(raw)).alias("end"), raw.alias("raw"))

            return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), hit)

        return let(running_sums(lengths), hits)

    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, "  "), F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))
    return let(F.split(marked, OPEN), placed)


def left_of(text: Column, start: Column, width: int) -> Column:
    """Up to ``width`` characters that end at ``start``."""
    return F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))


def right_of(text: Column, end: Column, width: int) -> Column:
    """Up to ``width`` characters that begin at ``end``."""
    return F.substring(text, end + 1, F.lit(width))


def tail(text: Column, width: int) -> Column:
    return F.right(text, F.lit(width))


def request_key(**parts: Column) -> Column:
    """Stable key of a request: hash of its parameters as JSON in name order."""
    return F.sha1(F.to_json(F.struct(*[parts[name].alias(name) for name in sorted(parts)])))
