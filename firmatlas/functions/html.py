"""HTML to text and links as one chain of column expressions per page, without a DOM and without shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmatlas.functions import urls
from firmatlas.functions.text import CLOSE, OPEN, let, strip, text_map
from firmatlas.rules import vocab

_NUMBER_LINK = r"(?i)<a\b[^>]*href\s*=\s*[\"']?\s*(?:tel:|callto:|whatsapp:|https?://[^\"'>]*(?:wa\.me/|phone=))"


# named character references, from the standard table; those of the first HTML versions come first, as a lookup reads in order
NAMED = {name: html5[f"{name};"] for name in ("amp", "nbsp", "quot", *name2codepoint)} | {
    name[:-1]: value for name, value in html5.items() if name.endswith(";")
}


def drop_opaque(html: Column) -> Column:
    """Remove comments and elements whose content is not shown."""
    out = F.regexp_replace(html, rf"[{OPEN}{CLOSE}]", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    *inner, head = vocab.OPAQUE_TAGS
    for group in (inner[:2], inner[2:], [head]):
        out = F.regexp_replace(out, rf"(?is)<({'|'.join(group)})\b[^>]*>.*?</\1\s*>", "")
    return out


def _attribute(tag: Column, name: str) -> Column:
    """Raw value of one attribute, empty when missing."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(found, r"^[\"']|[\"']$", "")


def show_link_numbers(html: Column) -> Column:
    """Append the number of a call link to its anchor text when that text holds no digit."""

    def piece(p: Column) -> Column:
        tag = F.regexp_extract(p, r"(?is)^(<a\b[^>]*>)", 1)
        inner = F.regexp_extract(p, r"(?is)^<a\b[^>]*>(.*?)</a\s*>", 1)
        number = urls.href_number(unescape(_attribute(tag, "href")))
        head = F.length(tag) + F.length(inner)
        open_end = ~p.rlike(r"(?is)^<a\b[^>]*>.*?</a\s*>")
        shown = F.regexp_replace(inner, r"<[^>]*>", "").rlike(r"\d")
        added = F.concat(F.substring(p, F.lit(1), head), F.lit(" "), number, F.substring(p, head + 1, F.length(p)))
        return F.when(~p.rlike(_NUMBER_LINK) | open_end | shown, p).otherwise(F.coalesce(added, p))

    def rewrite(h: Column) -> Column:
        pieces = F.split(F.regexp_replace(h, r"(?i)(<a\b)", f"{OPEN}$1"), OPEN)
        return F.when(h.rlike(_NUMBER_LINK), F.array_join(F.transform(pieces, piece), "")).otherwise(h)

    return let(html, rewrite)


def _unescape_once(text: Column) -> Column:
    named = text_map(NAMED)

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, r"^(?:#\d{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)", 0)

        def decode(r: Column) -> Column:
            digits = F.regexp_replace(r, r"^#[xX]?|;$", "")
            base = F.when(r.rlike(r"^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))

            def char(code: Column) -> Column:
                good = code.between(32, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
                return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

            symbol = F.when(r.startswith("#"), let(base.cast("long"), char)).otherwise(
                F.try_element_at(named, F.regexp_replace(r, ";$", ""))
            )
            return F.coalesce(F.concat(symbol, F.substring(p, F.length(r) + 1, F.length(p))), F.concat(F.lit("&"), p))

        return let(ref, decode)

    def rebuild(a: Column) -> Column:
        rest = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
        return F.concat(F.element_at(a, 1), F.array_join(F.transform(rest, piece), ""))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), rebuild)).otherwise(text)


def unescape(text: Column) -> Column:
    """Named and numeric entities; a second pass resolves doubly escaped ones."""
    return let(let(text, _unescape_once), _unescape_once)


def tidy(raw: Column) -> Column:
    """Collapse spaces, cell separators and blank lines; trim every line."""
    out = F.replace(raw, F.lit("\t"), F.lit(" · "))
    out = F.regexp_replace(out, r"[\r\f\x0B  ]+", " ")
    out = F.regexp_replace(out, r"(?: *· *)+", " · ")
    out = F.regexp_replace(out, r"(?m)^[ ·]+|[ ·]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n"), r"^\n+|\n+$", "")


def strip_markup(body: Column) -> Column:
    """Tags to line breaks, cell separators or nothing."""
    out = F.regexp_replace(body, rf"(?i)</?(?:br|{'|'.join(vocab.BLOCK_TAGS)})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(?:td|th)\b[^>]*>", "\t")
    out = F.regexp_replace(out, r"(?i)</?a\b[^>]*>", " ")
    return F.regexp_replace(out, r"<[/!?A-Za-z][^>]*>", "")


def visible_text(html: Column) -> Column:
    return F.coalesce(tidy(unescape(strip_markup(show_link_numbers(drop_opaque(html))))), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def attributes(tag: Column) -> Column:
    """map<name, value> of a tag without href; the first of repeated names wins."""
    inside = F.regexp_replace(tag, r"(?s)^<\s*[A-Za-z0-9]+|/?>$", "")
    found = F.regexp_extract_all(
        inside, F.lit(r"([A-Za-z_:][-A-Za-z0-9_:.]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)"), F.lit(1)
    )
    pairs = F.transform(
        found,
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, r"^([-A-Za-z0-9_:.]+)", 1)).alias("key"),
            unescape(F.regexp_replace(F.regexp_extract(x, r"(?s)=\s*(.*)$", 1), r"^[\"']|[\"']$", "")).alias("value"),
        ),
    )

    def first_only(a: Column) -> Column:
        names = F.transform(a, lambda e: e["key"])
        return F.map_from_entries(
            F.filter(a, lambda e, i: (e["key"] != "href") & (F.array_position(names, e["key"]) == i + 1))
        )

    return let(pairs, first_only)


def links_of(
    html: Column, url: Column, suffixes: Sequence[str] = vocab.TWO_LEVEL_SUFFIXES
) -> Column:
    """array<struct<href, text, kind, attrs>> of all links and protected addresses, in page order."""
    body = drop_opaque(html)
    marked = F.regexp_replace(
        body, r"(?i)(<a\b[^>]*\shref\s*=|<[a-z][a-z0-9]*\b[^>]*\sdata-cfemail\s*=)", f"{OPEN}$1"
    )

    def read(p: Column) -> Column:
        return let(F.regexp_extract(p, r"(?s)^(<[^>]*>)", 1), lambda tag: parts(p, tag))

    def parts(p: Column, tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"^<([A-Za-z0-9]+)", 1))
        rest = F.substring(p, F.length(tag) + 1, F.length(p))
        inner = F.when(name == "a", F.regexp_extract(rest, r"(?is)^(.*?)(?:</a\s*>|<a\b|$)", 1)).otherwise(
            F.regexp_extract(rest, r"(?is)^([^<]*)", 1)
        )
        mail = urls.protected_email(_attribute(tag, "data-cfemail"))
        raw = strip(unescape(_attribute(tag, "href")))
        return F.struct(
            F.coalesce(F.concat(F.lit("mailto:"), mail), raw).alias("raw"),
            strip(F.regexp_replace(unescape(F.regexp_replace(inner, r"<[^>]*>", " ")), r"[\s ]+", " ")).alias("text"),
            attributes(tag).alias("attrs"),
        )

    def named(x: Column, kind: Column) -> Column:
        absolute = kind.isin("internal", "external", "vcard", "social")
        href = F.when(absolute, urls.resolve(url, x["raw"])).otherwise(x["raw"])
        lost = (kind == "vcard") & ~F.contains(F.lower(x["raw"]), F.lit(".vcf"))
        return F.struct(
            href.alias("href"),
            x["text"].alias("text"),
            F.when(lost, "internal").otherwise(kind).alias("kind"),
            x["attrs"].alias("attrs"),
        )

    def collect(base_domain: Column) -> Column:
        found = let(
            F.split(marked, OPEN),
            lambda a: F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), read),
        )
        finish = lambda x: let(
            urls.link_kind(x["raw"], base_domain, suffixes), lambda kind: named(x, kind)
        )
        return F.transform(F.filter(found, lambda x: x["raw"] != ""), finish)

    return let(urls.registrable_domain(url, suffixes), collect)
