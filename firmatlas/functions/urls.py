"""URL and domain expressions. Hosts come from a pattern, since Spark's URL parser rejects umlaut hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmatlas.functions.text import first_group, let, strip
from firmatlas.rules import vocab

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def with_scheme(url: Column, scheme: str = "http") -> Column:
    return let(
        url, lambda u: F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit(f"{scheme}://"), u))
    )


def host(url: Column) -> Column:
    """Lower-case host without port and credentials, null when there is none."""
    return F.lower(first_group(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def registrable_domain(url: Column, suffixes: Sequence[str] = vocab.TWO_LEVEL_SUFFIXES) -> Column:
    """Domain under its public suffix, else the host without ``www.``, else null."""
    value = F.lower(strip(url))

    def pick(h: Column) -> Column:
        labels = F.split(h, r"\.")
        pair = F.substring_index(h, ".", -2)
        triple = F.substring_index(h, ".", -3)
        top = F.substring_index(h, ".", -1)
        named = top.rlike(r"^\p{L}{2,}$") & ~top.isin(*vocab.RESERVED_TLDS)
        bare = F.regexp_replace(h, r"^www\.", "")
        return (
            F.when(pair.isin(*suffixes), F.when(F.size(labels) >= 3, triple).otherwise(bare))
            .when(named & (F.size(labels) >= 2), pair)
            .otherwise(bare)
        )

    return F.nullif(let(host(with_scheme(value)), pick), F.lit(""))


def page_key(url: Column) -> Column:
    """Identity of a page: scheme, ``www.``, trailing slash and fragment do not count."""
    h = F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))
    p = F.coalesce(F.nullif(F.regexp_replace(path(url), r"/+$", ""), F.lit("")), F.lit("/"))
    q = F.concat(F.lit("?"), F.nullif(query(url), F.lit("")))
    return F.when(url.isNotNull(), F.concat(h, p, F.coalesce(q, F.lit(""))))


def start_url(website: Column) -> Column:
    """Address to begin with: https by default, lower-case scheme and host, path never empty."""

    def build(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([^:]*)://", 1))
        netloc = F.lower(F.regexp_extract(u, r"^[^:]*://([^/?#]*)", 1))
        p = F.coalesce(F.nullif(path(u), F.lit("")), F.lit("/"))
        q = F.concat(F.lit("?"), F.nullif(query(u), F.lit("")))
        return F.concat(scheme, F.lit("://"), netloc, p, F.coalesce(q, F.lit("")))

    return let(
        strip(website), lambda site: F.when(site == "", site).otherwise(let(with_scheme(site, "https"), build))
    )


def http_fallback(start: Column) -> Column:
    """Plain-http twin of an https start address, else null."""
    return F.when(start.startswith("https://"), F.regexp_replace(start, r"^https://", "http://"))


def is_social(url: Column) -> Column:
    """Social network by whole domain, so hosts that merely end in the same letters do not count."""
    named = "|".join(d.replace(".", r"\.") for d in vocab.SOCIAL_DOMAINS)
    return F.coalesce(host(url), F.lit("")).rlike(rf"(?:^|\.)(?:(?:{named})|pinterest\.[a-z.]+)$")


def link_kind(href: Column, base_domain: Column, suffixes: Sequence[str] = vocab.TWO_LEVEL_SUFFIXES) -> Column:
    """tel, mailto, whatsapp, vcard, internal, social, external or other - first rule wins."""

    def rules(low: Column) -> Column:
        return (
            F.when(low.rlike(r"^(?:tel|callto):"), "tel")
            .when(low.startswith("mailto:"), "mailto")
            .when(low.rlike(r"wa\.me/|whatsapp\.com|^whatsapp:"), "whatsapp")
            .when(low.rlike(r"^(?:javascript:|#|data:)|^(?:/#)?$"), "other")
            .when(path(low).endswith(".vcf"), "vcard")
            .when(~low.rlike(_SCHEME) & ~low.startswith("//"), "internal")
            .when(is_social(low), "social")
            .when(registrable_domain(low, suffixes) == base_domain, "internal")
            .otherwise("external")
        )

    return let(F.lower(href), rules)


def page_kind(url: Column, anchor: Column | None = None) -> Column:
    """struct<priority, kind> by the first matching rule; foreign-language paths rank one lower."""
    p = F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/"))
    text = F.concat(p, F.lit(" "), F.coalesce(anchor, F.lit("")) if anchor is not None else F.lit(""))

    def first_rule(t: Column) -> Column:
        none = len(vocab.PAGE_KIND_RULES)
        number = F.lit(none)
        for i, rule in reversed(list(enumerate(vocab.PAGE_KIND_RULES))):
            number = F.when(t.rlike(vocab.any_of(rule.words)), F.lit(i)).otherwise(number)
        late = F.when(t.rlike(vocab.FOREIGN_PATH.replace("(?:/|$)", "[/ ]")), 1).otherwise(0)

        def read(n: Column) -> Column:
            rank = F.element_at(F.array(*[F.lit(r.priority) for r in vocab.PAGE_KIND_RULES], F.lit(9)), n + 1)
            kind = F.element_at(F.array(*[F.lit(r.kind) for r in vocab.PAGE_KIND_RULES], F.lit("sonstige")), n + 1)
            return F.struct(
                F.when(n == none, rank).otherwise(rank + late).cast("int").alias("priority"), kind.alias("kind")
            )

        return let(number, read)

    return let(text, first_rule)


def is_skipped_link(url: Column, priority: Column) -> Column:
    """Binary and feed files, shop and search paths, and query pages of low priority."""
    q = query(url)
    target = F.concat(path(url), F.lit("?"), q)
    return url.rlike(vocab.SKIP_EXTENSION) | target.rlike(vocab.SKIP_PATH) | ((q != "") & (priority > 3))


def is_person_path(url: Column) -> Column:
    return path(url).rlike(vocab.PERSON_PATH)


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a link without its fragment; dot segments are folded."""

    def join(h: Column) -> Column:
        origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
        return (
            F.when(h.rlike(_SCHEME), h)
            .when(h == "", F.regexp_replace(base, r"#.*$", ""))
            .when(h.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), h))
            .otherwise(F.concat(origin, F.coalesce(first_group(path(base), r"^(.*/)"), F.lit("/")), h))
        )

    def fold(joined: Column) -> Column:
        origin = F.regexp_extract(joined, r"^([^:/?#]+://[^/?#]*)", 1)
        segments = F.split(F.regexp_extract(joined, r"^[^:/?#]+://[^/?#]*/([^?#]*)", 1), "/")
        rest = F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)

        def step(done: Column, segment: Column) -> Column:
            up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
            return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.array_append(done, segment))

        # an address that ends in a dot segment names a folder
        ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
        folded = F.aggregate(ended, F.expr("cast(array() as array<string>)"), step)
        whole = F.concat(origin, F.lit("/"), F.array_join(folded, "/"), rest)
        return F.when(joined.rlike(r"^[^:/?#]+://[^/?#]*(?:/[^?#]*)?/\.\.?(?:[/?#]|$)"), whole).otherwise(joined)

    return let(let(F.regexp_replace(strip(href), r"#.*$", ""), join), fold)


def whatsapp_number(href: Column) -> Column:
    """Number of a chat link, with a leading plus; null for message links and short numbers."""

    def read(u: Column) -> Column:
        low = F.lower(u)
        segment = F.regexp_extract(path(u), r"^/*([^/]*)", 1)
        short = F.when(F.lower(segment) == "message", F.lit("")).otherwise(segment)
        raw = (
            F.when(F.contains(low, F.lit("wa.me")), short)
            .when(F.contains(low, F.lit("whatsapp")), F.regexp_extract(u, r"[?&]phone=([^&#]*)", 1))
            .otherwise(F.lit(""))
        )
        return F.regexp_replace(raw, r"\D", "")

    decoded = let(
        strip(href), lambda h: F.coalesce(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h)
    )
    return let(let(decoded, read), lambda d: F.when(F.length(d) >= 8, F.concat(F.lit("+"), d)))


def href_number(href: Column) -> Column:
    """Digits (and plus) of a tel, callto or chat link, for the visible text of its line."""

    def read(low: Column) -> Column:
        dialled = F.replace(F.regexp_extract(low, r"^(?:tel|callto):(.*)$", 1), F.lit("%20"), F.lit(""))
        tel = F.regexp_replace(F.regexp_replace(dialled, r"[^\d+]", ""), r"^00", "+")
        chat = F.regexp_extract(low, r"(?:wa\.me/|[?&]phone=(?:%2b|\+)?)(\d{8,15})", 1)
        return F.when(low.rlike(r"^(?:tel|callto):"), first_group(tel, r"^(\+*(?:\d\+*){7,})$")).otherwise(
            F.concat(F.lit("+"), F.nullif(chat, F.lit("")))
        )

    return let(F.lower(strip(href)), read)


def protected_email(code: Column) -> Column:
    """Decode a hex string whose first byte is XORed over the rest; null when invalid."""

    def decode(h: Column) -> Column:
        key = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
        at = F.sequence(F.lit(2), (F.length(h) / 2).cast("int"))
        plain = F.transform(
            at,
            lambda i: F.lpad(
                F.hex(F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)), 2, "0"
            ),
        )
        return F.try_validate_utf8(F.unhex(F.array_join(plain, "")).cast("string"))

    h = F.lower(strip(code))
    ok = h.rlike(r"^(?:[0-9a-f]{2}){2,}$")
    # the guarded value keeps the decoder from seeing text it would reject under ANSI rules
    return F.when(ok, let(F.when(ok, h).otherwise(F.lit("0000")), decode))


def file_stem(name: Column) -> Column:
    return F.left(F.regexp_replace(name, r"[^\p{L}\p{N}_\-]", "_"), F.lit(60))
