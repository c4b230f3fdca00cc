"""Company-level lookups as expressions: state, chain exclusion, funding band and pitch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmatlas.functions.text import let, lookup
from firmatlas.rules import dims


def state_of_plz(plz: Column, ranges: Sequence[tuple[int, int, str]] = dims.PLZ_RANGES) -> Column:
    """State of the two-digit zone: an array indexed by the zone, so no join and no range search."""
    table: list[str | None] = [None] * 100
    for lo, hi, state in ranges:
        table[lo : hi + 1] = [state] * (hi - lo + 1)
    zone = F.regexp_extract(plz, r"^(\d\d)", 1).try_cast("int")
    listed = F.split(F.lit("|".join(s or "" for s in table)), r"\|")
    return F.nullif(F.get(listed, zone), F.lit(""))


def normalize_state(
    name: Column, states: Sequence[str] = dims.STATES, aliases: Mapping[str, str] = dims.STATE_ALIASES
) -> Column:
    table = {**{s.lower(): s for s in states}, **aliases}
    return F.try_element_at(lookup(table), F.lower(F.trim(name)))


def exclusion_reason(
    domain: Column, name: Column, domains: Sequence[str] = dims.CHAIN_DOMAINS, names: Sequence[str] = dims.CHAIN_NAMES
) -> Column:
    """Why a company counts as chain or portal: its domain, else the first name rule; null if it does not."""
    low = F.lower(name)
    by_name = F.lit(None).cast("string")
    for rule in reversed(names):
        text = f"Kette/Franchise (Name „{rule.lower().strip()}“)"
        by_name = F.when(F.contains(low, F.lit(rule.lower())), F.lit(text)).otherwise(by_name)
    by_domain = F.concat(F.lit("Kette/Franchise (Domain "), domain, F.lit(")"))
    return F.when(domain.isin(*domains), by_domain).otherwise(by_name)


def size_band(n: Column, bands: Sequence[dims.Band] = dims.BANDS) -> Column:
    """struct<band, lo, hi, cost_pct, wage_pct> for a headcount, null outside all bands."""
    out = F.lit(None).cast("struct<band:string,lo:int,hi:int,cost_pct:int,wage_pct:int>")
    for b in reversed(bands):
        row = F.struct(*[F.lit(v).cast("int" if k != "band" else "string").alias(k) for k, v in b._asdict().items()])
        fits = (n >= b.lo) & (n >= 0) if b.hi is None else n.between(b.lo, b.hi) & (n >= 0)
        out = F.when(fits, row).otherwise(out)
    return out


def headcount_for_band(size: Column) -> Column:
    """Careful headcount: the point only at high confidence, else the upper end."""
    return F.when(size["confidence"] == "high", F.coalesce(size["point"], size["hi"])).otherwise(
        F.coalesce(size["hi"], size["point"])
    )


def programme_of(state: Column, programmes: Sequence[dims.Programme] = dims.PROGRAMMES) -> Column:
    out = F.lit(None).cast("struct<programme:string,note:string,url:string>")
    for p in reversed(programmes):
        row = F.struct(F.lit(p.programme).alias("programme"), F.lit(p.note).alias("note"), F.lit(p.url).alias("url"))
        out = F.when(state == p.state, row).otherwise(out)
    return out


def funding(size: Column, state: Column) -> Column:
    """struct<band, cost_pct, wage_pct, programme, programme_url, programme_note, pitch>."""

    def build(s: Column) -> Column:
        band, prog = s["band"], s["prog"]
        text = lambda c: c.cast("string")
        people = (
            F.when((band["lo"] == 0) & band["hi"].isNotNull(), F.concat(F.lit("Bei unter "), text(band["hi"] + 1)))
            .when(band["hi"].isNull(), F.concat(F.lit("Ab "), text(band["lo"])))
            .otherwise(F.concat(F.lit("Bei "), text(band["lo"]), F.lit(" bis "), text(band["hi"])))
        )
        known = F.concat(
            people, F.lit(" Beschäftigten übernimmt die Agentur für Arbeit bis zu "), text(band["cost_pct"]),
            F.lit(" % der Lehrgangskosten und bis zu "), text(band["wage_pct"]),
            F.lit(f" % des Arbeitsentgelts während der Weiterbildung ({dims.FUNDING_LAW})."),
            F.coalesce(
                F.concat(F.lit(" In "), state, F.lit(" zusätzlich: "), prog["programme"], F.lit(" ("), prog["note"], F.lit(").")),
                F.lit(""),
            ),
            F.when(size["confidence"].isin("low", "none"), " Beschäftigtenzahl im Gespräch verifizieren.").otherwise(""),
        )
        general = F.concat(
            F.lit(
                "Die Agentur für Arbeit fördert Weiterbildung Beschäftigter nach § 82 SGB III – bei kleinen Betrieben "
                "bis zu 100 % der Lehrgangskosten. Die genaue Quote hängt von der Beschäftigtenzahl ab."
            ),
            F.coalesce(F.concat(F.lit(" Zusätzlich in "), state, F.lit(": "), prog["programme"], F.lit(".")), F.lit("")),
        )
        return F.struct(
            band["band"].alias("band"), band["cost_pct"].alias("cost_pct"), band["wage_pct"].alias("wage_pct"),
            prog["programme"].alias("programme"), prog["url"].alias("programme_url"), prog["note"].alias("programme_note"),
            F.when(band.isNotNull(), known).otherwise(general).alias("pitch"),
        )

    return let(
        F.struct(size_band(headcount_for_band(size)).alias("band"), programme_of(state).alias("prog")), build
    )


def in_range(size: Column, lo: Column, hi: Column) -> Column:
    """True, false or null (unknown) whether an estimate meets the wanted range; null bounds do not count."""
    low, high = F.coalesce(size["lo"], size["point"]), F.coalesce(size["hi"], size["point"])
    return F.when(low.isNull() | high.isNull(), F.lit(None).cast("boolean")).otherwise(
        ~(F.coalesce(high < lo, F.lit(False)) | F.coalesce(low > hi, F.lit(False)))
    )
