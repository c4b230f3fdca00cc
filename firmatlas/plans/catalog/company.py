"""Queries over company rows that Spark derives from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmatlas.functions import company as CO
from firmatlas.functions import headcount as HC
from firmatlas.functions import legal as L
from firmatlas.functions import phone as P
from firmatlas.functions import urls
from firmatlas.operators import contacts as C
from firmatlas.operators import guard as G
from firmatlas.operators import score as S
from firmatlas.operators import vcards as V
from firmatlas.operators.resolve import dedupe_companies
from firmatlas.plans.catalog.base import query, table
from firmatlas.rules import dims
from firmatlas.session import checkpoint_dir
from firmatlas.sources import readers as R

_ZONES = " ".join(f"when z between {lo} and {hi} then '{state}'" for lo, hi, state in dims.PLZ_RANGES)


def _customers(spark, sf):
    return table(spark, sf, "customer")


@query("postal_range_state", f"""
with p as (select c_custkey, lpad(cast(c_custkey * 37 % 100000 as varchar), 5, '0') as plz from customer)
select c_custkey, plz, case {_ZONES} end as state from (select *, cast(substr(plz, 1, 2) as integer) as z from p)""")
def postal_range_state(spark, sf):
    plz = F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0")
    rows = _customers(spark, sf).select("c_custkey", plz.alias("plz"))
    return rows.withColumn("state", CO.state_of_plz(F.col("plz")))


_NAMES = [*dims.STATES, *dims.STATE_ALIASES, "Tirol", ""]
_SQL_NAMES = ", ".join(f"'{n}'" for n in _NAMES)
_SQL_STATES = " ".join(f"when '{k}' then '{v}'" for k, v in {**{s.lower(): s for s in dims.STATES}, **dims.STATE_ALIASES}.items())


@query("state_alias", f"""
with n as (select c_custkey, '  ' || upper([{_SQL_NAMES}][c_custkey % {len(_NAMES)} + 1]) || ' ' as raw from customer)
select case lower(trim(raw)) {_SQL_STATES} end as state, count(*) as n, min(c_custkey) as first_key from n group by 1""")
def state_alias(spark, sf):
    listed = F.array(*[F.lit(n) for n in _NAMES])
    raw = F.concat(F.lit("  "), F.upper(F.element_at(listed, (F.col("c_custkey") % len(_NAMES)).cast("int") + 1)), F.lit(" "))
    rows = _customers(spark, sf).select("c_custkey", CO.normalize_state(raw).alias("state"))
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


_STAFF = "staff as (select c_custkey, count(o_orderkey) * (c_custkey % 40) as n from customer left join orders on o_custkey = c_custkey group by 1)"
_SIZE = """size as (select c_custkey, n, case when c_custkey % 5 = 0 then null else n end as point, case when c_custkey % 7 = 0 then null else n + 10 end as hi,
   case c_custkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'none' end as confidence from staff),
 est as (select *, case when confidence = 'high' then coalesce(point, hi) else coalesce(hi, point) end as e from size)"""
_BAND = "case when e between 0 and 49 then '<50' when e between 50 and 499 then '50-499' when e >= 500 then '>=500' end"


def _staffed(spark, sf):
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    k = F.col("c_custkey")
    rows = _customers(spark, sf).join(per, "c_custkey", "left").withColumn("n", F.coalesce("orders", F.lit(0)) * (k % 40))
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("none")), (k % 4).cast("int") + 1)
    size = F.struct(
        F.col("n").cast("int").alias("lo"), F.when(k % 7 != 0, F.col("n") + 10).cast("int").alias("hi"),
        F.when(k % 5 != 0, F.col("n")).cast("int").alias("point"), level.alias("confidence"),
    )
    return rows.withColumn("size", size)


@query("headcount_band", f"with {_STAFF}, {_SIZE} select {_BAND} as band, count(*) as n, max(e) as largest from est group by 1")
def headcount_band(spark, sf):
    rows = _staffed(spark, sf).select(CO.headcount_for_band(F.col("size")).alias("e"))
    return rows.groupBy(CO.size_band(F.col("e"))["band"].alias("band")).agg(F.count("*").alias("n"), F.max("e").cast("bigint").alias("largest"))


_PROGRAMME = " ".join(f"when '{p.state}' then '{p.programme}'" for p in dims.PROGRAMMES)
_NOTE = " ".join(f"when '{p.state}' then '{p.note}'" for p in dims.PROGRAMMES)


@query("funding_assessment", f"""
with {_STAFF}, {_SIZE}, s as (select *, {_BAND} as band, [{', '.join(f"'{s}'" for s in dims.STATES)}][c_custkey % 16 + 1] as state from est),
 p as (select *, case state {_PROGRAMME} end as programme, case state {_NOTE} end as note, case band when '<50' then 100 when '50-499' then 50 when '>=500' then 25 end as cost,
   case band when '<50' then 75 when '50-499' then 50 when '>=500' then 25 end as wage from s)
select c_custkey, band, cost as cost_pct, wage as wage_pct, programme,
 case when band is null then 'Die Agentur für Arbeit fördert Weiterbildung Beschäftigter nach § 82 SGB III – bei kleinen Betrieben bis zu 100 % der Lehrgangskosten. Die genaue Quote hängt von der Beschäftigtenzahl ab.'
     || case when programme is null then '' else ' Zusätzlich in ' || state || ': ' || programme || '.' end
 else case band when '<50' then 'Bei unter 50' when '50-499' then 'Bei 50 bis 499' else 'Ab 500' end || ' Beschäftigten übernimmt die Agentur für Arbeit bis zu ' || cost ||
  ' % der Lehrgangskosten und bis zu ' || wage || ' % des Arbeitsentgelts während der Weiterbildung (§ 82 SGB III).'
  || case when programme is null then '' else ' In ' || state || ' zusätzlich: ' || programme || ' (' || note || ').' end
  || case when confidence in ('low', 'none') then ' Beschäftigtenzahl im Gespräch verifizieren.' else '' end end as pitch from p""")
def funding_assessment(spark, sf):
    states = F.array(*[F.lit(s) for s in dims.STATES])
    rows = _staffed(spark, sf).withColumn("state", F.element_at(states, (F.col("c_custkey") % 16).cast("int") + 1))
    f = rows.select("c_custkey", CO.funding(F.col("size"), F.col("state")).alias("f"))
    return f.select("c_custkey", "f.band", "f.cost_pct", "f.wage_pct", "f.programme", "f.pitch")


@query("phone_key", """
with v as (select c_custkey, [ '+49 (0) 221 ' || c_custkey, '0049 221/' || c_custkey, '0221-' || c_custkey, '49221' || c_custkey, cast(c_custkey as varchar)][c_custkey % 5 + 1] as raw from customer)
select c_custkey, case when c_custkey % 5 = 4 then case when length(cast(c_custkey as varchar)) >= 8 then cast(c_custkey as varchar) end
   when length('49221' || c_custkey) >= 8 then '49221' || c_custkey end as phone_key from v""")
def phone_key(spark, sf):
    k = F.col("c_custkey").cast("string")
    forms = F.array(
        F.concat(F.lit("+49 (0) 221 "), k), F.concat(F.lit("0049 221/"), k), F.concat(F.lit("0221-"), k), F.concat(F.lit("49221"), k), k
    )
    raw = F.element_at(forms, (F.col("c_custkey") % 5).cast("int") + 1)
    # numbers of customers with a leading zero do not occur, so the last form has no national prefix to replace
    return _customers(spark, sf).select("c_custkey", P.phone_key(raw).alias("phone_key"))


@query("phone_classify", """
with d as (select c_custkey, lpad(cast(c_custkey as varchar), 7, '0') as d from customer)
select c_custkey, case c_custkey % 5 when 0 then '+49171' || d when 1 then '+49221' || d when 2 then '+49800' || d when 3 then '+4932' || d end as e164,
  case c_custkey % 5 when 0 then '0171 ' || d when 1 then '0221 ' || d end as national,
  case c_custkey % 5 when 0 then 'mobile' when 1 then 'landline' when 2 then 'unknown' when 3 then 'voip' end as kind from d""")
def phone_classify(spark, sf):
    d = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    forms = F.array(
        F.concat(F.lit("0171 "), d), F.concat(F.lit("+49 (0) 221/"), d), F.concat(F.lit("0800 "), d), F.concat(F.lit("0049 32-"), d), F.concat(F.lit("01-"), d)
    )
    n = P.classify(F.element_at(forms, (F.col("c_custkey") % 5).cast("int") + 1))
    rows = _customers(spark, sf).select("c_custkey", n.alias("n"))
    known = (F.col("c_custkey") % 5).isin(0, 1)
    return rows.select("c_custkey", "n.e164", F.when(known, F.col("n.national")).alias("national"), "n.kind")


@query("whatsapp_links", """
select c_custkey, case c_custkey % 4 when 0 then '+49160' || lpad(cast(c_custkey as varchar), 7, '0') when 1 then '+49160' || lpad(cast(c_custkey as varchar), 7, '0') end as number from customer""")
def whatsapp_links(spark, sf):
    d = F.concat(F.lit("49160"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    forms = F.array(
        F.concat(F.lit("https://wa.me/"), d, F.lit("?text=Hallo")), F.concat(F.lit("whatsapp://send?text=x&phone=%2B"), d),
        F.concat(F.lit("https://wa.me/message/"), d), F.concat(F.lit("https://firma.example/?phone="), d),
    )
    href = F.element_at(forms, (F.col("c_custkey") % 4).cast("int") + 1)
    return _customers(spark, sf).select("c_custkey", urls.whatsapp_number(href).alias("number"))


@query("protected_emails", """
select c_custkey, case when c_custkey % 6 = 5 then null else lower(replace(c_name, '#', '.')) || '@firma.example' end as email from customer""")
def protected_emails(spark, sf):
    plain = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@firma.example"))
    key = (F.col("c_custkey") % 256).cast("int")
    codes = F.transform(F.filter(F.split(plain, ""), lambda x: x != ""), lambda x: F.lpad(F.hex(F.ascii(x).bitwiseXOR(key)), 2, "0"))
    code = F.concat(F.lpad(F.hex(key), 2, "0"), F.array_join(codes, ""))
    broken = F.when(F.col("c_custkey") % 6 == 5, F.concat(code, F.lit("x"))).otherwise(code)
    return _customers(spark, sf).select("c_custkey", urls.protected_email(broken).alias("email"))


@query("disguised_emails", """
select c_custkey, case c_custkey % 4 when 3 then null else lower(replace(c_name, '#', '.')) || '@haus.firma.example' end as email from customer""")
def disguised_emails(spark, sf):
    user = F.replace(F.col("c_name"), F.lit("#"), F.lit("."))
    forms = F.array(
        F.concat(F.lit("Mail: "), user, F.lit(" [at] haus [dot] firma.example.")), F.concat(F.lit("an "), user, F.lit("(at)Haus(punkt)firma (dot) example")),
        F.concat(user, F.lit(" {at} haus.firma.example, oder")), F.concat(user, F.lit("@logo.png und Bild")),
    )
    text = F.element_at(forms, (F.col("c_custkey") % 4).cast("int") + 1)
    return _customers(spark, sf).select("c_custkey", F.try_element_at(C.emails_in_text(text), F.lit(1)).alias("email"))


_FORM_LIST = ("GmbH", "GmbH & Co. KG", "AG", "UG (haftungsbeschränkt)", "e.K.", "PartG mbB", "GbR", "", "SE & Co. KGaA", "e. V.", "Stiftung", "Ltd.")
_FORM_NAMES = ("GmbH", "GmbH & Co. KG", "AG", "UG", "e.K.", "PartG mbB", "GbR", None, "SE & Co. KG", "e.V.", "Stiftung", "ausländisch")


@query("legal_form", f"""
select [{', '.join('null' if n is None else f"'{n}'" for n in _FORM_NAMES)}][c_custkey % 12 + 1] as legal_form, count(*) as n, min(c_custkey) as first_key from customer group by 1""")
def legal_form(spark, sf):
    listed = F.array(*[F.lit(f) for f in _FORM_LIST])
    name = F.concat(F.lit("Betrieb Nord "), F.element_at(listed, (F.col("c_custkey") % 12).cast("int") + 1))
    rows = _customers(spark, sf).select("c_custkey", L.legal_form(name).alias("legal_form"))
    return rows.groupBy("legal_form").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("headcount_hits", """
with n as (select c_custkey, c_custkey % 7 as f, c_custkey % 900 + 2 as n from customer)
select c_custkey, cast(case when f in (1, 2) then greatest(1, floor(n * cast(0.8 as double))) else n end as integer) as lo,
 cast(case f when 0 then greatest(n + 1, floor(n * cast(1.5 as double))) when 2 then floor(n * cast(1.2 as double)) + 1 when 3 then n + 10 else n end as integer) as hi,
 cast(case f when 0 then greatest(n + 1, floor(n * cast(1.2 as double))) when 1 then greatest(1, floor(n * cast(0.9 as double))) when 3 then n + 5 else n end as integer) as point,
 cast(case f when 5 then 1 else 2 end as integer) as quality from n where f <> 6""")
def headcount_hits(spark, sf):
    k = F.col("c_custkey")
    n = (k % 900 + 2).cast("int")
    t = n.cast("string")
    forms = F.array(
        F.concat(F.lit("Mit über "), t, F.lit(" Mitarbeitern an drei Standorten.")), F.concat(F.lit("knapp "), t, F.lit(" Kolleginnen")),
        F.concat(F.lit("rund "), t, F.lit(" Beschäftigte")), F.concat(F.lit("zwischen "), t, F.lit(" und "), (n + 10).cast("string"), F.lit(" Mitarbeitern")),
        F.concat(F.lit("Mitarbeiterzahl: "), t), F.concat(F.lit("Unser Team von "), t, F.lit(" Profis")), F.concat(F.lit("seit "), t, F.lit(" Jahren für "), t, F.lit(" Kunden")),
    )
    text = F.element_at(forms, (k % 7).cast("int") + 1)
    rows = _customers(spark, sf).select("c_custkey", F.explode(HC.hits(text)).alias("h"))
    return rows.select("c_custkey", "h.value.lo", "h.value.hi", "h.value.point", "h.quality")


@query("headcount_rejects", """select c_custkey % 8 as form, count(*) as texts, cast(0 as bigint) as hits from customer group by 1""")
def headcount_rejects(spark, sf):
    k = F.col("c_custkey")
    t = (k % 900 + 2).cast("string")
    tails = ("seit über {} Jahren für Sie da", "{} zufriedene Kunden", "{} Standorte in NRW", "{} % Qualität", "{} Stunden Notdienst",
             "über {} Objekte verkauft", "{} Referenzen", "{} Wohnungen verwaltet")
    forms = F.array(*[F.concat(F.lit(x.split("{}")[0]), t, F.lit(x.split("{}")[1])) for x in tails])
    text = F.element_at(forms, (k % 8).cast("int") + 1)
    rows = _customers(spark, sf).select((k % 8).alias("form"), F.size(HC.hits(text)).alias("n"))
    return rows.groupBy("form").agg(F.count("*").alias("texts"), F.sum("n").alias("hits"))


@query("vcard_people", """
select c_custkey as page_id, cast(0 as integer) as card_no, 'Thea Berg' as name, 'geschaeftsfuehrung' as category, 't' || c_custkey || '@firma.example' as email, '+49171' || lpad(cast(c_custkey as varchar), 7, '0') as mobile from customer
union all select c_custkey, 1, 'Jan Petersen', 'sonstige', null, null from customer where c_custkey % 2 = 0""")
def vcard_people(spark, sf):
    d = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    one = F.concat(
        F.lit("BEGIN:VCARD\r\nVERSION:3.0\r\nN:Berg;Thea\r\nFN:Dr. Thea Berg\r\nTITLE:Geschäfts\r\n führerin\r\nitem1.TEL;TYPE=CELL:+49 171 "), d,
        F.lit("\r\nTEL;TYPE=FAX:+49 221 5550001\r\nEMAIL:T"), F.col("c_custkey").cast("string"), F.lit("@Firma.example\r\nEND:VCARD\r\n"),
    )
    two = F.when(F.col("c_custkey") % 2 == 0, F.lit("BEGIN:VCARD\nN:Petersen;Jan\nEND:VCARD\n")).otherwise("")
    files = _customers(spark, sf).select(F.lit("f").alias("company_id"), F.col("c_custkey").alias("page_id"), F.lit("").alias("url"), F.concat(one, two).alias("text"))
    people = V.card_people(V.cards(files))
    raw = F.try_element_at("tels", F.lit(1))["value"]
    return people.select("page_id", "card_no", "name", "category", "email", P.classify(raw)["e164"].alias("mobile"))


def _companies(spark, sf):
    k = F.col("c_custkey")
    rows = _customers(spark, sf).select(
        F.concat(F.lit("p"), (F.floor(k / 2)).cast("string")).alias("place_id"), F.concat(F.lit("p"), k.cast("string")).alias("company_id"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 6 < 3, F.concat(F.lit("https://www.d"), F.floor(k / 6).cast("string"), F.lit(".de/x"))).alias("website"),
        F.when(k % 10 == 7, F.concat(F.lit("0221 77"), F.lpad(F.floor(k / 40).cast("string"), 5, "0"))).alias("phone"),
        F.concat(F.lit("q"), (k % 4).cast("string")).alias("query"), k.alias("ord"),
    )
    return R.with_company_columns(rows)


@query("company_dedupe", """
with recursive r as (select c_custkey as ord, 'p' || (c_custkey // 2) as place_id, case when c_custkey % 3 = 0 then '' else c_name end as name,
    case when c_custkey % 6 < 3 then 'd' || (c_custkey // 6) || '.de' end as domain,
    case when c_custkey % 10 = 7 then '4922177' || lpad(cast(c_custkey // 40 as varchar), 5, '0') end as phone, 'q' || (c_custkey % 4) as query from customer),
 keys as (select ord as record, 'i' || place_id as token from r union all select ord, 'd' || domain from r where domain is not null union all select ord, 'p' || phone from r where phone is not null),
 hub as (select token, min(record) as hub from keys group by 1),
 edge as (select distinct record as u, hub as v from keys join hub using (token) where record <> hub),
 sym as (select u, v from edge union select v, u from edge),
 walk(record, label) as (select ord, ord from r union select b.v, w.label from walk w join sym b on b.u = w.record where w.label < b.v),
 c as (select record, min(label) as cluster from walk group by 1),
 m as (select r.*, cluster from r join c on record = ord)
select min(ord) as ord, arg_min(place_id, ord) as place_id, arg_min(name, ord) filter (name <> '') as name, arg_min(domain, ord) filter (domain is not null) as domain,
  (select string_agg(query, ' | ' order by f) from (select query, min(ord) as f from m m2 where m2.cluster = m.cluster group by 1)) as query from m group by cluster""")
def company_dedupe(spark, sf):
    return dedupe_companies(_companies(spark, sf)).select("ord", "place_id", "name", "domain", "query")


@query("company_list_csv", f"""
with p as (select c_custkey, case when c_custkey % 9 = 4 then '1' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') else lpad(cast(c_custkey % 100000 as varchar), 5, '0') end as raw from customer),
 q as (select c_custkey, case when length(raw) = 4 then '0' || raw else raw end as plz from p), z as (select *, cast(substr(plz, 1, 2) as integer) as z from q)
select case when c_custkey % 5 = 0 then 'firma' || c_custkey || '.de' else c_name end as name, case when c_custkey % 11 = 1 then null else 'https://firma' || c_custkey || '.de' end as website,
   case when c_custkey % 11 = 1 then null else 'firma' || c_custkey || '.de' end as domain, plz, case {_ZONES} end as state from z join customer using (c_custkey)
 where not (c_custkey % 5 = 0 and c_custkey % 11 = 1)""")
def company_list_csv(spark, sf):
    import uuid

    k = F.col("c_custkey")
    raw = F.when(k % 9 == 4, F.concat(F.lit("1"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.lpad((k % 100000).cast("string"), 5, "0"))
    rows = _customers(spark, sf).select(
        F.when(k % 5 != 0, F.col("c_name")).alias("Firma"), F.when(k % 11 != 1, F.concat(F.lit("firma"), k.cast("string"), F.lit(".de"))).alias("Web-Seite"),
        raw.alias("PLZ"), F.lit(" ").alias("Ort"),
    )
    path = f"{checkpoint_dir(spark).rstrip('/')}/list-{uuid.uuid4().hex}"
    rows.write.option("sep", ";").option("header", True).csv(path)
    return R.read_company_list(spark, path).select("name", "website", "domain", "plz", "state")


@query("places_json", f"""
with p as (select c_custkey, lpad(cast(c_custkey * 37 % 100000 as varchar), 5, '0') as plz from customer where c_custkey % 10 <> 3 and c_custkey % 7 <> 2),
 z as (select *, cast(substr(plz, 1, 2) as integer) as z from p)
select 'g' || c_custkey as place_id, c_name as name, case when c_custkey % 4 = 0 then 'Weg' else 'Weg ' || c_custkey end as street, plz,
  case when c_custkey % 2 = 0 then 'Ort A' else 'Ort B' end as city, case when c_custkey % 3 = 0 then 'Bayern' else case {_ZONES} end end as state,
  'DE' as country, c_custkey as ord from z join customer using (c_custkey)""")
def places_json(spark, sf):
    k = F.col("c_custkey")
    part = "struct<longText:string,shortText:string,types:array<string>,languageCode:string>"

    def comp(kind: str, long, short=None):
        return F.struct(long.alias("longText"), (F.lit(None) if short is None else short).cast("string").alias("shortText"), F.array(F.lit(kind)).alias("types"), F.lit("de").alias("languageCode")).cast(part)

    parts = F.filter(F.array(
        comp("route", F.lit(" Weg ")), F.when(k % 4 != 0, comp("street_number", k.cast("string"))),
        comp("postal_code", F.lpad((k * 37 % 100000).cast("string"), 5, "0")),
        F.when(k % 2 == 0, comp("locality", F.lit("Ort A"))).otherwise(comp("postal_town", F.lit("Ort B"))),
        F.when(k % 3 == 0, comp("administrative_area_level_1", F.lit("bavaria"))),
        F.when(k % 10 == 3, comp("country", F.lit("Österreich"), F.lit("AT"))).when(k % 10 == 4, comp("country", F.lit("Deutschland"))),
    ), lambda x: x.isNotNull())
    place = F.struct(
        F.concat(F.lit("g"), k.cast("string")).alias("id"),
        F.struct(F.when(k % 7 != 2, F.col("c_name")).otherwise(" ").alias("text"), F.lit("de").alias("languageCode")).alias("displayName"),
        F.lit("").alias("formattedAddress"), parts.alias("addressComponents"),
        F.struct(F.lit(50.0).alias("latitude"), F.lit(7.0).alias("longitude")).alias("location"), F.lit("").alias("nationalPhoneNumber"),
        F.lit("").alias("internationalPhoneNumber"), F.lit("https://x.de").alias("websiteUri"), F.lit("t").alias("primaryType"),
        F.array(F.lit("t")).alias("types"), F.lit(4.5).alias("rating"), k.cast("int").alias("userRatingCount"), F.lit("OPERATIONAL").alias("businessStatus"), F.lit("").alias("googleMapsUri"),
    )
    answers = _customers(spark, sf).select(k.alias("no"), F.to_json(F.struct(F.array(place).alias("places"))).alias("j"))
    parsed = answers.select("no", F.explode(F.from_json("j", R.PLACES_SCHEMA)["places"]).alias("place"))
    out = R.companies_from_places(parsed, F.lit("q"), F.col("no"))
    return out.select("place_id", "name", "street", "plz", "city", "state", "country", "ord")


@query("masked_contacts", """
select c_custkey, '+49171' || repeat('*', 7) as phone, substr(sha256(lower(c_name) || '@x.de'), 1, 12) || '@x.de' as email from customer""")
def masked_contacts(spark, sf):
    phone = F.concat(F.lit("+49171"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    email = F.concat(F.col("c_name"), F.lit("@x.de"))
    return _customers(spark, sf).select("c_custkey", G.mask_phone(phone).alias("phone"), G.mask_email(email).alias("email"))


def _lead_rows(spark, sf):
    """Lead rows derived from customers and their orders, with every scoring input varied by key."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.lit("Thea Berg"))
    return _staffed(spark, sf).select(
        k.alias("company_id"), F.col("c_name").alias("name"), F.when(k % 8 != 0, F.lit("https://x.de")).alias("website"),
        F.when(k % 13 == 0, "CLOSED_PERMANENTLY").when(k % 2 == 0, "OPERATIONAL").alias("business_status"), F.lit("Bayern").alias("state"),
        F.when(k % 9 == 0, 0).otherwise(3).alias("pages"), name.alias("decider_name"), F.when(k % 6 == 0, name).alias("decider_mobile"),
        F.when(k % 10 == 0, F.lit("Mara Lenz")).alias("hr_name"), F.when(k % 15 == 0, F.lit("Thea Berg")).alias("owner_named"),
        F.when(k % 6 == 0, 2).when(k % 5 == 0, 1).otherwise(0).alias("mobiles"), "size",
        F.when(k % 4 == 0, "angestellt").when(k % 4 == 1, "frei").otherwise("unklar").alias("employment_signal"), (k % 2).alias("emails"),
        F.when(k % 7 == 0, F.lit("l")).alias("linkedin_url"), F.lit(None).cast("string").alias("xing_url"), F.lit(None).cast("string").alias("legal_name"),
        F.when(k % 11 == 0, F.lit("GbR")).otherwise("GmbH").alias("legal_form"),
    )


_LEAD = f"""{_STAFF}, {_SIZE}, f as (select c_custkey as k, n, point, hi, confidence, coalesce(hi, point) as eh, n as el,
   case when coalesce(hi, point) is null then null when coalesce(hi, point) < 5 then false when n > 50 then false else true end as fit, coalesce(nullif(point, 0), hi) as est from size)"""
_SCORE = """(case when k % 13 = 0 then -40 else 0 end) + (case when k % 8 = 0 then -20 when k % 9 = 0 then -20 else 0 end)
  + (case when k % 6 = 0 then 50 when k % 5 = 0 then case when est <= 10 then 25 else 20 end else 0 end) + (case when k % 6 <> 0 and k % 3 = 0 then 10 else 0 end)
  + (case when k % 10 = 0 then 5 else 0 end) + (case when k % 15 = 0 or k % 11 = 0 then case when k % 6 = 0 or k % 5 = 0 then 10 else 5 end else 0 end)
  + (case when fit then case confidence when 'high' then 20 when 'medium' then 12 when 'low' then 5 else 0 end when not fit then case confidence when 'high' then -30 when 'medium' then -15 when 'low' then -5 else 0 end else 0 end)
  + (case k % 4 when 0 then 8 when 1 then -20 else 0 end) + (case when k % 2 = 1 then 3 else 0 end) + (case when k % 7 = 0 then 2 else 0 end)"""
_MISSING = """[x for x in [case when k % 13 = 0 then 'Google-Status CLOSED_PERMANENTLY' end, case when k % 9 = 0 then 'Website nicht erreichbar/keine Website' end,
  case when k % 9 <> 0 and k % 3 <> 0 then 'kein Entscheider im Impressum erkannt' end, case when k % 9 <> 0 and k % 3 = 0 and k % 6 <> 0 then 'keine Handynummer namentlich beim Entscheider' end,
  case when k % 9 <> 0 and confidence not in ('high', 'medium') then 'Mitarbeiterzahl nicht belegt' end,
  case when k % 9 <> 0 and confidence in ('high', 'medium') and not coalesce(fit, false) then 'Mitarbeiterzahl außerhalb 5–50' end,
  case when k % 9 <> 0 and k % 4 = 1 then 'freie Handelsvertreter/Franchise – keine förderfähigen Beschäftigten erkennbar' end,
  case when k % 9 <> 0 and k % 4 in (2, 3) and confidence <> 'high' then 'sozialversicherungspflichtige Beschäftigte nicht belegt' end] if x is not null]"""


@query("lead_score", f"with {_LEAD} select k as company_id, fit as in_target_size, cast(greatest(0, least(100, {_SCORE})) as integer) as score from f")
def lead_score(spark, sf):
    return S.finalize(_lead_rows(spark, sf)).select("company_id", "in_target_size", "score")


@query("score_reasons", f"""with {_LEAD} select k as company_id, array_to_string([x for x in [case when k % 13 = 0 then 'Google-Status CLOSED_PERMANENTLY' end,
  case when k % 8 = 0 then 'keine Website' when k % 9 = 0 then 'Website nicht erreichbar' end, case when k % 6 = 0 then 'Entscheider mit Handy: Thea Berg' when k % 5 = 0 then
     case when est <= 10 then 'Handynummer (Kleinbetrieb – vermutlich Inhaber)' else 'Handynummer ohne Namenszuordnung' end end, case when k % 6 <> 0 and k % 3 = 0 then 'Entscheider bekannt: Thea Berg' end,
  case when k % 10 = 0 then 'HR/Ausbildung: Mara Lenz' end, case when k % 15 = 0 then 'inhabergeführt: „Thea Berg“ im Firmennamen' when k % 11 = 0 then 'inhabergeführt: Rechtsform GbR' end,
  case when fit then 'Größe passt (' || coalesce(cast(est as varchar), 'None') || ' MA, ' || confidence || ')' when not fit then 'Größe außerhalb (' || n || '-' || coalesce(cast(hi as varchar), 'None') || ' MA, ' || confidence || ')' else 'Größe unbekannt' end,
  case k % 4 when 0 then 'Festangestellte erkennbar' when 1 then 'freie Handelsvertreter/Franchise – Förderfähigkeit fraglich' end, case when k % 2 = 1 then 'E-Mail' end, case when k % 7 = 0 then 'LinkedIn/XING' end] if x is not null], '; ') as reasons from f""")
def score_reasons(spark, sf):
    return S.finalize(_lead_rows(spark, sf)).select("company_id", F.array_join("score_reasons", "; ").alias("reasons"))


@query("premium_missing", f"with {_LEAD} select k as company_id, array_to_string({_MISSING}, '; ') as missing, len({_MISSING}) = 0 as premium from f")
def premium_missing(spark, sf):
    return S.finalize(_lead_rows(spark, sf)).select("company_id", F.array_join("premium_missing", "; ").alias("missing"), "premium")


@query("lead_filters", f"with {_LEAD} select k as company_id from f where not (coalesce(not fit, false) and confidence = 'high') and (k % 6 = 0 or k % 5 = 0)")
def lead_filters(spark, sf):
    return S.finalize(_lead_rows(spark, sf)).where(S.passes(need_mobile=True)).select("company_id")


_SCHEMA = "company_id bigint, name string, phone string, score int, premium boolean, in_target_size boolean, size struct<lo:int,hi:int,point:int,confidence:string>"


@query("leads_json_export", f"""with {_LEAD}, s as (select k as company_id, c_name as name, cast(greatest(0, least(100, {_SCORE})) as integer) as score from f join customer on c_custkey = k)
select company_id, name, score, '0221 55' || lpad(cast(company_id as varchar), 6, '0') as phone from s where score >= 40 and company_id % 50 <> 20""")
def leads_json_export(spark, sf):
    import uuid

    from firmatlas.sinks.writers import reexport, write_json

    path = f"{checkpoint_dir(spark).rstrip('/')}/leads-{uuid.uuid4().hex}"
    number = lambda c, head: F.concat(F.lit(head), F.lpad(c.cast("string"), 6, "0"))
    rows = S.finalize(_lead_rows(spark, sf)).select("company_id", "name", "score", "premium", "in_target_size", "size")
    # every fiftieth company objects, under another spelling of its number
    objections = _customers(spark, sf).where("c_custkey % 50 = 20").select(F.lit("phone").alias("kind"), number(F.col("c_custkey"), "+49 (221) 55-").alias("key"))
    write_json(rows.withColumn("phone", number(F.col("company_id"), "0221 55")), path, objections, phone="phone")
    return reexport(spark, path, _SCHEMA, min_score=40).select("company_id", "name", "score", "phone")


@query("role_categories", """
select ['geschaeftsfuehrung', 'inhaber', 'hr', 'hr', 'ausbildung', 'prokura', 'betriebsleitung', 'sonstige', 'sonstige'][c_custkey % 9 + 1] as category, count(*) as n from customer group by 1""")
def role_categories(spark, sf):
    from firmatlas.functions.names import role_category

    roles = ("GESCHÄFTSFÜHRERIN", "Inhaber & Makler", "Leitung Personal", "Head of HR", "Ausbildungsleiter", "Prokuristin", "Niederlassungsleiter", "Maklerin", None)
    role = F.element_at(F.array(*[F.lit(r) for r in roles]), (F.col("c_custkey") % 9).cast("int") + 1)
    return _customers(spark, sf).groupBy(role_category(role).alias("category")).agg(F.count("*").alias("n"))


@query("size_fallback", """
with t as (select c_custkey as k, case when c_custkey % 4 = 0 then c_custkey % 30 end as team, case when c_custkey % 4 = 1 then 'GmbH' when c_custkey % 4 = 2 then 'eigen' end as form,
   case when c_custkey % 8 <> 6 then c_custkey % 150 end as reviews from customer)
select k, cast(case when team >= 3 then team when form = 'GmbH' then 5 when reviews < 10 then 1 when reviews <= 100 then 3 when reviews is not null then 10 end as integer) as lo,
  cast(case when team >= 3 then round_even(team * 1.5, 0) when form = 'GmbH' then 49 when reviews < 10 then 9 when reviews <= 100 then 30 when reviews is not null then 100 end as integer) as hi,
  case when team >= 3 then 'medium' when form = 'GmbH' or reviews is not null then 'low' else 'none' end as confidence from t""")
def size_fallback(spark, sf):
    from firmatlas.operators.headcount import fallback_size

    k = F.col("c_custkey")
    none = F.lit(None).cast("struct<lo:int,hi:int,point:int,confidence:string,evidence:array<string>>")
    size = fallback_size(
        none, F.when(k % 4 == 0, k % 30), F.when(k % 4 == 1, "GmbH").when(k % 4 == 2, "eigen"), F.when(k % 8 != 6, k % 150).cast("int")
    )
    return _customers(spark, sf).select(k.alias("k"), size.alias("s")).select("k", "s.lo", "s.hi", "s.confidence")


