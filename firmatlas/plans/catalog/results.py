"""Result tables through the shipped sinks, over lead rows that Spark derives from customers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from firmatlas.functions import company as CO
from firmatlas.functions import text as T
from firmatlas.functions import urls
from firmatlas.operators import contacts as C
from firmatlas.operators import guard as G
from firmatlas.operators import headcount as HC
from firmatlas.operators import people as PE
from firmatlas.operators import score as S
from firmatlas.plans.catalog.base import query, table
from firmatlas.plans.catalog.company import _SIZE, _STAFF, _staffed
from firmatlas.rules import dims, vocab
from firmatlas.session import checkpoint_dir
from firmatlas.sinks import meta as M
from firmatlas.sinks import tables as TB
from firmatlas.sinks.writers import write_parquet
from firmatlas.sources import readers as R
from firmatlas.sources.spec import build_spec

_SPEC = build_spec(["Makler", "Notar"], cities=["Kiel"], require_mobile=True)


def _digits(head: str, c):
    return F.concat(F.lit(head), F.lpad(c.cast("string"), 7, "0"))


def _numbers(spark, sf):
    """Up to three numbers per customer: a mobile of its own, a free mobile, a landline of its pages."""
    k = F.col("c_custkey")
    row = lambda no, when, head, kind, source, person, label: F.when(
        when,
        F.struct(
            F.lit(no).alias("no"), _digits(f"+49{head}", k).alias("e164"), _digits(f"0{head} ", k).alias("national"), F.lit(kind).alias("kind"), F.lit(source).alias("source"),
            person.alias("person"), F.lit(label).cast("string").alias("label"), F.lit("u" + str(no)).alias("source_url"),
        ),
    )
    none = F.lit(None).cast("string")
    listed = F.array(
        row(0, k % 3 == 0, "171", "mobile", "team", F.lit("Thea Berg"), "Mobil"), row(1, k % 5 == 0, "160", "mobile", "whatsapp", F.when(k % 2 == 0, "Mara Lenz"), None),
        row(2, k % 2 == 0, "221", "landline", "impressum", none, "Tel"), row(3, k % 7 == 0, "30", "landline", "places", none, None),
    )
    rows = table(spark, sf, "customer").select(k.alias("company_id"), F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("n"))
    return rows.select("company_id", "n.*").withColumn("first_at", F.col("no"))


def _people(spark, sf):
    k = F.col("c_custkey")
    mobile = F.struct(_digits("+49171", k).alias("e164"), _digits("0171 ", k).alias("national"), F.lit("u0").alias("source_url"))
    landline = F.struct(_digits("+49221", k).alias("e164"), _digits("0221 ", k).alias("national"))
    none = lambda c: F.lit(None).cast(c)
    one = F.struct(
        F.lit("Thea Berg").alias("name"), F.when(k % 4 == 0, "Inhaberin").alias("role"), F.when(k % 4 < 2, "inhaber").otherwise("sonstige").alias("category"),
        F.when(k % 4 < 2, 0).otherwise(9).alias("priority"), F.when(k % 3 == 0, mobile).alias("mobile"), F.when(k % 2 == 0, landline).alias("landline"), none("string").alias("email"), F.lit(0).alias("first_at"),
    )
    two = F.struct(
        F.lit("Mara Lenz").alias("name"), F.lit("HR").alias("role"), F.lit("hr").alias("category"), F.lit(2).alias("priority"), none("struct<e164:string,national:string,source_url:string>").alias("mobile"),
        none("struct<e164:string,national:string>").alias("landline"), F.lit("m@x.de").alias("email"), F.lit(1).alias("first_at"),
    )
    listed = F.filter(F.array(F.when(k % 2 == 0, one), F.when(k % 5 == 0, two)), lambda x: x.isNotNull())
    return table(spark, sf, "customer").select(k.alias("company_id"), F.explode(listed).alias("p")).select("company_id", "p.*", F.lit("p").alias("source_url"))


def _leads(spark, sf):
    """Finished leads with every column that the result tables read."""
    k, text = F.col("c_custkey"), lambda v: F.lit(v).cast("string")
    mobile = lambda head, who: F.struct(_digits(f"+49{head}", k).alias("e164"), _digits(f"0{head} ", k).alias("national"), who.alias("person"), F.lit("u").alias("source_url"))
    own = F.struct(_digits("+49171", k).alias("e164"), _digits("0171 ", k).alias("national"), F.lit("u0").alias("source_url"))
    contact = F.struct(F.lit("Thea Berg").alias("name"), F.when(k % 4 == 0, "Inhaberin").alias("role"), F.lit("inhaber").alias("category"), F.when(k % 6 == 0, "t@x.de").alias("email"), F.when(k % 3 == 0, own).alias("mobile"))
    rows = _staffed(spark, sf).select(
        k.alias("company_id"), F.concat(F.lit("list-"), k.cast("string")).alias("place_id"), F.col("c_name").alias("name"), F.when(k % 4 == 1, F.concat(F.lit("Haus "), k.cast("string"), F.lit(" GmbH"))).alias("legal_name"),
        F.when(k % 8 != 0, F.lit("https://x.de")).alias("website"), F.lit("OPERATIONAL").alias("business_status"), F.lit("Bayern").alias("state"), F.lit(3).alias("pages"),
        F.when(k % 2 == 0, "Thea Berg").alias("decider_name"), F.when(k % 6 == 0, "Thea Berg").alias("decider_mobile"), F.when(k % 10 == 0, "Mara Lenz").alias("hr_name"), text(None).alias("owner_named"),
        ((k % 3 == 0).cast("int") + (k % 5 == 0).cast("int")).alias("mobiles"), F.col("size").withField("evidence", F.array(F.lit("e"))).alias("size"), F.when(k % 4 == 0, "angestellt").when(k % 4 == 1, "frei").otherwise("unklar").alias("employment_signal"),
        F.array(text("+ a"), text("+ b")).alias("employment_evidence"), (k % 2).alias("emails"), F.when(k % 2 == 1, "i@x.de").alias("first_email"), text(None).alias("linkedin_url"), text("x").alias("xing_url"),
        F.when(k % 5 == 0, "https://wa.me/1").alias("whatsapp_url"), F.when(k % 11 == 0, "GbR").otherwise("GmbH").alias("legal_form"), F.when(k % 2 == 0, contact).alias("contact"),
        F.when(k % 3 == 0, mobile("171", F.lit("Thea Berg"))).when(k % 5 == 0, mobile("160", F.when(k % 2 == 0, "Mara Lenz"))).alias("best_mobile"),
        F.when((k % 5 == 0) & (k % 2 == 1), mobile("160", text(None))).alias("open_mobile"), F.when(k % 7 == 0, _digits("030 ", k)).alias("phone"), F.array(text("sucht Personal")).alias("call_indicators"),
        F.lit("makler").alias("primary_type"), F.when(k % 4 == 1, "Weg 1").alias("legal_street"), F.when(k % 4 == 1, "24103").alias("legal_plz"), F.when(k % 4 == 1, "Kiel").alias("legal_city"),
        F.lit("Allee 2").alias("street"), F.lit("80331").alias("plz"), F.lit("München").alias("city"), F.when(k % 4 == 1, "https://x.de/impressum").alias("legal_url"),
        F.when(k % 2 == 0, F.concat(F.lit("HRB "), k.cast("string"))).alias("register"), F.when(k % 3 != 0, "Amtsgericht Kiel").alias("court"), F.lit(4.5).alias("rating"), (k % 300).cast("int").alias("reviews"),
        F.lit("m").alias("maps_url"), F.lit("Makler").alias("query"), F.array(F.when(k % 9 == 0, "wenig Text")).alias("errors"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz").alias("scraped_at"),
    )
    return S.finalize(rows.withColumn("errors", F.filter("errors", lambda x: x.isNotNull())))


_BASE = f"""{_STAFF}, {_SIZE}, k as (select c_custkey as k, c_name, lpad(cast(c_custkey as varchar), 7, '0') as d, n, point, hi, confidence from size join customer using (c_custkey)),
 l as (select *, case when k % 4 = 1 then 'Haus ' || k || ' GmbH' else c_name end as firm, case when k % 2 = 0 and k % 3 = 0 then '0171 ' || d when k % 3 = 0 then null when k % 5 = 0 and k % 2 = 1 then '0160 ' || d end as main from k)"""


@query("leads_table", f"""with {_BASE}
select k as company_id, firm as "Firma", case when k % 2 = 0 then 'Thea Berg' else '' end as "Entscheider", case when k % 4 = 0 then 'Inhaberin' when k % 2 = 0 then 'Inhaber/-in' else '' end as "Rolle", coalesce(case when k % 2 = 0 and k % 3 = 0 then '0171 ' || d when k % 5 = 0 and k % 2 = 1 then '0160 ' || d end, '') as "Handy Entscheider",
  array_to_string([x for x in [case when k % 3 = 0 and not (k % 2 = 0) then '0171 ' || d || ' (Thea Berg)' end, case when k % 5 = 0 and k % 2 = 0 then '0160 ' || d || ' (Mara Lenz)' end] if x is not null], ', ') as "Weitere Handynummern",
  case when k % 7 = 0 then '030 ' || d else '' end as "Festnetz (Places)", case when k % 2 = 0 then '0221 ' || d else '' end as "Festnetz (Website)", case when k % 6 = 0 then 't@x.de' when k % 2 = 1 then 'i@x.de' else '' end as "E-Mail",
  case when k % 4 = 1 then 'Weg 1' else 'Allee 2' end as "Straße", case when k % 4 = 1 then '24103' else '80331' end as "PLZ", case when k % 4 = 1 then 'Kiel' else 'München' end as "Ort",
  case when k % 2 = 0 and k % 3 <> 0 then 'HRB ' || k || ' (Amtsgericht Kiel)' when k % 2 = 0 then 'HRB ' || k when k % 3 <> 0 then 'Amtsgericht Kiel' else '' end as "Register",
  case confidence when 'high' then 'hoch' when 'medium' then 'mittel' when 'low' then 'niedrig' else '' end as "MA Konfidenz", case when k % 4 = 1 then 'freie Vertreter?' when k % 4 = 0 then 'angestellt' else 'unklar' end as "Beschäftigte",
  case when k % 9 = 0 then 'wenig Text' else '' end as "Fehler", case when k % 4 = 1 then 'Impressum' else 'Liste' end as "Firmenname Quelle", '' as "Notizen", timestamp '2026-01-02 03:04:05' as "Gescrapt am" from l""")
def leads_table(spark, sf):
    out = TB.leads_table(_leads(spark, sf), _numbers(spark, sf))
    return out.select(
        "company_id", "Firma", "Entscheider", "Rolle", "Handy Entscheider", "Weitere Handynummern", "`Festnetz (Places)`", "`Festnetz (Website)`", "E-Mail", "Straße", "PLZ", "Ort", "Register",
        "MA Konfidenz", "Beschäftigte", "Fehler", "Firmenname Quelle", "Notizen", "Gescrapt am",
    )


@query("people_table", f"""with {_BASE},
 p as (select k, firm, 'Thea Berg' as name, case when k % 4 = 0 then 'Inhaberin' when k % 4 < 2 then 'Inhaber/-in' else '' end as role, case when k % 4 < 2 then 'inhaber' else 'sonstige' end as cat, k % 3 = 0 as m, '' as mail from l where k % 2 = 0
   union all select k, firm, 'Mara Lenz', 'HR', 'hr', false, 'm@x.de' from l where k % 5 = 0)
select firm as "Firma", case when k % 4 = 1 then 'Kiel' else 'München' end as "Ort", name as "Name", role as "Rolle", cat as "Kategorie", case when m then '0171 ' || lpad(cast(k as varchar), 7, '0') else '' end as "Handy",
  mail as "E-Mail", case when m then 'u0' else 'p' end as "Fundstelle" from p where cat <> 'sonstige' or m""")
def people_table(spark, sf):
    return TB.people_table(_people(spark, sf), _leads(spark, sf)).select("Firma", "Ort", "Name", "Rolle", "Kategorie", "Handy", "E-Mail", "Fundstelle")


@query("numbers_table", f"""with {_BASE},
 n as (select k, firm, unnest([{{'w': k % 3 = 0, 'h': '171', 'a': 'mobil', 'l': 'Mobil', 'p': 'Thea Berg', 's': 'team', 'u': 'u0'}}, {{'w': k % 5 = 0, 'h': '160', 'a': 'mobil', 'l': '', 'p': case when k % 2 = 0 then 'Mara Lenz' else '' end, 's': 'whatsapp', 'u': 'u1'}},
   {{'w': k % 2 = 0, 'h': '221', 'a': 'festnetz', 'l': 'Tel', 'p': '', 's': 'impressum', 'u': 'u2'}}, {{'w': k % 7 = 0, 'h': '30', 'a': 'festnetz', 'l': '', 'p': '', 's': 'places', 'u': 'u3'}}]) as x, d from l)
select firm as "Firma", '0' || x.h || ' ' || d as "Nummer", '+49' || x.h || d as "E.164", x.a as "Art", x.l as "Label", x.p as "Person", x.s as "Quelle", x.u as "Fundstelle" from n where x.w""")
def numbers_table(spark, sf):
    return TB.phones_table(_numbers(spark, sf), _leads(spark, sf))


@query("run_summary", f"""with {_BASE}
select cast(k % 101 as integer) as "Score", left(firm, 40) as "Firma", case when k % 2 = 0 then 'Thea Berg (inhaber)' else '–' end as "Entscheider",
  case when k % 3 = 0 then '0171 ' || d || ' (Thea Berg)' when k % 10 = 0 then '0160 ' || d || ' (Mara Lenz)' when k % 5 = 0 then '0160 ' || d else '–' end as "Handy", 'München' as "Ort"
from l order by k % 101 desc, lower(c_name), k limit 25""")
def run_summary(spark, sf):
    """The report of a run: 25 rows in lead order."""
    leads = _leads(spark, sf).withColumn("score", (F.col("company_id") % 101).cast("int"))
    return TB.summary(leads).select("Score", "Firma", "Entscheider", "Handy", "Ort")


@query("run_meta_observed", f"""with {_BASE},
 c as (select count(*) as n, count(*) filter (k % 3 = 0 or k % 5 = 0) as m, count(*) filter (k % 2 = 0 and k % 3 = 0) as named from l)
select cast(ord as integer) as ord, parameter, value from c, (values (0, 'Suchbegriffe'), (1, 'Ort'), (4, 'Max. Treffer je Suchbegriff'), (7, 'Nur mit Handy'), (10, 'Anzahl Firmen'), (11, 'mit Handynummer'), (12, 'Entscheider mit Handy')) t(ord, parameter),
 lateral (select case ord when 0 then 'Makler, Notar' when 1 then 'Kiel' when 4 then '60' when 7 then 'ja' when 10 then cast(n as varchar) when 11 then cast(m as varchar) else cast(named as varchar) end as value)""")
def run_meta_observed(spark, sf):
    """Counters seen while the leads are written."""
    leads, seen = M.observed(_leads(spark, sf), f"run-{uuid.uuid4().hex}", TB.lead_counts())
    none = spark.createDataFrame([], "kind string, key string")
    write_parquet(leads.select("company_id", "score", "website"), f"{checkpoint_dir(spark).rstrip('/')}/counted-{uuid.uuid4().hex}", none, domain="website")
    return M.observed_meta(spark, _SPEC, seen).where(F.col("ord").isin(0, 1, 4, 7, 10, 11, 12))


_BANDS = ", ".join(f"('{b.band}', {b.cost_pct}, {b.wage_pct})" for b in dims.BANDS)


@query("funding_reference", f"""
with s as (select s_suppkey, [{', '.join(f"'{p.state}'" for p in dims.PROGRAMMES)}][s_suppkey % {len(dims.PROGRAMMES)} + 1] as state from supplier),
 r as (select * from (values {', '.join(f"('{p.state}', '{p.programme}: {p.note}' || '{'' if p.status == 'aktiv' else ' [' + p.status + ']'}')" for p in dims.PROGRAMMES)}) t(state, note))
select state, note, count(*) as n from s join r using (state) group by 1, 2""")
def funding_reference(spark, sf):
    """State programmes of the reference table, with the suppliers of the state."""
    states = F.array(*[F.lit(p.state) for p in dims.PROGRAMMES])
    sup = table(spark, sf, "supplier").select(F.get(states, (F.col("s_suppkey") % len(dims.PROGRAMMES)).cast("int")).alias("band_or_state"))
    rules = dims.funding_reference(spark).where("category = 'Landesprogramm'")
    return sup.join(rules, "band_or_state").groupBy(F.col("band_or_state").alias("state"), "note").agg(F.count("*").alias("n"))


@query("owner_signal", """
select c_custkey as company_id, case when c_custkey % 3 = 0 then 'Thea Berg' when c_custkey % 3 = 1 and c_custkey % 2 = 0 then 'Otto Kruse' end as owner from customer where c_custkey % 3 = 0 or (c_custkey % 3 = 1 and c_custkey % 2 = 0)""")
def owner_signal(spark, sf):
    """Surnames in company names, in legal names, too short ones, and none."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "Berg & Sohn").when(k % 3 == 1, F.when(k % 2 == 0, "Haus").otherwise("Ott")).otherwise("Nord")
    companies = table(spark, sf, "customer").select(k.alias("company_id"), name.alias("company_name"), F.when((k % 3 == 1) & (k % 2 == 0), "Kruse GmbH").alias("legal_name"))
    person = F.explode(F.array(F.struct(F.lit("Thea Berg").alias("name"), F.lit(0).alias("no")), F.struct(F.lit("Otto Kruse").alias("name"), F.lit(1).alias("no")), F.struct(F.lit("Ida Ott").alias("name"), F.lit(2).alias("no"))))
    people = companies.select("company_id", person.alias("p")).select("company_id", "p.name", F.lit(0).alias("priority"), F.col("p.no").alias("first_at"))
    out = S.owner_in_name(people, companies)
    return out.select("company_id", F.col(out.columns[-1]).alias("owner")).where("owner is not null")


@query("social_links", """
select c_custkey as company_id, case when c_custkey % 2 = 0 then 'https://de.linkedin.com/company/x' end as linkedin_url, case when c_custkey % 3 = 0 then 'https://www.xing.com/pages/x' end as xing_url,
  case when c_custkey % 5 = 0 then 'https://wa.me/491715550123' end as whatsapp_url from customer""")
def social_links(spark, sf):
    k = F.col("c_custkey")
    link = lambda href, kind, when: F.when(when, F.struct(F.lit(href).alias("href"), F.lit(kind).alias("kind")))
    links = F.filter(F.array(
        link("https://linkedin.de/other", "external", F.lit(True)), link("https://de.linkedin.com/company/x", "social", k % 2 == 0), link("https://de.linkedin.com/company/late", "social", k % 2 == 0),
        link("https://www.xing.com/pages/x", "social", k % 3 == 0), link("https://wa.me/message/AB", "whatsapp", F.lit(True)), link("whatsapp://send?phone=%2B491715550123", "whatsapp", k % 5 == 0),
    ), lambda x: x.isNotNull())
    docs = table(spark, sf, "customer").select(k.alias("company_id"), k.alias("page_id"), F.lit(0).alias("page_ord"), links.alias("links"))
    return C.social_links(docs).select("company_id", "linkedin_url", "xing_url", "whatsapp_url")


@query("employment_evidence", """
with d as (select source, doc_id, regexp_matches(text, '(?i)(?:festangestellt|unbefristet)') as never from documents)
select c_custkey as company_id, case when c_custkey % 3 = 0 or c_custkey % 4 = 0 then 'angestellt' when c_custkey % 5 = 0 then 'frei' end as status,
  array_to_string([x for x in [case when c_custkey % 3 = 0 then '+ „Wir sind alle festangestellt hier.“ (u)' end, case when c_custkey % 4 = 0 then '+ Rolle „Büroleitung“: Ida Lenz' end, case when c_custkey % 5 = 0 then '− „Nur auf Provisionsbasis, bitte.“ (u)' end] if x is not null], '; ') as evidence
from customer where c_custkey % 3 = 0 or c_custkey % 4 = 0 or c_custkey % 5 = 0""")
def employment_evidence(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 3 == 0, "Wir sind alle festangestellt hier.\n").otherwise("Guten Tag.\n"), F.when(k % 5 == 0, "Nur auf Provisionsbasis, bitte.").otherwise("Bis bald."))
    split = F.explode(F.split(text, "\n"))
    docs = table(spark, sf, "customer").select(k.alias("company_id"), split.alias("text")).withColumn("page_id", F.xxhash64("company_id", "text"))
    docs = docs.select("company_id", "page_id", F.lit(0).alias("page_ord"), F.lit("u").alias("url"), F.lit("sonstige").alias("kind"), "text")
    at = F.struct(F.lit(0).alias("group_no"), F.lit(0).alias("page_ord"), F.lit(0).alias("page_id"), F.lit(0).alias("line_no"), F.lit(0).alias("sub_no"))
    people = table(spark, sf, "customer").where(k % 4 == 0).select(k.alias("company_id"), F.lit("Büroleitung").alias("role"), F.lit("Ida Lenz").alias("name"), at.alias("first_at"))
    out = C.employment(C.page_signals(docs), people)
    return out.select("company_id", F.col("employment_signal").alias("status"), F.array_join("employment_evidence", "; ").alias("evidence"))


@query("call_indicators", """
select c_custkey as company_id, array_to_string([x for x in [case when c_custkey % 2 = 0 then 'Karriere-/Stellenseite vorhanden' end, case when c_custkey % 4 = 0 then 'sucht Personal' end,
  case when c_custkey % 3 = 0 then 'KI/Digitalisierung auf der Website erwähnt' end, case when c_custkey % 5 = 0 then 'Weiterbildung auf der Website erwähnt' end] if x is not null], ';') as indicators from customer""")
def call_indicators(spark, sf):
    """Flags found on pages, then the labelled list."""
    k = F.col("c_custkey")
    text = F.concat_ws(" ", F.when(k % 4 == 0, "Wir suchen dich: bewirb dich."), F.when(k % 3 == 0, "Mit KI und mehr."), F.when(k % 5 == 0, "Jedes Jahr eine Fortbildung."))
    docs = table(spark, sf, "customer").select(
        k.alias("company_id"), k.alias("page_id"), F.lit(0).alias("page_ord"), F.lit("u").alias("url"), F.when(k % 2 == 0, "karriere").otherwise("sonstige").alias("kind"), text.alias("text")
    )
    flags = C.site_flags(C.page_signals(docs))
    none = F.lit(None)
    listed = C.call_indicators(F.col("career"), F.col("hiring"), F.col("digital"), F.col("training"), none.cast("boolean"), none.cast("int"), none.cast("string"))
    return flags.select("company_id", F.array_join(listed, ";").alias("indicators"))


@query("scalar_helpers", """
select page_id, left(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 60) as stem, sha1('{"a":"' || page_id || '","b":"x"}') as request from pages""")
def scalar_helpers(spark, sf):
    pages = table(spark, sf, "pages")
    key = T.request_key(b=F.lit("x"), a=F.col("page_id").cast("string"))
    return pages.select("page_id", urls.file_stem(F.col("url")).alias("stem"), key.alias("request"))
