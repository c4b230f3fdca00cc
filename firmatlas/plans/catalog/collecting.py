"""Queries over collected companies: search hits, chain rules, suffix and number tables, resolution batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from firmatlas.functions import urls
from firmatlas.operators import prefixes as PX
from firmatlas.operators.entities import EntityStore
from firmatlas.operators.exclusion import exclusion_reasons
from firmatlas.operators.resolve import unseen
from firmatlas.plans import collect as CL
from firmatlas.plans.catalog.base import query, sql_host, table
from firmatlas.session import checkpoint_dir, spread

_PART = "struct<longText:string,shortText:string,types:array<string>,languageCode:string>"
_LIMIT = 45


def _answers(spark, sf):
    """Three answer pages of twenty places per customer; neighbouring customers find the same places."""
    k = F.col("c_custkey")

    def place(page, i):
        n = F.floor((k * 3 + page * 7 + i) / 2)
        country = F.struct(F.lit("Österreich").alias("longText"), F.lit("AT").alias("shortText"), F.array(F.lit("country")).alias("types"), F.lit("de").alias("languageCode")).cast(_PART)
        return F.struct(
            F.concat(F.lit("g"), n.cast("string")).alias("id"),
            F.struct(F.when(n % 11 != 3, F.concat(F.lit("Haus "), n.cast("string"))).alias("text"), F.lit("de").alias("languageCode")).alias("displayName"),
            F.lit("").alias("formattedAddress"), F.when(n % 13 == 5, F.array(country)).alias("addressComponents"),
            F.lit(None).cast("struct<latitude:double,longitude:double>").alias("location"),
            # some hits of a place have its number, others not
            F.when((n + k) % 3 == 0, F.concat(F.lit("0221 55"), F.lpad(F.floor(n / 5).cast("string"), 6, "0"))).alias("nationalPhoneNumber"),
            F.lit("").alias("internationalPhoneNumber"), F.when(n % 4 == 1, F.concat(F.lit("https://www.haus"), F.floor(n / 20).cast("string"), F.lit(".de/"))).alias("websiteUri"),
            F.lit("t").alias("primaryType"), F.lit(None).cast("array<string>").alias("types"), F.lit(None).cast("double").alias("rating"),
            F.lit(None).cast("int").alias("userRatingCount"), F.lit("OPERATIONAL").alias("businessStatus"), F.lit("").alias("googleMapsUri"),
        )

    # dealt before: the customers of all searches may be one split
    pages = spread(table(spark, sf, "customer").select(k), "c_custkey").select(k, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page_no"))
    places = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: place(F.col("page_no"), i))
    return pages.select(k.alias("task_no"), "page_no", F.concat(F.lit("Suche "), (k % 7).cast("string")).alias("query"), places.alias("places"))


_SQL_HITS = f"""
 a as (select c_custkey as k, page, i, (c_custkey * 3 + page * 7 + i) // 2 as n from customer, range(3) p(page), range(20) r(i)),
 u as (select k, page, i, n, (k * 4096 + page) * 4096 + i as ord, 'g' || n as place_id, 'Haus ' || n as name, 'Suche ' || (k % 7) as query,
    case when (n + k) % 3 = 0 then '0221 55' || lpad(cast(n // 5 as varchar), 6, '0') end as phone, case when n % 4 = 1 then 'haus' || (n // 20) || '.de' end as domain
    from a where n % 11 <> 3 and n % 13 <> 5),
 hits as (select * from u qualify row_number() over (partition by k order by page, i) <= {_LIMIT})"""


@query("search_hits_union", f"""with {_SQL_HITS}
select place_id, min(ord) as ord, min(name) as name, arg_min(phone, ord) filter (phone is not null) as phone,
  (select string_agg(query, ' | ' order by f) from (select query, min(ord) as f from hits h2 where h2.place_id = hits.place_id group by 1)) as query from hits group by place_id""")
def search_hits_union(spark, sf):
    return CL.union_hits(CL.search_hits(_answers(spark, sf), _LIMIT)).select("place_id", "ord", "name", "phone", "query")


_RULES = f"""rules as (select 'domain' as kind, 'haus' || (s_suppkey * 3) || '.de' as pattern, s_suppkey as rule_ord from supplier
   union all select 'name', 'HAUS ' || (s_suppkey * 7), s_suppkey from supplier where s_suppkey > 0)"""


def _rules(spark, sf):
    s = F.col("s_suppkey")
    sup = table(spark, sf, "supplier")
    by_domain = sup.select(F.lit("domain").alias("kind"), F.concat(F.lit("haus"), (s * 3).cast("string"), F.lit(".de")).alias("pattern"), s.cast("long").alias("rule_ord"))
    by_name = sup.where(s > 0).select(F.lit("name").alias("kind"), F.concat(F.lit("HAUS "), (s * 7).cast("string")).alias("pattern"), s.cast("long").alias("rule_ord"))
    return by_domain.unionByName(by_name)


@query("search_companies", f"""with recursive {_SQL_HITS.strip()}, {_RULES},
 tok as (select ord as record, 'i' || place_id as token from hits union all select ord, 'd' || domain from hits where domain is not null
   union all select ord, 'p' || phone from hits where phone is not null),
 hub as (select token, min(record) as hub from tok group by 1),
 edge as (select distinct hub as u, record as v from tok join hub using (token)),
 ids as (select distinct hub as u from hub),
 pair as (select distinct h.hub as a, h2.hub as b from tok t join hub h using (token) join tok t2 on t2.record = t.record join hub h2 on h2.token = t2.token where h.hub <> h2.hub),
 walk(hub, label) as (select u, u from ids union select p.b, w.label from walk w join pair p on p.a = w.hub where w.label < p.b),
 lab as (select hub, min(label) as label from walk group by 1),
 c as (select t.record, min(l.label) as cluster from tok t join hub h using (token) join lab l on l.hub = h.hub group by 1),
 m as (select cluster, min(ord) as ord, arg_min(place_id, ord) as place_id, arg_min(name, ord) as name, arg_min(domain, ord) filter (domain is not null) as domain
   from hits join c on record = ord group by 1),
 named as (select ord, arg_min(pattern, rule_ord) as pattern from m join rules on kind = 'name' and contains(lower(name), lower(pattern)) group by 1)
select m.ord, place_id, name, domain, case when domain in (select pattern from rules where kind = 'domain') then 'Kette/Franchise (Domain ' || domain || ')'
   when pattern is not null then 'Kette/Franchise (Name „' || lower(pattern) || '“)' end as reason from m left join named using (ord)""")
def search_companies(spark, sf):
    found = CL.search_companies(_answers(spark, sf), _rules(spark, sf), _LIMIT)
    return found.select("ord", "place_id", "name", "domain", "reason")


@query("exclusion_rule_table", """
with rules as (select lower(p_name) as pattern, p_partkey as rule_ord from part where p_partkey % 10 = 0
   union all select lpad(cast(p_partkey * 7 % 10000 as varchar), 4, '0'), 1000000 + p_partkey from part union all select '#' || substr(p_brand, 7), 2000000 + p_partkey from part),
 names as (select c_custkey, c_name || case c_custkey % 50 when 7 then ' Small Ring' when 9 then ' red widget' else '' end as name from customer),
 hit as (select c_custkey, min(rule_ord) as o, arg_min(pattern, rule_ord) as pattern from names join (select pattern, min(rule_ord) as rule_ord from rules group by 1) on contains(lower(name), pattern) group by 1)
select c_custkey, 'Kette/Franchise (Name „' || pattern || '“)' as reason from names left join hit using (c_custkey)""")
def exclusion_rule_table(spark, sf):
    """About two rules for each part against all customer names."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    part = table(spark, sf, "part")
    rules = part.where(p % 10 == 0).select(F.upper("p_name").alias("pattern"), p.alias("rule_ord"))
    rules = rules.unionByName(part.select(F.lpad((p * 7 % 10000).cast("string"), 4, "0").alias("pattern"), (p + 1000000).alias("rule_ord")))
    rules = rules.unionByName(part.select(F.concat(F.lit("#"), F.substring("p_brand", 7, 9)).alias("pattern"), (p + 2000000).alias("rule_ord")))
    extra = F.when(k % 50 == 7, " Small Ring").when(k % 50 == 9, " red widget").otherwise("")
    rows = table(spark, sf, "customer").select(k, F.concat("c_name", extra).alias("name"), F.lit(None).cast("string").alias("domain"))
    return exclusion_reasons(rows, rules.withColumn("kind", F.lit("name")), key="c_custkey").select("c_custkey", "reason")


# rows of a suffix list with a wildcard, an exception, and endings of several lengths
_SUFFIX_LINES = ("// of the test hosts", "com", "net", "org", "example.com", "*.example.net", "!tiontion.example.net", "blog.tionsh.example.com", "")
_SQL_SUFFIX = """
 h as (select distinct {host} as host from pages where {host} <> ''), l as (select host, string_split(host, '.') as p from h),
 r as (select unnest(['com', 'net', 'org', 'example.com', 'example.net', 'tiontion.example.net', 'blog.tionsh.example.com']) as ending, unnest([0, 0, 0, 0, 1, 2, 0]) as kind
   union all select 'example.net', 1 where false),
 t as (select host, p, n, array_to_string(p[-n:], '.') as ending from l, range(1, 9) g(n) where n <= len(p)),
 m as (select host, p, max(case kind when 2 then 1000 + n - 1 when 1 then case when len(p) > n then n + 1 end when 0 then n end) as best from t left join r using (ending) group by 1, 2),
 s as (select host, p, coalesce(case when best >= 1000 then best - 1000 else best end, 1) as n from m)"""


@query("suffix_table_domain", f"""with {_SQL_SUFFIX.format(host=sql_host('url')).strip()}
select host, cast(n as integer) as suffix_labels, case when len(p) > n then array_to_string(p[-(n + 1):], '.') end as domain from s""")
def suffix_table_domain(spark, sf):
    rules = PX.suffix_rules(spark.createDataFrame([(x,) for x in _SUFFIX_LINES], "rule string"))
    hosts = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"))
    return PX.registrable_hosts(hosts, rules)


# invented plan: prefix, region, shortest and longest whole number, kind
_PLAN = (("1", "NA", 11, 11, "landline"), ("49", "DE", 8, 14, "landline"), ("4915", "DE", 12, 13, "mobile"), ("49151", "DE", 13, 13, "mobile"), ("4932", "DE", 9, 14, "voip"), ("44", "GB", 12, 12, "landline"), ("447", "GB", 12, 12, "mobile"))


@query("number_plan_table", f"""
with d as (select distinct [('1' || lpad(cast(o_orderkey * 37 % 10000000000 as varchar), 10, '2')), '4915' || (o_orderkey % 10) || lpad(cast(o_orderkey as varchar), cast(7 + o_orderkey % 3 as integer), '0'),
    '493' || (o_orderkey % 7) || o_orderkey, '447' || lpad(cast(o_orderkey as varchar), 9, '0'), '99' || o_orderkey][o_orderkey % 5 + 1] as digits from orders),
 plan as (select * from (values {', '.join(f"('{p}', '{r}', {a}, {b}, '{k}')" for p, r, a, b, k in _PLAN)}) t(prefix, region, lo, hi, kind)),
 m as (select digits, prefix, region, lo, hi, kind from d left join plan on starts_with(digits, prefix) qualify row_number() over (partition by digits order by length(prefix) desc) = 1)
select digits, prefix, region, case when length(digits) between lo and hi then kind else 'unknown' end as kind, coalesce(length(digits) between lo and hi, false) as valid from m""")
def number_plan_table(spark, sf):
    o = F.col("o_orderkey")
    t = o.cast("string")
    made = F.array(
        F.concat(F.lit("1"), F.lpad((o * 37 % 10000000000).cast("string"), 10, "2")),
        F.concat(F.lit("4915"), (o % 10).cast("string"), F.lpad(t, (7 + o % 3).cast("int"), F.lit("0"))),
        F.concat(F.lit("493"), (o % 7).cast("string"), t), F.concat(F.lit("447"), F.lpad(t, 9, "0")), F.concat(F.lit("99"), t),
    )
    plan = spark.createDataFrame(list(_PLAN), "prefix string, region string, min_len int, max_len int, kind string")
    numbers = table(spark, sf, "orders").select(F.get(made, (o % 5).cast("int")).alias("digits"))
    return PX.number_kinds(numbers, plan)


_KEYS = """select c_custkey as record, 'p' || (c_custkey * 7 % (select count(*) // 2 from customer)) as token from customer
   union all select c_custkey, 'd' || (c_custkey // 6) from customer where c_custkey % 6 < 2 union all select c_custkey, 'h' from customer where c_custkey % 100 = 3"""


@query("entities_in_batches", f"""
with recursive keys as ({_KEYS}),
 hub as (select token, min(record) as hub from keys group by 1),
 edge as (select distinct record as u, hub as v from keys join hub using (token) where record <> hub),
 sym as (select u, v from edge union select v, u from edge),
 walk(record, label) as (select distinct record, record from keys union select b.v, w.label from walk w join sym b on b.u = w.record where w.label < b.v)
select record, min(label) as cluster from walk group by 1""")
def entities_in_batches(spark, sf):
    """Customers arrive in four batches, the last numbers first; the last batch is sent twice."""
    customers = table(spark, sf, "customer").select("c_custkey")
    n = customers.count()
    k = F.col("c_custkey")
    named = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    tokens = F.array(named("p", k * 7 % max(n // 2, 1)), F.when(k % 6 < 2, named("d", F.floor(k / 6))), F.when(k % 100 == 3, F.lit("h")))
    pairs = customers.select(k.cast("long").alias("record"), F.explode(F.filter(tokens, lambda t: t.isNotNull())).alias("token"))
    store = EntityStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/entities-{uuid.uuid4().hex}")
    for batch, part in enumerate((3, 1, 0, 2, 2)):
        store.add(pairs.where(F.col("record") % 4 == part), min(batch, 3))
    return store.current()


@query("unseen_chain", """
with recursive b as (select o_orderkey as ord, 'i' || (o_orderkey // 2) as place_id, 'd' || ((o_orderkey + 1) // 2) as domain from orders),
 r as (select cast(0 as bigint) as ord, true as taken union all select b.ord, not taken from r join b on b.ord = r.ord + 1)
select b.ord, b.place_id, b.domain from r join b using (ord) where taken""")
def unseen_chain(spark, sf):
    """All orders as one chain: each has the id of the one before or the domain of the one behind it."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("ord"), F.concat(F.lit("i"), F.floor(k / 2).cast("string")).alias("place_id"), F.concat(F.lit("d"), F.floor((k + 1) / 2).cast("string")).alias("domain")
    )
    none = spark.createDataFrame([], "place_id string, domain string")
    return unseen(rows, none).select("ord", "place_id", "domain")
