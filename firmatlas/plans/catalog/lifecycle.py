"""Queries over what runs keep: lifetimes, erasure, snapshots, counters, and crawls in rounds."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from firmatlas.operators import erase as ER
from firmatlas.operators import frontier as FR
from firmatlas.operators import legal as L
from firmatlas.operators import pages as PG
from firmatlas.plans.catalog.base import query, table
from firmatlas.plans.catalog.sites import _SQL_BASE, _boss
from firmatlas.plans.enrich import stage_pages
from firmatlas.session import checkpoint_dir, write_stage
from firmatlas.sources.readers import prepare_pages
from firmatlas.streaming.published import Published
from firmatlas.streaming.ttl import lifetimes

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("stream_lifetimes", """
with recursive slice as (select min(ts) as lo, max(ts) as hi from events),
 t as (select user_id, event_type, min(ts) as began from events group by 1, 2
   union all select e.user_id, e.event_type, min(e.ts) from t join events e on e.user_id = t.user_id and e.event_type = t.event_type and e.ts > t.began + interval 36 hour group by e.user_id, e.event_type, t.began),
 n as (select *, lead(began) over (partition by user_id, event_type order by began) as again from t)
select user_id, event_type, count(*) as taken, count(*) filter (again is not null or began + interval 36 hour < (select hi from slice)) as purged from n group by 1, 2""")
def stream_lifetimes(spark, sf):
    """Events in four time slices, each read by a run of its own that goes on with the state of the run before."""
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    src, out, before = _folder(spark, "feed"), _folder(spark, "stream"), spark.conf.get(STORE)
    step = (hi - lo) / 4 if lo else timedelta(1)
    spark.conf.set(STORE, ROCKS)
    try:
        for i in range(4):
            inside = (F.col("ts") >= F.lit(lo + i * step)) & (F.col("ts") < F.lit(lo + (i + 1) * step) if i < 3 else F.lit(True)) if lo else F.lit(False)
            rows.where(inside).write.mode("append").parquet(src)
            lives = lifetimes(spark.readStream.schema(rows.schema).parquet(src), ["user_id", "event_type"], "ts", timedelta(hours=36))
            run = lives.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    told = spark.read.schema("user_id bigint, event_type string, ts timestamp, event string").parquet(f"{out}/rows")
    return told.groupBy("user_id", "event_type").agg(F.count_if(F.col("event") == "taken").alias("taken"), F.count_if(F.col("event") == "purged").alias("purged"))


_ERASED = """
 n as (select max(ts) as now from events), e as (select *, cast(ts as date) as day, 'user' || user_id || '@x.de' as email from events),
 bad as (select distinct 'user' || user_id || '@x.de' as email from events where event_id % 997 = 5 and event_type = 'error')"""


def _stored_events(spark, sf):
    """Events as a stored table by day, with an address per user, and an objection list."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("email", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@x.de")))
    path = _folder(spark, "events-by-day")
    ER.write_by_day(e, path, "ts")
    bad = e.where("event_id % 997 = 5 and event_type = 'error'")
    return path, bad.select(F.lit("email").alias("kind"), F.upper("email").alias("key")), e.agg(F.max("ts")).first()[0]


@query("erase_by_day", f"""with {_ERASED}
select day, count(*) as rows, sum(event_id) as ids from e, n where ts >= now - interval 240 hour and email not in (select email from bad) group by 1""")
def erase_by_day(spark, sf):
    path, objections, now = _stored_events(spark, sf)
    ER.erase(spark, path, objections, now or datetime(2024, 1, 1), 10, "ts", email="email")
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


@query("erase_report", f"""with {_ERASED}, k as (select day, ts >= now - interval 240 hour and email not in (select email from bad) as stays from e, n)
select day, count(*) as rows_before, count(*) filter (stays) as rows_after from k group by 1 having not bool_and(stays)""")
def erase_report(spark, sf):
    path, objections, now = _stored_events(spark, sf)
    return ER.erase(spark, path, objections, now or datetime(2024, 1, 1), 10, "ts", email="email")


@query("published_snapshot", "select user_id, count(*) as n from events where event_id % 3 <> 2 group by 1")
def published_snapshot(spark, sf):
    """Three exports: the second grows, the third is sent again and then one stops before its manifest."""
    e = table(spark, sf, "events")
    counts = lambda parts: e.where(F.col("event_id") % 3 < parts).groupBy("user_id").agg(F.count("*").alias("n"))
    shown = Published(spark, _folder(spark, "published"), "user_id bigint, n bigint")
    shown.publish(counts(1), 0)
    shown.publish(counts(2), 1)
    shown.publish(counts(3), 1)  # a batch that is there already
    counts(3).write.parquet(f"{shown.path}/data/batch=2")  # data without a manifest
    return shown.read()


def _crawl_pages(customers):
    """Start page, legal notice, team and contact page per customer, with links between them and further targets."""
    k = F.col("c_custkey")
    surname = F.element_at(F.split(_boss(), " "), -1)
    person = F.concat(F.lit("/team/"), F.lower(F.replace(_boss(), F.lit(" "), F.lit("-"))))
    link = lambda href, text: F.concat(F.lit('<p><a href="'), href, F.lit('">'), text, F.lit("</a></p>"))
    lit = F.lit
    start = F.concat(
        link(lit("/leistungen"), lit("Leistungen")), link(lit("/kontakt"), lit("Kontakt")), link(lit("/impressum#top"), lit("Impressum")),
        F.when(k % 4 != 0, link(lit("/jobs"), lit("Jobs"))).otherwise(""), link(lit("/team"), lit("Team")),
        link(lit("/mehr"), F.concat(lit("Mehr zu "), surname)), link(lit("/preise"), lit("Preise")), link(lit("/login"), lit("Login")),
    )
    legal = F.concat(lit("<h2>Impressum</h2><p>Haus GmbH</p><p>Geschäftsführer: "), _boss(), lit("</p><p>HRB 7</p>"), link(lit("/leistungen/"), lit("Leistungen")), link(lit("/recht"), lit("Disclaimer")))
    team = F.concat(lit("<h2>Team</h2>"), link(person, _boss()), F.when(k % 3 == 0, link(lit("/anfahrt"), lit("Anfahrt"))).otherwise(""))
    pages = F.array(*[F.struct(lit(i).alias("no"), lit(p).alias("path"), h.alias("html")) for i, (p, h) in enumerate((("/", start), ("/impressum", legal), ("/team", team), ("/kontakt", lit("<p>Post</p>"))))])
    return customers.select(k.alias("_k"), F.explode(pages).alias("p")).select(
        F.concat(lit("c"), F.col("_k").cast("string")).alias("company_id"), (F.col("_k") * 4 + F.col("p.no")).alias("page_id"),
        F.concat(lit("https://www.haus"), F.col("_k").cast("string"), lit(".example"), F.col("p.path")).alias("url"), F.col("p.html").alias("html"),
    )


@query("crawl_rounds", f"""with {_SQL_BASE},
 w as (select *, lower(replace(boss, ' ', '-')) as slug from k),
 a as (select company_id, k, slug, unnest([{{'r': 1, 'rank': 1, 'p': '/impressum', 'prio': 0, 'h': false}}, {{'r': 1, 'rank': 2, 'p': '/kontakt', 'prio': 1, 'h': false}}, {{'r': 1, 'rank': 3, 'p': '/team', 'prio': 2, 'h': false}},
   {{'r': 1, 'rank': 4, 'p': case when k % 4 <> 0 then '/jobs' end, 'prio': 3, 'h': false}},
   {{'r': 2, 'rank': 1, 'p': case when k % 4 = 0 then case when k % 3 = 0 then '/anfahrt' else '/mehr' end end, 'prio': case when k % 3 = 0 then 1 else 4 end, 'h': k % 3 <> 0}},
   {{'r': 3, 'rank': 1, 'p': case when k % 3 = 0 and k % 4 <> 0 then '/anfahrt' when k % 4 <> 0 then '/mehr' when k % 3 = 0 then '/mehr' else '/team/' || slug end,
     'prio': case when k % 3 = 0 and k % 4 <> 0 then 1 else 4 end, 'h': not (k % 3 = 0 and k % 4 <> 0)}},
   {{'r': 3, 'rank': 2, 'p': case when k % 3 = 0 and k % 4 <> 0 then '/mehr' when k % 4 <> 0 or k % 3 = 0 then '/team/' || slug end, 'prio': 4, 'h': true}},
   {{'r': 3, 'rank': 3, 'p': case when k % 3 = 0 and k % 4 <> 0 then '/team/' || slug end, 'prio': 4, 'h': true}}]) as s from w)
select company_id, cast(s.r as integer) as round_no, cast(s.rank as integer) as rank, 'https://www.haus' || k || '.example' || s.p as href, cast(s.prio as integer) as priority, s.h as hinted from a where s.p is not null""")
def crawl_rounds(spark, sf):
    """Two rounds within a budget of five pages, then up to three more; names of the legal notices are known from the second round on."""
    docs = stage_pages(prepare_pages(_crawl_pages(table(spark, sf, "customer"))), "crawl")
    from firmatlas.functions import urls

    # pages are read once; a round takes up what the pages of the round before gave
    base = docs.select("company_id", "page_id", "page_ord", "links", urls.page_key(F.col("url")).alias("page_key"), urls.registrable_domain(F.col("url")).alias("base_domain"))
    people_on = write_stage(L.legal_mentions(docs), "crawl-people").withColumn("page_key", urls.page_key(F.col("url")))
    state = FR.start_crawl(docs.where("kind = 'startseite'").select("company_id", "url"))
    loaded, chosen = state.asked.select("company_id", "page_key"), []
    for round_no, extra in ((1, None), (2, None), (3, 3)):
        read = lambda rows: rows.join(loaded, ["company_id", "page_key"], "left_semi").drop("page_key")  # noqa: B023, E731
        new = read(base).select("company_id", "page_id", "page_ord", "base_domain", F.posexplode("links").alias("link_no", "l"))
        new = new.select("company_id", "page_id", "page_ord", "link_no", "l.href", "l.text", "l.kind", "base_domain")
        people = L.mentioned_people(read(people_on)) if round_no > 1 else None
        state, pages = FR.next_round(state, new, round_no, budget=5, extra=extra, legal_people=people)
        loaded = pages.select("company_id", "page_key")
        chosen.append(pages.select("company_id", F.lit(round_no).alias("round_no"), "rank", "href", "priority", "hinted"))
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
