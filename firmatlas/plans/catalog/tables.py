"""Queries over events, orders, parts and customers: windows, rank selection, merging, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmatlas.functions import company as CO
from firmatlas.operators.guard import retain
from firmatlas.operators.people import attach_unique
from firmatlas.operators.resolve import fresh_values, join_in_order, merge_records, unseen
from firmatlas.operators.skew import chunk_window, chunked, first_by, top_rows, upper_median
from firmatlas.plans.catalog.base import query, table


@query("lookback_asof", """
select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls)
   over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as last_signup,
   max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 4 preceding and 1 preceding) as error_before
from events""")
def lookback_asof(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    cut = chunked(rows, ["user_id"], F.date_trunc("day", "ts"), ["ts", "event_id"], before=4)
    w = chunk_window(["user_id"], ["ts", "event_id"])
    return cut.select(
        "event_id", "user_id", "_halo",
        F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(-4, 0)).alias("last_signup"),
        F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w.rowsBetween(-4, -1)).alias("error_before"),
    ).where(~F.col("_halo")).drop("_halo")


@query("first_nonnull_merge", """
select user_id, arg_min(value, event_id) filter (event_type = 'purchase') as first_purchase_value,
  arg_min(event_type, event_id) filter (value > 50) as first_big_type, arg_min(props, event_id) as first_props, min(event_id) as first_event from events group by 1""")
def first_nonnull_merge(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(
        first_by(F.col("value"), F.col("event_id"), F.col("event_type") == "purchase").alias("first_purchase_value"),
        first_by(F.col("event_type"), F.col("event_id"), F.col("value") > 50).alias("first_big_type"),
        F.min_by("props", "event_id").alias("first_props"), F.min("event_id").alias("first_event"),
    )


@query("record_merge", """
with r as (select user_id as cluster, event_id as ord, case when event_type = 'error' then '' else event_type end as name,
    case when value < 20 then null else value end as amount, event_type as query from events)
select cluster, arg_min(name, ord) filter (name <> '') as name, arg_min(amount, ord) filter (amount is not null) as amount, min(ord) as ord,
  (select string_agg(query, ' | ' order by f) from (select query, min(ord) as f from r r2 where r2.cluster = r.cluster group by 1)) as query from r group by cluster""")
def record_merge(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("cluster"), F.col("event_id").alias("ord"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("name"),
        F.when(F.col("value") >= 20, F.col("value")).alias("amount"), F.col("event_type").alias("query"),
    )
    return merge_records(rows)


@query("ordered_distinct_join", """
select user_id, string_agg(event_type, ' | ' order by f) as types from (select user_id, event_type, min(event_id) as f from events group by 1, 2) group by 1""")
def ordered_distinct_join(spark, sf):
    return join_in_order(table(spark, sf, "events"), ["user_id"], "event_type", "event_id", " | ", "types")


@query("ttl_latest", """
with n as (select max(ts) as now from events), l as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events)
select user_id, event_type, event_id, value from l, n where rn = 1 and ts >= now - interval 1 day""")
def ttl_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    now = e.agg(F.max("ts").alias("now"))
    keys = ["user_id", "event_type"]
    # one row; a scalar subquery in SQL terms
    return fresh_values(e, keys, "ts", "event_id", F.lit(now.first()["now"]), 1).select(*keys, "event_id", "value")


@query("ttl_purge_count", """
with n as (select max(ts) as now from events) select event_type, count(*) filter (ts < now - interval 10 day) as expired, count(*) as n from events, n group by 1""")
def ttl_purge_count(spark, sf):
    e = table(spark, sf, "events")
    limit = F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("interval 10 days")
    return e.groupBy("event_type").agg(F.count_if(F.col("ts") < limit).alias("expired"), F.count("*").alias("n"))


@query("retention_filter", """
with n as (select max(ts) as now from events) select event_id, user_id, event_type from events, n where ts >= now - interval 7 day""")
def retention_filter(spark, sf):
    e = table(spark, sf, "events")
    return retain(e, "ts", F.lit(e.agg(F.max("ts")).first()[0]), 7).select("event_id", "user_id", "event_type")


@query("unseen_companies", """
with b as (select event_id as ord, user_id || '/' || strftime(ts, '%Y-%m-%d') as place_id, event_type || (event_id % 2503) as domain, event_type from events),
 seen as (select place_id, 'view' || substr(domain, 6) as domain from b where event_type = 'error'), batch as (select * from b where event_type <> 'error'),
 f as (select *, row_number() over (order by ord) as n from batch where place_id not in (select place_id from seen) and domain not in (select domain from seen)),
 r as (select cast(0 as bigint) as n, cast([] as varchar[]) as ids, cast([] as varchar[]) as domains, false as taken
   union all select f.n, case when t then list_append(ids, place_id) else ids end, case when t then list_append(domains, domain) else domains end, t
   from (select f.*, r.ids, r.domains, not list_contains(r.ids, f.place_id) and not list_contains(r.domains, f.domain) as t
         from r join f on f.n = r.n + 1) f)
select f.place_id, f.domain, f.ord from r join f using (n) where r.taken""".replace("with b as", "with recursive b as", 1))
def unseen_companies(spark, sf):
    """Error events play the companies of earlier runs, all other events the new batch."""
    b = table(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("place_id"),
        F.concat("event_type", (F.col("event_id") % 2503).cast("string")).alias("domain"), "event_type",
    )
    seen = b.where("event_type = 'error'").withColumn("domain", F.concat(F.lit("view"), F.substring("domain", 6, 9)))
    return unseen(b.where("event_type <> 'error'").drop("event_type"), seen).select("place_id", "domain", "ord")


@query("json_extract", """
select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint)) as total, count(*) filter (json_extract_string(props, '$.k') is null) as missing
from events group by 1""")
def json_extract(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("p.k").alias("total"), F.count_if(F.col("p.k").isNull()).alias("missing")
    )


@query("upper_median_pick", """
with r as (select o_custkey, o_orderkey, cast(floor(o_totalprice / 100) as bigint) as point,
    row_number() over (partition by o_custkey order by cast(floor(o_totalprice / 100) as bigint), o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders)
select o_custkey, o_orderkey, point from r where rn = n // 2 + 1""")
def upper_median_pick(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100).alias("point"))
    blocks = rows.withColumn("_block", F.floor(F.col("o_orderkey") / 65536))
    return upper_median(blocks, ["o_custkey"], "point", ["_block", "o_orderkey"], width=512).select("o_custkey", "o_orderkey", "point")


@query("upper_median_by_status", """
with r as (select o_orderstatus, o_orderkey, cast(floor(o_totalprice / 100) as bigint) as point,
    row_number() over (partition by o_orderstatus order by cast(floor(o_totalprice / 100) as bigint), o_orderkey) as rn, count(*) over (partition by o_orderstatus) as n from orders)
select o_orderstatus, o_orderkey, point from r where rn = n // 2 + 1""")
def upper_median_by_status(spark, sf):
    """Few keys that hold all rows: the hot-key case of the rank selection."""
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.floor(F.col("o_totalprice") / 100).alias("point"))
    blocks = rows.withColumn("_block", F.floor(F.col("o_orderkey") / 65536))
    return upper_median(blocks, ["o_orderstatus"], "point", ["_block", "o_orderkey"], width=512).select("o_orderstatus", "o_orderkey", "point")


@query("in_range_tristate", """
select p_partkey, case when lo is null and hi is null and pt is null then null when coalesce(lo, pt) is null or coalesce(hi, pt) is null then null
   when coalesce(hi, pt) < 10 then false when coalesce(lo, pt) > 30 then false else true end as fits
from (select p_partkey, case when p_partkey % 4 = 0 then null else p_size - p_partkey % 5 end as lo, case when p_partkey % 3 = 0 then null else p_size + p_partkey % 7 end as hi,
   case when p_partkey % 2 = 0 then null else p_size end as pt from part)""")
def in_range_tristate(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    size = F.struct(
        F.when(k % 4 != 0, s - k % 5).alias("lo"), F.when(k % 3 != 0, s + k % 7).alias("hi"), F.when(k % 2 != 0, s).alias("point")
    )
    return table(spark, sf, "part").select("p_partkey", CO.in_range(size, F.lit(10), F.lit(30)).alias("fits"))


@query("attach_unique", """
with o as (select c_nationkey, c_mktsegment, c_custkey, floor(c_acctbal / 200) as bucket from customer),
 f as (select c_nationkey, c_custkey as full_key, max(c_custkey) as owner from o group by 1, 2),
 l as (select c_nationkey, bucket, min(c_custkey) as owner from o group by 1, 2 having count(*) = 1),
 i as (select o_orderkey, c_nationkey, case when o_orderkey % 3 = 0 then c_custkey else -1 end as full_key, bucket from orders join o on o_custkey = c_custkey)
select o_orderkey, coalesce(f.owner, l.owner) as owner from i left join f using (c_nationkey, full_key) left join l on l.c_nationkey = i.c_nationkey and l.bucket = i.bucket""")
def attach_unique_query(spark, sf):
    owners = table(spark, sf, "customer").select(
        "c_nationkey", F.col("c_custkey").alias("full_key"), F.floor(F.col("c_acctbal") / 200).alias("bucket"), F.col("c_custkey").alias("owner")
    )
    items = (
        table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(owners.drop("owner"), F.col("o_custkey") == F.col("full_key"))
        .withColumn("full_key", F.when(F.col("o_orderkey") % 3 == 0, F.col("full_key")).otherwise(-1))
        .select("o_orderkey", "c_nationkey", "full_key", "bucket")
    )
    return attach_unique(items, owners, ["c_nationkey"], "full_key", "bucket", "owner").select("o_orderkey", "owner")


@query("lead_order", """
select s_suppkey, n_name, cast(greatest(0, least(100, floor(s_acctbal / 90))) as bigint) as score,
   row_number() over (partition by n_name order by cast(greatest(0, least(100, floor(s_acctbal / 90))) as bigint) desc, lower(s_name), s_suppkey) as rank
from supplier join nation on s_nationkey = n_nationkey qualify rank <= 3""")
def lead_order(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    scored = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("s_acctbal") / 90))))
    top = top_rows(scored, ["n_name"], [F.col("score").desc(), F.lower("s_name"), F.col("s_suppkey")], 3)
    return top.select("s_suppkey", "n_name", "score", F.col("rank").cast("bigint").alias("rank"))


@query("search_tasks", """
with q as (select unnest(['Steuerberater', 'Pflegedienst BRAZIL', 'Makler in germany']) as query, generate_subscripts([1, 2, 3], 1) - 1 as no),
 c as (select distinct n_name as city, case when n_nationkey % 2 = 0 then cast(6.0 as double) end as radius_km from nation)
select city, cast(no as integer) as query_no, query, case when contains(' ' || lower(query) || ' ', ' ' || lower(city) || ' ') then query else query || ' ' || city end as text,
   coalesce(radius_km, cast(20.0 as double)) as radius_km from c, q""")
def search_tasks_query(spark, sf):
    from firmatlas.sources.spec import build_spec, search_tasks

    places = table(spark, sf, "nation").select(F.col("n_name").alias("city"), F.when(F.col("n_nationkey") % 2 == 0, 6.0).alias("radius_km"))
    spec = build_spec(["Steuerberater", "Pflegedienst BRAZIL", "Makler in germany"], radius_km=20.0)
    return search_tasks(places, spec).select("city", F.col("query_no").alias("query_no"), "query", "text", "radius_km")
