"""Collecting, resolving and keeping data batch by batch: hits, chain rules, tables of prefixes, entities, lifetimes, erasure."""

import os
import random
import shutil
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from firmatlas.operators import entities as EN
from firmatlas.operators import erase as ER
from firmatlas.operators import exclusion as EX
from firmatlas.operators import frontier as FR
from firmatlas.operators import prefixes as PX
from firmatlas.operators import resolve as RS
from firmatlas.operators.contacts import emails_in_text
from firmatlas.operators.resolve import clusters, unseen
from firmatlas.operators.skew import join_counted
from firmatlas.plans import collect as CL
from firmatlas.plans.catalog.lifecycle import ROCKS, STORE
from firmatlas.sinks.meta import observed, observed_meta
from firmatlas.sinks.tables import lead_counts, run_meta
from firmatlas.sources.readers import PLACES_SCHEMA, prepare_pages, with_company_columns
from firmatlas.sources.spec import build_spec
from firmatlas.streaming.published import Published
from firmatlas.streaming.ttl import lifetimes

REPO = Path(__file__).resolve().parents[1]


# acceptance in order


def in_order(rows, seen_ids=(), seen_domains=()):
    ids, domains, out = set(seen_ids), set(seen_domains), []
    for at, i, d in sorted(rows):
        if not (i is not None and i in ids) and not (d is not None and d in domains):
            out.append(at)
            ids |= {i} - {None}
            domains |= {d} - {None}
    return out


@pytest.mark.parametrize("fold", [16384, 8])
def test_unseen_equals_reading_in_order(spark, fold):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, f"p{rng.randrange(40)}"]), rng.choice([None, f"d{rng.randrange(40)}", "hot"])) for i in range(160)]
    rows += [(200 + i, f"c{i // 2}", f"e{(i + 1) // 2}") for i in range(23)]  # a chain
    rng.shuffle(rows)
    batch = spark.createDataFrame(rows, "ord long, place_id string, domain string").repartition(5)
    seen = spark.createDataFrame([("p1", "d2"), (None, "d3"), ("p4", None)], "place_id string, domain string")
    got = sorted(r.ord for r in unseen(batch, seen, fold=fold).collect())
    assert got == in_order(rows, {"p1", "p4"}, {"d2", "d3"})


def test_long_chain_ends_in_few_jobs(spark):
    rows = spark.range(10_000).select(
        F.col("id").alias("ord"), F.concat(F.lit("i"), F.floor(F.col("id") / 2)).alias("place_id"), F.concat(F.lit("d"), F.floor((F.col("id") + 1) / 2)).alias("domain")
    )
    none = spark.createDataFrame([], "place_id string, domain string")
    tracker, group = spark.sparkContext.statusTracker(), "long-chain"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = [r.ord for r in unseen(rows, none).orderBy("ord").collect()]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == list(range(0, 10_000, 2))
    assert len(tracker.getJobIdsForGroup(group)) < 60  # adaptive plans count each shuffle; a round a link were thousands


def test_chains_much_longer_than_a_fold_end_in_few_jobs(spark):
    rows = [(i, f"i{i // 2}", f"d{(i + 1) // 2}") for i in range(600)]
    # chains that hang on two records, or on one through both keys
    rows += [(1000 + i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(40)] + [(1100, "a3", "b9"), (1101, "a19", "b20"), (1102, "x", "b20"), (1103, "x", "b20"), (1104, "x", None)]
    batch = spark.createDataFrame(rows, "ord long, place_id string, domain string")
    none = spark.createDataFrame([], "place_id string, domain string")
    tracker, group = spark.sparkContext.statusTracker(), "fold-chain"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = sorted(r.ord for r in unseen(batch, none, fold=4).collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == in_order(rows)
    assert len(tracker.getJobIdsForGroup(group)) < 400  # a round every four links were thousands


def estimate_bits(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()


def test_estimates_do_not_grow_with_the_rounds_of_a_chain(spark):
    # joins multiply estimates: kept from round to round, the number fills the driver's memory
    rows = spark.createDataFrame([(i, f"i{i // 2}", f"d{(i + 1) // 2}") for i in range(200)], "ord long, place_id string, domain string")
    assert estimate_bits(RS._along_chains(rows, "ord", ["place_id", "domain"])) < 600
    pairs = spark.createDataFrame([(i, f"{c}{(i + k) // 2}") for i in range(60) for k, c in enumerate("cd")], "record long, token string")
    assert estimate_bits(RS.clusters(pairs)) < 600


def test_chains_are_settled_through_shorter_lists(spark, monkeypatch):
    monkeypatch.setattr(RS, "SHORT", 5)
    rng = random.Random(7)
    rows = [(3 * i, f"i{i // 2}", f"d{(i + 1) // 2}") for i in range(60)]
    rows += [(1000 + i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(41)] + [(1100, "a3", "b9"), (1101, "a19", "b20"), (1102, "x", "b20"), (1103, "x", "b20"), (1104, "x", None)]
    rows += [(2000 + i, rng.choice([None, f"p{rng.randrange(40)}"]), rng.choice([None, f"q{rng.randrange(40)}"])) for i in range(40)]
    rng.shuffle(rows)
    batch = spark.createDataFrame(rows, "ord long, place_id string, domain string").withColumn("note", F.lit(None))
    got = unseen(batch, spark.createDataFrame([], "place_id string, domain string"), fold=4)
    assert got.columns == batch.columns and sorted(r.ord for r in got.collect()) == in_order(rows)


def test_records_that_say_the_same_are_linked_once(spark, monkeypatch):
    linked, whole = [], RS.clusters
    monkeypatch.setattr(RS, "clusters", lambda pairs: linked.append(pairs.count()) or whole(pairs))
    rows = [("a", "A", "https://a.de", None, f"q{i % 3}|q3", i) for i in range(40)] + [("b", "B", "https://www.a.de/x", "50667", "q9", 50), ("c", "C", None, None, "q1", 51), (None, "no key", None, None, "q1", 52)]
    make = lambda listed: with_company_columns(spark.createDataFrame(listed, "place_id string, name string, website string, plz string, query string, ord long"))
    got = sorted((r.ord, r.place_id, r.name, r.plz, r.domain, r["query"]) for r in RS.dedupe_companies(make(rows)).collect())
    assert got == [(0, "a", "A", "50667", "a.de", "q0 | q3 | q1 | q2 | q9"), (51, "c", "C", None, None, "q1")]
    assert linked == [5]  # rows of three places: not one for each record
    # records of one number are one record, whatever they say; a row without a key goes with its number
    rows += [("d", "D", None, None, "q7", 51), (None, "no key", None, "1", "q8", 51), ("e", "E", None, None, None, None)]
    got = sorted((r.ord, r.plz, r["query"]) for r in RS.dedupe_companies(make(rows)).collect())
    assert got[0] == (0, "50667", "q0 | q3 | q1 | q2 | q9") and got[1][:2] == (51, "1") and sorted(got[1][2].split(" | ")) == ["q1", "q7", "q8"] and len(got) == 2


def test_answers_are_dealt_once(spark):
    answers = spark.createDataFrame([], f"task_no long, page_no int, query string, {PLACES_SCHEMA.partition(', ')[2]}")
    plan = CL.search_hits(answers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


# entities


def test_clusters_of_exploded_keys_send_no_table(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("record")).coalesce(1).write.parquet(str(tmp_path / "records"))
    keys = F.array(*[F.concat(F.lit(f"t{i}-"), F.floor((F.col("record") + i) / 3).cast("string")) for i in range(2)])
    linked = clusters(spark.read.parquet(str(tmp_path / "records")).select("record", F.explode(keys).alias("token")))
    assert {r.cluster for r in linked.collect()} == {0}
    assert "BroadcastExchange" not in linked._jdf.queryExecution().executedPlan().toString()


def test_two_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(9)
    pairs = sorted({(r, f"t{rng.randrange(90)}") for r in range(120) for _ in range(2)} | {(r, "hot") for r in range(0, 120, 11)})
    want = {r.record: r.cluster for r in clusters(spark.createDataFrame(pairs, "record long, token string")).collect()}
    for name, cut in (("falling", lambda r: 2 - r // 40), ("mixed", lambda r: r % 3)):
        store = EN.EntityStore(spark, str(tmp_path / name))
        frames = [spark.createDataFrame([p for p in pairs if cut(p[0]) == b], "record long, token string") for b in range(3)]
        for b in (0, 1, 1, 2):  # the second batch is repeated
            store.add(frames[b], b)
        assert {r.record: r.cluster for r in store.current().collect()} == want


def test_unfinished_batch_is_not_read(spark, tmp_path):
    store = EN.EntityStore(spark, str(tmp_path / "e"))
    store.add(spark.createDataFrame([(5, "a"), (6, "a")], "record long, token string"), 0)
    spark.createDataFrame([(7, 1)], "record long, cluster long").write.parquet(str(tmp_path / "e/members/batch=1"))  # stopped here
    assert sorted(map(tuple, store.current().collect())) == [(5, 5), (6, 5)]
    store.add(spark.createDataFrame([(2, "a")], "record long, token string"), 1)
    assert sorted(map(tuple, store.current().collect())) == [(2, 2), (5, 2), (6, 2)]
    assert EN.no_entities(spark).current().collect() == []


# search hits and chain rules


def place(name, ident, phone=None):
    return {"id": ident, "displayName": {"text": name}, "nationalPhoneNumber": phone}


def test_hits_keep_their_order_under_any_split(spark):
    answers = [(t, p, f"q{t % 2}", [place(f"Haus {n}", f"g{n}", f"0221 5{n:06d}" if n % 2 else None) for n in range(t + p, t + p + 20)]) for t in range(6) for p in range(4)]
    answers += [(6, 0, "q", None), (7, 0, "q", []), (8, 0, "q", [place(" ", "x"), place("ok", ""), place("Ende", "g999")])]
    kind = PLACES_SCHEMA.split("places ", 1)[1]
    df = spark.createDataFrame(answers, f"task_no int, page_no int, query string, places {kind}")
    shown = []
    for n in (1, 3, 11):
        hits = CL.search_hits(df.repartition(n))
        shown.append(sorted((r.ord, r.place_id, r.query) for r in hits.collect()))
        both = CL.union_hits(hits)
        union = {r.place_id: (r.ord, r.phone, r.query) for r in both.select("place_id", "ord", "phone", "query").collect()}
    assert shown[0] == shown[1] == shown[2]
    assert sum(1 for o, *_ in shown[0] if o >> 24 == 0) == 60  # of 80
    assert shown[0][-1] == (8 << 24 | 2, "g999", "q")
    assert union["g3"] == (3, "0221 5000003", "q0 | q1") and union["g999"][0] == 8 << 24 | 2
    first = CL.search_hits(df.where("task_no = 0"), 5)
    assert sorted(r.place_id for r in first.collect()) == ["g0", "g1", "g2", "g3", "g4"]


def test_rules_of_any_length(spark):
    names = [(1, "Alpha Ümlaut Haus", "a.de"), (2, "beta", "chain.de"), (3, "Xy", None), (4, None, None), (5, "", "b.de"), (6, "The Alpha", "c.de"), (7, "zeta x", "d.de")]
    rules = [("name", "ALPHA", 5), ("name", "ümlaut h", 3), ("name", "y", 9), ("name", " x", 2), ("name", "alpha", 4), ("name", "", 1), ("name", "nobody has this", 0), ("domain", " Chain.DE ", 7), ("name", "beta", 8)]
    rows = spark.createDataFrame(names, "company_id long, name string, domain string")
    listed = spark.createDataFrame(rules, "kind string, pattern string, rule_ord int")
    got = {r.company_id: r.reason for r in EX.exclusion_reasons(rows, listed).collect()}
    assert got == {
        1: "Kette/Franchise (Name „ümlaut h“)", 2: "Kette/Franchise (Domain chain.de)", 3: "Kette/Franchise (Name „y“)", 4: None, 5: None,
        6: "Kette/Franchise (Name „alpha“)", 7: "Kette/Franchise (Name „x“)",
    }
    assert {r.reason for r in EX.exclusion_reasons(rows, listed.where("false")).collect()} == {None}
    plan = EX.exclusion_reasons(rows, listed)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# longest match


@pytest.mark.parametrize("most", [20_000, 10])
def test_names_are_never_sent_through_the_driver(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(EX, "join_counted", lambda rows, small, on: join_counted(rows, small, on, most))
    spark.range(4000).select("id", F.concat(F.lit("Haus "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name")).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    numbers = F.lpad((F.col("id") * 7).cast("string"), 6, "0")
    rules = spark.range(3000).select(F.concat(F.lit("HAUS "), numbers).alias("pattern"), F.col("id").alias("rule_ord"))
    hits = EX.name_hits(names, rules, "id", "name")
    got = {r.id: r.rule_ord for r in hits.collect()}
    assert got == {7 * i: i for i in range(3000) if 7 * i < 4000}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("SortMergeJoin [piece" in plan) == (most == 10)


def test_suffix_list(spark):
    lines = ["// a list", "", "com", "co.uk", "uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp"]
    hosts = ["a.b.com", "com", "x.co.uk", "www.x.co.uk", "co.uk", "a.b.c.ck", "b.ck", "ck", "www.ck", "x.www.ck", "city.kawasaki.jp", "a.b.kawasaki.jp", "b.kawasaki.jp", "kawasaki.jp", "host", "a.unknown", "", None]
    df = spark.createDataFrame([(h,) for h in hosts * 2], "host string")
    got = {r.host: r.domain for r in PX.registrable_hosts(df, PX.suffix_rules(spark.createDataFrame([(x,) for x in lines], "rule string"))).collect()}
    assert got == {
        "a.b.com": "b.com", "com": None, "x.co.uk": "x.co.uk", "www.x.co.uk": "x.co.uk", "co.uk": None, "a.b.c.ck": "b.c.ck", "b.ck": None, "ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck",
        "city.kawasaki.jp": "city.kawasaki.jp", "a.b.kawasaki.jp": "a.b.kawasaki.jp", "b.kawasaki.jp": None, "kawasaki.jp": "kawasaki.jp", "host": None, "a.unknown": "a.unknown",
    }
    back = PX.with_registrable_domain(df, PX.suffix_rules(spark.createDataFrame([("com",)], "rule string")))
    assert back.count() == len(hosts) * 2 and back.columns == ["host", "domain"]


def test_number_plan_table(spark):
    plan = spark.createDataFrame([("49", "DE", 8, 14, "landline"), ("4915", "DE", 12, 13, "mobile"), ("1", "NA", 11, 11, "landline")], "prefix string, region string, min_len int, max_len int, kind string")
    digits = spark.createDataFrame([(d,) for d in ("4915123456789", "491512345", "4930123456", "15551234567", "999", "4", "", None)], "digits string")
    got = {r.digits: (r.prefix, r.kind, r.valid) for r in PX.number_kinds(digits, plan).collect()}
    assert got == {"4915123456789": ("4915", "mobile", True), "491512345": ("4915", "unknown", False), "4930123456": ("49", "landline", True), "15551234567": ("1", "landline", True),
                   "999": (None, "unknown", False), "4": (None, "unknown", False)}


# lifetimes


def test_lifetimes_over_restarts(spark, tmp_path):
    t0 = datetime(2024, 5, 1)
    slices = [[("a", 0), ("a", 5), ("b", 1), ("a", 30), (None, 2)], [("a", 31), ("b", 60), ("c", 61)], [("a", 200), ("b", 70)]]
    schema, before = "k string, t timestamp", spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        for rows in slices:  # each slice is a run of its own
            spark.createDataFrame([(k, t0 + timedelta(hours=h)) for k, h in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
            out = lifetimes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "t", timedelta(hours=24))
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    got = sorted((r.k or "", int((r.t - t0).total_seconds() // 3600), r.event) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([
        ("", 2, "taken"), ("", 2, "purged"), ("a", 0, "taken"), ("a", 0, "purged"), ("a", 30, "taken"), ("a", 30, "purged"), ("a", 200, "taken"),
        ("b", 1, "taken"), ("b", 1, "purged"), ("b", 60, "taken"), ("b", 60, "purged"), ("c", 61, "taken"), ("c", 61, "purged"),
    ])


def test_lifetimes_of_many_keys_in_few_states(spark, tmp_path):
    rng, t0, hour = random.Random(5), datetime(2024, 5, 1), timedelta(hours=1)
    keys = [(rng.choice([None, 0, 2**53 + 1, 2**53 + 2, *range(40)]), rng.choice([None, "", "x", "y"])) for _ in range(60)]
    rows = [(*rng.choice(keys), t0 + hour * i + timedelta(microseconds=rng.randrange(3))) for i in range(600)]
    schema, before = "_n long, k string, t timestamp", spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        for part in (rows[:250], rows[250:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = lifetimes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["_n", "k"], "t", 30 * hour, buckets=4)
            run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            run.awaitTermination()
            # a state for each bucket, not for each key, whatever rows its timer takes
            assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 3
    finally:
        spark.conf.set(STORE, before)
    want, held, end = [], {}, max(t for *_, t in rows)
    for n, k, t in sorted(rows, key=lambda r: r[2]):
        last = held.get((n, k))
        if last is None or t > last + 30 * hour:
            want += [(n, k, t, "taken")] + [(n, k, last, "purged")] * (last is not None)
            held[n, k] = t
    want += [(n, k, t, "purged") for (n, k), t in held.items() if t + 30 * hour + timedelta(milliseconds=2) < end]
    assert sorted(map(repr, map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))) == sorted(map(repr, want))


# erasure


def test_erase_rewrites_touched_days_only(spark, tmp_path):
    path, now = str(tmp_path / "stored"), datetime(2024, 3, 20, 12)
    rows = [(i, datetime(2024, 3, 1 + i % 20, 6 + i % 12), f"user{i}@x.de", f"0221 55{i:06d}") for i in range(200)] + [(900, None, "user900@x.de", None)]
    ER.write_by_day(spark.createDataFrame(rows, "i int, at timestamp, mail string, tel string"), path, "at")
    files = {f: os.stat(f).st_mtime_ns for f in map(str, Path(path).rglob("*.parquet"))}
    bad = spark.createDataFrame([("email", " USER37@x.de "), ("phone", "+49 221 55000052"), ("email", "nobody@x.de")], "kind string, key string")
    report = {str(r.day): (r.rows_before, r.rows_after) for r in ER.erase(spark, path, bad, now, 10, "at", email="mail", phone="tel").collect()}
    limit = now - timedelta(days=10)
    stay = [r for r in rows if r[1] is not None and r[1] >= limit and r[0] not in (37, 52)]
    left = spark.read.parquet(path)
    assert sorted(r.i for r in left.collect()) == sorted(r[0] for r in stay)
    hit = {"None", *(f"2024-03-{d:02d}" for d in range(1, 11)), "2024-03-18", "2024-03-13"}
    assert set(report) == hit and report["2024-03-18"] == (10, 9) and report["2024-03-01"] == (10, 0)
    assert not (Path(path) / "day=2024-03-01").exists()
    now_there = {f: os.stat(f).st_mtime_ns for f in map(str, Path(path).rglob("*.parquet"))}
    for f, stamp in files.items():
        day = next(p for p in f.split("/") if p.startswith("day=")).removeprefix("day=")
        if day not in hit and not day.startswith("__"):
            assert now_there[f] == stamp
    assert ER.erase(spark, path, bad, now, 10, "at", email="mail", phone="tel").collect() == []


# snapshots and counters


def test_published_snapshots(spark, tmp_path):
    shown = Published(spark, str(tmp_path / "p"), "a long")
    assert shown.latest() is None and shown.read().collect() == []
    assert shown.publish(spark.range(3).select(F.col("id").alias("a")), 0)
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).alias("a"))
    with pytest.raises(Exception, match="stop"):
        shown.publish(broken, 1)
    assert shown.read().count() == 3 and shown.latest()["batch"] == 0
    assert shown.publish(spark.range(4).select(F.col("id").alias("a")), 1)
    assert not shown.publish(spark.range(9).select(F.col("id").alias("a")), 1)
    assert not shown.publish(spark.range(9).select(F.col("id").alias("a")), 0)
    assert shown.read().count() == 4 and shown.latest() == {"batch": 1, "folder": "data/batch=1", "rows": 4}


def test_observed_counters(spark, tmp_path):
    rows = [(1, True, 2, ("+49", "inhaber")), (2, False, 1, (None, "inhaber")), (3, True, 0, None), (4, False, 0, ("+49", "sonstige"))]
    leads = spark.createDataFrame(rows, "i int, premium boolean, mobiles int, contact struct<mobile:string,category:string>")
    spec = build_spec(["Makler"])
    counted, seen = observed(leads, "run", lead_counts())
    counted.write.parquet(str(tmp_path / "leads"))
    got = [tuple(r) for r in observed_meta(spark, spec, seen).collect()]
    assert got == [tuple(r) for r in run_meta(leads, spec).collect()]
    assert dict((p, v) for _, p, v in got)["Premium-Leads"] == "2" and got[-1][2] == "1"


def test_crawl_goes_on_where_it_was(spark):
    schema = "company_id string, page_ord long, page_id long, link_no int, href string, text string, kind string, base_domain string"
    link = lambda page, no, path, text="": ("s", page, page, no, f"https://s.de{path}", text, "internal", "s.de")
    state = FR.start_crawl(spark.createDataFrame([("s", "https://www.s.de/")], "company_id string, url string"))
    one = spark.createDataFrame([link(0, 0, "/"), link(0, 1, "/kontakt"), link(0, 2, "/kontakt/"), link(0, 3, "/a"), link(0, 4, "/b")], schema)
    state, first = FR.next_round(state, one, 1, budget=3)
    assert [r.href for r in first.orderBy("rank").collect()] == ["https://s.de/kontakt", "https://s.de/a"]
    people = spark.createDataFrame([("s", "Ada Berg")], "company_id string, name string")
    two = spark.createDataFrame([link(1, 0, "/impressum"), link(1, 1, "/a"), link(1, 2, "/c", "Frau Berg")], schema)
    state, more = FR.next_round(state, two, 2, extra=4, legal_people=people)
    assert [(r.href, r.hinted) for r in more.orderBy("rank").collect()] == [("https://s.de/impressum", False), ("https://s.de/c", True)]
    assert sorted(r.page_key for r in state.asked.collect()) == ["s.de/", "s.de/a", "s.de/c", "s.de/impressum", "s.de/kontakt"]
    assert [r.page_key for r in state.open.collect()] == ["s.de/b"]


def test_a_round_reads_its_links_once(spark, tmp_path, monkeypatch):
    rows = [("s", 0, 0, n, f"https://s.de/{n}", "", "internal", "s.de") for n in range(9)]
    schema = "company_id string, page_ord long, page_id long, link_no int, href string, text string, kind string, base_domain string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "links"))
    readers = []

    def noted(df, name, stage=FR.write_stage):
        readers.extend([name] * any(str(tmp_path / "links") in f for f in df.inputFiles()))
        return stage(df, name)

    monkeypatch.setattr(FR, "write_stage", noted)
    state = FR.start_crawl(spark.createDataFrame([("s", "https://www.s.de/")], "company_id string, url string"))
    state, first = FR.next_round(state, spark.read.parquet(str(tmp_path / "links")), 1, budget=4)
    assert readers == ["crawl-open"]
    assert not any(str(tmp_path / "links") in f for f in state.open.inputFiles())
    assert sorted(r.page_key for r in first.unionByName(state.open, allowMissingColumns=True).collect()) == [f"s.de/{n}" for n in range(9)]


def test_legal_people_of_pages_taken_up_bit_by_bit(spark):
    from firmatlas.operators import legal as L
    from firmatlas.session import write_stage

    lines = lambda name: ["Impressum", f"Geschäftsführer: {name}", "HRB 77"]
    rows = [("a", 1, "impressum", lines("Ida Lenz")), ("a", 2, "sonstige", lines("Uwe Berg")), ("a", 3, "impressum", lines("Max Vogt")), ("a", 4, "impressum", lines("Eva Kranz")), ("b", 5, "sonstige", lines("Tina Oberg")), ("b", 6, "team", ["Team"])]
    docs = spark.createDataFrame([(c, i, i, f"https://{c}.de/{i}", k, t) for c, i, k, t in rows], "company_id string, page_id long, page_ord long, url string, kind string, lines array<string>")
    stored = write_stage(L.legal_mentions(docs), "mentions")
    for upto in ([2, 6], [2, 4, 5], [1, 2, 3, 4, 5, 6]):
        part = F.col("page_id").isin(*upto)
        got, want = L.mentioned_people(stored.where(part)), L.legal_people(L.legal_pages(docs.where(part)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) != []
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000 < len(want._jdf.queryExecution().optimizedPlan().toString())


# hostile addresses


def test_addresses_in_linear_time(spark):
    many = " ".join(f"u{i}@h{i}.example" for i in range(100_000))
    texts = ["a@b" + ".c" * 100_000, "x" * 1_000_000, "a@" + "b" * 1_000_000, "a (at) b" + " (dot) c" * 50_000, "a.b-" * 250_000 + "@", " at " * 200_000, many, "w" + " " * 500_000 + "(at) h.de"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", emails_in_text(F.col("t")).alias("e")).orderBy("i").collect()
    assert [len(r.e) for r in found] == [1, 0, 0, 1, 0, 0, 100_000, 1]
    assert found[0].e[0].count(".") == 100_000 and found[3].e[0].count(".") == 50_000


# the entry without the corpus operators


@pytest.mark.parametrize("gone", ["both", "folder", "library"])
def test_entry_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    parts = shutil.ignore_patterns("llm", "__pycache__") if gone != "library" else shutil.ignore_patterns("__pycache__")
    shutil.copytree(REPO / "firmatlas", copy / "firmatlas", ignore=parts)
    shutil.copy(REPO / "__spark_entry__.py", copy)
    if gone != "both" and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", copy)
    if gone == "library":
        (copy / "ahocorasick.py").write_text("raise ImportError('not here')")
    told = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", told], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, corpus, fits = out.stdout.split()
    assert int(n) > 80 and corpus == "0" and fits == "True"


# pages that two companies share, ids of any size, retention in every sink


def test_a_page_of_two_companies(spark):
    from firmatlas.operators import legal as L
    from firmatlas.operators import people as PE
    from firmatlas.operators import phones as PH

    links = "array<struct<href:string,text:string,kind:string,attrs:map<string,string>>>"
    lines = ["Impressum", "Inhaberin: Ida Lenz", "HRB 77", "Ida Lenz", "Prokura", "Tel. 0221 5550777"]
    mail = [("mailto:ida.lenz@haus.example", "Mail", "mailto", {}), ("tel:+492215550777", "Ida Lenz", "tel", {})]
    rows = [(c, 5, 5, "https://haus.example/team", "team", lines, "\n".join(lines), mail) for c in ("a", "b")]
    docs = spark.createDataFrame(rows, f"company_id string, page_id long, page_ord long, url string, kind string, lines array<string>, text string, links {links}")
    people = PE.assign_emails(PE.page_people(PE.page_mentions(docs)), docs)
    assert sorted((r.company_id, r.name, r.email) for r in people.collect()) == [(c, "Ida Lenz", "ida.lenz@haus.example") for c in ("a", "b")]
    text = PH.text_numbers(PH.nearest_person(PH.number_lines(docs)))
    both = text.drop("person_line").unionByName(PH.link_numbers(docs, text))
    assert sorted((r.company_id, r.e164, r.person) for r in PH.dedupe_page_numbers(both).collect()) == [(c, "+492215550777", "Ida Lenz") for c in ("a", "b")]
    pages = L.legal_pages(docs)
    facts = L.legal_facts(pages, L.legal_people(pages))
    assert sorted((r.company_id, r.register, r.legal_form, r.legal_name) for r in facts.collect()) == [(c, "HRB 77", "Einzelunternehmen", "Ida Lenz") for c in ("a", "b")]


def test_pages_of_one_file_are_read_by_all_cores(spark, tmp_path):
    rows = spark.range(400).select(F.lit("c").alias("company_id"), F.col("id").alias("page_id"), F.lit("https://a.de/x").alias("url"), F.lit("<p>Haus</p>").alias("html"))
    rows.coalesce(1).write.parquet(str(tmp_path / "pages"))
    prepared = prepare_pages(spark.read.parquet(str(tmp_path / "pages")))
    counts = [r["count"] for r in prepared.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 4 and sum(counts) == 400


def test_texts_of_one_file_are_read_by_all_cores(spark, tmp_path):
    from firmatlas.plans.catalog.web import _texts

    ids = spark.range(400).coalesce(1)
    ids.select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("Haus").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    ids.select(F.col("id").alias("page_id"), F.lit("https://a.de/").alias("url"), F.lit("<p>Haus</p>").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    counts = [r["count"] for r in _texts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 8 and sum(counts) == 800


def test_page_order_of_hashed_ids(spark):
    from firmatlas.sources.readers import prepare_pages

    big = 2**62
    rows = [("c", big + 900, "https://h.de/sonst"), ("c", big + 1, "https://h.de/sonst2"), ("c", big + 5000, "https://h.de/impressum"), ("c", 2**63 - 1, "https://h.de/"), ("c", 3, "https://h.de/kontakt")]
    pages = spark.createDataFrame([(*r, "<p>x</p>") for r in rows], "company_id string, page_id long, url string, html string")
    for n in (1, 4):
        got = prepare_pages(pages.repartition(n)).orderBy("page_ord", "page_id")
        assert [r.url.rsplit("/", 1)[1] for r in got.collect()] == ["", "impressum", "kontakt", "sonst2", "sonst"]


def test_sinks_drop_what_is_too_old(spark, tmp_path):
    from firmatlas.operators.guard import Retention
    from firmatlas.sinks.writers import write_json, write_parquet

    now = datetime(2024, 6, 30)
    rows = spark.createDataFrame([(i, now - timedelta(days=i), f"h{i}.de") for i in range(40)], "i int, at timestamp, site string")
    objections = spark.createDataFrame([("domain", "www.h3.de")], "kind string, key string")
    for write, read in ((write_json, spark.read.schema("i int").json), (write_parquet, spark.read.parquet)):
        write(rows, str(tmp_path / write.__name__), objections, retention=Retention("at", now, 10), domain="site")
        assert sorted(r.i for r in read(str(tmp_path / write.__name__)).collect()) == [i for i in range(11) if i != 3]
