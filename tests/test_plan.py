"""Crawl planning, page intake, localities and small helpers."""

import json

from pyspark.sql import functions as F

from firmatlas.functions import urls as U
from firmatlas.functions.text import request_key
from firmatlas.operators import frontier as FR
from firmatlas.operators import pages as PG
from firmatlas.rules import dims
from firmatlas.sinks.tables import reachability
from firmatlas.sources import readers as R

SITE = "https://a.de"


def links(spark, entries):
    rows = [("a", 0, 0, i, f"{SITE}{p}", t, "internal", "a.de") for i, (p, t) in enumerate(entries)]
    return spark.createDataFrame(rows, "company_id string, page_ord long, page_id long, link_no int, href string, text string, kind string, base_domain string")


def test_candidates_and_budget(spark):
    entries = [
        ("/x1", "eins"), ("/impressum", "Impressum"), ("/team/jonas-brandt/", "Jonas Brandt"), ("/kontakt", "Kontakt"), ("/datei.pdf", "PDF"), ("/login", "Login"),
        ("/x2?p=1", "Suche"), ("/kontakt/", "noch einmal"), ("/x3", "Mara Lenz"), ("/x4", "WhatsApp"), ("/x5", "fünf"), ("/x6", "sechs"), ("/", "Start"),
    ]
    loaded = spark.createDataFrame([("a", SITE + "/")], "company_id string, url string")
    rows = FR.candidates(links(spark, entries), loaded)
    got = {r.href[len(SITE):]: r.priority for r in rows.collect()}
    assert got == {"/x1": 9, "/impressum": 0, "/team/jonas-brandt/": 5, "/kontakt": 1, "/x3": 5, "/x4": 5, "/x5": 9, "/x6": 9}
    plan = [r.href[len(SITE):] for r in FR.plan(rows, budget=8).orderBy("rank").collect()]
    # one page is loaded; unknown pages stop at six pages in all
    assert plan == ["/impressum", "/kontakt", "/team/jonas-brandt/", "/x3", "/x4"]
    people = spark.createDataFrame([("a", "Jonas Brandt"), ("a", "Dr. Ole Ex")], "company_id string, name string")
    hinted = FR.promote_hints(rows, FR.hint_names(people))
    assert {r.href[len(SITE):] for r in hinted.where("hinted").collect()} == {"/team/jonas-brandt/"}
    more = [(r.href[len(SITE):], r.priority) for r in FR.plan_more(hinted).orderBy("rank").collect()]
    assert more == [("/impressum", 0), ("/kontakt", 1), ("/team/jonas-brandt/", 4)]


def test_robots(spark):
    rules = spark.createDataFrame(
        [("a.de", "*", 1, "/intern/offen", True), ("a.de", "*", 2, "/intern", False), ("a.de", "otherbot", 3, "/", False), ("a.de", "*", 4, "", False)],
        "host string, agent string, rule_no int, path_prefix string, allow boolean",
    )
    df = spark.createDataFrame([(f"{SITE}{p}",) for p in ("/", "/intern/x", "/intern/offen/1", "/b")] + [("https://b.de/intern",)], "href string")
    got = sorted(r.href for r in FR.allowed(df, rules, "firmatlas").collect())
    assert got == [f"{SITE}/", f"{SITE}/b", f"{SITE}/intern/offen/1", "https://b.de/intern"]
    assert FR.allowed(df, rules, "otherbot/1.0").count() == 1


def test_page_intake(spark):
    rows = [(1, 200, "text/html; charset=utf-8"), (2, 404, "text/html"), (3, 200, "application/pdf"), (4, None, None)]
    df = spark.createDataFrame([(*r, "<p>lang</p>") for r in rows], "page_id long, status int, content_type string, html string")
    assert sorted(r.page_id for r in R.usable_pages(df).collect()) == [1, 4]
    assert R.usable_pages(df, 3).first().html == "<p>"
    flagged = {r.s: r.low_text for r in PG.low_text_sites(df.withColumn("s", (F.col("page_id") % 3).cast("string")), "s").collect()}
    assert flagged == {"0": True, "1": False, "2": True}


def test_localities_and_rules(spark, tmp_path):
    rows = [{"city": "Kiel", "state": "Schleswig-Holstein", "radius_km": 6.0}, {"city": "Ulm", "state": "Baden-Württemberg"}]
    (tmp_path / "orte.json").write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    assert R.read_localities(spark, str(tmp_path)).count() == 2
    assert [r.city for r in R.read_localities(spark, str(tmp_path), ["schleswig-holstein"]).collect()] == ["Kiel"]
    zones = {r.zone: r.state for r in dims.postal_zones(spark).collect()}
    assert zones["50"] == "Nordrhein-Westfalen" and "00" not in zones and "05" not in zones
    ref = dims.funding_reference(spark).orderBy("ord").collect()
    assert len(ref) == 3 + 3 + 5 + 13 + 1 and ref[0].band_or_state == "<50" and "[ausgesetzt]" in ref[-2].note


def test_reachability_and_keys(spark):
    df = spark.createDataFrame([(i, i != 5, f"e{i}") for i in range(6)], "i int, failed boolean, e string")
    r = reachability(df, F.col("failed"), F.col("i"), F.col("e")).first()
    assert (r.sites, r.failed, r.warn, r.first_error) == (6, 5, True, "e0")
    one = df.select(request_key(b=F.col("e"), a=F.col("i")).alias("k"), request_key(a=F.col("i"), b=F.col("e")).alias("k2"))
    assert one.where("k <> k2").count() == 0 and one.select("k").distinct().count() == 6
    assert df.select(U.file_stem(F.lit("Köln Bau/1")).alias("s")).first().s == "Köln_Bau_1"


def test_results_do_not_depend_on_partitions(spark):
    import sites

    from firmatlas.operators import contacts as C
    from firmatlas.operators import headcount as HC
    from firmatlas.operators import phones as PH

    pages, _, _ = sites.frames(spark)
    seen = []
    for n in (1, 5):
        docs = R.prepare_pages(pages.repartition(n, "html"))
        numbers = PH.site_numbers(PH.dedupe_page_numbers(PH.text_numbers(PH.nearest_person(PH.number_lines(docs))).drop("person_line")))
        emails = C.emails_first_seen(C.page_emails(docs))
        sizes = HC.pick_hit(HC.size_hits(docs))
        seen.append([sorted(map(str, d.collect())) for d in (numbers, emails, sizes)])
    assert seen[0] == seen[1]
