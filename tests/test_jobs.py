"""Skew-safe building blocks, resolution, sources, sinks, streaming and the whole run."""

import random

import sites
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmatlas.functions import company as CO
from firmatlas.operators import guard as G
from firmatlas.operators import headcount as HC
from firmatlas.operators import resolve as RS
from firmatlas.operators import skew as SK
from firmatlas.plans.enrich import enrich
from firmatlas.sinks import tables as TB
from firmatlas.sinks.writers import reexport, write_json
from firmatlas.sources import readers as R
from firmatlas.sources.spec import build_spec, search_tasks
from firmatlas.streaming import runs as RN


def test_rank_selection_on_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.randint(1, 9), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, v int, o int").repartition(7).withColumn("block", F.floor(F.col("o") / 100))
    got = {r.k: (r.v, r.o) for r in SK.upper_median(df, ["k"], "v", ["block", "o"], width=4).collect()}
    groups = {}
    for k, v, o in rows:
        groups.setdefault(k, []).append((v, o))
    assert got == {k: sorted(g)[len(g) // 2] for k, g in groups.items()}


def test_chunked_windows_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"u{i % 9}", rng.randint(0, 400), "s" if rng.random() < 0.2 else "x") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, u string, t int, e string").repartition(5)
    mark = F.when(F.col("e") == "s", F.col("id"))
    plain = Window.partitionBy("u").orderBy("t", "id")
    want = df.select("id", F.last(mark, ignorenulls=True).over(plain.rowsBetween(-4, 0)).alias("a"), F.lead("id", 2).over(plain).alias("b"))
    cut = SK.chunked(df, ["u"], F.floor(F.col("t") / 10), ["t", "id"], before=4, after=2)
    w = SK.chunk_window(["u"], ["t", "id"])
    got = cut.select("id", "_halo", F.last(mark, ignorenulls=True).over(w.rowsBetween(-4, 0)).alias("a"), F.lead("id", 2).over(w).alias("b")).where("not _halo").drop("_halo")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    total = SK.running_total(df, ["u"], F.floor(F.col("t") / 10), ["t", "id"], "t", "s").select("id", "s")
    check = df.select("id", F.sum("t").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, check.collect()))


def test_clusters_close_chains_and_hot_keys(spark):
    pairs = [(i, f"c{i // 2}") for i in range(40)] + [(i, f"d{(i + 1) // 2}") for i in range(40)]  # one chain of 40
    pairs += [(100 + i, "hot") for i in range(200)] + [(500, "alone")]
    df = spark.createDataFrame(pairs, "record long, token string").repartition(6)
    got = {r.record: r.cluster for r in RS.clusters(df).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[100 + i] for i in range(200)} == {100} and got[500] == 500


def test_company_dedupe(spark):
    rows = [
        ("1", "A", "https://www.foo.de/x", "0221 123456", None, "q1", 1), ("2", "A GmbH", "http://foo.de", None, "50667", "q2", 2),
        ("3", "B", None, "+49 221 123456", None, "q3", 3), ("1", "A", None, None, None, "q1", 4), ("9", "Other", "https://other.de", "0228 999999", None, "q", 5),
        # a later record that bridges two earlier ones joins all three
        ("20", "X", "https://x.de", None, None, "q", 6), ("21", "Y", None, "0431 777777", None, "q", 7), ("22", "Z", "https://x.de", "0431 777777", None, "q", 8),
    ]
    df = R.with_company_columns(spark.createDataFrame(rows, "place_id string, name string, website string, phone string, plz string, query string, ord long"))
    got = RS.dedupe_companies(df).orderBy("ord").collect()
    assert [r.place_id for r in got] == ["1", "9", "20"]
    assert (got[0].query, got[0].plz, got[0].domain) == ("q1 | q2 | q3", "50667", "foo.de") and got[2].phone == "0431 777777"
    again = RS.dedupe_companies(RS.dedupe_companies(df)).orderBy("ord").collect()
    assert [r.place_id for r in again] == ["1", "9", "20"]


def test_size_fallback_chain(spark):
    rows = [(7, None, None), (None, "e.K.", None), (None, "GmbH & Co. KG", 5), (None, None, 150), (2, None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t int, f string, r int")
    none = F.lit(None).cast("struct<lo:int,hi:int,point:int,confidence:string,evidence:array<string>>")
    got = df.select("i", HC.fallback_size(none, F.col("t"), F.col("f"), F.col("r")).alias("s")).orderBy("i").collect()
    assert [(r.s.lo, r.s.hi, r.s.point, r.s.confidence) for r in got] == [
        (7, 10, 7, "medium"), (1, 9, 4, "low"), (10, 99, 30, "low"), (10, 100, 25, "low"), (None, None, None, "none"), (None, None, None, "none"),
    ]
    assert got[4].s.evidence == ["Team-Seite: 2 Personen aufgeführt"]


def test_bands_and_ranges(spark):
    df = spark.createDataFrame([(n,) for n in (-1, 0, 49, 50, 499, 500)], "n int")
    assert [r[0] for r in df.select(CO.size_band(F.col("n"))["band"]).collect()] == [None, "<50", "<50", "50-499", "50-499", ">=500"]
    states = spark.createDataFrame([(s,) for s in (" bavaria", "NRW", "Hessen", "Tirol", "")], "s string")
    assert [r[0] for r in states.select(CO.normalize_state(F.col("s"))).collect()] == ["Bayern", "Nordrhein-Westfalen", "Hessen", None, None]
    plz = spark.createDataFrame([(s,) for s in ("50667", "01067", "05000", "x1", "9")], "s string")
    assert [r[0] for r in plz.select(CO.state_of_plz(F.col("s"))).collect()] == ["Nordrhein-Westfalen", "Sachsen", None, None, None]


def test_chain_rules(spark):
    rows = [("remax.de", "R"), ("a.de", "RE/MAX Nord"), ("a.de", "mcmakler gmbh"), (None, "Berg Bau")]
    df = spark.createDataFrame(rows, "d string, n string")
    got = [r[0] for r in df.select(CO.exclusion_reason(F.col("d"), F.col("n"))).collect()]
    assert "Domain remax.de" in got[0] and "re/max" in got[1] and "mcmakler" in got[2] and got[3] is None


def test_company_list(spark, tmp_path):
    (tmp_path / "liste.csv").write_text(
        "﻿Firma;Web-Seite;Telefon;PLZ;Ort;Unbekannt\nAlpha Bau;alpha.de;0221 1;1067;Dresden;x\n;https://www.beta.de/x;;50667;Köln;\nGamma;;;;;\n;;0221 5;;;\n",
        encoding="utf-8",
    )
    rows = R.read_company_list(spark, str(tmp_path / "liste.csv")).orderBy("ord").collect()
    assert [(r.place_id, r.name, r.website, r.domain, r.plz, r.state) for r in rows] == [
        ("list-1", "Alpha Bau", "https://alpha.de", "alpha.de", "01067", "Sachsen"),
        ("list-2", "www.beta.de", "https://www.beta.de/x", "beta.de", "50667", "Nordrhein-Westfalen"),
        ("list-3", "Gamma", None, None, None, None),
    ]
    assert rows[0].query == "Liste: liste.csv"


def test_search_spec(spark):
    spec = build_spec(["Hotel", "Hotel"], "makler", [" Kiel ", None, "Bonn"])
    assert spec.queries[0] == "Hotel" and len(spec.queries) == 5 and spec.included_type == "real_estate_agency"
    assert (spec.city, spec.cities) == ("Kiel", ("Bonn",)) and build_spec().queries[0] == "Immobilienmakler"
    places = spark.createDataFrame([("Kiel", 6.0), ("Ulm", None)], "city string, radius_km double")
    got = {(r.text, r.radius_km) for r in search_tasks(places, build_spec(["Hotel Kiel", "Pulmologe"])).collect()}
    assert got == {("Hotel Kiel", 6.0), ("Pulmologe Kiel", 6.0), ("Hotel Kiel Ulm", 25.0), ("Pulmologe Ulm", 25.0)}


def test_objections_and_masking(spark):
    rows = spark.createDataFrame([(1, "+491715550123", "a@x.de", "https://x.de"), (2, None, "b@y.de", "https://www.z.de"), (3, None, None, None)], "i int, p string, e string, w string")
    no = spark.createDataFrame([("phone", "0171 5550123"), ("domain", "z.de"), ("email", "A@q.de")], "kind string, key string")
    assert [r.i for r in G.suppress(rows, no, phone="p", email="e", domain="w").collect()] == [3]
    assert rows.where("i = 1").select(G.mask_phone(F.col("p"))).first()[0] == "+49171*******"


def test_streaming_run_resumes(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "place_id string, domain string, ord long"
    first = spark.createDataFrame([("a", "a.de", 1), ("b", "b.de", 2), ("a", "a.de", 3)], schema)
    first.coalesce(1).write.parquet(str(src / "one"))
    exports = []
    none = spark.createDataFrame([], "kind string, key string")
    writer = RN.batch_writer(f"{out}/rows", schema, none, export=lambda df: exports.append(df.count()), export_every=2)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = RN.run_available(stream, writer, f"{out}/ckpt")
    assert RN.progress_counts(q) == [3] and RN.read_results(spark, f"{out}/rows", schema).count() == 2
    RN.run_available(stream, writer, f"{out}/ckpt")
    assert RN.read_results(spark, f"{out}/rows", schema).count() == 2
    spark.createDataFrame([("c", "c.de", 4), ("x", "a.de", 5), ("b", None, 6)], schema).coalesce(1).write.parquet(str(src / "two"))
    RN.run_available(stream, writer, f"{out}/ckpt")
    assert sorted(r.place_id for r in RN.read_results(spark, f"{out}/rows", schema).collect()) == ["a", "b", "c"]
    # somebody who objects is not written any more
    barred = RN.batch_writer(f"{out}/rows", schema, spark.createDataFrame([("domain", "www.d.de")], "kind string, key string"))
    barred(spark.createDataFrame([("d", "d.de", 7)], schema), 2)
    assert RN.read_results(spark, f"{out}/rows", schema).where("place_id = 'd'").count() == 0
    # a repeated batch overwrites its own folder
    writer(spark.createDataFrame([("c", "c.de", 4)], schema), 1)
    assert RN.read_results(spark, f"{out}/rows", schema).count() == 3 and exports[0] == 3


def test_whole_run(spark, tmp_path):
    pages, companies, cards = sites.frames(spark)
    done = enrich(pages, companies, cards, build_spec())
    leads = {r.company_id: r for r in done.leads.collect()}
    nord, sued = leads["nord"], leads["sued"]
    assert (nord.legal_name, nord.legal_form, nord.register, nord.legal_city) == ("Nordlicht Bau GmbH", "GmbH", "HRB 4711", "Kiel")
    assert nord.decider_mobile == "Jonas Brandt" and nord.hr_name == "Mara Lenz" and nord.premium
    assert nord.contact.email == "j.brandt@nordlicht-bau.example" and nord.contact.mobile.e164 == "+491715550123"
    assert (nord.size.point, nord.size.confidence, nord.score) == (14, "high", 50 + 5 + 20 + 8 + 3 + 2)
    assert (sued.size.point, sued.size.confidence, sued.owner_named) == (6, "medium", "Clara Südwind")
    assert sued.score == 50 + 10 + 12 + 3 and sued.premium_missing == ["sozialversicherungspflichtige Beschäftigte nicht belegt"]
    assert leads["ohne"].score == 5 and leads["ohne"].errors == ["keine Website bei Google Places"]
    assert leads["weg"].score == 0 and leads["weg"].premium_missing[0].startswith("Google-Status")
    numbers = {(r.company_id, r.e164): r for r in done.numbers.collect()}
    assert ("nord", "+494315550009") not in numbers  # fax
    assert numbers[("nord", "+491725550456")].person == "Ole Thiessen" and numbers[("sued", "+491605550777")].person == "Clara Südwind"
    assert {r.email for r in done.emails.collect()} == {"m.lenz@nordlicht-bau.example", "buero@suedwind-steuern.example"}
    assert all(0 <= r.score <= 100 for r in leads.values())

    table = TB.leads_table(done.leads, done.numbers)
    assert len(table.columns) == 1 + 47 + 4
    top = table.first().asDict()
    assert (top["Firma"], top["Handy Entscheider"], top["Weitere Handynummern"]) == ("Nordlicht Bau GmbH", "0171 5550123", "0172 5550456 (Ole Thiessen)")
    assert [r.Name for r in TB.people_table(done.people, done.leads).collect()] == ["Jonas Brandt", "Clara Südwind", "Ole Thiessen", "Mara Lenz"]
    meta = {r.parameter: r.value for r in TB.run_meta(done.leads, build_spec()).collect()}
    assert (meta["Anzahl Firmen"], meta["mit Handynummer"], meta["Entscheider mit Handy"], meta["Premium-Leads"]) == ("4", "3", "2", "1")
    saved = done.leads.select("company_id", "name", "score", "premium")
    with pytest.raises(ValueError):
        write_json(saved, str(tmp_path / "leads"), spark.createDataFrame([], "kind string, key string"))
    objections = spark.createDataFrame([("domain", "weg.example")], "kind string, key string")
    write_json(saved.withColumn("site", F.lit("https://ok.example")), str(tmp_path / "leads"), objections, domain="site")
    again = reexport(spark, str(tmp_path / "leads"), "company_id string, name string, score int, premium boolean", min_score=5)
    assert [r.company_id for r in again.collect()] == ["nord", "sued", "ohne"]


def test_only_usable_pages_are_read(spark):
    from pyspark.sql import functions as F

    from firmatlas.plans import enrich as EN

    pages, companies, _ = sites.frames(spark)
    some = companies.where("company_id <> 'sued'")
    want = sorted(r.page_id for r in EN.pages_of(pages, some).select("page_id").collect())
    assert len(want) == 3
    marked = pages.withColumn("status", F.lit(200)).withColumn("content_type", F.lit("text/html; charset=utf-8"))
    bad = marked.limit(1).withColumn("page_id", F.lit(900)).withColumn("status", F.lit(404))
    other = marked.limit(1).withColumn("page_id", F.lit(901)).withColumn("content_type", F.lit("application/pdf"))
    got = sorted(r.page_id for r in EN.pages_of(marked.union(bad).union(other), some).select("page_id").collect())
    assert got == want


def test_unseen_companies_in_order(spark):
    """A record that is left out marks neither its id nor its domain; missing keys match nothing."""
    import random

    from firmatlas.operators.resolve import unseen

    rng = random.Random(4)
    pick = lambda k, n: None if rng.random() < 0.2 else f"{k}{rng.randrange(n)}"
    batch = [(i, pick("id", 25), pick("d", 20), f"n{i}") for i in range(120)]
    seen = [(pick("id", 25), pick("d", 20)) for _ in range(5)]
    ids, domains, want = {a for a, _ in seen} - {None}, {b for _, b in seen} - {None}, []
    for row in batch:
        _, i, d, _ = row
        if (i is None or i not in ids) and (d is None or d not in domains):
            want.append(row)
            ids |= {i} - {None}
            domains |= {d} - {None}
    frame = spark.createDataFrame(batch, "ord long, place_id string, domain string, name string").repartition(5)
    old = spark.createDataFrame(seen, "place_id string, domain string")
    assert sorted(map(tuple, unseen(frame, old).select("ord", "place_id", "domain", "name").collect())) == want
    assert unseen(frame.limit(0), old).count() == 0


def test_a_cell_lists_all_mobiles(spark):
    from firmatlas.sinks.tables import other_mobiles

    rows = [("a", f"+49160{k:07d}", f"0160 {k:07d}", None, "mobile", (0, 0, 0, k, 0)) for k in range(300)]
    at = "first_at struct<page_ord:long,page_id:long,part:int,line_no:int,match_no:int>"
    numbers = spark.createDataFrame(rows, f"company_id string, e164 string, national string, person string, kind string, {at}")
    mobile = "struct<e164:string,national:string,source_url:string,person:string>"
    leads = spark.createDataFrame([("a", None, ("+491600000000", "0160 0000000", "u", None), None)], f"company_id string, contact struct<mobile:{mobile}>, best_mobile {mobile}, open_mobile {mobile}")
    assert other_mobiles(leads, numbers).first()["other_mobiles"] == ", ".join(r[2] for r in rows[1:])


def test_employment_evidence_order(spark):
    from firmatlas.operators import contacts as C

    schema = "company_id string, page_id long, page_ord long, url string, employed array<string>, freelance array<string>"
    signals = spark.createDataFrame([("a", 9, 9, "u9", ["x"], []), ("b", 1, 1, "u", [], ["f1", "f2"])], schema)
    people = spark.createDataFrame(
        [("a", f"P{i}", "Assistenz", (2, i, i, 0, 0)) for i in (10, 9, 11)],
        "company_id string, name string, role string, first_at struct<group_no:int,page_ord:long,page_id:long,line_no:int,sub_no:int>",
    )
    got = {r.company_id: (r.employment_signal, r.employment_evidence) for r in C.employment(signals, people).collect()}
    assert got["a"] == ("angestellt", ["+ „x“ (u9)", "+ Rolle „Assistenz“: P9", "+ Rolle „Assistenz“: P10"])
    assert got["b"] == ("frei", ["− „f1“ (u)", "− „f2“ (u)"])
