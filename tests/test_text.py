"""Scalar rules with hand-made cases. All cases of one rule run in one job."""

from pyspark.sql import functions as F

from firmatlas.functions import headcount as HC
from firmatlas.functions import html as H
from firmatlas.functions import legal as L
from firmatlas.functions import names as N
from firmatlas.functions import phone as P
from firmatlas.functions import urls as U
from firmatlas.functions.text import spans
from firmatlas.operators.contacts import emails_in_text
from firmatlas.operators.pages import page_lines, page_links


def apply(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_domains_and_keys(spark):
    values = ["https://www.alpha-haus.de/team/", "shop.alpha.co.uk", "", None, "alpha.example"]
    assert apply(spark, U.registrable_domain, values) == ["alpha-haus.de", "alpha.co.uk", None, None, "alpha.example"]
    assert apply(spark, U.page_key, ["https://www.A.de/x/#f", "http://a.de/x?q=1", "https://a.de"]) == ["a.de/x", "a.de/x?q=1", "a.de/"]
    assert apply(spark, U.start_url, [" Beta.DE ", "HTTP://Beta.de/Pfad?x#y"]) == ["https://beta.de/", "http://beta.de/Pfad?x"]


def test_phone_keys(spark):
    values = ["0221 123456", "+49 (0) 221 123456", "0049 221 123456", "123", None]
    assert apply(spark, P.phone_key, values) == ["49221123456"] * 3 + [None, None]


def test_links_of_a_chat(spark):
    values = ["https://wa.me/491715550123", "https://wa.me/message/ABC", "whatsapp://send?phone=%2B491715550123", "https://a.de"]
    assert apply(spark, U.whatsapp_number, values) == ["+491715550123", None, "+491715550123", None]


def test_protected_email(spark):
    plain = "post@haus.example"
    code = "2a" + "".join(f"{ord(c) ^ 0x2A:02x}" for c in plain)
    assert apply(spark, U.protected_email, [code, "zz", "2a", "2aff"]) == [plain, None, None, None]


def test_page_kinds(spark):
    values = ["https://a.de/impressum", "https://a.de/en/contact", "https://a.de/ueber-uns/", "https://a.de/jobs", "https://a.de/objekte/7", "https://a.de/xyz"]
    got = [(r.priority, r.kind) for r in apply(spark, U.page_kind, values)]
    assert got == [(0, "impressum"), (2, "kontakt"), (2, "team"), (3, "karriere"), (4, "sonstige"), (9, "sonstige")]


def test_names(spark):
    good = ["Tilda Wrede", "Dr. Hans-Georg Lütke-Daldrup", "Frau Dipl.-Kffr. Mia von der Heide", "Prof. Dr. rer. nat. Ömer Celik", "K. Sommer", "Wrede, Tilda", "Jan Ole van den Berg"]
    bad = ["Lindenweg 7", "Lindner Bau GmbH", "Ulm Hauptbahnhof", "Unsere Leistungen", "Tilda", "TILDA WREDE", "Landgericht Kiel Nord", "Leiterin Vertrieb", "", "Tilda W.", "Tilda Wrede Kontakt", "Bergisch Gladbach",
           "Dienstag Donnerstag", "Max Moritz Karl Otto Emil", "a Wrede", "Herr Wrede"]
    assert dict(zip(good + bad, apply(spark, N.is_name, good + bad))) == {t: t in good for t in good + bad}
    assert apply(spark, N.normalize_name, ["Herrn Dr. jur. Till  Weiß ", "frau Ida Lenz,", "Dr.", " Ida "]) == ["Till Weiß", "Ida Lenz", "Dr.", "Ida"]
    assert apply(spark, N.surname, ["Dr. Mia von der Heide", "Karl Otto Busch sen.", "", "Busch"]) == ["Heide", "Busch", "", "Busch"]
    texts = {
        "Vorstand: Prof. Dr. Till Weiß sowie Ida Lenz; Prokura: Uwe Brecht.": ["Prof. Dr. Till Weiß", "Ida Lenz", "Uwe Brecht"],
        "Ida Lenz Geschäftsführerin, Ihr Kontakt Ida Lenz": ["Ida Lenz"], "Ansprechpartnerin Frau Dipl.-Ing. Ida Lenz (Hannover)": ["Dipl.-Ing. Ida Lenz"],
        "Nordlicht Immobilien GmbH, Bergisch Gladbach": [], "Ida Lenz Bauleitung": [], "Fragen? Ida Lenz. Oder Uwe Brecht!": ["Ida Lenz", "Uwe Brecht"],
        "IDA LENZ und ida lenz": [], "K. Sommer/Ida Lenz": ["K. Sommer", "Ida Lenz"], "Mia von der Heide-Lenz": ["Mia von der Heide-Lenz"],
    }
    assert dict(zip(texts, apply(spark, N.find_names, list(texts)))) == texts
    assert apply(spark, lambda c: N.find_names(c, ("lenz",)), ["Ida Lenz und Uwe Brecht"]) == [["Uwe Brecht"]]


def test_roles(spark):
    values = ["GESCHÄFTSFÜHRERIN", "Inhaber & Makler", "Leitung Personal", "Ausbildungsleiter", "Prokuristin", "Filialleiter", "Maklerin", None]
    want = ["geschaeftsfuehrung", "inhaber", "hr", "ausbildung", "prokura", "betriebsleitung", "sonstige", "sonstige"]
    assert apply(spark, N.role_category, values) == want


def test_numbers(spark):
    values = ["0171 5550123", "+49 (0) 221 5550000", "0221/55 50 00 0", "0800 1234567", "12345", "Weg 12"]
    got = apply(spark, P.classify, values)
    assert [(g.e164, g.kind) if g else None for g in got] == [
        ("+491715550123", "mobile"), ("+492215550000", "landline"), ("+492215550000", "landline"), ("+498001234567", "unknown"), None, None,
    ]
    assert got[0].national == "0171 5550123"


def test_legal_forms(spark):
    values = ["Alpha GmbH & Co. KG", "Alpha Verwaltungsgesellschaft mbH", "Elektro Beta e.K.", "Lind PartG mbB", "Möller GbR", "Alpha AG", "Jonas Brandt"]
    assert apply(spark, L.legal_form, values) == ["GmbH & Co. KG", "GmbH", "e.K.", "PartG mbB", "GbR", "AG", None]


def test_headcounts(spark):
    cases = {
        "Die Werkstatt trägt ein Team aus 17 Kolleginnen und Kollegen.": (17, 17, 17, 2), "Mit mehr als 60 Beschäftigten in Lüneburg": (60, 90, 72, 2),
        "Heute ein 9-köpfiges Team": (9, 9, 9, 1), "Mitarbeiterzahl: 37": (37, 37, 37, 2), "Unser Team von 5 Leuten": (5, 5, 5, 0), "Team mit 5 Handwerkern": (5, 5, 5, 1), "Team von sechs Köpfen": (6, 6, 6, 1),
        "etwa 25 Mitarbeitende": (20, 31, 25, 2), "zwischen 8 und 11 Monteuren": (8, 11, 9, 2), "8-11 Gesellen": (8, 11, 9, 2), "fünfzehn Angestellte": (15, 15, 15, 2),
        "fast 90 Fachkräfte": (72, 90, 81, 2), "2.300 Mitarbeiter:innen": (2300, 2300, 2300, 2), "gut 10 erfahrene Berater": (10, 15, 12, 2), "wir sind inzwischen 7": (7, 7, 7, 1),
        "Seit 2004 haben wir 31 Mitarbeiter": (31, 31, 31, 2), "Beschäftigte: ca. 44": (35, 53, 44, 2), "12 Menschen": (12, 12, 12, 0),
    }
    got = apply(spark, HC.hits, list(cases))
    assert {t: (h[0].value.lo, h[0].value.hi, h[0].value.point, h[0].quality) if h else None for t, h in zip(cases, got)} == cases
    assert [len(h) for h in got] == [1] * len(cases)
    none = ["40 Jahre Erfahrung", "1.200 verkaufte Wohnungen", "4 Filialen", "50 % Rabatt", "Mo bis Fr 8 bis 17 Uhr", "gegründet 1987", "Team", "300000 Mitarbeiter", "0 Mitarbeiter", "123456 Personen", ""]
    assert apply(spark, HC.hits, none) == [[]] * len(none)
    two = apply(spark, HC.hits, ["Konzern mit 900 Mitarbeitern weltweit. Hier arbeiten 12 Kollegen; zwölf Leute im Lager."])[0]
    assert [(h.value.point, h.is_group, h.quality) for h in two] == [(900, True, 2), (12, False, 2), (12, False, 0)]


def test_many_numbers_on_a_page(spark):
    page = "12 Mitarbeiter und 7 Autos, " * 50_000
    df = spark.createDataFrame([(page, "1 " * 100_000)], "a string, b string")
    row = df.select(F.size(HC.hits(F.col("a"))).alias("a"), F.size(HC.hits(F.concat(F.lit("Team "), "b"))).alias("b"), F.element_at(spans(F.col("a"), r"\d+"), -1).alias("last")).first()
    assert (row.a, row.b) == (50_000, 0) and row.last.raw == "7" and page[row.last.start : row.last.end] == "7"


def test_emails(spark):
    text = "A.B@Haus.example, bild@x.png und info (at) haus [dot] example"
    assert apply(spark, emails_in_text, [text]) == [["a.b@haus.example", "info@haus.example"]]


def test_html(spark):
    html = (
        "<html><head><title>x</title><script>var t='</p>';</script></head><body><nav><a href='/a'>Eins</a><a href=\"/b/\">Zwei <b>fett</b></a></nav>"
        "<p>Mobil: <b>0171 5550123</b><br>&copy; 2026 &amp; &#228;</p><a href='tel:+491725550456'>anrufen</a>"
        "<table><tr><td>Tel.</td><td>0221 5550000</td></tr></table><a href='../x/./y.vcf?z#f' download>Karte</a>"
        "<a href='https://www.linkedin.com/company/z'>L</a><a href='#top'>hoch</a><a>ohne</a></body></html>"
    )
    df = spark.createDataFrame([(1, "https://www.haus.example/k/l/", html), (2, "https://x.de", "<div><p>a<p>b")], "page_id long, url string, html string")
    lines = [r.line for r in page_lines(df).where("page_id = 1").orderBy("line_no").collect()]
    assert lines == ["Eins Zwei fett", "Mobil: 0171 5550123", "© 2026 & ä", "anrufen +491725550456", "Tel. · 0221 5550000", "Karte L hoch ohne"]
    assert [r.line for r in page_lines(df).where("page_id = 2").orderBy("line_no").collect()] == ["a", "b"]
    links = [(r.kind, r.href) for r in page_links(df).orderBy("link_no").collect()]
    assert links == [
        ("internal", "https://www.haus.example/a"), ("internal", "https://www.haus.example/b/"), ("tel", "tel:+491725550456"),
        ("vcard", "https://www.haus.example/k/x/y.vcf?z"), ("social", "https://www.linkedin.com/company/z"), ("other", "#top"),
    ]
    assert apply(spark, H.unescape, ["&amp;auml; &#x1F600;", "a & b"]) == ["ä 😀", "a & b"]


def test_relative_links_fold_any_number_of_dots(spark):
    from firmatlas.functions import urls

    base = "https://x.de/" + "/".join("abcdefghijkl") + "/page?q=1"
    cases = {"../" * 10 + "z": "https://x.de/a/b/z", "../" * 30 + "z": "https://x.de/z", "./y/../z/.": "https://x.de/" + "/".join("abcdefghijkl") + "/z/", "/m/../../n?u=/../v": "https://x.de/n?u=/../v", "..": "https://x.de/" + "/".join("abcdefghijk") + "/"}
    df = spark.createDataFrame([(k,) for k in cases], "href string")
    got = {r[0]: r[1] for r in df.select("href", urls.resolve(F.lit(base), F.col("href"))).collect()}
    assert got == cases


def test_named_references_of_the_standard_table(spark):
    from firmatlas.functions import html

    df = spark.createDataFrame([("<p>Se&ntilde;or &Oslash;rsted &amp; &Eacute;mile &rarr; &hearts; &nosuch;</p>",)], "html string")
    assert df.select(html.visible_text(F.col("html"))).first()[0] == "Señor Ørsted & Émile → ♥ &nosuch;"


def test_spans_of_texts_with_control_characters(spark):
    from firmatlas.functions.text import spans

    df = spark.createDataFrame([("\u0001a 12\u0002b 345",)], "t string")
    assert [(s["start"], s["end"], s["raw"]) for s in df.select(spans(F.col("t"), "[0-9]+")).first()[0]] == [(3, 5, "12"), (8, 11, "345")]
