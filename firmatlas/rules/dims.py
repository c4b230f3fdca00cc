"""Rule tables for places, chains, funding and search profiles.

Deployments pass their own lists to the operators; these are the defaults.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: states and postal ranges -------------------------------------------------------

STATES = (
    "Baden-Württemberg", "Bayern", "Berlin", "Brandenburg", "Bremen", "Hamburg", "Hessen", "Mecklenburg-Vorpommern",
    "Niedersachsen", "Nordrhein-Westfalen", "Rheinland-Pfalz", "Saarland", "Sachsen", "Sachsen-Anhalt",
    "Schleswig-Holstein", "Thüringen",
)
STATE_ALIASES = {
    "baden-wurttemberg": "Baden-Württemberg", "baden-wuerttemberg": "Baden-Württemberg", "bavaria": "Bayern",
    "hesse": "Hessen", "lower saxony": "Niedersachsen", "north rhine-westphalia": "Nordrhein-Westfalen",
    "nrw": "Nordrhein-Westfalen", "rhineland-palatinate": "Rheinland-Pfalz", "saxony": "Sachsen",
    "saxony-anhalt": "Sachsen-Anhalt", "thuringia": "Thüringen", "thueringen": "Thüringen",
    "mecklenburg-western pomerania": "Mecklenburg-Vorpommern",
}
# two-digit postal zones, first and last; zones that are not listed have no state
PLZ_RANGES = (
    (1, 2, "Sachsen"), (3, 3, "Brandenburg"), (4, 4, "Sachsen"), (6, 6, "Sachsen-Anhalt"), (7, 7, "Thüringen"),
    (8, 9, "Sachsen"), (10, 14, "Berlin"), (15, 16, "Brandenburg"), (17, 19, "Mecklenburg-Vorpommern"),
    (20, 22, "Hamburg"), (23, 25, "Schleswig-Holstein"), (26, 27, "Niedersachsen"), (28, 28, "Bremen"),
    (29, 31, "Niedersachsen"), (32, 33, "Nordrhein-Westfalen"), (34, 36, "Hessen"), (37, 38, "Niedersachsen"),
    (39, 39, "Sachsen-Anhalt"), (40, 48, "Nordrhein-Westfalen"), (49, 49, "Niedersachsen"),
    (50, 53, "Nordrhein-Westfalen"), (54, 56, "Rheinland-Pfalz"), (57, 59, "Nordrhein-Westfalen"), (60, 65, "Hessen"),
    (66, 66, "Saarland"), (67, 67, "Rheinland-Pfalz"), (68, 79, "Baden-Württemberg"), (80, 87, "Bayern"),
    (88, 89, "Baden-Württemberg"), (90, 97, "Bayern"), (98, 99, "Thüringen"),
)

# --- Fixed values: chains and portals -------------------------------------------------------------

CHAIN_DOMAINS = tuple(
    "engelvoelkers.com remax.de von-poll.com mcmakler.de homeday.de dahlercompany.com immobilienscout24.de immowelt.de "
    "immonet.de sparkassen-immobilien.de lbs.de postbank-immobilien.de allianz.de ergo.de huk.de debeka.de "
    "wuestenrot.de dvag.de swisslife-select.de mlp.de tecis.de atu.de pitstop.de euromaster.de vergoelst.de carglass.de "
    "obi.de hornbach.de bauhaus.info toom.de fielmann.de apollo.de mcdonalds.de burgerking.de subway.com rewe.de "
    "edeka.de lidl.de aldi-sued.de aldi-nord.de dm.de rossmann.de tuev-sued.de tuv.com dekra.de".split()
)
CHAIN_NAMES = (
    "Engel & Völkers", "RE/MAX", "REMAX", "VON POLL", "McMakler", "Homeday", "Sparkasse", "Volksbank",
    "Raiffeisenbank", "Allianz ", "ERGO ", "HUK-COBURG", "Debeka", "DVAG", "Deutsche Vermögensberatung", "A.T.U",
    "pitstop", "Euromaster", "Fielmann", "Apollo-Optik", "McDonald", "Burger King", "REWE", "EDEKA", "Lidl", "ALDI",
    "Rossmann", "TÜV", "DEKRA",
)

# --- Fixed values: funding ------------------------------------------------------------------------


class Band(NamedTuple):
    band: str
    lo: int
    hi: int | None
    cost_pct: int
    wage_pct: int


class Programme(NamedTuple):
    state: str
    programme: str
    note: str
    url: str
    status: str


FUNDING_AS_OF = "2026-09-13"
FUNDING_LAW = "§ 82 SGB III"
FUNDING_URL = "https://www.arbeitsagentur.de/unternehmen/finanziell/foerderung-von-weiterbildung"
BANDS = (Band("<50", 0, 49, 100, 75), Band("50-499", 50, 499, 50, 50), Band(">=500", 500, None, 25, 25))
BONUS_NOTES = (
    "+5 Prozentpunkte Lehrgangskosten UND Arbeitsentgeltzuschuss bei Betriebsvereinbarung oder Tarifvertrag zur Weiterbildung",
    "100 % Lehrgangskosten für Beschäftigte ab 45 Jahren oder mit Schwerbehinderung in Betrieben unter 500 Beschäftigten",
    "Bis zu 100 % Arbeitsentgeltzuschuss bei Beschäftigten ohne Berufsabschluss in abschlussbezogener Weiterbildung",
)
PREREQUISITES = (
    "Maßnahme > 120 Stunden; Träger UND Maßnahme nach AZAV zugelassen",
    "Kenntnisse, die über kurzfristige arbeitsplatzbezogene Anpassungsfortbildung hinausgehen (kein reines Tool-Training)",
    "Berufsabschluss bzw. letzte geförderte Weiterbildung liegt i. d. R. mindestens 2 Jahre zurück",
    "Antrag VOR Maßnahmebeginn beim Arbeitgeber-Service der Agentur für Arbeit; Sammelantrag für mehrere Beschäftigte möglich",
    "Keine Kumulierung derselben Kosten mit Landesprogrammen (Doppelförderungsverbot)",
)
PROGRAMMES = (
    Programme("Schleswig-Holstein", "Weiterbildungsbonus Schleswig-Holstein",
              "60 % der Kosten, max. 5.000 € je Weiterbildung (bis 31.12.2028)",
              "https://www.ib-sh.de/produkt/a3-weiterbildungsbonus-schleswig-holstein/", "aktiv"),
    Programme("Brandenburg", "Weiterbildungsrichtlinie Brandenburg 2026 (ILB)",
              "betriebliche Weiterbildung bis 60 % (KMU), bis 30.06.2027",
              "https://www.ilb.de/de/weiterbildungsrichtlinie-2026/", "aktiv"),
    Programme("Sachsen-Anhalt", "Sachsen-Anhalt WEITERBILDUNG BETRIEB",
              "60 % (≤ 10 Beschäftigte) / 50 % (≤ 249), +10 Pp. bei Tarifbindung",
              "https://www.ib-sachsen-anhalt.de/de/unternehmen/aus-weiterbildung/weiterbildung-betrieblich", "aktiv"),
    Programme("Mecklenburg-Vorpommern", "Bildungsschecks für Unternehmen (GSA)", "50 %, max. 3.000 € je Scheck",
              "https://www.gsa-schwerin.de/foerderung/bildungsschecks-fuer-unternehmen", "aktiv"),
    Programme("Hamburg", "Hamburger Weiterbildungsbonus PLUS", "50 % (bis 75 % Zielgruppen), max. 750 € je Kurs",
              "https://www.esf-hamburg.de/hamburger-weiterbildungsbonus-plus-617752", "aktiv"),
    Programme("Bremen", "Bremer Weiterbildungsscheck für kleine Unternehmen",
              "50 %, max. 500 € je Scheck, 4 Schecks pro Unternehmen und Jahr",
              "https://www.bremen.de/wirtschaft/wirtschaftsfoerderung/gute-arbeit/bremer-weiterbildungsscheck-fuer-kleine-unternehmen",
              "aktiv"),
    Programme("Saarland", "Kompetenz durch Weiterbildung (KdW)", "40 %, max. 2.000 € je Mitarbeiter",
              "https://www.saarland.de/masfg/DE/portale/ausundweiterbildung/weiterbildung/kdw_/kdw", "aktiv"),
    Programme("Rheinland-Pfalz", "Betriebliche Weiterbildung RLP (ESF+) / QualiScheck",
              "betrieblich 40 % (Region Trier 60 %), max. 1.500 € je Teilnehmer",
              "https://esf.rlp.de/berufliche-weiterbildung/betriebliche-weiterbildung", "aktiv"),
    Programme("Bayern", "ESF+ Bayern – Betriebliche Weiterbildung",
              "bis 40–50 % der Projektkosten (Trägerprojekte, Antrag prüfen)",
              "https://www.esf.bayern.de/esf-foerderung/foerderaktion/fp2021-2027/betrieblicheweiterbildung.php", "aktiv"),
    Programme("Baden-Württemberg", "ESF Plus Fachkurse BW",
              "Zuschuss auf Kursgebühren zugelassener Fachkurse (45 % ab 09/2026)",
              "https://www.esf-bw.de/projekte-und-programme-umsetzen/foerderbereich-wirtschaft/foerderprogramm-fachkurse",
              "aktiv"),
    Programme("Nordrhein-Westfalen", "Bildungsscheck NRW 2.0",
              "seit 02/2026 nur noch individueller Zugang (50 %, max. 500 €) – kein Betriebszugang mehr",
              "https://www.mags.nrw/bildungsscheck", "eingeschraenkt"),
    Programme("Sachsen", "Weiterbildungsscheck Sachsen (betrieblich)",
              "derzeit ausgesetzt (keine Antragstellung 2025/2026) – nur § 82 SGB III argumentieren",
              "https://www.sab.sachsen.de", "ausgesetzt"),
    Programme("Thüringen", "Weiterbildungsscheck Thüringen", "Antragsstopp, Neustart voraussichtlich Herbst 2026",
              "https://www.aw-landesverwaltungsamt.thueringen.de/foerderung/foerderung-a-z/weiterbildungsscheck",
              "ausgesetzt"),
)

# --- Fixed values: search profiles ----------------------------------------------------------------


class Profile(NamedTuple):
    queries: tuple[str, ...]
    types: tuple[str, ...] = ()


PROFILES = {
    "makler": Profile(
        ("Immobilienmakler", "Immobilienbüro", "Immobilienvermittlung", "Makler Wohnung Haus"), ("real_estate_agency",)),
    "versicherung": Profile(
        ("Versicherungsmakler", "Versicherungsbüro", "Finanzberatung", "Versicherungsagentur"), ("insurance_agency",)),
    "handwerk": Profile(
        ("Elektrotechnik Betrieb", "Sanitär Heizung Klima Betrieb", "Schreinerei", "Malerbetrieb", "Dachdecker",
         "Bauunternehmen", "Metallbau"),
        ("electrician", "plumber", "roofing_contractor", "general_contractor", "painter")),
    "steuer_recht": Profile(
        ("Steuerberater", "Steuerberatungsgesellschaft", "Rechtsanwaltskanzlei", "Wirtschaftsprüfer"),
        ("accounting", "lawyer")),
    "gesundheit": Profile(
        ("Pflegedienst", "Physiotherapie Praxis", "Zahnarztpraxis", "Apotheke", "Augenoptiker"),
        ("physiotherapist", "dentist", "pharmacy", "home_health_care_service")),
    "auto_technik": Profile(("Autohaus", "Kfz-Werkstatt", "Autolackiererei"), ("car_dealer", "car_repair")),
    "agenturen_it": Profile(("Werbeagentur", "IT-Dienstleister", "Softwareentwicklung", "Digitalagentur")),
    "logistik_handel": Profile(
        ("Spedition", "Großhandel", "Logistikunternehmen", "Kurierdienst"), ("moving_company", "courier_service")),
    "produktion": Profile(
        ("Maschinenbau", "Metallverarbeitung", "Kunststoffverarbeitung", "Werkzeugbau", "Feinmechanik")),
    "immobilien_finanzen": Profile(
        ("Immobilienmakler", "Hausverwaltung", "Versicherungsbüro"), ("real_estate_agency", "insurance_agency")),
    "gastro_hotel": Profile(("Hotel", "Restaurant", "Catering"), ("hotel", "restaurant")),
}
DEFAULT_PROFILE = "makler"

# --- Rule tables ----------------------------------------------------------------------------------


def postal_zones(spark: SparkSession) -> DataFrame:
    """zone ('01'..'99'), state: ranges unrolled so that the lookup is an equi-join."""
    rows = [(f"{n:02d}", state) for lo, hi, state in PLZ_RANGES for n in range(lo, hi + 1)]
    return spark.createDataFrame(rows, "zone string, state string")


def funding_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANDS), "band string, lo int, hi int, cost_pct int, wage_pct int")


def funding_programmes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROGRAMMES), "state string, programme string, note string, url string, status string")


def funding_reference(spark: SparkSession) -> DataFrame:
    """All funding rules as one ordered table for the reader of the results."""
    kind = "Bund (§ 82 SGB III)"
    rows: list[tuple] = [(kind, b.band, b.cost_pct, b.wage_pct, "", FUNDING_URL) for b in BANDS]
    rows += [("Bonus", "", None, None, note, "") for note in BONUS_NOTES]
    rows += [("Voraussetzung", "", None, None, note, "") for note in PREREQUISITES]
    for p in PROGRAMMES:
        state = "" if p.status == "aktiv" else f" [{p.status}]"
        rows.append(("Landesprogramm", p.state, None, None, f"{p.programme}: {p.note}{state}", p.url))
    rows.append(("Stand", FUNDING_AS_OF, None, None, "Werte vor Kundengesprächen prüfen", ""))
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "ord int, category string, band_or_state string, cost_pct int, wage_pct int, note string, url string",
    )
