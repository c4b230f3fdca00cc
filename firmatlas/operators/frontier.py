"""Crawl planning for any fetcher: candidate links, name hints, robots rules and the page budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmatlas.functions import names as N
from firmatlas.functions import urls
from firmatlas.operators.skew import top_rows
from firmatlas.rules import vocab
from firmatlas.session import write_stage


def candidates(
    links: DataFrame, loaded: DataFrame | None = None, site: str = "company_id", suffixes: Sequence[str] = vocab.TWO_LEVEL_SUFFIXES
) -> DataFrame:
    """Distinct internal targets per site with priority, in the order they were first seen.

    ``links`` needs site, page_ord, page_id, link_no, href, text, kind and base_domain.
    """
    rows = links.where(F.col("kind") == "internal").where(
        urls.registrable_domain(F.col("href"), suffixes) == F.col("base_domain")
    )
    ranked = rows.withColumn("priority", urls.page_kind(F.col("href"), F.col("text"))["priority"]).where(
        ~urls.is_skipped_link(F.col("href"), F.col("priority"))
    )
    personal = urls.is_person_path(F.col("href")) | N.is_name(F.col("text"))
    mobile = (F.col("priority") == 9) & F.col("text").rlike(vocab.MOBILE_ANCHOR)
    at = F.struct("page_ord", "page_id", "link_no")
    first = (
        ranked.withColumn("priority", F.when(personal | mobile, 5).otherwise(F.col("priority")))
        .withColumn("page_key", urls.page_key(F.col("href")))
        .groupBy(site, "page_key")
        .agg(
            F.min_by("href", at).alias("href"), F.min_by("text", at).alias("text"),
            F.min_by("priority", at).alias("priority"), F.min(at).alias("seen_at"),
        )
    )
    if loaded is None:
        return first
    done = loaded.select(site, urls.page_key(F.col("url")).alias("page_key")).distinct()
    return first.join(done, [site, "page_key"], "left_anti")


def promote_hints(rows: DataFrame, hints: DataFrame, site: str = "company_id") -> DataFrame:
    """Links that mention a surname from the legal notice rank 4. ``hints``: site, names (a short list)."""
    hay = F.lower(F.concat_ws(" ", "href", "text"))
    hit = F.exists("names", lambda h: (F.length(h) >= 3) & F.contains(F.col("_hay"), F.lower(h)))
    return (
        rows.withColumn("_hay", hay)
        .join(hints, site, "left")
        .withColumn("hinted", F.coalesce(hit, F.lit(False)))
        .withColumn("priority", F.when(F.col("hinted"), F.least("priority", F.lit(4))).otherwise(F.col("priority")))
        .drop("_hay", "names")
    )


def hint_names(legal_people: DataFrame, site: str = "company_id") -> DataFrame:
    """Distinct surnames per site; legal notices are two pages at most, so the list stays short."""
    rows = legal_people.select(site, N.surname(F.col("name")).alias("sn")).where(F.length("sn") >= 3)
    return rows.groupBy(site, "sn").agg(F.count("*").alias("_n")).groupBy(site).agg(F.array_sort(F.collect_list("sn")).alias("names"))


def plan(rows: DataFrame, budget: int = 8, loaded: int = 1, site: str = "company_id") -> DataFrame:
    """Pages to load next: by priority, then first seen; pages of no known kind only while room is ample."""
    order = [F.col("priority"), F.col("seen_at"), F.col("page_key")]
    top = top_rows(rows, [site], order, max(budget - loaded, 0))
    return top.where((F.col("priority") < 9) | (F.col("rank") <= max(3, budget - 2) - loaded))


def plan_more(rows: DataFrame, extra: int = 4, site: str = "company_id") -> DataFrame:
    """Second round: legal, contact and team pages, and pages that mention a known name."""
    wanted = rows.where((F.col("priority") <= 2) | F.col("hinted"))
    return top_rows(wanted, [site], [F.col("priority"), F.col("seen_at"), F.col("page_key")], extra)


CANDIDATE = "href string, text string, priority int, round_no int, seen_at struct<page_ord:bigint,page_id:bigint,link_no:int>"


@dataclass(frozen=True)
class Crawl:
    """What a crawl knows between rounds, one row per site and page key: asked pages, open candidates, and name hints."""

    asked: DataFrame  # site, page_key, round_no
    open: DataFrame  # site, page_key, href, text, priority, round_no, seen_at
    hints: DataFrame  # site, hint


def start_crawl(starts: DataFrame, site: str = "company_id") -> Crawl:
    """``starts``: site and url of the first page of each site, which counts as asked in round 0."""
    spark, kind = starts.sparkSession, starts.schema[site].dataType.simpleString()
    asked = starts.select(site, urls.page_key(F.col("url")).alias("page_key"), F.lit(0).alias("round_no")).distinct()
    return Crawl(
        asked,
        spark.createDataFrame([], f"{site} {kind}, page_key string, {CANDIDATE}"),
        spark.createDataFrame([], f"{site} {kind}, hint string"),
    )


def within_budget(rows: DataFrame, asked: DataFrame, budget: int, site: str) -> DataFrame:
    """The next pages of each site that its budget still has room for, under the rules of ``plan``."""
    used = asked.groupBy(site).agg(F.count("*").alias("_used"))
    top = top_rows(rows, [site], [F.col("priority"), F.col("round_no"), F.col("seen_at"), F.col("page_key")], budget)
    room = top.join(used, site, "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    fits = F.col("rank") <= F.lit(budget) - F.col("_used")
    known = (F.col("priority") < 9) | (F.col("rank") <= F.lit(max(3, budget - 2)) - F.col("_used"))
    return room.where(fits & known).drop("_used")


def next_round(
    state: Crawl,
    links: DataFrame,
    round_no: int,
    budget: int = 8,
    extra: int | None = None,
    legal_people: DataFrame | None = None,
    site: str = "company_id",
    suffixes: Sequence[str] = vocab.TWO_LEVEL_SUFFIXES,
    allow: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> tuple[Crawl, DataFrame]:
    """The state after one more round and the pages to load in it: site, page_key, href, priority, hinted, rank.

    ``links`` are the links of the pages that the round before loaded; only they are read. Targets that were asked for
    leave by an anti-join, the others join the open candidates, each under the link that named it first. ``legal_people``
    are people found on those pages; their surnames promote links, from this round on. With ``extra`` the round is a
    second pass: up to that many legal, contact, team or hinted pages besides the budget. ``allow`` may drop targets.
    """
    found = candidates(links, site=site, suffixes=suffixes).withColumn("round_no", F.lit(round_no))
    columns = [site, "page_key", "href", "text", "priority", "round_no", "seen_at"]
    at = F.struct("round_no", "seen_at")
    first = [F.min_by(c, at).alias(c) for c in columns[2:]]
    every = state.open.unionByName(allow(found).select(columns)).groupBy(site, "page_key").agg(*first)
    every = every.join(state.asked, [site, "page_key"], "left_anti")
    hints = state.hints
    if legal_people is not None:
        named = legal_people.select(site, F.lower(N.surname(F.col("name"))).alias("hint")).where(F.length("hint") >= 3)
        hints = write_stage(hints.unionByName(named).distinct(), "crawl-hints")
    # one short list per site: the surnames of its legal notices
    listed = hints.groupBy(site).agg(F.array_sort(F.collect_list("hint")).alias("names"))
    # every target with the priority of its link beside the promoted one, so that it is read off its links once
    rows = write_stage(promote_hints(every.withColumn("_named", F.col("priority")), listed, site), "crawl-open")
    if extra is None:
        chosen = within_budget(rows, state.asked, budget, site)
    else:
        chosen = plan_more(rows.withColumn("seen_at", at), extra, site)
    chosen = write_stage(chosen.select(site, "page_key", "href", "priority", "hinted", "rank"), "crawl-chosen")
    # promoted priorities are not stored: a later round promotes again with the hints of that time
    left = rows.join(chosen, [site, "page_key"], "left_anti")
    rest = left.withColumn("priority", F.col("_named")).select(columns)  # of two stored tables; the next round reads it once
    now = state.asked.unionByName(chosen.select(site, "page_key", F.lit(round_no).alias("round_no")))
    return Crawl(write_stage(now, "crawl-asked"), rest, hints), chosen


def robots_by_host(rules: DataFrame, agent: str) -> DataFrame:
    """host -> rules of our agent and of everyone. One robots file is one small list."""
    named = F.contains(F.lit(agent.lower()), F.lower(F.col("agent")))
    entry = F.struct("rule_no", "path_prefix", "allow")
    return rules.groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(named & (F.col("agent") != "*"), entry))).alias("own"),
        F.array_sort(F.collect_list(F.when(F.col("agent") == "*", entry))).alias("everyone"),
    )


def allowed(links: DataFrame, rules: DataFrame, agent: str, url: str = "href") -> DataFrame:
    """Links that robots rules permit: the first rule whose path fits decides, no rule means yes."""
    target = F.concat(urls.path(F.col(url)), F.when(urls.query(F.col(url)) == "", "").otherwise(F.concat(F.lit("?"), urls.query(F.col(url)))))

    def verdict(name: str):
        fits = F.filter(name, lambda r: F.col("_path").startswith(r["path_prefix"]) & (r["path_prefix"] != ""))
        return F.coalesce(F.try_element_at(fits, F.lit(1))["allow"], F.lit(True))

    joined = (
        links.withColumn("host", urls.host(F.col(url)))
        .withColumn("_path", F.when(target == "", "/").otherwise(target))
        .join(robots_by_host(rules, agent), "host", "left")
    )
    own = F.when(F.size("own") > 0, verdict("own")).otherwise(verdict("everyone"))
    return joined.where(own & verdict("everyone")).drop("own", "everyone", "_path")
