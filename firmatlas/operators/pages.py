"""Pages to text, lines and links. A page is one row, so every step here is a narrow transformation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions import html as H
from firmatlas.functions import urls
from firmatlas.functions.text import each
from firmatlas.rules import vocab


def page_text(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``text``. Write this as a stage when several extractors follow."""
    return pages.withColumn("text", H.visible_text(F.col("html"))).drop("html")


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per non-empty line: key columns, line_no from 0, line."""
    keep = [c for c in pages.columns if c not in ("html", "text")]
    text = F.col("text") if "text" in pages.columns else H.visible_text(F.col("html"))
    split = pages.select(*keep, H.lines_of(text).alias("_lines"))
    return each(split, keep, F.col("_lines"), "line_no", "line")


def page_links(
    pages: DataFrame, suffixes: Sequence[str] = vocab.TWO_LEVEL_SUFFIXES, url: str = "url"
) -> DataFrame:
    """One row per link: key columns, link_no from 0, href, text, kind, attrs."""
    keep = [c for c in pages.columns if c not in ("html", "text")]
    found = pages.select(*keep, H.links_of(F.col("html"), F.col(url), suffixes).alias("_links"))
    return each(found, keep, F.col("_links"), "link_no", "_l").select(
        *keep, "link_no", "_l.href", "_l.text", "_l.kind", "_l.attrs"
    )


def low_text_sites(pages: DataFrame, site: str, limit: int = 15) -> DataFrame:
    """Pages and lines per site; ``low_text`` marks sites whose only page has fewer than ``limit`` lines."""
    lines = F.col("lines") if "lines" in pages.columns else H.lines_of(H.visible_text(F.col("html")))
    counted = pages.select(site, F.size(lines).alias("_n"))
    return (
        counted.groupBy(site)
        .agg(F.count("*").alias("pages"), F.sum("_n").alias("lines"))
        .withColumn("low_text", (F.col("pages") == 1) & (F.col("lines") < limit))
    )


def site_profile(pages: DataFrame, suffixes: Sequence[str] = vocab.TWO_LEVEL_SUFFIXES) -> DataFrame:
    """Per registrable domain: pages, visible lines, links, distinct targets, pages with an e-mail.

    Everything is counted per page first, so the only shuffle carries partial sums and distinct targets.
    """
    per_page = pages.select(
        urls.registrable_domain(F.col("url"), suffixes).alias("domain"),
        H.visible_text(F.col("html")).alias("text"),
        H.links_of(F.col("html"), F.col("url"), suffixes).alias("links"),
    ).select(
        "domain",
        F.size(H.lines_of(F.col("text"))).alias("lines"),
        F.col("text").rlike(vocab.EMAIL).cast("int").alias("mail"),
        F.size("links").alias("links"),
        F.array_distinct(F.transform("links", lambda x: x["href"])).alias("targets"),
    )
    return sum_sites(per_page)


def sum_sites(per_page: DataFrame) -> DataFrame:
    """Two levels of aggregation: (domain, target) keeps distinct counting spread over tasks."""
    rows = per_page.select(
        "domain",
        F.explode_outer(  # never empty; an inner explode would compute the targets twice
            F.concat(
                F.array(
                    F.struct(
                        F.lit(None).cast("string").alias("target"),
                        F.lit(1).alias("pages"),
                        F.col("lines").alias("lines"),
                        F.col("links").alias("links"),
                        F.col("mail").alias("mail"),
                    )
                ),
                F.transform(
                    "targets",
                    lambda t: F.struct(
                        t.alias("target"),
                        F.lit(0).alias("pages"),
                        F.lit(0).alias("lines"),
                        F.lit(0).alias("links"),
                        F.lit(0).alias("mail"),
                    ),
                ),
            )
        ).alias("r"),
    ).select("domain", "r.*")
    by_target = rows.groupBy("domain", "target").agg(
        *[F.sum(c).alias(c) for c in ("pages", "lines", "links", "mail")]
    )
    return by_target.groupBy("domain").agg(
        F.sum("pages").alias("pages"),
        F.sum("lines").alias("lines"),
        F.sum("links").alias("links"),
        F.count("target").alias("targets"),
        F.sum("mail").alias("pages_with_email"),
    )


def page_kinds(pages: DataFrame, anchor: Column | None = None) -> DataFrame:
    k = urls.page_kind(F.col("url"), anchor)
    return pages.select(*pages.columns, k.alias("_k")).select(*pages.columns, "_k.priority", "_k.kind")
