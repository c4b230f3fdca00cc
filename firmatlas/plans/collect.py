"""From the answers of many searches to one company list: union of hits, resolution, and the chain filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmatlas.operators.exclusion import exclusion_reasons
from firmatlas.operators.resolve import dedupe_companies, merge_records
from firmatlas.operators.skew import top_rows
from firmatlas.session import spread
from firmatlas.sources.readers import companies_from_places

PAGE_BITS, HIT_BITS = 12, 12
MOST_HITS = 60  # of one search


def hit_order(task, page, position):
    """One number per hit, in the order of tasks, answer pages and places in an answer."""
    fits = page.between(0, (1 << PAGE_BITS) - 1) & position.between(0, (1 << HIT_BITS) - 1)
    number = F.shiftleft(F.shiftleft(task.cast("long"), PAGE_BITS) + page, HIT_BITS) + position
    return F.when(fits, number).otherwise(F.raise_error(F.lit("page or position of a hit out of range")))


def search_hits(answers: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """Company rows of all answers, the first ``most`` usable ones of each search.

    ``answers``: task_no, page_no (from 0), query, places (array, as in ``sources.readers.PLACES_SCHEMA``). ``ord`` is
    made of task, page and position, so it doesn't depend on how Spark splits the input. Hits are read by all cores: the
    answers are dealt once, by search, so that the usable places of a search are picked where they are read.
    """
    answers = spread(answers.withColumn("_task", F.col("task_no").cast("long")), "_task")
    rows = answers.select("_task", "page_no", "query", F.posexplode_outer("places").alias("_no", "place")).where("_no is not null")  # an inner explode would compute the array twice
    order = hit_order(F.col("_task"), F.col("page_no"), F.col("_no"))
    usable = companies_from_places(rows, F.col("query"), order, keep=("_task",))
    return top_rows(usable, ["_task"], [F.col("ord")], min(most, MOST_HITS), "_hit").drop("_task", "_hit")


def union_hits(hits: DataFrame) -> DataFrame:
    """One row per place id: first seen, gaps filled from later hits, all its search terms in order."""
    return merge_records(hits.withColumn("_place", F.col("place_id")), cluster="_place").drop("_place")


def search_companies(answers: DataFrame, rules: DataFrame | None = None, most: int = MOST_HITS) -> DataFrame:
    """Resolved companies of all searches with ``reason``: null for those that stay, else why a chain rule drops them."""
    companies = dedupe_companies(search_hits(answers, most))
    if rules is None:
        return companies.withColumn("reason", F.lit(None).cast("string"))
    return exclusion_reasons(companies, rules, key="ord")
