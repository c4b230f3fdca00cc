"""Chain exclusion by rule tables of any length: domains by equality, name rules through an index of short pieces.

A name rule is a text that a company name contains. Of its pieces of ``PIECE`` characters the one that fewest names have
becomes its entry; names are joined by their pieces with these entries, and only such pairs are compared in full. So the
work follows the number of near hits, not names times rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.operators.skew import join_counted
from firmatlas.session import write_stage

PIECE = 3


def pieces(text: Column, size: Column | int = PIECE) -> Column:
    """Distinct substrings of ``size`` characters."""
    width = F.lit(size) if isinstance(size, int) else size
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substring(text, i, width)), lambda p: F.length(p) == width))


def rule_entries(rules: DataFrame, names: DataFrame, sizes: list[int]) -> DataFrame:
    """rule_ord, pattern, piece: the rarest piece of each rule among the names (``names`` has a column ``low``)."""
    own = rules.select("rule_ord", "pattern", F.explode(pieces(F.col("pattern"), F.least(F.length("pattern"), F.lit(PIECE)))).alias("piece"))
    wanted = own.select("piece").distinct()
    counted = names.select(F.explode(F.flatten(F.array(*[pieces(F.col("low"), n) for n in sizes]))).alias("piece")).join(wanted, "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    # a piece that no name has settles the rule: it is not joined at all
    rated = own.join(counted, "piece", "left").select("rule_ord", "pattern", "piece", F.coalesce("n", F.lit(0)).alias("n"))
    best = rated.groupBy("rule_ord", "pattern").agg(F.min(F.struct("n", "piece")).alias("b"))
    return best.where("b.n > 0").select("rule_ord", "pattern", F.col("b.piece").alias("piece"))


def name_hits(rows: DataFrame, rules: DataFrame, key: str, name: str) -> DataFrame:
    """``key``, rule_ord, pattern: the first name rule that each row's name contains.

    ``rules``: pattern, rule_ord; patterns are compared without case, blanks at their ends count.
    """
    low = rules.select(F.lower("pattern").alias("pattern"), "rule_ord").where("pattern <> ''").groupBy("pattern").agg(F.min("rule_ord").alias("rule_ord"))
    # lengths of pieces in use: three numbers at most
    sizes = sorted(r["n"] for r in low.select(F.least(F.length("pattern"), F.lit(PIECE)).alias("n")).distinct().collect())
    names = rows.select(key, F.lower(name).alias("low")).where("low <> ''")
    if not sizes:
        return names.select(key, F.lit(0).alias("rule_ord"), F.lit("").alias("pattern")).where("false")
    entries = write_stage(rule_entries(low, names, sizes), "rule-entries")
    every = F.explode(F.flatten(F.array(*[pieces(F.col("low"), n) for n in sizes]))).alias("piece")
    near = join_counted(names.select(key, "low", every), entries, "piece").where(F.contains("low", "pattern"))
    return near.groupBy(key).agg(F.min(F.struct("rule_ord", "pattern")).alias("r")).select(key, "r.rule_ord", "r.pattern")


def exclusion_reasons(rows: DataFrame, rules: DataFrame, key: str = "company_id", name: str = "name", domain: str = "domain") -> DataFrame:
    """``rows`` with ``reason``: why the company counts as a chain or portal, null if it does not.

    ``rules``: kind ('domain' or 'name'), pattern, rule_ord. A listed domain tells before any name rule. Rows keep their
    order keys; ``key`` is unique per row.
    """
    listed = rules.where("kind = 'domain'").select(F.lower(F.trim("pattern")).alias("_d")).distinct()
    found = name_hits(rows, rules.where("kind = 'name'").select("pattern", "rule_ord"), key, name)
    named = found.select(key, F.concat(F.lit("Kette/Franchise (Name „"), F.trim("pattern"), F.lit("“)")).alias("_by_name"))
    joined = rows.join(listed, F.col(domain) == F.col("_d"), "left").join(named, key, "left")
    by_domain = F.when(F.col("_d").isNotNull(), F.concat(F.lit("Kette/Franchise (Domain "), "_d", F.lit(")")))
    return joined.withColumn("reason", F.coalesce(by_domain, "_by_name")).drop("_d", "_by_name")
