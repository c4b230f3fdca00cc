"""Longest match against tables: host endings in a public suffix table, number beginnings in a number plan.

The ending (or beginning) of each length becomes a row key, so the match is an equi-join of any size, and the longest hit
per distinct host or number wins. Hosts and numbers are made distinct first, so a hot one is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffix_rules(lines: DataFrame, rule: str = "rule") -> DataFrame:
    """ending, wild, exception: rows of a suffix list. ``*.ck`` covers one more label, ``!www.ck`` is none in spite of it."""
    text = F.lower(F.trim(F.col(rule)))
    plain = F.regexp_replace(text, r"^(?:!|\*\.)", "")
    read = lines.where((text != "") & ~text.startswith("//")).select(plain.alias("ending"), text.startswith("*.").alias("wild"), text.startswith("!").alias("exception"))
    return read.groupBy("ending").agg(F.bool_or("wild").alias("wild"), F.bool_or("exception").alias("exception"), F.bool_or(~F.col("wild") & ~F.col("exception")).alias("plain"))


def registrable_hosts(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """host, suffix_labels, domain for each distinct host; the domain is null for a host that is a suffix itself.

    The rule with most labels wins and an exception wins over all; without a rule the last label is the suffix.
    """
    labels = F.split("_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    each = hosts.select(F.col(host).alias("_host")).where("_host <> ''").distinct()
    tails = each.select("_host", F.size(labels).alias("_n"), F.posexplode(ends).alias("_p", "ending"))
    n = F.col("_p") + 1
    # labels of the public suffix that a matching row gives; a wildcard needs one label more than its ending
    hit = tails.join(rules, "ending", "left").select(
        "_host", "_n",
        F.when(F.col("exception"), F.struct(F.lit(1).alias("rank"), (n - 1).alias("labels")))
        .when(F.col("wild") & (F.col("_n") > n), F.struct(F.lit(0).alias("rank"), (n + 1).alias("labels")))
        .when(F.col("plain"), F.struct(F.lit(0).alias("rank"), n.alias("labels"))).alias("hit"),
    )
    best = hit.groupBy("_host", "_n").agg(F.coalesce(F.max("hit")["labels"], F.lit(1)).alias("suffix_labels"))
    domain = F.when(F.col("_n") > F.col("suffix_labels"), F.array_join(F.slice(labels, -(F.col("suffix_labels") + 1), F.col("suffix_labels") + 1), "."))
    return best.select(F.col("_host").alias(host), "suffix_labels", domain.alias("domain"))


def with_registrable_domain(rows: DataFrame, rules: DataFrame, host: str = "host", out: str = "domain") -> DataFrame:
    found = registrable_hosts(rows, rules, host).select(F.col(host).alias("_h"), F.col("domain").alias(out))
    return rows.join(found, F.col(host) == F.col("_h"), "left").drop("_h")


def number_kinds(numbers: DataFrame, plan: DataFrame, digits: str = "digits") -> DataFrame:
    """digits, prefix, region, kind, valid for each distinct number (digits with country code, no sign).

    ``plan``: prefix, region, min_len, max_len (of the whole number), kind. The longest prefix decides; the number is
    valid if its length fits that row. Numbers without a row have no region and are not valid.
    """
    longest = plan.agg(F.max(F.length("prefix"))).first()[0] or 0  # one number
    each = numbers.select(F.col(digits).alias("_d")).where("_d <> ''").distinct()
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length("_d"), F.lit(longest)), F.lit(1))), lambda i: F.substring("_d", F.lit(1), i))
    row = F.struct(F.length("prefix").alias("n"), "prefix", "region", "min_len", "max_len", "kind")
    best = each.select("_d", F.explode(heads).alias("prefix")).join(plan, "prefix").groupBy("_d").agg(F.max(row).alias("r"))
    joined = each.join(best, "_d", "left")
    fits: Column = F.coalesce(F.length("_d").between(F.col("r.min_len"), F.col("r.max_len")), F.lit(False))
    return joined.select(F.col("_d").alias(digits), "r.prefix", "r.region", F.when(fits, F.col("r.kind")).otherwise("unknown").alias("kind"), fits.alias("valid"))
