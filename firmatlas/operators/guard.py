"""Data protection before every sink: objections, retention and masking."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions import phone as P
from firmatlas.functions import urls


NORMAL = {"phone": P.phone_key, "email": lambda c: F.lower(F.trim(c)), "domain": urls.registrable_domain}


def normalised(kind: str, value: Column) -> Column:
    """The form in which a number, address or domain is compared."""
    return NORMAL[kind](value)


def listed_keys(objections: DataFrame, kind: str) -> DataFrame:
    """_k: distinct objected values of one kind."""
    return objections.where(F.col("kind") == kind).select(normalised(kind, F.col("key")).alias("_k")).where("_k is not null").distinct()


def suppress(rows: DataFrame, objections: DataFrame, phone: str | None = None, email: str | None = None, domain: str | None = None) -> DataFrame:
    """Drop rows whose number, address or domain is on the objection list (kind, key)."""
    if phone is None and email is None and domain is None:
        raise ValueError("name at least one column to check against objections")
    out = rows
    for kind, column in (("phone", phone), ("email", email), ("domain", domain)):
        if column is not None:
            out = out.withColumn("_k", normalised(kind, F.col(column))).join(listed_keys(objections, kind), "_k", "left_anti").drop("_k")
    return out


def retain(rows: DataFrame, at: str, now: Column, days: float) -> DataFrame:
    """Keep rows that are not older than the retention period."""
    return rows.where(F.col(at) >= now - F.expr(f"make_dt_interval(0, 0, 0, {days * 86400})"))


@dataclass(frozen=True)
class Retention:
    """How long rows may be kept: their time column, the time it is, and a number of days."""

    at: str
    now: datetime
    days: float


def protect(rows: DataFrame, objections: DataFrame, retention: Retention | None = None, **keys: str) -> DataFrame:
    """What every sink applies: no row of people who object, and none past its retention."""
    kept = suppress(rows, objections, **keys)
    return kept if retention is None else retain(kept, retention.at, F.lit(retention.now), retention.days)


def mask_phone(c: Column) -> Column:
    """Country and area stay readable, the rest is hidden."""
    head = F.regexp_extract(c, r"^(\+?\d{5})", 1)
    return F.concat(head, F.regexp_replace(F.substring(c, F.length(head) + 1, F.length(c)), r"\d", "*"))


def mask_email(c: Column) -> Column:
    return F.concat(F.left(F.sha2(F.lower(c), 256), F.lit(12)), F.lit("@"), F.substring_index(c, "@", -1))
