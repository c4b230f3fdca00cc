"""Erasure from stored tables: rows past their retention and rows of people who object leave the files themselves.

A table is stored by day. Only days that lose rows are written again, by dynamic partition overwrite; days without a
hit keep their files, and days of which nothing is left lose their folder.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.operators.guard import listed_keys, normalised, retain, suppress
from firmatlas.session import write_stage


def write_by_day(rows: DataFrame, path: str, at: str, day: str = "day") -> None:
    """Store a table by the day of ``at``. Rows of a day meet in as many tasks as Spark finds useful."""
    dated = rows.withColumn(day, F.to_date(at))
    dated.repartition(day, F.pmod(F.xxhash64(at), F.lit(16))).write.mode("overwrite").partitionBy(day).parquet(path)


def touched_days(stored: DataFrame, objections: DataFrame, limit: datetime, at: str, day: str, keys: dict[str, str]) -> list:
    """Days with a row to erase: one value per day reaches the driver. A row without a time is past its retention."""
    found = stored.where(F.col(at).isNull() | (F.col(at) < F.lit(limit))).select(day)
    for kind, column in keys.items():
        hit = stored.select(day, normalised(kind, F.col(column)).alias("_k")).join(listed_keys(objections, kind), "_k", "left_semi")
        found = found.unionByName(hit.select(day))
    return sorted((r[0] for r in found.distinct().collect()), key=str)


def erase(spark: SparkSession, path: str, objections: DataFrame, now: datetime, days: float, at: str, day: str = "day", **keys: str) -> DataFrame:
    """Erase and report: day, rows_before, rows_after of each day that lost rows.

    ``keys`` names the phone, email and domain columns to check against objections (kind, key). The rows that stay are
    written to the shared folder first, so a run that stops while it replaces days can be repeated.
    """
    path = path.rstrip("/")
    stored = spark.read.parquet(path)
    limit = now - timedelta(days=days)
    touched = touched_days(stored, objections, limit, at, day, keys)
    inside = stored.where(F.col(day).isin([d for d in touched if d is not None]) | (F.col(day).isNull() if None in touched else F.lit(False)))
    kept = retain(inside, at, F.lit(now), days)
    kept = suppress(kept, objections, **keys) if keys else kept
    counted = write_stage(inside.groupBy(day).agg(F.count("*").alias("rows_before")), "erase-before")
    staged = write_stage(kept.select(*stored.columns), "erase-kept")
    after = staged.groupBy(day).agg(F.count("*").alias("rows_after"))
    report = write_stage(counted.join(after, counted[day].eqNullSafe(after[day]), "left").select(counted[day], "rows_before", F.coalesce("rows_after", F.lit(0)).alias("rows_after")), "erase-report")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for row in report.where("rows_after = 0").select(day).collect():
        folder = hadoop.Path(f"{path}/{day}={'__HIVE_DEFAULT_PARTITION__' if row[0] is None else row[0]}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return report
