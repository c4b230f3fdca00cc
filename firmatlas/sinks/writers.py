"""Files of a run. Every writer takes the objection list, so no table leaves without that check, and a retention period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.operators.guard import Retention, protect
from firmatlas.operators.score import lead_order


def write_json(rows: DataFrame, path: str, objections: DataFrame, mode: str = "append", retention: Retention | None = None, **keys: str) -> None:
    """JSON lines; ``keys`` names the phone, email and domain columns to check against objections."""
    protect(rows, objections, retention, **keys).write.mode(mode).json(path)


def write_parquet(
    rows: DataFrame, path: str, objections: DataFrame, by: tuple[str, ...] = (), mode: str = "overwrite", retention: Retention | None = None, **keys: str
) -> None:
    writer = protect(rows, objections, retention, **keys).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def reexport(spark: SparkSession, path: str, schema: str, min_score: int = 0, premium_only: bool = False) -> DataFrame:
    """Saved leads again, filtered and in lead order."""
    rows = spark.read.schema(schema).json(path).where(F.col("score") >= min_score)
    return (rows.where("premium") if premium_only else rows).orderBy(*lead_order())
