"""Incremental runs: each arriving company is processed once, and a stopped run goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firmatlas.operators.guard import Retention, protect
from firmatlas.operators.resolve import unseen

Process = Callable[[DataFrame], DataFrame]


def read_results(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All results so far with their batch number; empty before the first batch. A damaged table is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(f"{schema}, batch_id bigint").parquet(out)
    return spark.createDataFrame([], f"{schema}, batch_id bigint")


def batch_writer(
    out: str,
    schema: str,
    objections: DataFrame,
    process: Process = lambda df: df,
    id_col: str = "place_id",
    domain: str = "domain",
    export: Callable[[DataFrame], None] | None = None,
    export_every: int = 10,
    retention: Retention | None = None,
    **keys: str,
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: drop what earlier batches have, process the rest, write one folder per batch.

    A repeated batch sees only the results of earlier batches and overwrites its own folder, so a crash between
    writing and committing changes nothing. Every tenth batch hands the whole table to ``export``. Rows on the
    objection list and rows past ``retention`` are not written; ``keys`` names further columns to check, the domain always is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_results(spark, out, schema).where(F.col("batch_id") < batch_id)
        fresh = unseen(batch, before.select(id_col, domain), id_col, domain)
        protect(process(fresh), objections, retention, **{"domain": domain, **keys}).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")
        if export is not None and (batch_id + 1) % export_every == 0:
            export(read_results(spark, out, schema))

    return write


def run_available(
    stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, name: str = "companies"
) -> StreamingQuery:
    """Process all waiting input and stop; the checkpoint remembers which input is done."""
    counted = stream.observe(name, F.count(F.lit(1)).alias("rows"))
    query = counted.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress_counts(query: StreamingQuery, name: str = "companies") -> list[int]:
    """Rows per finished batch, from the observed metrics."""
    return [p["observedMetrics"][name]["rows"] for p in query.recentProgress if name in (p["observedMetrics"] or {})]


def fresh_stream(stream: DataFrame, keys: list[str], at: str, ttl: str = "14 days") -> DataFrame:
    """First value per key within the time to live, by event time; state older than that is dropped."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Finished counts per key and time window, for monitoring a run."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n"))
