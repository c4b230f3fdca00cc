"""Streaming queries over the events table, fed as files."""

from __future__ import annotations

import uuid
from contextlib import suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmatlas.plans.catalog.base import query, table
from firmatlas.session import checkpoint_dir
from firmatlas.streaming import runs as RN


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _feed(spark, sf, rows: DataFrame, files: int = 4) -> tuple[DataFrame, str]:
    """The rows as a file stream of a few batches, and a folder for its output."""
    src, out = _folder(spark, "feed"), _folder(spark, "stream")
    rows.repartition(files).write.parquet(src)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(src), out


@query("resumable_stream", """
select distinct user_id || '-' || event_type as place_id, cast(1 as bigint) as times from events where user_id % 10 <> 3""")
def resumable_stream(spark, sf):
    """The run breaks off in its second batch and is started again; every tenth user objects."""
    rows = table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("place_id"), F.col("event_id").alias("ord")
    )
    rows = rows.select("place_id", F.concat(F.lit("https://www.u"), "place_id", F.lit(".de/")).alias("domain"), "ord")
    stream, out = _feed(spark, sf, rows)
    schema = "place_id string, domain string, ord bigint"
    objections = rows.where("cast(split(place_id, '-')[0] as bigint) % 10 = 3").select(F.lit("domain").alias("kind"), F.concat(F.lit("u"), "place_id", F.lit(".de")).alias("key"))

    def broken(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("stopped")
        RN.batch_writer(f"{out}/rows", schema, objections)(batch, batch_id)

    with suppress(StreamingQueryException):
        RN.run_available(stream, broken, f"{out}/checkpoint")
    for _ in range(2):  # the second of these runs finds everything done
        RN.run_available(stream, RN.batch_writer(f"{out}/rows", schema, objections), f"{out}/checkpoint")
    return RN.read_results(spark, f"{out}/rows", schema).groupBy("place_id").agg(F.count("*").alias("times"))


@query("stream_first_in_ttl", "select user_id, event_type, cast(1 as bigint) as times from events group by 1, 2")
def stream_first_in_ttl(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    stream, out = _feed(spark, sf, rows)
    once = RN.fresh_stream(stream, ["user_id", "event_type"], "ts", "400 days")
    q = once.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").groupBy("user_id", "event_type").agg(F.count("*").alias("times"))
