"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "firmatlas", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; a cluster overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local master may do without: then it is a private folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = spark.sparkContext.getCheckpointDir()
    if named is None and current is None and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if current is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="firmatlas-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return named or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages re-read files, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to tasks for all cores by a hash of ``by``, before work that is heavy per row.

    Spark cuts its input by bytes and row groups. A compressed file of a few megabytes may hold a million rows, which
    then all are worked on in one task.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *by)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes that begin here remove their shuffle files as they end; else these stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write an intermediate as Parquet in the shared folder and read it back.

    Used where several consumers need the same expensive columns: the cost is one write, and each
    consumer gets column pruning and filter pushdown on the stage. Its size as Spark sees it is that of its files.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(stage: DataFrame) -> None:
    """Remove the files of a stage that nobody reads any more, as of the last round of a loop."""
    jvm = stage.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in stage.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        if path.getName().startswith("stage-"):
            path.getFileSystem(stage.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
