"""Company resolution that goes on from batch to batch, without clustering what is there again.

What is stored is a star per key: the key and the cluster that has it. A batch joins its keys with the stars, so only
clusters that the batch touches take part, each as one record beside the batch's own. When a batch joins clusters, the
smallest keeps its name and the others are listed as renamed; older rows are read through that list and stay as written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.operators.resolve import clusters
from firmatlas.session import cut_lineage

MEMBERS, STARS, RENAMED = "record bigint, cluster bigint", "token string, cluster bigint", "cluster bigint, into bigint"


@dataclass(frozen=True)
class Entities:
    """``members`` (record, cluster) and ``stars`` (token, cluster) as written, ``renamed`` (cluster, into) to read them."""

    members: DataFrame
    stars: DataFrame
    renamed: DataFrame

    def current(self) -> DataFrame:
        """record, cluster as of now."""
        return named(self.members, self.renamed)


def no_entities(spark: SparkSession) -> Entities:
    return Entities(*[spark.createDataFrame([], schema) for schema in (MEMBERS, STARS, RENAMED)])


def named(rows: DataFrame, renamed: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows with the present name of their cluster."""
    to = renamed.select(F.col("cluster").alias("_old"), F.col("into").alias("_new"))
    joined = rows.join(to, F.col(cluster) == F.col("_old"), "left")
    return joined.withColumn(cluster, F.coalesce("_new", cluster)).drop("_old", "_new")


def resolve_batch(pairs: DataFrame, known: Entities) -> Entities:
    """What a batch of ``pairs`` (record, token) adds: its members, the stars of new keys, and the whole new list of names.

    Records of a batch have numbers that no earlier record has. The list of renamed clusters is the only part that is
    written again; it holds one row per cluster that was ever joined to a smaller one.
    """
    asked = pairs.select("token").distinct()
    touched = cut_lineage(named(known.stars.join(asked, "token", "left_semi"), known.renamed))
    linked = cut_lineage(clusters(pairs.select("record", "token").unionByName(touched.select(F.col("cluster").alias("record"), "token"))))
    old = touched.select(F.col("cluster").alias("record")).distinct()
    changed = cut_lineage(linked.join(old, "record", "left_semi").where("record <> cluster").select(F.col("record").alias("cluster"), F.col("cluster").alias("into")))
    members = linked.join(old, "record", "left_anti").select("record", "cluster")
    fresh = pairs.join(touched.select("token"), "token", "left_anti").join(linked, "record")
    stars = fresh.groupBy("token").agg(F.min("cluster").alias("cluster"))
    renamed = named(known.renamed, changed, "into").unionByName(changed)
    return Entities(members, stars, renamed)


class EntityStore:
    """Entities in a folder, written batch by batch; a repeated batch replaces what it wrote before.

    Members and stars are one folder per batch, the names one whole version per batch, so a batch reads the version
    before it and never changes a file of another batch.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _batches(self, before: int) -> list[int]:
        """Numbers of finished batches: their names are written last."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/renamed")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [s.getPath() for s in fs.listStatus(folder) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(n for n in (int(p.getName().split("=")[1]) for p in done) if n < before)

    def before(self, batch_id: int) -> Entities:
        done = self._batches(batch_id)
        return Entities(self._read("members", MEMBERS, done), self._read("stars", STARS, done), self._read("renamed", RENAMED, done[-1:]))

    def add(self, pairs: DataFrame, batch_id: int) -> None:
        """One batch; also the body of a ``foreachBatch``."""
        new = resolve_batch(pairs, self.before(batch_id))
        for name in ("members", "stars", "renamed"):
            getattr(new, name).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def current(self) -> DataFrame:
        """record, cluster after all finished batches."""
        return self.before(1 << 62).current()
