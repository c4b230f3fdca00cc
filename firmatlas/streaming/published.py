"""Snapshots that readers see whole or not at all, and each batch once.

Data goes to a folder of its own; a manifest that names it is written after it, under a number that nobody has used, and
put in place by one rename. Readers take the manifest with the greatest number. A run that stops halfway leaves data
without a manifest, which nobody reads and the next run of the same batch replaces.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Published:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def latest(self) -> dict | None:
        """The newest manifest: batch, folder, rows."""
        numbers = self._numbers()
        return json.loads(self._read_text(f"manifests/{numbers[-1]:020d}.json")) if numbers else None

    def publish(self, rows: DataFrame, batch_id: int) -> bool:
        """Write ``rows`` as the snapshot of a batch. False if a snapshot of this batch or a later one is there already."""
        newest = self.latest()
        if newest is not None and newest["batch"] >= batch_id:
            return False
        folder = f"data/batch={batch_id}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        count = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()  # from the footers
        name, draft = f"manifests/{batch_id:020d}.json", f"manifests/_{batch_id:020d}.draft"
        out = self._fs.create(self._path(draft), True)
        try:
            out.write(bytearray(json.dumps({"batch": batch_id, "folder": folder, "rows": count}).encode()))
        finally:
            out.close()
        if not self._fs.rename(self._path(draft), self._path(name)):
            raise OSError(f"could not publish {name}")
        return True

    def read(self) -> DataFrame:
        """The newest whole snapshot; empty before the first."""
        newest = self.latest()
        if newest is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{newest['folder']}")
