"""Counters of a run, observed while its tables are written, so that counting costs no job of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from firmatlas.sinks.tables import meta_entries
from firmatlas.sources.spec import SearchSpec


def observed(rows: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows`` that count themselves when they are written; afterwards the numbers are in ``get`` of the second."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def observed_meta(spark: SparkSession, spec: SearchSpec, seen: Observation) -> DataFrame:
    """The run-meta table from what was observed while the leads were written (``tables.lead_counts``)."""
    entries = meta_entries(spec, {k: str(v) for k, v in seen.get.items()})
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "ord int, parameter string, value string")
