"""Time to live as keyed state: a key counts as fresh for a while after it was taken, and is taken again afterwards.

The state of a key is the time at which it was last taken. Keys are kept in buckets by their hash: one call of Python,
one state and one timer serve all keys of a bucket, so the calls of a batch do not grow with its keys. The timer stands
at the first end of a life and removes what is over, so the state holds live keys only, and both outlive a restart
through the checkpoint. Every end of a life is told as a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TAKEN, PURGED = "taken", "purged"
BUCKETS = 512
AT = "us"  # microseconds


class Lifetimes(StatefulProcessor):
    """Rows of a bucket in event time; those of one batch are sorted here by key and time."""

    def __init__(self, names: list[str], ttl: timedelta) -> None:
        self.names, self.ttl = names, ttl // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "rows binary")

    def _read(self) -> pd.DataFrame | None:
        """Live keys and when each was taken."""
        return pa.ipc.open_stream(self.live.get()[0]).read_pandas() if self.live.exists() else None

    def _write(self, before: pd.DataFrame | None, live: pd.DataFrame) -> None:
        was, now = (None if rows is None or rows.empty else self._timer(rows[AT].min()) for rows in (before, live))
        if now is None:
            self.live.clear()
        else:
            table, sink = pa.Table.from_pandas(live, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.live.update((sink.getvalue().to_pybytes(),))
        if was != now:
            if was is not None:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)

    def _timer(self, at):
        """Milliseconds after the end of the life that began at ``at``."""
        return int(at + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [*self.names, AT]
        before = self._read()
        new = pd.concat([part[columns] for part in rows], ignore_index=True)
        known = 0 if before is None else len(before)
        every = new if before is None else pd.concat([before, new], ignore_index=True)
        every["_key"] = every.groupby(self.names, sort=False, dropna=False).ngroup()
        ordered = every[known:].sort_values(["_key", AT])
        last = dict(zip(every["_key"][:known].tolist(), range(known), strict=True))  # key: row that it was taken with
        times, taken, purged = every[AT].tolist(), [], []
        for row, k in zip(ordered.index.tolist(), ordered["_key"].tolist(), strict=True):
            held = last.get(k)
            if held is not None:
                if times[row] <= times[held] + self.ttl:
                    continue
                purged.append(held)
            taken.append(row)
            last[k] = row
        if taken:
            every = every[columns]
            self._write(before, every.iloc[list(last.values())])
            yield pd.concat([every.iloc[taken].assign(event=TAKEN), every.iloc[purged].assign(event=PURGED)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        live = self._read()
        if live is not None:
            ends = (live[AT] + self.ttl) // 1000 + 1
            over = (ends < timerValues.getCurrentWatermarkInMs()) | (ends <= expiredTimerInfo.getExpiryTimeInMs())
            self._write(None, live[~over])  # its timer has run
            yield live[over].assign(event=PURGED)

    def close(self) -> None:
        pass


def lifetimes(stream: DataFrame, keys: list[str], at: str, ttl: timedelta, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """keys, ``at``, event: 'taken' when a key is new or its life is over, 'purged' when a life that began ``at`` ended.

    ``at`` is a timestamp. Rows that come more than ``late`` behind the newest one are ignored, as is a null time.
    The session needs a state store that keeps timers (``spark.sql.streaming.stateStore.providerClass``).
    A task holds the rows of one bucket in one batch and its live keys, so more keys want more ``buckets``; their
    number stays as it is for the life of a checkpoint. Keys are of plain types, no arrays, maps or structs.
    """
    fields = [T.StructField(f"k{i}", stream.schema[k].dataType) for i, k in enumerate(keys)]
    # a null among numbers would turn them into floating point numbers in Python: its place is kept apart
    bits = {f.name: 1 << i for i, f in enumerate(fields) if isinstance(f.dataType, T.NumericType)}
    rows = stream.select(*[F.col(k).alias(f.name) for k, f in zip(keys, fields, strict=True)], F.col(at).alias("at"))
    rows = rows.withWatermark("at", late).where(F.col("at").isNotNull())
    filled = [F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name) if f.name in bits else F.col(f.name) for f in fields]
    nulls = sum((F.when(F.col(name).isNull(), bit).otherwise(0) for name, bit in bits.items()), F.lit(0).cast("long")).alias("nulls")
    bucket = F.pmod(F.xxhash64(*[f.name for f in fields]), F.lit(buckets)).alias("bucket")
    grouped = rows.select(*filled, nulls, "at", F.unix_micros("at").alias(AT), bucket).groupBy("bucket")
    schema = T.StructType([*fields, T.StructField("nulls", T.LongType()), T.StructField(AT, T.LongType()), T.StructField("event", T.StringType())])
    told = grouped.transformWithStateInPandas(
        statefulProcessor=Lifetimes([*[f.name for f in fields], "nulls"], ttl), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    back = [F.when(F.col("nulls").bitwiseAND(F.lit(bits.get(f.name, 0))) == 0, F.col(f.name)).alias(k) for k, f in zip(keys, fields, strict=True)]
    return told.select(*back, F.timestamp_micros(AT).alias(at), "event")
