"""Building blocks that keep one hot key from landing in one task.

``kth_row`` selects by rank through nested histograms, ``chunked`` cuts ordered groups into pieces that
overlap by a few rows, and ``running_total`` adds chunk offsets to sums inside chunks. All are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmatlas.session import write_stage

SENT_ROWS = 20_000  # of a table that a join may send to all executors


def kth_row(df: DataFrame, keys: Sequence[str], levels: Sequence[str], rank: Column) -> DataFrame:
    """The row at position ``rank`` (from 1) per key in the order of ``levels``.

    ``rank`` may use ``_n``, the group size. Counts are taken once over all levels with map-side
    partial sums; each level then looks only at its own distinct values inside the value chosen
    before, so no task ever sorts a whole group. The last level must make rows unique.
    """
    # read once for each level
    base = write_stage(df.groupBy(*keys, *levels).agg(F.count("*").alias("_c")), "rank-levels")
    todo = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, rank.cast("long").alias("_k"))
    fixed: list[str] = []
    for level in levels:
        on = [*keys, *fixed]
        inside = base.join(todo, on)
        sums = inside.groupBy(*on, level, "_k").agg(F.sum("_c").alias("_c"))
        w = Window.partitionBy(*on).orderBy(level)
        upto = sums.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        todo = upto.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k"))).select(
            *on, level, (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k")
        )
        fixed.append(level)
    return df.join(todo.drop("_k"), [*keys, *fixed], "left_semi")


def upper_median(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], width: int | None = None) -> DataFrame:
    """Row at index n div 2 of the group sorted by an integer ``value``, then by ``order``.

    ``width`` adds a first level of value ranges, for values with very many different numbers.
    """
    rank = F.floor(F.col("_n") / 2) + 1
    if width is None:
        return kth_row(df, keys, [value, *order], rank)
    staged = df.withColumn("_coarse", F.floor(F.col(value) / width))
    return kth_row(staged, keys, ["_coarse", value, *order], rank).drop("_coarse")


def chunked(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], before: int = 0, after: int = 0
) -> DataFrame:
    """Rows plus copied border rows: each (keys, _chunk) holds the neighbours its window frames need.

    ``chunk`` must not decrease along ``order``. Copies carry ``_halo`` = true; drop them after the
    window. Only ``before`` + ``after`` rows per chunk are copied.
    """
    cut = df.withColumn("_chunk", chunk)
    index = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_chunk")))
        .drop("_rows")
    )
    parts = [cut.withColumn("_halo", F.lit(False))]
    for size, ascending in ((before, False), (after, True)):
        if not size:
            continue
        sort = [F.col(c).asc() if ascending else F.col(c).desc() for c in order]
        w = Window.partitionBy(*keys, "_chunk").orderBy(*sort)
        edge = cut.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")
        steps = F.sequence(F.lit(1), F.lit(size))
        shift = F.transform(steps, lambda s: F.col("_i") + (-s if ascending else s))
        moved = edge.join(index, [*keys, "_chunk"]).withColumn("_i", F.explode(shift)).drop("_chunk")
        parts.append(moved.join(index, [*keys, "_i"]).drop("_i").withColumn("_halo", F.lit(True)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunk_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def running_total(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Running sum per key: sums inside chunks plus the total of all earlier chunks."""
    cut = df.withColumn("_chunk", chunk)
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.sum(value).over(inner) + F.col("_o"))
        .drop("_chunk", "_o")
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, number: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark keeps k rows per task before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).where(F.col(number) <= k)


def join_counted(rows: DataFrame, small: DataFrame, on: str | list[str], most: int = SENT_ROWS) -> DataFrame:
    """``rows`` joined with a stored table whose rows are counted first: up to ``most`` of them are sent, more are shuffled.

    For exploded ``rows``: Spark's estimate of their size leaves out how long the arrays were, so by size alone it may
    send them, the large side, through the driver.
    """
    sent = small.limit(most + 1).count() <= most
    return rows.join(F.broadcast(small) if sent else small.hint("merge"), on)


def first_by(value: Column, order: Column, when: Column | None = None) -> Column:
    """Value of the earliest row where ``when`` holds (default: value not null)."""
    test = value.isNotNull() if when is None else when
    return F.min_by(value, F.when(test, order))
