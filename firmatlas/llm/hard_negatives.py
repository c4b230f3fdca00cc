"""Hard negatives: per anchor and positive, the best rows of other labels that score almost as high as the positive.

Scores are exact integer inner products by Kronecker packing. The components of several candidates are made
non-negative by a bias and laid into separated bit fields of one wide integer, so one multiplication by an anchor
component serves them all, and the sum over the components holds each candidate's product in its own field. The wide
integer is the 53-bit significand of a double while a field fits into it (two candidates at 8-bit components, and the
sums are one matrix product); larger components take Python integers, which have no end.

Anchors are compared with all rows, in blocks: the grid has blocks of anchors (bounded by bytes) times columns of rows
(by a hash of the id, so of like size). A task streams the rows of its cell in the order of their ids past the anchors
and keeps the best few of each. Two passes: the first finds the positives, the second the negatives of each positive's
band. Nothing is sampled, and no task holds more than one block of anchors and one batch of rows.

Defined results: rows with a null id, a null label, a null vector or a null or non-finite component take no part
(a component is also non-finite if it overflows when scaled). An empty vector scores 0; of two vectors the shorter is
read as padded with zeros. Rows with the anchor's id are not its partners. An id that several anchor rows have is one
anchor, its smallest row by label and vector; other repeated rows count each. Ties go to the smaller id. Scores outside
a 64-bit integer stop at its ends. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.llm.common import shipped
from firmatlas.operators.skew import top_rows
from firmatlas.session import write_stage

SCALE = 256
ANCHOR_BYTES = 64 << 20  # of a block of anchors with what they hold
COLUMN_ROWS = 1 << 21  # rows that stream through one task
LEAST_ROWS = 4096  # a column is not made shorter than this for the sake of more tasks
PRODUCTS = 1 << 20  # scores in memory at once
SIGNIFICAND = 53
LONG = np.iinfo(np.int64)
CODED = "vec_id long, label long, n int, codes binary"
BEST = "anchor_id long, band int, score long, other_id long"


def coded(vectors: pa.ListArray, scale: int = SCALE) -> tuple[list[bytes | None], np.ndarray]:
    """floor(scale * x) of each vector, in two bytes a component if they fit and else as doubles; None if not usable."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.slice(ends[0], ends[-1] - ends[0])
    ends -= ends[0]
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # a null is read as nan
    unusable = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    wide = np.concatenate([[0], np.cumsum(~(np.abs(x) < 1 << 15))])
    narrow = np.where(np.abs(x) < 1 << 15, x, 0).astype(np.int16)
    codes: list[bytes | None] = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        codes.append(None if unusable[a] < unusable[b] else x[a:b].tobytes() if wide[a] < wide[b] else narrow[a:b].tobytes())
    return codes, np.diff(ends).astype(np.int32)


def matrix(codes: list[bytes], sizes: list[int]) -> np.ndarray:
    """Vectors as rows, padded with zeros; int16 while all fit."""
    n = max(sizes, default=0)
    narrow = all(len(c) == 2 * k for c, k in zip(codes, sizes, strict=True))
    if narrow and all(k == n for k in sizes):
        return np.frombuffer(b"".join(codes), dtype=np.int16).reshape(len(codes), n)
    out = np.zeros((len(codes), n), dtype=np.int16 if narrow else np.float64)
    for i, (c, k) in enumerate(zip(codes, sizes, strict=True)):
        out[i, :k] = np.frombuffer(c, dtype=np.int16 if len(c) == 2 * k else np.float64)
    return out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    n = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, n - p.shape[1]))) for p in parts])


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """The same values as Python integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


class Packed:
    """Candidate rows in separated fields of wide integers, ready for anchors whose components lie in given limits."""

    def __init__(self, rows: np.ndarray, least: float, most: float) -> None:
        self.count, self.n = rows.shape
        low = min(float(rows.min(initial=0)), 0.0)
        self.row_bias, self.anchor_bias = int(-low), int(-min(least, 0.0))
        row, anchor = int(max(float(rows.max(initial=0)), 0.0)) + self.row_bias, int(max(most, 0.0)) + self.anchor_bias
        self.bits = max(1, (max(self.n, 1) * max(row, 1) * max(anchor, 1)).bit_length())
        self.exact = self.bits <= SIGNIFICAND  # a double holds a field, and so whole sums
        self.fields = max(1, min(SIGNIFICAND // self.bits, self.count)) if self.exact else 8
        biased = (rows.astype(np.float64) if self.exact else whole_numbers(rows)) + self.row_bias
        sums = biased.sum(axis=1) if self.n else np.zeros(self.count)
        self.row_part = self._integers(sums) * self.anchor_bias
        self.length = -(-self.count // self.fields)
        self.words = biased[: self.length].T.copy()  # components x words
        for k in range(1, self.fields):
            field = biased[k * self.length : (k + 1) * self.length].T
            self.words[:, : field.shape[1]] = self.words[:, : field.shape[1]] + field * (float(1 << k * self.bits) if self.exact else 1 << k * self.bits)

    def _integers(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.int64) if self.exact else np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, anchors x rows, as 64-bit integers."""
        own = anchors[:, : self.n].astype(np.float64) if self.exact else whole_numbers(anchors[:, : self.n])
        if own.shape[1] < self.n:
            own = np.pad(own, ((0, 0), (0, self.n - own.shape[1])))
        held = self._integers((own + self.anchor_bias) @ self.words) if self.n else np.zeros((len(anchors), self.length), dtype=np.int64)
        anchor_part = (self._integers(own.sum(axis=1)) * self.row_bias)[:, None]
        out = np.empty((len(anchors), self.count), dtype=held.dtype)
        for k in range(self.fields):
            part = slice(k * self.length, min((k + 1) * self.length, self.count))
            wide = max(part.stop - part.start, 0)
            if wide:
                field = (held[:, :wide] >> k * self.bits) & ((1 << self.bits) - 1)
                out[:, part] = field - self.row_part[part] - anchor_part
        return out if self.exact else np.clip(out, LONG.min + 1, LONG.max).astype(np.int64)


class Best:
    """The ``k`` best rows in each band of scores of each anchor; rows are offered in the order of their ids."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, k: int) -> None:
        self.lows, self.highs = lows, highs
        self.score = np.repeat(lows[:, :, None] - 1, k, axis=2)  # a free place lies below its band
        self.score[lows > highs] = LONG.max  # an empty band takes nothing
        self.id = np.zeros(self.score.shape, dtype=np.int64)
        self.most = highs.max(axis=1, initial=LONG.min)

    def least(self, anchors: np.ndarray) -> np.ndarray:
        """Scores up to this one change nothing."""
        return self.score[anchors, :, -1].min(axis=1, initial=LONG.max)

    def offer(self, anchor: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Later rows of equal score lose, as their ids are larger."""
        k = self.score.shape[2]
        for band in range(self.score.shape[1]):
            better = (score > self.score[anchor, band, -1]) & (score <= self.highs[anchor, band])
            if not better.any():
                continue
            touched = np.unique(anchor[better])
            who = np.concatenate([np.repeat(touched, k), anchor[better]])
            scores = np.concatenate([self.score[touched, band].ravel(), score[better]])
            ids = np.concatenate([self.id[touched, band].ravel(), ident[better]])
            order = np.lexsort((~scores, who))  # stable: what is held comes before what is new
            first = order[np.searchsorted(who[order], touched)[:, None] + np.arange(k)]
            self.score[touched, band], self.id[touched, band] = scores[first], ids[first]

    def found(self, anchor_id: np.ndarray) -> pa.RecordBatch:
        filled = (self.score >= self.lows[:, :, None]) & (self.lows <= self.highs)[:, :, None]
        anchor, band, place = np.nonzero(filled)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor_id[anchor]), pa.array((band + 1).astype(np.int32)), pa.array(self.score[anchor, band, place]), pa.array(self.id[anchor, band, place])],
            names=["anchor_id", "band", "score", "other_id"],
        )


class Cell:
    """One block of anchors, past which a column of rows streams."""

    def __init__(self, same_label: bool, k: int, low: int, high: int) -> None:
        self.same_label, self.k, self.low, self.high = same_label, k, low, high
        self.parts: list[tuple] = []
        self.best: Best | None = None

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bands: list[list[int] | None]) -> None:
        self.parts.append((ids, labels, vectors, bands))

    def close(self) -> None:
        """All anchors are there: order them by label and open their bands."""
        ids, labels = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], stacked([p[2] for p in self.parts])[order]
        bands = [b for p in self.parts for b in p[3]]
        self.parts = []
        if self.same_label:
            lows, highs = np.full((len(ids), 1), LONG.min + 1), np.full((len(ids), 1), LONG.max)
        else:
            lows = np.ones((len(ids), max(map(len, bands), default=0)), dtype=np.int64)
            highs = np.zeros_like(lows)
            for i, at in enumerate(order):
                p = np.array(bands[at], dtype=np.int64)
                # least and largest n with low * p <= 100 * n <= high * p, without leaving 64 bits
                lows[i, : len(p)] = self.low * (p // 100) - (-self.low * (p % 100)) // 100
                highs[i, : len(p)] = self.high * (p // 100) + (self.high * (p % 100)) // 100
        self.best = Best(lows, highs, self.k)
        self.limits = float(self.vectors.min(initial=0)), float(self.vectors.max(initial=0))

    def stream(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        if not self.parts and self.best is None:
            return  # rows without anchors
        if self.best is None:
            self.close()
        if not self.same_label:
            self._compare(np.arange(len(self.ids)), ids, labels, vectors)
            return
        order = np.argsort(labels, kind="stable")
        values, first = np.unique(labels[order], return_index=True)
        for value, rows in zip(values, np.split(order, first[1:]), strict=True):
            anchors = np.arange(*np.searchsorted(self.labels, [value, value + 1]))
            if len(anchors):
                self._compare(anchors, ids[rows], labels[rows], vectors[rows])

    def _compare(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        packed = Packed(vectors, *self.limits)
        step = max(1, PRODUCTS // len(ids))
        for start in range(0, len(anchors), step):
            block = anchors[start : start + step]
            scores = packed.scores(self.vectors[block])
            a, r = np.nonzero((scores > self.best.least(block)[:, None]) & (scores <= self.best.most[block][:, None]))
            score, a = scores[a, r], block[a]
            fit = self.ids[a] != ids[r]
            if not self.same_label:
                fit &= self.labels[a] != labels[r]
            if fit.any():
                self.best.offer(a[fit], score[fit], ids[r[fit]])

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None:
            yield self.best.found(self.ids)


def _runs(values: np.ndarray) -> Iterator[slice]:
    edges = np.flatnonzero(np.diff(values)) + 1
    yield from (slice(a, b) for a, b in zip([0, *edges], [*edges, len(values)], strict=True) if a < b)


def _grid(rows: DataFrame, anchors: DataFrame, blocks: int, columns: int, same_label: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """anchor_id, band, score, other_id: the best rows of each column for each band of an anchor."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    places = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("column", every(columns)).withColumn("kind", F.lit(0))
    others = rows.withColumn("column", F.pmod(F.xxhash64("vec_id"), F.lit(columns))).withColumn("block", every(blocks)).withColumn("kind", F.lit(1))
    both = places.unionByName(others.withColumn("bands", F.lit(None).cast("array<long>")))
    dealt = both.withColumn("cell", (F.col("block") * columns + F.col("column")).cast("int")).drop("block", "column")
    dealt = dealt.repartitionById(blocks * columns, "cell").sortWithinPartitions("cell", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell(same_label, k, low, high)
        for batch in batches:
            where, kind = (batch.column(c).to_numpy() for c in ("cell", "kind"))
            for part in _runs(where.astype(np.int64) * 2 + kind):
                if at != where[part.start]:
                    yield from cell.found()
                    at, cell = where[part.start], Cell(same_label, k, low, high)
                rows = batch.slice(part.start, part.stop - part.start)
                ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
                vectors = matrix(rows.column("codes").to_pylist(), rows.column("n").to_pylist())
                if kind[part.start] == 0:
                    cell.add(ids, labels, vectors, rows.column("bands").to_pylist())
                else:
                    cell.stream(ids, labels, vectors)
        yield from cell.found()

    return dealt.mapInArrow(run, BEST)


def mine(
    rows: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells which rows are anchors (a condition on columns of ``rows``). Per anchor, its ``positives`` best
    rows of the same label; for each of them the ``negatives`` best rows of other labels whose score lies between
    ``low`` and ``high`` hundredths of the positive's. Labels are whole numbers.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes = coded(batch.column("vector"), scale)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(sizes, type=pa.int32()), pa.array(codes, type=pa.binary()), batch.column("anchor")]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "n", "codes", "anchor"])

    read = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor")
    ).where("vec_id is not null and label is not null and vector is not null")
    base = write_stage(shipped(read).mapInArrow(code, f"{CODED}, anchor boolean").where("codes is not null"), "negatives-rows")
    first = base.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "n", "codes")).alias("r")).select("vec_id", "r.*")
    base = base.drop("anchor")
    size = base.agg(F.count("*").alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
    asking = first.count()
    blocks = max(1, ceil(asking * (8 * size["n"] + 16 * positives * negatives + 16) / ANCHOR_BYTES))
    wanted = ceil(2 * rows.sparkSession.sparkContext.defaultParallelism / blocks)
    columns = max(1, ceil(size["rows"] / COLUMN_ROWS), min(wanted, ceil(size["rows"] / LEAST_ROWS)))

    none = F.lit(None).cast("array<long>")
    best = _grid(base, first.withColumn("bands", none), blocks, columns, True, positives)
    order = [F.col("score").desc(), F.col("other_id")]
    kept = write_stage(top_rows(best.drop("band"), ["anchor_id"], order, positives, "band"), "negatives-positives")
    bands = kept.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "score"))), lambda x: x["score"]).alias("bands"))
    best = _grid(base, first.join(bands, "vec_id"), blocks, columns, False, negatives, low, high)
    found = top_rows(best, ["anchor_id", "band"], order, negatives)
    named = kept.select("anchor_id", "band", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor_id", "band"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
