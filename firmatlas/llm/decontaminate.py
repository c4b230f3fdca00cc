"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item with q five-word shingles is contained in a document that holds at least 80 of 100 of them. Items are
partitioned by size (powers of two). An item's MinHash sketch is its q - ceil(0.8 q) + 1 smallest shingle codes:
a document that contains the item misses at most q - ceil(0.8 q) of its shingles, so it holds one of the sketch,
and no item is lost. Each partition has a bound, the largest code in its sketches; a document's sketch for the
partition is its codes up to that bound, so long documents are compared by a fraction of their shingles, and
partitions of items larger than the document allows are skipped. Candidates are verified by exact containment.

Sketches and shingles of the items are sent to the executors while they are few (``CODES_SENT``, counted first);
beyond that the same search runs as shuffles on the codes. Documents are read once and never shuffled in the
first way.

Defined results: null and empty texts, on either side, match nothing; a text of fewer than five words is one
shingle and matches only a text with the same words; rows without an id are skipped; rows that repeat an id count
as one document each, so their pairs repeat; equal items each match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmatlas.llm.common import rows_in_slices, shingle_set, shipped

PERCENT, CODES_SENT = 80, 4_000_000
PAIRS = "doc_id long, item_id long, item_shingles long, shared long"


def least_shared(size: int, percent: int = PERCENT) -> int:
    return -(-size * percent // 100)


def sketch_size(size: int, percent: int = PERCENT) -> int:
    return size - least_shared(size, percent) + 1


class Partition:
    """Items of one size class: sketch codes with their items, and the bound up to which documents are probed."""

    def __init__(self, items: list[int], sets: list[np.ndarray], percent: int) -> None:
        codes = np.concatenate([sets[i][: sketch_size(len(sets[i]), percent)] for i in items])
        owner = np.repeat(np.array(items), [sketch_size(len(sets[i]), percent) for i in items])
        order = np.argsort(codes, kind="stable")
        codes, self.owner = codes[order], owner[order]
        self.codes, self.starts = np.unique(codes, return_index=True)
        self.starts = np.append(self.starts, len(codes))
        self.bound = codes[-1]
        self.least = min(least_shared(len(sets[i]), percent) for i in items)

    def candidates(self, found: np.ndarray) -> set[int]:
        """Items that share a code with the document's sketch for this partition."""
        if len(found) < self.least:
            return set()
        near = found[: np.searchsorted(found, self.bound, side="right")]
        if not len(near):
            return set()
        at = np.minimum(np.searchsorted(near, self.codes), len(near) - 1)
        hits = np.flatnonzero(near[at] == self.codes)
        return {int(i) for h in hits for i in self.owner[self.starts[h] : self.starts[h + 1]]}


def shared_codes(item: np.ndarray, found: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(found, item), len(found) - 1)
    return int((found[at] == item).sum())


def partitions(sets: list[np.ndarray], percent: int) -> list[Partition]:
    classes: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            classes.setdefault(len(s).bit_length(), []).append(i)
    return [Partition(items, sets, percent) for _, items in sorted(classes.items())]


def item_sets(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, codes: the shingles of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_slices(batches, "text"):
            sets = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sets, type=pa.list_(pa.int64()))], ["item_id", "codes"])

    picked = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))
    return picked.mapInArrow(run, "item_id long, codes array<long>").where(F.size("codes") > 0)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, codes_sent: int = CODES_SENT) -> DataFrame:
    """doc_id, item_id, item_shingles, shared: every document with every item that it contains."""
    read = shipped(docs).where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    sets = item_sets(items, item_id, item_text)
    total = sets.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    if total > codes_sent:
        return search_by_shuffle(read, sets, percent)
    rows = sets.collect()  # at most codes_sent numbers
    ids, codes = [r["item_id"] for r in rows], [np.array(r["codes"], dtype=np.int64).view(np.uint64) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = partitions(codes, percent)
        for batch in rows_in_slices(batches, "text"):
            out = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingle_set(data)
                for i in sorted(set().union(*[p.candidates(found) for p in parts])) if len(found) else ():
                    shared = shared_codes(codes[i], found)
                    if shared >= least_shared(len(codes[i]), percent):
                        out.append((doc, ids[i], len(codes[i]), shared))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], ["doc_id", "item_id", "item_shingles", "shared"])

    return read.mapInArrow(run, PAIRS)


def search_by_shuffle(read: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same pairs for any number of items: sketches and documents meet on the codes, then in pairs."""
    size = F.size("codes")
    least = F.ceil(size * percent / F.lit(100)).cast("int")
    sketches = sets.select("item_id", F.ceil(F.log2(size + 1)).alias("part"), F.explode(F.slice(_unsigned_order("codes"), 1, size - least + 1)).alias("code"))
    # the bound of all partitions lets a document leave out codes that no sketch can hold
    bound = sketches.agg(F.max(_unsigned("code"))).first()[0]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.int64(bound).astype(np.uint64) ^ np.uint64(1 << 63)
        for batch in rows_in_slices(batches, "text"):
            found = [s[: np.searchsorted(s, last, side="right")].view(np.int64) for s in map(shingle_set, batch.column("text").to_pylist())]
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], ["doc_id", "code"])

    if bound is None:
        return read.sparkSession.createDataFrame([], PAIRS)
    near = read.mapInArrow(probe, "doc_id long, code long").join(sketches.select("item_id", "code"), "code").select("doc_id", "item_id").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_slices(batches, "text"):
            out = []
            for row in batch.to_pylist():
                item = np.array(row["codes"], dtype=np.int64).view(np.uint64)
                shared = shared_codes(np.sort(item), shingle_set(row["text"]))
                if shared >= least_shared(len(item), percent):
                    out.append((row["doc_id"], row["item_id"], len(item), shared))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], ["doc_id", "item_id", "item_shingles", "shared"])

    return near.join(sets, "item_id").join(read, "doc_id").select("doc_id", "item_id", "codes", "text").mapInArrow(verify, PAIRS)


def _unsigned(code: str):
    return F.col(code).bitwiseXOR(F.lit(-(1 << 63)))


def _unsigned_order(codes: str):
    flip = F.lit(-(1 << 63))
    return F.transform(F.sort_array(F.transform(codes, lambda c: c.bitwiseXOR(flip))), lambda c: c.bitwiseXOR(flip))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, codes_sent: int = CODES_SENT) -> DataFrame:
    """``docs`` without those that contain an item; rows pass or go whole, with all their columns."""
    sets = item_sets(shipped(items), item_id, item_text)
    if sets.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0] > codes_sent:
        keyed = docs.withColumn("_row", F.xxhash64(text))
        hits = search(keyed.select("_row", text).distinct(), items, "_row", text, item_id, item_text, percent, codes_sent)
        return keyed.join(hits.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(docs.columns)
    codes = [np.array(r["codes"], dtype=np.int64).view(np.uint64) for r in sets.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = partitions(codes, percent)

        def hit(data: str | None) -> bool:
            found = shingle_set(data.encode() if data else None)
            near = set().union(*[p.candidates(found) for p in parts]) if len(found) else set()
            return any(shared_codes(codes[i], found) >= least_shared(len(codes[i]), percent) for i in near)

        for batch in rows_in_slices(batches, text):
            yield batch.filter(pa.array([not hit(t) for t in batch.column(text).to_pylist()], type=pa.bool_()))

    return shipped(docs).mapInArrow(run, docs.schema)
