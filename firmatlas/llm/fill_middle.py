"""Fill-in-the-middle: cut each text at two boundaries of its units and move the middle to the end.

Units are runs of letters A-Z, a-z and single other characters. The boundaries, that is the places where a unit starts,
are kept as a set of byte offsets in the manner of Roaring bitmaps: one container for each 64 KiB of text, as a sorted
array, a bitmap or a list of runs, whichever is smallest, and the cumulated cardinalities beside them. The k-th boundary
is found by a search in the cumulated cardinalities and a local select inside one container. So a text of any length
needs few bytes beside itself, and both cuts cost two selects.

The seed and the id of a document decide its cuts and its form, so a repeated or resumed run gives the same output.

Forms: ``plain`` is the text itself, for empty texts, texts that hold one of the three markers, and the share that is
left as it is; ``psm`` is prefix, suffix, middle, and ``spm`` suffix, prefix, middle, each part after its marker.

Defined results: a null text is read as empty; a null id as the empty id. Repeated rows are cut each. Other columns pass
through; one that has the name of a result is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmatlas.llm.common import rows_in_slices, shipped, with_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
PLAIN, PSM, SPM = "plain", "psm", "spm"
CONTAINER = 1 << 16
BITMAP_BYTES = CONTAINER // 8
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class ArrayContainer:
    """Sorted offsets, two bytes each."""

    def __init__(self, offsets: np.ndarray) -> None:
        self.offsets = offsets.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class BitmapContainer:
    """One bit for each offset, and the number of ones before every 64th byte."""

    def __init__(self, offsets: np.ndarray) -> None:
        bits = np.zeros(CONTAINER, dtype=bool)
        bits[offsets] = True
        self.bytes = np.packbits(bits, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(_ONES[self.bytes].reshape(-1, 64).sum(axis=1, dtype=np.int64))])

    def select(self, k: int) -> int:
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.bytes[block * 64 : block * 64 + 64], bitorder="little"))
        return block * 512 + int(ones[k - self.before[block]])


class RunContainer:
    """Runs of neighbouring offsets: where each starts, and the number of offsets before it."""

    def __init__(self, starts: np.ndarray, before: np.ndarray) -> None:
        self.starts, self.before = starts.astype(np.uint16), before.astype(np.uint16)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(offsets: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted offsets below 65,536."""
    first = np.flatnonzero(np.diff(offsets, prepend=-2) != 1)
    sizes = {"array": 2 * len(offsets), "bitmap": BITMAP_BYTES, "runs": 4 * len(first)}
    kind = min(sizes, key=sizes.get)
    if kind == "runs":
        return RunContainer(offsets[first], first)
    return ArrayContainer(offsets) if kind == "array" else BitmapContainer(offsets)


class Boundaries:
    """The starts of all units of a text, as byte offsets."""

    def __init__(self, text: bytes) -> None:
        data = np.frombuffer(text, dtype=np.uint8)
        self.keys: list[int] = []
        self.containers: list = []
        ends, total, letter_before = [], 0, False
        for at in range(0, len(data), CONTAINER):
            part = data[at : at + CONTAINER]
            lower = part | 0x20
            letter = (lower >= 0x61) & (lower <= 0x7A)  # no other byte gets into that range by the bit
            inside = np.concatenate([[letter_before], letter[:-1]]) & letter
            offsets = np.flatnonzero(~inside & (part & 0xC0 != 0x80))
            letter_before = bool(letter[-1])
            if len(offsets):
                self.keys.append(at)
                self.containers.append(container(offsets))
                total += len(offsets)
                ends.append(total)
        self.ends, self.size = np.array(ends, dtype=np.int64), len(text)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def select(self, k: int) -> int:
        """Byte offset at which unit ``k`` (from 0) starts; the end of the text for the unit after the last."""
        if k == len(self):
            return self.size
        at = int(np.searchsorted(self.ends, k, side="right"))
        return self.keys[at] + self.containers[at].select(k - (int(self.ends[at - 1]) if at else 0))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2 to the 32nd from the seed and the id."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def characters(text: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80))


def moved(text: bytes, doc_id: int | None, seed: int, changed: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and middle, output. ``changed`` and ``spm`` are shares in hundredths."""
    bounds = Boundaries(text)
    n = len(bounds)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= changed:
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = bounds.select(first), bounds.select(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKERS
    form = SPM if h4 % 100 < spm else PSM
    output = b"".join((s, suffix, p, prefix, m, middle) if form == SPM else (p, prefix, s, suffix, m, middle))
    return n, form, characters(prefix), characters(middle), output


def transform(docs: DataFrame, seed: int = 1, changed: int = 90, spm: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output."""
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.BinaryType())]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    read = docs.withColumns({"_text": F.coalesce(F.col(text).cast("binary"), F.lit(b"")), "_id": F.col(doc_id)}).drop(*[name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_slices(batches, "_text"):
            texts, ids = batch.column("_text").to_pylist(), batch.column("_id").to_pylist()
            rows = [moved(t, i, seed, changed, spm) for t, i in zip(texts, ids, strict=True)]
            out = batch.drop_columns(["_text", "_id"])
            for (name, _), kind, values in zip(fields, kinds, zip(*rows, strict=True) if rows else [()] * len(fields), strict=True):
                out = with_column(out, name, pa.array(values, type=kind))
            yield out

    kept = [f for f in read.schema.fields if f.name not in ("_text", "_id")]
    done = shipped(read).mapInArrow(run, T.StructType(kept + [T.StructField(*f) for f in fields]))
    return done.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from the output and its form alone. No part holds a marker, so the first of each is it."""
    head = F.substring(output, len(PREFIX) + 1, F.length(output))  # after the first marker

    def between(start: str | None, end: str | None) -> Column:
        part = head if start is None else F.substring(head, F.instr(head, start) + len(start), F.length(head))
        return part if end is None else F.substring(part, F.lit(1), F.instr(part, end) - 1)

    psm = F.concat(between(None, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(None, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
