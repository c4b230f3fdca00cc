"""Helpers shared by the corpus operators: words, shingles, splits, Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a missing id has no remainder."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    """Rows kept for testing; a row without an id belongs to the training side."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on arrays."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


# an odd multiplier per position in a window, hashed from the position so that no two orders of words agree
_STEPS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct codes of five-word windows; a shorter text is one window, an empty one none."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = word_codes(words)
    n = len(codes)
    if n < SHINGLE:
        return mixed((codes * _STEPS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = codes[: n - SHINGLE + 1] * _STEPS[0]
    for k in range(1, SHINGLE):
        total += codes[k : n - SHINGLE + 1 + k] * _STEPS[k]
    return np.unique(mixed(total))


def rows_in_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds few megabytes, so memory does not follow the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """Append a column; one of that name is replaced."""
    if name in batch.schema.names:
        batch = batch.drop_columns([name])
    return batch.append_column(name, values)


def packed(sorted_codes: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed differences, byte planes side by side."""
    steps = np.diff(sorted_codes, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def power_of_two(n: float, least: int) -> int:
    return 1 << max(least.bit_length() - 1, int(max(n, 1) - 1).bit_length())


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after this package has been given to the Python workers of all executors (once per application).

    The driver packs it into an archive and Spark hands that out, so workers need no path of their own to it.
    """
    context = df.sparkSession.sparkContext
    if not getattr(context, "_corpus_operators_shipped", False):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._corpus_operators_shipped = True
    return df
