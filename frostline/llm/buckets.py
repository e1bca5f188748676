"""Tables of hashed keys, packed: one row holds a chunk's keys of one bucket.

A bucket is a range of key values. Rows of packed arrays cost the shuffle a few bytes a key,
and a bucket's keys are sorted and compared at once in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.session import partitions

#: Bytes of input for each bucket; a bucket's keys stay far below a task's memory.
BUCKET_BYTES = 8 << 20
#: What Spark takes for the size of rows it knows nothing about is above this.
UNKNOWN = 1 << 60


def bucket_bits(documents: DataFrame, text: str = "text") -> int:
    """Bits of a key that name its bucket: as many buckets as the input's size asks for.

    The size is Spark's estimate, for files what they take; where Spark has none, the texts are measured.
    """
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN:
        size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = max(64, 2 * partitions(documents.sparkSession), size // BUCKET_BYTES)
    return min(24, int(least - 1).bit_length())


def split(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The bucket and place of each run of sorted 64-bit keys."""
    numbers = (keys >> np.uint64(64 - bits)).astype(np.int64)
    if not len(numbers):
        return
    starts = runs(numbers)
    for a, b in zip(starts, np.concatenate([starts[1:], [len(numbers)]]).astype(np.int64), strict=True):
        yield int(numbers[a]), slice(int(a), int(b))


def within(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below a key's bucket; together they tell keys apart but for one in billions."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


def whole(bucket: int, low: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and lower bits as one number."""
    return (np.uint64(bucket) << np.uint64(32)) | low.astype(np.uint64)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def joined(column: pa.ChunkedArray | pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and the row each came from."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.repeat(np.arange(len(parts)), sizes)


def runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
