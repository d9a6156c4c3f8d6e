"""Fixed-size arrays that tasks fill and a tree of groups merges; only the merged array reaches the driver."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 14  # entries
FAN = 256  # how many tasks' segments meet in the first merge
KIND = "segment int, body binary"


def parts(array: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's array as compressed segments; segments of zeros are left out."""
    for s in range(0, len(array), SEGMENT):
        body = array[s : s + SEGMENT]
        if body.any():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s // SEGMENT], pa.int32()), "body": pa.array([zlib.compress(body.tobytes(), 1)], pa.binary())})


def merged(segments: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Merges `parts` of many tasks: integers are added, bytes are united bit by bit."""
    unite = np.dtype(dtype) == np.uint8

    def merge(group: pa.Table) -> pa.Table:
        out = None
        for body in group.column("body"):
            own = np.frombuffer(zlib.decompress(body.as_py()), dtype=dtype)
            out = own if out is None else (out | own if unite else out + own)
        return pa.table({"segment": group.column("segment")[:1], "body": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    one = segments.withColumn("part", F.spark_partition_id() % FAN).groupBy("segment", "part").applyInArrow(merge, KIND)
    out = np.zeros(size, dtype=dtype)
    for r in one.groupBy("segment").applyInArrow(merge, KIND).toLocalIterator():  # at most `size` entries in all
        own = np.frombuffer(zlib.decompress(bytes(r["body"])), dtype=dtype)
        out[r["segment"] * SEGMENT : r["segment"] * SEGMENT + len(own)] = own
    return out


def _places(hashes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte and mask of the two bits of each hash in a Bloom filter of 2**bits bits."""
    for shift in (64 - bits, 32 - bits // 2):
        at = ((hashes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        yield at >> 3, (1 << (at & 7)).astype(np.uint8)


def set_bits(array: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for byte, mask in _places(hashes, bits):
        np.bitwise_or.at(array, byte, mask)


def has_bits(array: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for byte, mask in _places(hashes, bits):
        out &= array[byte] & mask > 0
    return out
