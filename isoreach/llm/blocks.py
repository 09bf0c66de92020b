"""Arrow batches in bounded blocks, and hashes of words without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructField, StructType

BLOCK_BYTES = 2 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POS = 4096
_POWERS = np.cumprod(np.full(_POS, np.uint64(0x100000001B3), dtype=np.uint64))


def powers_at(pos: np.ndarray) -> np.ndarray:
    """A 64-bit factor for each place of a byte in its word, the next places of a long word too."""
    if not len(pos) or pos.max() < _POS:
        return _POWERS[pos]
    with np.errstate(over="ignore"):
        return np.where(pos < _POS, _POWERS[pos % _POS], mix(pos.astype(np.uint64)) | np.uint64(1))


#: ASCII letters and digits and all bytes of longer UTF-8 sequences belong to words.
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def tidy(f):
    """A batch function that hands freed memory back to the system when its task ends; workers outlive tasks."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def map_rows(docs, f, schema):
    """``docs.mapInArrow`` for columns of any name: the batches' columns are c0, c1 and so on, the result has the names of ``schema``."""
    plain = StructType([StructField(f"c{i}", x.dataType, x.nullable) for i, x in enumerate(schema)])
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(f, plain).toDF(*schema.names)


def trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES):
    """Slices of a batch whose texts hold about ``limit`` bytes; a longer text stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(col):
        base = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, word starts, word ends, text of each word), for runs of word bytes."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = WORD_BYTE[buf].astype(np.int8)
    step = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64)) if texts else np.zeros(0, np.int64)
    return buf, starts, ends, np.searchsorted(text_ends, starts, side="right")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    offsets = np.cumsum(n) - n
    pos = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(offsets, n)
    at = pos + np.repeat(starts, n)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat((buf[at].astype(np.uint64) + np.uint64(1)) * powers_at(pos), offsets) ^ (n.astype(np.uint64) << np.uint64(48)))


def lowered(texts: list) -> list[bytes]:
    """Lower-case UTF-8; null is empty."""
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]
