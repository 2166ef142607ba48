"""Arrow helpers shared by the operators: text columns as flat byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at once; only memory depends on it.
PIECE = 1 << 20


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; null counts as empty."""
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, where, data = col.buffers()
    if len(col) == 0 or where is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(where, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], bytes_[offsets[0] : offsets[-1]]


def pieces(batches: Iterator[pa.RecordBatch], text: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``size`` bytes of column ``text``, or one row."""
    for batch in batches:
        offsets, _ = flat(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def packed(rows: np.ndarray) -> pa.Array:
    """A 2-d array as one binary value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_of(offsets: np.ndarray, data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes outside ``gap`` (a table of 256 flags) that cross no row: start, end, row."""
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = edges[edges > 0] - 1
    last[ends] |= inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    head = np.cumsum(length) - length
    place = np.arange(total) - np.repeat(head, length)
    taken = data[np.repeat(start, length) + place].astype(np.uint64) + np.uint64(1)
    # long runs reuse the powers, mixed with the number of the round
    rounds = (place >> 12).astype(np.uint64)
    taken = taken * _POWERS[place & 4095]
    if rounds.any():
        taken = mix(taken + rounds)
    return mix(np.add.reduceat(taken, head) + length.astype(np.uint64))
