"""Small helpers that every text operator of this subpackage shares.

Operators run Arrow batches through ``mapInArrow``.  Batches are cut again here
by bytes, so that the memory of one step depends on ``CHUNK_BYTES`` and on the
longest single text, never on how many rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 3_000_000


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its row offsets (null: empty), as NumPy arrays."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    filled = pa.concat_arrays([filled])
    _, offsets, data = filled.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0]


def gather_spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of many spans laid end to end: starts[0]..starts[0]+lengths[0]-1, starts[1].. and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked bytes that stay inside their row: starts, ends, and each row's bounds among the runs."""
    begin, finish = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    finish[:-1] &= ~mask[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    begin[first] = mask[first]
    finish[first[1:] - 1] = mask[first[1:] - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def distinct_runs(raw: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Runs as indexes into an array of their distinct values."""
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[mask])]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between bounds, empty rows included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
