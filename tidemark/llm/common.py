"""What several operators share: text buffers as numpy arrays, range hashes, bounded slices of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch holds about so many bytes of text; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `limit` bytes of text each."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offset of each text plus the end; a null is empty."""
    a = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    _, where, data = a.buffers()
    offsets = np.frombuffer(where, np.int64)[a.offset : a.offset + len(a) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _table(k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the 256 bytes, powers and inverse powers of the base, for n positions at least."""
    if k not in _tables or len(_tables[k][1]) <= n:
        size = max(n + 1, SLICE_BYTES + (1 << 18))
        base = _BASES[k]
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = (np.random.default_rng(k + 1).integers(1, 2**63, 256, np.uint64), np.cumprod(up), np.cumprod(down))
        if size > 8 * SLICE_BYTES:
            return made
        _tables[k] = made
    return _tables[k]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads all of them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer: prefix sums modulo 2**64, so each range costs a few operations."""

    def __init__(self, data: np.ndarray, k: int = 0):
        values, up, self.down = _table(k, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (run without ASCII white space, within one text) and the index of the first word of each text, plus the end."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
