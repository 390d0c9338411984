"""Words, shingles and their 64-bit hashes from Arrow string columns, vectorised over bounded slices of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own, whole.
SLICE_BYTES = 1 << 21
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> list[np.ndarray]:
    """At least n powers and inverse powers; a worker keeps them, so not many more than its slices ask for."""
    if len(_POWERS[0]) < n:
        size = -(-n // (1 << 16)) << 16
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a finalizer of the splitmix family)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of bounded slices; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the rows of a slice, A-Z lowered: start, end (bytes), row and hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE):
        self.rows = len(offs) - 1
        low = LOWER[data]
        gap = np.ones(len(low) + 1, bool)
        gap[:-1] = breaks[low]
        first = np.zeros(len(low) + 1, bool)
        first[offs] = True
        inside = ~gap[:-1]
        begins = inside.copy()
        begins[1:] &= gap[:-2] | first[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(inside & (gap[1:] | first[1:])) + 1
        self.row = np.searchsorted(offs, self.start, "right") - 1
        up, down = powers(len(low) + 1)
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low * up[: len(low)], out=sums[1:])
        self._sums, self._down = sums, down
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix(raw ^ ((self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        #: Words of row r are first[r]:first[r + 1].
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def beginnings(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of the words; 0 for words that are not longer."""
        longer = self.end - self.start > k
        at = self.start[longer]
        out = np.zeros(len(self.start), np.uint64)
        out[longer] = mix((self._sums[at + k] - self._sums[at]) * self._down[at] ^ np.uint64(k * 0x100000001B3))
        return out

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word sequences in order, and where each row's begin; fewer words make one of all."""
        n = np.diff(self.first)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        begin = np.concatenate([[0], np.cumsum(count)])
        h, m = self.hash, len(self.hash)
        out = np.zeros(begin[-1], np.uint64)
        if m >= k:
            rolled = np.zeros(m - k + 1, np.uint64)
            for j in range(k):
                rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : m - k + 1 + j]
            whole = self.row[: m - k + 1] == self.row[k - 1 :]
            rows = self.row[: m - k + 1][whole]
            within = np.flatnonzero(whole) - self.first[rows]
            out[begin[rows] + within] = mix(rolled[whole])
        for r in np.flatnonzero((n > 0) & (n < k)):
            acc = np.uint64(n[r])
            for x in h[self.first[r] : self.first[r + 1]]:
                acc = np.uint64((int(acc) * 0xC2B2AE3D27D4EB4F + int(x)) & _MASK)
            out[begin[r]] = mix(np.array([acc ^ np.uint64(0x5851F42D4C957F2D)]))[0]
        return out, begin
