"""NumPy kernels over Arrow text columns: word boundaries, word hashes, shingles. All hashes are 64-bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that the numeric kernels take at once (one longer text is taken alone).
SLICE_BYTES = 2 << 20
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def slices(column: pa.ChunkedArray | pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) of consecutive rows of a string column, about `most` bytes each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, kept for texts of usual length."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = powers(n, _BASE), powers(n, _BASE_INV)
            if n > 2 * SLICE_BYTES:
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
    """(start, end, hash) of each word and the index of each row's first word (one entry more than rows).

    Words do not cross rows. lower folds A-Z.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    first = np.searchsorted(start, offsets)
    if not hashes:
        return start, end, None, first
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[:n], out=total[1:])
    got = (total[end] - total[start]) * down[start]
    return start, end, mix(got + (end - start).astype(U) * U(0xD6E8FEB86659FD93)), first


def grams(units: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size units, by doubling; one entry for each start (runs may cross rows)."""
    if len(units) < size:
        return np.zeros(0, U)
    out, done, span, run, base = None, 0, 1, units, _BASE
    left = size
    while True:
        if left & 1:
            if out is None:
                out = run
            else:
                m = len(units) - done - span + 1
                out = out[:m] * base + run[done : done + m]
            done += span
        left >>= 1
        if not left:
            return out[: len(units) - size + 1]
        run = run[: len(run) - span] * base + run[span:]
        base, span = U(pow(int(base), 2, 1 << 64)), span * 2


def shingles(data: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True):
    """Distinct word shingles of each row: (hashes sorted within rows, index of each row's first).

    With fewer words than size a row's whole word sequence is its one shingle; a row without words has none.
    """
    _, _, word, first = words(data, offsets, lower)
    all_runs = mix(grams(word, size)) if len(word) >= size else np.zeros(0, U)
    out, at = [], [0]
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        n = hi - lo
        if n >= size:
            got = np.sort(all_runs[lo : hi - size + 1])
            keep = np.empty(len(got), bool)
            keep[0] = True
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            got = got[keep]
        elif n:
            got = mix(mix(grams(word[lo:hi], n)) + U(n))
        else:
            got = word[:0]
        out.append(got)
        at.append(at[-1] + len(got))
    return (np.concatenate(out) if out else np.zeros(0, U)), np.array(at, np.int64)


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow list column of 64-bit integers."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
