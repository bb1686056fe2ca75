"""Words of whole text columns as numpy arrays.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return
(``[^\\x20\\x09-\\x0D]+``); all of these are single bytes in UTF-8, so whole Arrow columns are cut at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=U64)
        out[0] = 1
        _POWERS[base] = have = np.cumprod(out, dtype=U64)
    return have[:n]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 2_000_000):
    """Row ranges whose texts have at most ``most`` bytes together, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


@dataclass
class Words:
    """starts and ends of all words in data; row: the text that holds each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    rows: int

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, mixed."""
        n = len(self.data)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * powers(_BASE, n), out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * powers(_INVERSE, n + 1)[self.starts])


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, rows)
    space = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(offsets[:-1], starts, side="right") - 1, rows)


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by one space, as bytes of all rows and their offsets."""
    keep = np.ones(len(w), bool) if keep is None else keep
    starts, ends, row = w.starts[keep], w.ends[keep], w.row[keep]
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(w.rows + 1, np.int64)
    out, take = w.data.copy(), np.zeros(len(w.data), dtype=bool)
    step = np.zeros(len(w.data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    take = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    more = np.flatnonzero(row[1:] == row[:-1])
    # two kept words may touch only where a space byte follows the first one
    out[ends[more]] = 0x20
    take[ends[more]] = True
    sizes = np.bincount(row, weights=ends - starts, minlength=w.rows).astype(np.int64)
    sizes += np.bincount(row[more], minlength=w.rows)
    return out[take], np.concatenate([[0], np.cumsum(sizes)])


def runs(w: Words, width: int) -> np.ndarray:
    """Indexes of the words at which ``width`` consecutive words of one row begin."""
    n = len(w) - width + 1
    return np.flatnonzero(w.row[:n] == w.row[width - 1 :]) if n > 0 else np.zeros(0, np.int64)


def rolled(h: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of the ``width`` word hashes that begin at each index of ``at``."""
    n = len(h) - width + 1
    if n <= 0 or not len(at):
        return np.zeros(0, U64)
    out = np.zeros(n, dtype=U64)
    for k in range(width):
        out = out * U64(_BASE) + h[k : k + n]
    return mix(out[at])
