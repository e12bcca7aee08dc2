"""Vectorised byte work on Arrow string columns: words, rolling hashes, bounded slices.

The rolling hash of bytes b[s:e] is sum(T[b[j]] * B**(j - s)) mod 2**64 for an odd B, taken
from prefix sums, then mixed. Any substring's hash costs three array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(seed))


LETTERS = stream(11, 256)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte tables that fold A-Z and map what cannot be in a word to a space.
SPACED = LOWER.copy()
SPACED[9:14] = 32
ALNUM = LOWER.copy()
for _b in range(128):
    if not (48 <= _b <= 57 or 65 <= _b <= 90 or 97 <= _b <= 122):
        ALNUM[_b] = 32

_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow["b"]) < n:
        size = 1 << max(16, int(n).bit_length())
        for k, v in (("b", BASE), ("i", INVERSE)):
            a = np.full(size, v, dtype=U)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["b"], _pow["i"]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[0] = 0, for span()."""
    b, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(LETTERS[data] * b[: len(data)], out=out[1:])
    return out


def span(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Mixed hash of each data[s:e]."""
    _, i = powers(len(p))
    return mix((p[e] - p[s]) * i[s] + (e - s).astype(U) * U(0xA24BAED4963EE407))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 data, int64 offsets) of a string array; null counts as empty."""
    col = col.cast(pa.string()).fill_null("") if col.null_count or not pa.types.is_string(col.type) else col
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
    if col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of at most `most` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, first word of each row and the total) of the words under a byte table."""
    folded = table[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1 : n + 1] = folded != 32
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    s = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    e = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return folded, s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of each row and the total)."""
    folded, s, e, first = words(data, off, table)
    return span(prefix(folded), s, e), first
