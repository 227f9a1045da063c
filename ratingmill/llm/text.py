"""Words of Arrow string columns as numpy arrays, without a Python object per word.

A batch is cut into slices of whole documents of about ``SLICE`` bytes; within a slice
every step is one numpy call over all bytes or words. Words are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_POSITIONS = 4096

_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, _POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Word bytes: as ALNUM without digits.
LETTER = ALNUM.copy()
LETTER[48:58] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values together, and where each begins (one more entry than
    values). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of the documents first..last-1 of a batch.

    ``data`` holds the slice's bytes, ``start`` and ``end`` the words' places in it,
    ``first`` for each document its first word (one more entry than documents), ``text``
    likewise its first byte, ``hash`` the words' names."""

    low: int
    high: int
    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def slices(at: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; a longer document stands alone."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def words(column: pa.Array, kept: np.ndarray, fold: bool = True, size: int = SLICE) -> Iterator[Words]:
    """Maximal runs of the bytes marked in ``kept``; ``fold`` lower-cases A to Z."""
    data, at = utf8(column)
    for low, high in slices(at, size):
        part = data[at[low] : at[high]]
        text = at[low : high + 1] - at[low]
        part = LOWER[part] if fold else part
        on = kept[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[text] = True
        before = np.empty_like(on)
        before[:1], before[1:] = False, on[:-1]
        start = np.flatnonzero(on & (~before | edge[:-1]))
        after = np.empty_like(on)
        after[-1:], after[:-1] = False, on[1:]
        end = np.flatnonzero(on & (~after | edge[1:])) + 1
        yield Words(low, high, part, text, start, end, np.searchsorted(start, text), hashed(part, on, start, end))


def hashed(data: np.ndarray, on: np.ndarray | None, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the words at ``start`` to ``end``; only bytes marked in ``on`` count, without it all."""
    if not len(start):
        return np.zeros(0, np.uint64)
    gap = np.diff(start, append=len(data))
    place = np.arange(start[0], len(data)) - np.repeat(start, gap)
    value = _BYTE[data[start[0] :]] * _PLACE[place & (_POSITIONS - 1)]
    if on is not None:
        value = np.where(on[start[0] :], value, np.uint64(0))
    return mix(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Names of all runs of ``width`` words, by where they begin."""
    n = max(0, len(hashes) - width + 1)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total + hashes[k : k + n] * _ORDER[k & 63] + (hashes[k : k + n] >> np.uint64(k & 31))
    return mix(total)


def whole(hashes: np.ndarray) -> np.ndarray:
    """The name of one run of all words, as an array of one."""
    return runs(hashes, len(hashes))
