"""Vectorised word tools over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes: white space is ASCII only, so byte
and code-point tokenisation agree.  Texts are handled in chunks of bounded size; one
very long text forms a chunk of its own, so memory follows the longest text, not the
batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Chunk:
    """Some consecutive texts: their rows, bytes and the byte offsets of each."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into runs of whole texts of about ``size`` bytes."""
    buf, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Chunk(i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_bounds(buf: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the index of the first word of each text (with a final total).

    ``letters``: words are runs of letters and digits instead (all bytes over 0x7F count as letters).
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _LETTER[buf] if letters else ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _table() -> np.ndarray:
    """256 odd-mixed 64-bit values by splitmix64, fixed for all runs and machines."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _table()
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    n = max(n, 1)
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        filled, step = 1, np.uint64(base)
        while filled < size:
            out[filled : 2 * filled] = out[:filled] * step
            filled, step = 2 * filled, np.uint64(int(step) * int(step) % (1 << 64))
        if size > 1 << 22:  # of one very long text: not kept
            return out[:n]
        _powers[base] = have = out
    return have[:n]


class Spans:
    """64-bit polynomial hashes of byte spans of ``buf``, equal for equal bytes wherever they stand."""

    def __init__(self, buf: np.ndarray) -> None:
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=self.total[1:])
        self.back = powers(_UNBASE, len(buf) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(starts) == 0:
            return np.zeros(0, np.uint64)
        return mix64((self.total[ends] - self.total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(buf)(starts, ends)


_GRAM = 0xD6E8FEB86659FD93 | 1
_UNGRAM = pow(_GRAM, -1, 1 << 64)


def gram_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs ``[start, end)`` of word hashes."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_GRAM, len(words)), out=total[1:])
    return mix64((total[ends] - total[starts]) * powers(_UNGRAM, len(words) + 1)[starts] + (ends - starts).astype(np.uint64))


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text of each word, from the first-word indices that ``word_bounds`` gives."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
