"""Hashed term counts of texts as sparse rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import _text

#: Byte classes for word shapes: letters in two cases, digits, sentence marks; other marks stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[[44, 46, 58, 59]] = 46

#: Upper bounds of the levels of the shares of different words and word pairs.
LEVELS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


def sparse(rows: np.ndarray, terms: np.ndarray, n: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, terms, counts) of term occurrences."""
    if n * dim <= 4_000_000:
        dense = np.bincount(rows * dim + terms, minlength=n * dim)
        at = np.flatnonzero(dense)
        counts = dense[at]
    else:
        at, counts = np.unique(rows * dim + terms, return_counts=True)
    return np.searchsorted(at, np.arange(n + 1) * dim), (at % dim).astype(np.int32), counts.astype(np.float32)


#: Lengths in bytes of the word beginnings that stand as terms beside the words.
STEMS = (5, 6, 7, 8)


def stem_terms(c: _text.Chunk, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) of every lower-cased run of letters and digits, and of its beginnings in longer words."""
    buf = _text.lower_ascii(c.buf)
    starts, ends, first = _text.word_bounds(buf, c.offsets, letters=True)
    rows = _text.owners(first)
    hashed = _text.Spans(buf)
    where, terms = [rows], [hashed(starts, ends)]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        where.append(rows[long])
        terms.append(hashed(starts[long], starts[long] + n) ^ np.uint64(0x5851F42D4C957F2D))
    return np.concatenate(where), (np.concatenate(terms) % np.uint64(dim)).astype(np.int64)


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many different values each row has."""
    keys = np.unique(_text.mix64(values ^ _text.mix64(rows.astype(np.uint64) + np.uint64(1))) & ~np.uint64(0xFFFF) | (rows % 65536).astype(np.uint64))
    return np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), minlength=n)[:n]


def surface_terms(c: _text.Chunk, dim: int, marks: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of words, word shapes and levels of repetition, hashed to ``dim`` terms.

    The last ``marks`` terms are for shapes and levels; a level counts as one occurrence for every word, so that it
    weighs alike in texts of any length.
    """
    n, low = len(c), _text.lower_ascii(c.buf)
    starts, ends, first = _text.word_bounds(c.buf, c.offsets)
    rows, words = _text.owners(first), np.diff(first)
    h = _text.span_hashes(low, starts, ends)
    kinds = _CLASS[c.buf]
    turn = np.ones(len(kinds), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[starts] = True
    at = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(turn, out=at[1:])
    shape = _text.span_hashes(kinds[turn], at[starts], at[ends])
    terms = [(h % np.uint64(dim - marks)).astype(np.int64), (dim - marks + shape % np.uint64(marks)).astype(np.int64)]
    where = [rows, rows]
    has = np.flatnonzero(words)
    if len(has):
        pair = h.copy()
        pair[1:] += h[:-1] * np.uint64(3)
        for k, values in enumerate((h, pair)):
            level = np.searchsorted(LEVELS, _distinct(values, rows, n)[has] / words[has])
            name = _text.mix64((level + 100 * (k + 1)).astype(np.uint64)) % np.uint64(marks)
            times = np.maximum(words[has] // 2, 1)
            terms.append(np.repeat(dim - marks + name.astype(np.int64), times))
            where.append(np.repeat(has, times))
    return sparse(np.concatenate(where), np.concatenate(terms), n, dim)


def lists(pointers: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(pointers.astype(np.int32)), pa.array(values))
