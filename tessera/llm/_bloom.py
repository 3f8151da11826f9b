"""A Bloom filter of bounded size that decides where rows are read; a filled one only lets more rows through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

#: 8 MB, whatever the input.
BITS = 26


def _places(ids: np.ndarray) -> np.ndarray:
    """Three filter bits of each id."""
    h = _text.mix64(ids.view(np.uint64))
    return np.stack([(h >> np.uint64(s)) & np.uint64((1 << BITS) - 1) for s in (0, 19, 38)]).astype(np.int64)


def fill(rows: DataFrame, column: str) -> np.ndarray:
    """The filter of a long column, put together on the executors word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy().copy()).ravel())
            word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            bits = np.bitwise_or.reduceat(bit, starts) if len(starts) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = rows.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def holds(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(0)
