"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits.  Fixed masks select some of the
positions of a sliding window; the selected tokens are hashed on both sides, and equal
hashes propose that a document and an item run in parallel at some shift.  Around every
such hit the two token sequences are compared at that shift, and every maximal run (a
match counts 1, a substitution -``PENALTY``) is reported if it has ``MIN_MATCH`` matches.
The three masks hit every window of 15 tokens with up to three substitutions.

Items under ``MIN_MATCH`` tokens overlap where they stand verbatim and whole; those under
``LEAST`` tokens (a phrase that any text may hold) only where they are the whole text.

Equal items are searched once; ``items`` says which item_ids stand behind each.  The test
side is read in slices of at most ``SLICE_TOKENS`` tokens, or one item if that is longer
(a slice is what is sent to the tasks); a larger benchmark takes more passes over the
documents, and nothing is left out.

Defined results: null and empty texts on either side have no overlaps; items without an
item_id are searched like others and reported with a null; repeated items are reported one
by one, so a document may have several rows; every row of repeated documents gets its own
overlaps; of runs with equal scores that overlap the first stays.  A column ``hits`` of the
input is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

#: Positions that each mask looks at.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10))
MIN_MATCH = 12
LEAST = 5
PENALTY = 2
#: Tokens of test items that are sent to the tasks at once, and parts into which so many are dealt before they are put together.
SLICE_TOKENS, DEAL = 2_000_000, 64

HITS = "array<struct<item:bigint,start:int,end:int,matched:int>>"


def token_hashes(c: _text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    buf = _text.lower_ascii(c.buf)
    starts, ends, first = _text.word_bounds(buf, c.offsets, letters=True)
    return _text.span_hashes(buf, starts, ends), first


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """One hash for every window start; windows may cross texts, which the caller excludes."""
    span = max(mask) + 1
    n = max(len(tokens) - span + 1, 0)
    out = np.full(n, salt + 1, np.uint64)
    for k in mask:
        out = (out ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Slice:
    """Some different test items, as sorted seed hashes of each mask and the tokens to compare with."""

    def __init__(self, keys: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> None:
        self.keys, self.tokens, self.first = keys, tokens, first
        own, lens = _text.owners(first), np.diff(first)
        self.seeds = []
        for s, mask in enumerate(MASKS):
            h, span = seed_hashes(tokens, mask, s), max(mask) + 1
            at = np.flatnonzero((np.arange(len(h)) + span <= first[own[: len(h)] + 1]) & (lens[own[: len(h)]] >= MIN_MATCH))
            order = at[np.argsort(h[at], kind="stable")]
            door = np.zeros(1 << 20, bool)  # most windows stop at this table of hash prefixes
            door[(h[at] >> np.uint64(44)).astype(np.int64)] = True
            self.seeds.append((h[order], order, door))
        #: Items that overlap verbatim only, by their length: sorted hashes and items.
        self.short = {}
        for n in range(1, MIN_MATCH):
            items = np.flatnonzero(lens == n)
            if len(items):
                h = _text.gram_hashes(tokens, first[items], first[items] + n)
                order = np.argsort(h, kind="stable")
                self.short[n] = h[order], items[order]

    def search(self, tokens: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """For each text its overlaps as (item, first token, end token, matched tokens)."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(first) - 1)]
        self._verbatim(tokens, first, out)
        found = []
        for s, mask in enumerate(MASKS):
            keys, where, door = self.seeds[s]
            if len(keys) == 0:
                continue
            h = seed_hashes(tokens, mask, s)
            at = np.flatnonzero(door[(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if len(at) == 0:
                continue
            item_at = where[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(np.stack([np.repeat(at, n), item_at], 1))
        if found:
            hits = np.concatenate(found)
            text = np.searchsorted(first, hits[:, 0], "right") - 1
            item = np.searchsorted(self.first, hits[:, 1], "right") - 1
            # one comparison for each text, item and shift
            for t, i, shift in np.unique(np.stack([text, item, hits[:, 0] - hits[:, 1]], 1), axis=0).tolist():
                a = max(self.first[i], first[t] - shift)
                b = min(self.first[i + 1], first[t + 1] - shift)
                x = int(a + shift - first[t])
                for start, end, matched in runs(self.tokens[a:b] == tokens[a + shift : b + shift]):
                    if matched >= MIN_MATCH:
                        out[t].append((int(self.keys[i]), x + start, x + end, matched))
        return [sorted(set(x)) for x in out]

    def _verbatim(self, tokens: np.ndarray, first: np.ndarray, out: list[list[tuple[int, int, int, int]]]) -> None:
        own, lens = _text.owners(first), np.diff(first)
        for n, (keys, items) in self.short.items():
            at = np.arange(max(len(tokens) - n + 1, 0))
            at = at[at + n <= first[own[at] + 1]]
            if n < LEAST:
                at = at[lens[own[at]] == n]
            h = _text.gram_hashes(tokens, at, at + n)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for i in np.flatnonzero(keys[k] == h).tolist():
                t = int(own[at[i]])
                x = int(at[i] - first[t])
                out[t].append((int(self.keys[items[k[i]]]), x, x + n, n))


def runs(same: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, matches) of all maximal scoring runs: no longer or shorter one around them has a higher score.

    One pass over the stretches of equal and unequal tokens, which keeps the runs that may still grow together.
    """
    if not same.any():
        return []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(same)) + 1, [len(same)]])
    total = 0
    kept: list[tuple[int, int, int, int, int]] = []  # start, end, matches, sum before, sum behind
    for a, b, good in zip(edges[:-1].tolist(), edges[1:].tolist(), same[edges[:-1]].tolist(), strict=True):
        if not good:
            total -= PENALTY * (b - a)
            continue
        run = (a, b, b - a, total, total + b - a)
        total += b - a
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][3] > run[3]:  # of equals the one that starts first
                j -= 1
            if j < 0 or kept[j][4] >= run[4]:
                break
            matched = sum(r[2] for r in kept[j:]) + run[2]
            run = (kept[j][0], run[1], matched, kept[j][3], run[4])
            del kept[j:]
        kept.append(run)
    return [r[:3] for r in kept]


def best_run(same: np.ndarray) -> tuple[int, int, int] | None:
    """Of ``runs`` the one with the highest score; the first of equals."""
    return max(runs(same), key=lambda r: r[2] - PENALTY * (r[1] - r[0] - r[2]), default=None)


def items(tests: DataFrame) -> DataFrame:
    """``item_id, item, tokens`` of every test item with tokens; ``item`` is a hash of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _text.chunks(batch.column(1)):
                h, first = token_hashes(c)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                keys = _text.gram_hashes(h, first[:-1], first[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.first : c.first + len(c)], pa.array(keys), lists], names=["item_id", "item", "tokens"])

    own = tests.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "item_id long, item long, tokens array<long>").where("size(tokens) > 0")


def _slices(tests: DataFrame) -> Iterator[Slice]:
    """The different items, in slices of bounded size."""
    unique = items(tests).groupBy("item").agg(F.min("tokens").alias("tokens"))
    total = unique.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    if total == 0:
        return
    deal = 1 if total <= SLICE_TOKENS else 1 + DEAL * total // SLICE_TOKENS
    part = F.pmod("item", F.lit(deal))
    sizes = unique.groupBy(part.alias("part")).agg(F.sum(F.size("tokens")).alias("n")).orderBy("part").collect()  # DEAL rows a slice
    taken: list[int] = []
    held = 0
    for r in [*sizes, None]:
        if taken and (r is None or held + r.n > SLICE_TOKENS):
            rows = unique if len(taken) == len(sizes) else unique.where(part.isin(taken))
            table = rows.toArrow().sort_by("item").combine_chunks()
            lists = table["tokens"].combine_chunks()
            first = np.asarray(lists.offsets).astype(np.int64)
            yield Slice(table["item"].to_numpy(), np.asarray(lists.flatten()).view(np.uint64), first - first[0])
            taken, held = [], 0
        if r is not None:
            taken.append(r.part)
            held += r.n


def overlaps(df: DataFrame, tests: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row and ``hits``, its overlaps with test items."""
    keep = [k for k in (df.columns if keep is None else keep) if k != "hits"]
    out = df.select(*keep, F.col("text").cast("string").alias("__text"), F.array().cast(HITS).alias("hits"))
    sc = df.sparkSession.sparkContext
    schema = out.schema

    def searched(rows: DataFrame, part: Slice) -> DataFrame:
        sent = sc.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list = []
                for c in _text.chunks(batch.column(batch.num_columns - 2)):
                    found += sent.value.search(*token_hashes(c))
                old = batch.column(batch.num_columns - 1)
                if any(found):
                    names = ("item", "start", "end", "matched")
                    merged = [(a.as_py() or []) + [dict(zip(names, x, strict=True)) for x in b] for a, b in zip(old, found, strict=True)]
                    old = pa.array(merged, old.type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], old], names=batch.schema.names)

        return rows.mapInArrow(run, schema)

    for part in _slices(tests):
        out = searched(out, part)
    return out.drop("__text")


def clean(df: DataFrame, tests: DataFrame) -> DataFrame:
    """The documents without an overlap, with all their columns."""
    own = df.select(F.struct(*df.columns).alias("__row"), F.col("text"))
    return overlaps(own, tests, ["__row"]).where("size(hits) = 0").select("__row.*")


def digest(df: DataFrame, tests: DataFrame) -> DataFrame:
    """A row for each run of a document and an item: ``doc_id, item_id, start, end, matched`` in tokens."""
    rows = overlaps(df.select(F.col("doc_id").cast("long"), "text"), tests, ["doc_id"])
    hits = rows.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
    return hits.join(items(tests).select("item", "item_id"), "item").select("doc_id", "item_id", "start", "end", "matched")
