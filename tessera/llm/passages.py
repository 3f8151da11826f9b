"""Repeated passages across documents by collinear chaining.

1. Seeds: of every ``WINDOW`` consecutive word ``K``-grams the one with the least hash, so
   that any common run of WINDOW + K - 1 words has a common seed.
2. Every seed that several documents have points to its first document (least doc_id).
   Documents are matched with that one only: a passage that thousands share makes a star,
   not all pairs.
3. The matches of a document with one other are chained: in order of position, each match
   takes the best predecessor that lies before it in both texts, at a cost for the gap.
   The maximum over predecessors is a prefix maximum in a Fenwick tree.
4. Chains are aligned word by word: between anchors along the diagonal, or from both sides
   of an insertion, and beyond both ends until mismatches outweigh matches.  Passages with
   ``MIN_WORDS`` words, of which ``IDENTITY`` agree, are reported.  Stretches of fewer than
   ``VARIETY`` different words are stutters, which any two texts may share, and no passages.
5. The first documents of a passage's seeds may hold parts of it only.  So where shared seeds
   lie close enough for a verbatim run of MIN_WORDS words, every MIN_WORDS words point to the
   first document that has all of them, and runs outside the passages of 4 are aligned too:
   MIN_WORDS words that a document with a lesser doc_id also has, VARIETY different ones among
   them, always lie in passages.
   Passages with edits in every MIN_WORDS words are found by 2 alone.

Defined results: null and short texts have no passage; rows that share a doc_id count as
one document, rows without one are left out; exact copies are passages as long as the
text.  Repeats within one document aren't reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bloom, _text
from ._cluster import drop_cut, swept

#: A run of WINDOW + K - 1 = 17 equal words has a common seed: a passage of MIN_WORDS with an edit in every third of it still has
#: two or three.  Denser seeds find no more runs of MIN_WORDS words and cost shuffle in proportion to 2 / (WINDOW + 1).
K = 6
WINDOW = 12
MIN_WORDS = 50
VARIETY = 10
IDENTITY = 0.8
#: Of a chain: seeds at least, and the cost of a word of gap on either side.
MIN_SEEDS = 2
GAP = 0.1
#: Words beyond a chain that the alignment may reach, and the loss at which it stops.
MARGIN = 64
DROP = 8


def word_hashes(c: _text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    buf = _text.lower_ascii(c.buf)
    starts, ends, first = _text.word_bounds(buf, c.offsets)
    return _text.span_hashes(buf, starts, ends), first


def minimizers(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash, first of its hash in the text) of the seeds of texts with MIN_WORDS words."""
    n = len(words) - K + 1
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(bool)
    grams = _text.gram_hashes(words, np.arange(n), np.arange(n) + K)
    m = n - WINDOW + 1
    least = grams[:m].copy()
    for o in range(1, WINDOW):
        np.minimum(least, grams[o : o + m], out=least)
    own = _text.owners(first)
    lens = np.diff(first)
    # windows that lie in one text of sufficient length
    valid = (np.arange(m) + WINDOW + K - 1 <= first[own[:m] + 1]) & (lens[own[:m]] >= MIN_WORDS)
    picked = np.zeros(n, bool)
    for o in range(WINDOW):
        picked[o : o + m] |= (grams[o : o + m] == least) & valid
    at = np.flatnonzero(picked)
    if len(at) == 0:
        return none, none, none, none.astype(bool)
    text, h = own[at], grams[at]
    # in stretches of one seed only every WINDOW-th place
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | (at[1:] - at[:-1] > 1)
    keep = (at - np.maximum.accumulate(np.where(new, at, 0))) % WINDOW == 0
    at, text, h = at[keep], text[keep], h[keep]
    order = np.lexsort((at, h, text))
    new = np.ones(len(at), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    opens = np.zeros(len(at), bool)
    opens[order] = new
    # the n-th place of a seed also is a seed of its own: texts that go on with one word or line match place by place
    again = order[nth > 0]
    h2 = _text.mix64(h[again] + nth[nth > 0].astype(np.uint64))
    text, at, h = np.concatenate([text, text[again]]), np.concatenate([at, at[again]]), np.concatenate([h, h2])
    return text, at - first[text], h.view(np.int64), np.concatenate([opens, np.ones(len(again), bool)])


def seeds(df: DataFrame) -> DataFrame:
    """``h, doc_id, pos, opens`` for every seed; ``opens``: the first of its hash in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for c in _text.chunks(batch.column(1)):
                text, at, h, opens = minimizers(*word_hashes(c))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[c.first + text]), pa.array(at.astype(np.int32)), pa.array(opens)], names=["h", "doc_id", "pos", "opens"])

    own = df.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return own.mapInArrow(run, "h long, doc_id long, pos int, opens boolean")


def chains(pos: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Indices of the matches of each chain, best chain first; every match is in one chain at most."""
    order = np.lexsort((other, pos))
    p, r = pos[order].tolist(), other[order].tolist()
    n = len(p)
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(r)))}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ranks) + 1)  # prefix maxima over the other text's positions
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and p[j] == p[i]:  # equal positions don't precede one another
            best, k = (-1e18, -1), ranks[r[j]] - 1
            while k:
                best = max(best, tree[k])
                k &= k - 1
            gain = best[0] - GAP * (p[j] + r[j])
            score[j], back[j] = (K + gain, best[1]) if gain > 0 else (float(K), -1)
            j += 1
        for x in range(i, j):
            value, k = (score[x] + GAP * (p[x] + r[x]), x), ranks[r[x]]
            while k < len(tree):
                tree[k] = max(tree[k], value)
                k += k & -k
        i = j
    used, out = [False] * n, []
    for x in sorted(range(n), key=lambda x: -score[x]):
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(x)
            x = back[x]
        if len(chain) >= MIN_SEEDS:
            out.append(order[chain[::-1]])
    return out


def _reach(same: np.ndarray) -> int:
    """How far an alignment goes on along these comparisons: to the best score before it has dropped by DROP."""
    score = np.cumsum(np.where(same, 1, -1.5))
    if len(score) == 0:
        return 0
    fall = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    score = score[: fall[0]] if len(fall) else score
    return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0


def align(a: np.ndarray, b: np.ndarray, at: list[int], bt: list[int], beyond: bool = True) -> tuple[int, int, int, int, int]:
    """(start, end, other start, other end, equal words) of an alignment through the anchors ``at`` and ``bt``.

    ``beyond``: it goes on before the first and behind the last anchor.
    """
    equal, x, y = 0, at[0], bt[0]
    for i, j in [*zip(at, bt, strict=True), (at[-1] + K, bt[-1] + K)]:
        da, db = i - x, j - y
        if da == db:
            equal += int((a[x:i] == b[y:j]).sum())
        elif da >= 0 and db >= 0:
            n = min(da, db)
            same = a[x : x + n] == b[y : y + n]
            head = n if same.all() else int(np.argmin(same))
            same = (a[i - n : i] == b[j - n : j])[::-1]
            equal += min(n, head + (n if same.all() else int(np.argmin(same))))
        x, y = max(x, i), max(y, j)
    n = min(at[0], bt[0])
    before = (a[at[0] - n : at[0]] == b[bt[0] - n : bt[0]])[::-1]
    n = min(len(a) - x, len(b) - y)
    after = a[x : x + n] == b[y : y + n]
    u, v = (_reach(before), _reach(after)) if beyond else (0, 0)
    return at[0] - u, x + v, bt[0] - u, y + v, equal + int(before[:u].sum()) + int(after[:v].sum())


def aligned(a: np.ndarray, b: np.ndarray, at: list[int], bt: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The alignments of a chain that are passages; a chain that isn't one as a whole is parted at its widest gap."""
    out, todo = [], [(at, bt)]
    while todo:
        at, bt = todo.pop()
        x0, x1, y0, y1, equal = align(a, b, at, bt)
        if min(x1 - x0, y1 - y0) < MIN_WORDS:
            continue
        if equal >= IDENTITY * max(x1 - x0, y1 - y0):
            out.append((x0, x1, y0, y1, equal))
            continue
        x0, x1, y0, y1, equal = align(a, b, at, bt, beyond=False)  # what lies beyond agrees less
        if min(x1 - x0, y1 - y0) >= MIN_WORDS and equal >= IDENTITY * max(x1 - x0, y1 - y0):
            out.append((x0, x1, y0, y1, equal))
        elif len(at) > 1:
            gaps = [max(at[i + 1] - at[i], bt[i + 1] - bt[i]) for i in range(len(at) - 1)]
            k = gaps.index(max(gaps)) + 1
            todo += [(at[:k], bt[:k]), (at[k:], bt[k:])]
    return out


def _tiles(lo: int, hi: int) -> tuple[int, int]:
    """A range with margins, rounded outwards to multiples of 32, so that like ranges are one slice."""
    return max(0, lo - MARGIN) // 32 * 32, -(-(hi + MARGIN) // 32) * 32


def chained(matches: DataFrame) -> DataFrame:
    """One row a chain: ``doc_id, a0, a1, src, b0, b1`` (the ranges to align) and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, src, at, bt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, bt = np.array(at), np.array(bt)
                for chain in chains(at, bt):
                    x, y = at[chain].tolist(), bt[chain].tolist()
                    a, b = _tiles(x[0], x[-1] + K), _tiles(y[0], y[-1] + K)
                    out.append({"doc_id": doc, "a0": a[0], "a1": a[1], "src": src, "b0": b[0], "b1": b[1], "at": x, "bt": y})
            yield pa.RecordBatch.from_pylist(out, schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("a0", pa.int32()), ("a1", pa.int32()), ("src", pa.int64()), ("b0", pa.int32()), ("b1", pa.int32()), ("at", ints), ("bt", ints)])
    return matches.mapInArrow(run, "doc_id long, a0 int, a1 int, src long, b0 int, b1 int, at array<int>, bt array<int>")


def slices(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, lo, hi, words`` for the ``wanted(doc_id, lo, hi)``: 32 bits of hash a word, cut at the end of the text.

    Texts don't travel: documents that nothing is wanted of are filtered where they are read, the others send their
    word hashes.
    """
    wanted = wanted.distinct()
    sent = df.sparkSession.sparkContext.broadcast(_bloom.fill(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_bloom.holds(sent.value, batch.column(0).to_numpy().copy())))
            for c in _text.chunks(batch.column(1)):
                words, first = word_hashes(c)
                raw = (words >> np.uint64(32)).astype(np.uint32).tobytes()
                made = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.first : c.first + len(c)], made], names=["doc_id", "all"])

    own = df.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut_out = F.expr("substring(all, lo * 4 + 1, (hi - lo) * 4)").alias("words")
    return own.mapInArrow(run, "doc_id long, all binary").join(wanted, "doc_id").select("doc_id", "lo", "hi", cut_out).dropDuplicates(["doc_id", "lo", "hi"])


def stretches(held: DataFrame) -> DataFrame:
    """``doc_id, lo, hi``: the words around shared seeds ``held(doc_id, pos)`` that can hold a verbatim run of MIN_WORDS.

    In such a run every WINDOW grams have a shared seed; in a stretch of one seed it may stand WINDOW - 1 places before.
    """
    grams = MIN_WORDS - K + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lo, hi = [], [], []
            for doc, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.sort(np.array(at))
                far = np.flatnonzero(np.diff(at) >= 2 * WINDOW)
                for x, y in zip(at[np.append(0, far + 1)].tolist(), at[np.append(far, len(at) - 1)].tolist(), strict=True):
                    x, y = max(0, x - WINDOW + 1), y - (grams - 2 * WINDOW + 1)  # the first and the last start of a run
                    if x <= y:
                        ids.append(doc)
                        lo.append(x)
                        hi.append(y + MIN_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc_id", "lo", "hi"])

    return held.groupBy("doc_id").agg(F.collect_set("pos").alias("at")).mapInArrow(run, "doc_id long, lo int, hi int")


def windows(parts: DataFrame) -> DataFrame:
    """``h, doc_id, pos`` for every MIN_WORDS words of slices.

    Of words that repeat and overlap in a slice, the first and last of the stretch and every MIN_WORDS-th place: these hold all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, lo, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(raw, np.uint32).astype(np.uint64)
                at = np.arange(max(0, len(words) - MIN_WORDS + 1))
                if len(at) == 0:
                    continue
                h = _text.gram_hashes(words, at, at + MIN_WORDS)
                if len(np.unique(h)) < len(h):
                    kept: dict[int, int] = {}
                    before: dict[int, int] = {}
                    keep = np.zeros(len(h), bool)
                    for i, x in enumerate(h.tolist()):
                        if i - before.get(x, -MIN_WORDS) >= MIN_WORDS:
                            keep[before.get(x, i)] = True
                        if i - kept.get(x, -MIN_WORDS) >= MIN_WORDS:
                            kept[x], keep[i] = i, True
                        before[x] = i
                    keep[list(before.values())] = True
                    at, h = at[keep], h[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), doc)), pa.array((at + lo).astype(np.int32))], names=["h", "doc_id", "pos"])

    return parts.select("doc_id", "lo", "words").mapInArrow(run, "h long, doc_id long, pos int")


def verbatim(df: DataFrame, held: DataFrame, within: DataFrame) -> DataFrame:
    """Verbatim runs of MIN_WORDS words with the first document that has them, in the columns of ``chained``; not those ``within(d, start, end)``."""
    ranges = swept(stretches(held))
    parts = swept(slices(df, ranges))
    drop_cut(ranges)
    own = windows(parts)
    firsts = own.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("last"))
    shared = swept(firsts.where("f.doc_id < last").select("h", F.col("f.doc_id").alias("src"), F.col("f.pos").alias("src_pos")))
    pairs = own.join(shared, "h").where("doc_id <> src").groupBy("doc_id", "src").agg(F.collect_list(F.struct("pos", "src_pos")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, src, at, bt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, bt = np.array(at), np.array(bt)
                order = np.lexsort((at, at - bt))
                at, bt = at[order], bt[order]
                # along one diagonal, without a gap that no window bridges
                ends = np.flatnonzero((np.diff(at - bt) != 0) | (np.diff(at) > MIN_WORDS))
                for i, j in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(at) - 1], strict=True):
                    x, y = [int(at[i]), int(at[j]) + MIN_WORDS - K], [int(bt[i]), int(bt[j]) + MIN_WORDS - K]
                    a, b = _tiles(x[0], x[1] + K), _tiles(y[0], y[1] + K)
                    out.append({"doc_id": doc, "a0": a[0], "a1": a[1], "src": src, "b0": b[0], "b1": b[1], "at": x, "bt": y})
            yield pa.RecordBatch.from_pylist(out, schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("a0", pa.int32()), ("a1", pa.int32()), ("src", pa.int64()), ("b0", pa.int32()), ("b1", pa.int32()), ("at", ints), ("bt", ints)])
    rows = pairs.select("doc_id", "src", F.col("m.pos").alias("at"), F.col("m.src_pos").alias("bt"))
    rows = rows.mapInArrow(run, "doc_id long, a0 int, a1 int, src long, b0 int, b1 int, at array<int>, bt array<int>")
    out = swept(rows.join(within, F.expr(f"doc_id = d and start <= at[0] and end >= at[1] + {K}"), "left_anti"))
    drop_cut(parts)
    drop_cut(shared)
    return out


def passages(df: DataFrame, found: DataFrame) -> DataFrame:
    """The passages of the chains ``found``, with the columns of ``repeated``."""
    wanted = found.select("doc_id", F.col("a0").alias("lo"), F.col("a1").alias("hi")).unionByName(found.select(F.col("src").alias("doc_id"), F.col("b0").alias("lo"), F.col("b1").alias("hi")))
    parts = swept(slices(df, wanted))
    a = parts.select("doc_id", F.col("lo").alias("a0"), F.col("hi").alias("a1"), F.col("words").alias("aw"))
    b = parts.select(F.col("doc_id").alias("src"), F.col("lo").alias("b0"), F.col("hi").alias("b1"), F.col("words").alias("bw"))
    both = found.join(a, ["doc_id", "a0", "a1"]).join(b, ["src", "b0", "b1"]).select("doc_id", "src", "a0", "b0", "at", "bt", "aw", "bw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, src, a0, b0, at, bt, aw, bw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(aw, np.uint32)
                for x0, x1, y0, y1, equal in aligned(own, np.frombuffer(bw, np.uint32), [x - a0 for x in at], [y - b0 for y in bt]):
                    if len(np.unique(own[x0:x1])) >= VARIETY:
                        out.append({"doc_id": doc, "start": x0 + a0, "end": x1 + a0, "src_doc_id": src, "src_start": y0 + b0, "src_end": y1 + b0, "equal_words": equal})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("src_doc_id", pa.int64()), ("src_start", pa.int32()), ("src_end", pa.int32()), ("equal_words", pa.int32())])
    out = swept(both.mapInArrow(run, "doc_id long, start int, end int, src_doc_id long, src_start int, src_end int, equal_words int").distinct())
    drop_cut(parts)
    return out


def repeated(df: DataFrame) -> DataFrame:
    """``doc_id, start, end, src_doc_id, src_start, src_end, equal_words`` of every repeated passage, in words."""
    own = seeds(df)
    firsts = own.where("opens").groupBy("h").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last"), F.min_by("pos", "doc_id").alias("src_pos"))
    # written first: the join then has a plain exchange on both sides, and a seed that very many places have can be split
    shared = swept(firsts.where("src < last").select("h", "src", "src_pos"))
    held = swept(own.select("h", "doc_id", "pos").join(shared, "h").drop("h"))
    drop_cut(shared)
    pairs = held.where("doc_id <> src").groupBy("doc_id", "src").agg(F.collect_list(F.struct("pos", "src_pos")).alias("m")).where(F.size("m") >= MIN_SEEDS)
    found = swept(chained(pairs.select("doc_id", "src", F.col("m.pos").alias("at"), F.col("m.src_pos").alias("bt"))))
    out = passages(df, found)
    drop_cut(found)
    runs = verbatim(df, held, out.select(F.col("doc_id").alias("d"), "start", "end"))
    drop_cut(held)
    if not runs.isEmpty():
        out = out.unionByName(passages(df, runs)).distinct()
    drop_cut(runs)
    return out
