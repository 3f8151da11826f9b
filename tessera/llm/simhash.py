"""SimHash near-duplicates by multi-index hashing.

Fingerprints are majority bits of the hashes of word shingles, in words of 64 bits.  The
bits form segments; two fingerprints that agree within the radius r_i on some segment i
are a candidate pair.  One side of the join enumerates the small Hamming ball of each of
its segments, the other stands in the table under its exact segment values, and complete
distances are verified inside the join.  Of two values that differ, only the one that has
a 0 at the lowest differing bit enumerates, so a pair is met once a segment.

Two steps keep groups of near copies from becoming all pairs.  First every entry of the
table is compared with the least one under its key only, and what links is put together
(``leaders``).  Then the balls are searched, and only pairs of entries that aren't together
yet leave the join (``crossing``).  Table keys with many entries are split by exact
sub-segments of all 64 bits (by pigeonhole, so no pair is lost) where the distance is small.

``groups`` (links: distance 4 of 64 bits over shingles of four words, radii such that every
such pair must agree on a segment) loses no link.  ``near_copies`` finds texts whose sets of
five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more: 128 bits in eight
segments of radius 1 put texts into coarse groups, and within a group the sets themselves
are compared, block by block; a pair of blocks returns a spanning forest, never its pairs.
Of pairs at 0.80 some 8 % aren't in one group, at 0.85 some 3 %, at 0.9 under 1 %.

Empty or null texts have the fingerprint zero and link like any other; equal
fingerprints (equal sets) are collapsed before the search, so copies are never expanded
into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bloom, _text
from ._cluster import components, cut, forest

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (word, lowest bit, width, radius); the radii sum to DISTANCE - segments + 1, so one segment must match.
SEGMENTS = (("w0", 0, 22, 1), ("w0", 22, 21, 1), ("w0", 43, 21, 0))
#: Fingerprints of one table bucket above which it is split by sub-segments.
BUCKET = 256
#: Of near copies: words of a shingle, least Jaccard similarity, segments, and the distance of 128 bits up to which texts are
#: compared (pairs at SIMILARITY differ in 19.4 bits on average, with a deviation of 4.1).
SET_SHINGLE, SIMILARITY = 5, 0.8
SET_SEGMENTS = tuple((w, lo, 16, 1) for w in ("w0", "w1") for lo in (0, 16, 32, 48))
SET_BITS = 28
#: Sets of a block that are compared with those of another.
SET_BLOCK = 512

#: For each byte, its bits spread over the eight bytes of a word, most significant first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _majority(h: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """For each text the 64 bits that are set in over half of its hashes (zero without hashes)."""
    out = np.zeros(len(per_text), np.uint64)
    has = np.flatnonzero(per_text)
    if len(has) == 0:
        return out
    counts = per_text[has]
    blocks = -(-counts // 255)  # a byte lane holds up to 255
    firsts = np.cumsum(counts) - counts
    block_text = np.repeat(np.arange(len(has)), blocks)
    nth = np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = firsts[block_text] + nth * 255
    lanes = _SPREAD[h.astype(">u8").view(np.uint8).reshape(-1, 8)]
    lanes = np.add.reduceat(lanes, starts, axis=0)
    bits = lanes.view(np.uint8).reshape(len(starts), 64)
    total = np.add.reduceat(bits, np.cumsum(blocks) - blocks, axis=0, dtype=np.int64)
    up = np.packbits(2 * total > counts[:, None], axis=1)
    out[has] = up.view(">u8").ravel()
    return out


def _shingles(first: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many of each text, first word, end) of all shingles; a shorter text is one shingle."""
    words = np.diff(first)
    per_text = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    text = np.repeat(np.arange(len(words)), per_text)
    a = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return per_text, a, np.minimum(a + shingle, first[text + 1])


def chunk_fingerprints(c: _text.Chunk, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    buf = _text.lower_ascii(c.buf)
    starts, ends, first = _text.word_bounds(buf, c.offsets)
    if len(starts) == 0:
        return np.zeros(len(c), np.uint64)
    # the words with one space between: every shingle is then one slice
    lens = ends - starts
    at = np.cumsum(lens + 1) - (lens + 1)
    inside = np.repeat(at - starts, lens) + np.flatnonzero(~_text._SPACE[buf])
    flat = np.full(int(at[-1] + lens[-1] + 1), 0x20, np.uint8)
    flat[inside] = buf[inside - np.repeat(at - starts, lens)]
    per_text, a, b = _shingles(first, shingle)
    b = b - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(raw[i:j], seed) for i, j in zip(at[a].tolist(), (at[b] + lens[b]).tolist(), strict=True)), np.uint64, len(a)
    )
    return _majority(h, per_text)


def fingerprints(df: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [chunk_fingerprints(c, shingle, seed) for c in _text.chunks(batch.column(1))]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _bits(fp: str, low: int, width: int) -> str:
    return f"(shiftrightunsigned({fp}, {low}) & {(1 << width) - 1}L)"


def _entries(fps: DataFrame, segments) -> DataFrame:
    """The table: a row for each entry and segment, under its value."""
    keys = [f"{_bits(word, lo, w)} * {len(segments)}L + {i}L" for i, (word, lo, w, _) in enumerate(segments)]
    return fps.select("*", F.explode(F.expr(f"array({','.join(keys)})")).alias("key"))


def _balls(fps: DataFrame, segments) -> DataFrame:
    """The searching side: all values within the radius of each segment; ``far`` where a bit differs."""
    n, found = len(segments), []
    for i, (word, lo, w, r) in enumerate(segments):
        value, flips = _bits(word, lo, w), {0}
        for _ in range(r):
            flips |= {f ^ (1 << k) for f in flips for k in range(w)}
        masks = "array(" + ",".join(f"{f}L" for f in sorted(flips)) + ")"
        found.append(f"transform(filter({masks}, f -> ({value} & f & -f) = 0), f -> struct(({value} ^ f) * {n}L + {i}L as key, f <> 0 as far))")
    return fps.select("*", F.explode(F.expr(f"concat({','.join(found)})")).alias("s")).select("*", "s.key", "s.far").drop("s")


def leaders(fps: DataFrame, near: str, segments) -> DataFrame:
    """Pairs ``u, v`` of each entry of ``fps(id, ...)`` with the least one under one of its keys."""
    stand = _entries(fps, segments)
    first = cut(stand.groupBy("key").agg(F.min(F.struct(*fps.columns)).alias("f"), F.count("*").alias("n")).where("n > 1").select("key", "f.*"))
    return stand.alias("q").join(first.alias("t"), F.expr(f"q.key = t.key and q.id <> t.id and {near}")).selectExpr("q.id as u", "t.id as v").distinct()


def crossing(fps: DataFrame, near: str, segments, slices: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``u, v`` of the groups ``comp`` of ``fps(comp, ...)`` that have entries near each other.

    ``slices``: keys with more than ``bucket`` entries are split by so many exact slices of w0, one of which near entries must
    share; 0: keys aren't split.
    """
    stand, seek = _entries(fps, segments), _balls(fps, segments)
    near = f"q.comp <> t.comp and (q.far or q.comp < t.comp) and {near}"
    pair = ("q.comp as u", "t.comp as v")
    hot = cut(stand.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key")) if slices else None
    if hot is None or hot.isEmpty():
        return seek.alias("q").join(stand.alias("t"), F.expr(f"q.key = t.key and {near}")).selectExpr(*pair).distinct()
    cuts = np.linspace(0, 64, slices + 1).astype(int).tolist()
    parts = [f"struct({k} as k, {_bits('w0', a, b - a)} as part)" for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def split(rows: DataFrame) -> DataFrame:
        own = rows.columns
        rows = rows.join(hot.withColumn("is_hot", F.lit(True)), "key", "left")
        whole = "array(struct(-1 as k, 0L as part))"
        return rows.select(*own, F.explode(F.expr(f"if(is_hot, array({','.join(parts)}), {whole})")).alias("s")).select(*own, "s.*")

    same = "q.key = t.key and q.k = t.k and q.part = t.part and "
    return split(seek).alias("q").join(split(stand).alias("t"), F.expr(same + near)).selectExpr(*pair).distinct()


def together(fps: DataFrame, near: str, segments, slices: int = 0, bucket: int = BUCKET) -> DataFrame:
    """``id, comp`` of ``fps(id, w0, ...)`` (distinct ids): the least id that links reach; ``near`` is SQL over entries q and t."""
    comp = components(leaders(fps, near, segments)).withColumnRenamed("node", "id")
    now = cut(fps.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"))
    last = components(crossing(now.drop("id"), near, segments, slices, bucket)).withColumnRenamed("node", "comp")
    return now.select("id", "comp").join(cut(last), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp"))


def groups(df: DataFrame, distance: int = DISTANCE, segments=SEGMENTS) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest doc_id reachable over links).

    Rows without a doc_id get the component of their fingerprint; if no member has a
    doc_id the component is null.
    """
    if sum(r for *_, r in segments) < distance - len(segments) + 1:
        raise ValueError("these radii would lose pairs")
    rows = cut(fingerprints(df))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # distance + 1 slices of all 64 bits: one of them must agree
    comp = together(distinct.select(F.col("fp").alias("id"), F.col("fp").alias("w0")), f"bit_count(q.w0 ^ t.w0) <= {distance}", segments, distance + 1).select(F.col("id").alias("fp"), F.col("comp").alias("component"))
    named = cut(distinct.join(comp, "fp"))
    # the minima are combined before the shuffle and written before the join: a component or fingerprint of very many rows can be split
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))
    label = cut(named.join(least, "component").select("fp", "component_id"))
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(c: _text.Chunk, shingle: int = SET_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(how many of each text, hashes in order) of the different shingles of each text."""
    buf = _text.lower_ascii(c.buf)
    starts, ends, first = _text.word_bounds(buf, c.offsets)
    per_text, a, b = _shingles(first, shingle)
    if len(a) == 0:
        return per_text, np.zeros(0, np.uint64)
    h = _text.gram_hashes(_text.span_hashes(buf, starts, ends), a, b)
    text = np.repeat(np.arange(len(c)), per_text)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[new], minlength=len(c)), h[new]


def _set_ids(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_text.mix64(h ^ np.uint64(0x94D049BB133111EB)), out=total[1:])
    ends = np.cumsum(counts)
    return _text.mix64(total[ends] - total[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def _own(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_copies(df: DataFrame, similarity: float = SIMILARITY, shingle: int = SET_SHINGLE) -> DataFrame:
    """``doc_id, text_hash, comp`` for every row: rows with one ``comp`` are linked by pairs of at least that similarity.

    ``text_hash`` is Spark's ``xxhash64`` of the text.  Texts under ``shingle`` words are one shingle; those without words
    have the empty set and are one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _text.chunks(batch.column(2)):
                counts, h = shingle_sets(c, shingle)
                w = [pa.array(_majority(x, counts).view(np.int64)) for x in (h, _text.mix64(h))]
                own = [x[c.first : c.first + len(c)] for x in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(_set_ids(counts, h)), *w, pa.array(counts.astype(np.int32))], names=["doc_id", "text_hash", "id", "w0", "w1", "n"])

    hashed = _own(df).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = cut(hashed.mapInArrow(run, "doc_id long, text_hash long, id long, w0 long, w1 long, n int"))
    fps = cut(rows.groupBy("id").agg(F.first("w0").alias("w0"), F.first("w1").alias("w1"), F.first("n").alias("n")))
    near = f"bit_count(q.w0 ^ t.w0) + bit_count(q.w1 ^ t.w1) <= {SET_BITS} and least(q.n, t.n) >= {similarity}D * greatest(q.n, t.n)"
    coarse = cut(together(fps, near, SET_SEGMENTS))
    comp = components(similar(df, coarse, similarity, shingle)).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    return rows.join(cut(comp), "id", "left").select("doc_id", "text_hash", F.coalesce("comp", "id").alias("comp"))


def similar(df: DataFrame, coarse: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``u, v``: links that join what is so similar within the groups ``coarse(id, comp)`` of set ids; the sets are read from the texts again."""
    sizes = cut(coarse.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.expr(f"cast(ceil(m / {SET_BLOCK}) as int)")))
    members = cut(coarse.join(sizes, "comp").withColumn("block", F.expr("pmod(xxhash64(id, 77), blocks)").cast("int")).select("id", "comp", "block", "blocks"))
    sent = df.sparkSession.sparkContext.broadcast(_bloom.fill(members, "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _text.chunks(batch.column(0)):
                counts, h = shingle_sets(c, shingle)
                ids, at = _set_ids(counts, h), np.cumsum(counts)
                hit = np.flatnonzero(_bloom.holds(sent.value, ids)).tolist()
                raw = [h[at[i] - counts[i] : at[i]].tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(raw, pa.binary())], names=["id", "set"])

    # of copies one row is enough: the filter may let others through, the join doesn't
    found = _own(df).select("text").mapInArrow(sets, "id long, set binary").dropDuplicates(["id"])
    found = cut(found.join(members, "id").select("comp", "block", "blocks", "id", "set"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("k")
    tasks = found.select("comp", "block", other, "id", "set").withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")}).drop("k")
    return tasks.groupBy("comp", "i", "j").applyInArrow(_compared(similarity), "u long, v long")


def _compared(similarity: float):
    """Two blocks of a group, or one with itself: a spanning forest of the pairs that are similar enough."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        ids, block = table["id"].to_numpy()[order], block[order]
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].take(pa.array(order)).to_pylist()]
        size = np.array([len(x) for x in sets])
        # common shingles by the lists of the rows that hold each shingle
        row = np.repeat(np.arange(len(sets)), size)
        h = np.concatenate(sets)
        by = np.argsort(h, kind="stable")
        h, row = h[by], row[by]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(h)))
        a, c = (len(sets), 0) if i == j else (int((block == i).sum()),) * 2
        both = np.zeros((a, len(sets) - c), np.float32)
        shared = np.flatnonzero(times > 1)
        for k in range(0, len(shared), 2048):
            part = shared[k : k + 2048]
            at = np.repeat(first[part], times[part]) + np.arange(times[part].sum()) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
            has = np.zeros((len(sets), len(part)), np.float32)
            has[row[at], np.repeat(np.arange(len(part)), times[part])] = 1
            both += has[:a] @ has[c:].T
        x, y = np.nonzero(both >= similarity * (size[:a, None] + size[None, c:] - both))
        node, root = forest(len(sets), x, y + c)
        return pa.table({"u": pa.array(ids[node], pa.int64()), "v": pa.array(ids[root], pa.int64())})

    return run


def keep_one(df: DataFrame, similarity: float = SIMILARITY, shingle: int = SET_SHINGLE) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the least doc_id (rows without one come last).

    Of rows with one doc_id and different texts, each is a document of its own; among rows of a group with one doc_id the least
    text hash stays.  Of rows that agree in doc_id and text one stays; which one isn't defined if other columns differ.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    first = near_copies(df, similarity, shingle).groupBy("comp").agg(F.min(rank).alias("r"))
    first = cut(first.select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__th")))
    own = df.withColumns({"__key": F.col("doc_id").cast("long"), "__hash": F.xxhash64(F.col("text").cast("string"))})
    kept = own.join(first, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left_semi")
    return kept.dropDuplicates(["__key", "__hash"]).select(*df.columns)


def digest(df: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    return groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
