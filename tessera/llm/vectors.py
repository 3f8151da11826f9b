"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors collapse into classes.  A bounded sample gives ``centres``; every class
   goes to its ``overlap`` nearest clusters, and clusters are cut into blocks of bounded
   size, the shards.
2. In each shard a flat graph is built: nearest candidates, robust pruning, reverse edges.
   The adjacency lists that a class gets in its shards are united.
3. Every class is a query of each of its shards: a beam search walks greedily from the
   shard's medoid and from the class's own neighbours in the united graph, and wherever it
   meets a vector within the range the search expands through all neighbours of such vectors
   until no new one appears.  Cosines are verified in double precision.
4. A pair is counted in the first cluster that both have, so nothing is counted twice,
   and a shard returns counts and a spanning forest of its links, never all pairs.
5. Audit: queries (those whose id is divisible by 50 first) are drawn and compared exactly
   with all vectors until ``AUDIT`` of them have links, or all are drawn.  If the graph found
   less than ``RECALL`` of these links, the search is repeated with twice the overlap, and
   after the last one all blocks of all vectors are compared exactly.

A search stays in its shard: a walk over the whole united graph would be a join of all
queries with the graph for every hop, many times the input in shuffles.  The united lists
bring what other shards know of a class's neighbourhood into each of its searches.  Vectors
travel in their own precision, once to build and once to search; a cluster of b blocks sends
each of them b times, as its pairs of blocks are searched one by one.

Defined results: null, empty, zero or non-finite vectors and rows without a vec_id link
with nothing; vectors of different lengths don't link; repeated rows of one vec_id count
once (the least vector).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import components, cut, drop_cut, forest

COSINE = 0.9
#: Vectors that give the centres, at most; clusters, at most; aimed size of a cluster; size of a block.
SAMPLE, CLUSTERS, AIM, BLOCK = 8192, 2048, 400, 4096
#: Queries that a shard searches at once.
AT_ONCE = 512
OVERLAP = 2
#: Of the graph: candidates, neighbours after pruning, the pruning's slack, width of the beam.
CANDIDATES, DEGREE, ALPHA, BEAM = 40, 16, 1.2, 16
#: Audited queries that have links and the share of these that must be found.
AUDIT, RECALL = 256, 0.95
#: Queries that one pass over all vectors compares, at most; the overlap after which the comparison is exact.
DRAWN, LAST = 4096, 32


def _unit(raw: list[bytes], dtype: type) -> np.ndarray:
    """Unit rows in double precision of vectors of one length."""
    v = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _dtype(df: DataFrame) -> type:
    """What holds the numbers of the column ``embedding`` without loss."""
    return np.float32 if df.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``vec_id, cls`` of every row, null without a usable vector; ``cls, rep, mult, vec`` of every class).

    ``vec`` holds the numbers as they are, ``rep`` the least vec_id.
    """
    dtype = _dtype(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lens = np.asarray(column.value_lengths().fill_null(0))
            values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)  # nulls are NaN
            first = np.cumsum(lens) - lens
            vec: list[bytes | None] = [None] * len(lens)
            for n in np.unique(lens[lens > 0]).tolist():
                rows = np.flatnonzero(lens == n)
                v = values[first[rows][:, None] + np.arange(n)]
                good = np.isfinite(v).all(1) & (v != 0).any(1)
                for i, x in zip(rows[good].tolist(), v[good], strict=True):
                    vec[i] = x.tobytes()
            cls = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in vec]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "cls", "vec"])

    kind = "array<float>" if dtype is np.float32 else "array<double>"
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    named = own.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = cut(named.mapInArrow(run, "vec_id long, cls binary, vec binary"))
    groups = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    return rows.select("vec_id", "cls"), cut(groups)


def centres(groups: DataFrame, dtype: type) -> dict[int, np.ndarray]:
    """Cluster centres by the bytes of a vector, from a bounded sample (spherical k-means)."""
    n = groups.count()
    sample = groups.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vec").collect()
    out: dict[int, np.ndarray] = {}
    for size in sorted({len(r.vec) for r in sample}):
        x = _unit([bytes(r.vec) for r in sample if len(r.vec) == size], dtype).astype(np.float32)
        k = int(np.clip(round(n / AIM), 1, min(CLUSTERS, max(1, len(x) // 4))))
        c = x[np.random.default_rng(2).permutation(len(x))[:k]]
        for _ in range(6):
            near = np.argmax(x @ c.T, 1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
        out[size] = c
    return out


def assigned(groups: DataFrame, middle: dict[int, np.ndarray], overlap: int, dtype: type) -> DataFrame:
    """``rep, mult, vec, clusters``: the nearest clusters of each class in order, as numbers with the vector's bytes."""
    sent = groups.sparkSession.sparkContext.broadcast(middle)  # at most CLUSTERS centres a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            lens = np.array([len(x) for x in raw])
            found: list[list[int]] = [[] for _ in raw]
            for size in np.unique(lens).tolist():
                rows = np.flatnonzero(lens == size).tolist()
                c = sent.value.get(size)
                if c is None:  # a length that the sample doesn't hold
                    near = np.zeros((len(rows), 1), np.int64)
                else:
                    k = min(overlap, len(c))
                    sims = _unit([raw[i] for i in rows], dtype).astype(np.float32) @ c.T
                    near = np.sort(np.argpartition(-sims, k - 1, axis=1)[:, :k], axis=1)
                for i, x in zip(rows, (size * 100_000 + near).tolist(), strict=True):
                    found[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=["rep", "mult", "vec", "clusters"])

    return groups.select("rep", "mult", "vec").mapInArrow(run, "rep long, mult long, vec binary, clusters array<long>")


def build(v: np.ndarray) -> list[np.ndarray]:
    """Adjacency of a robust-pruned flat graph over unit rows."""
    n = len(v)
    if n == 1:
        return [np.zeros(0, np.int64)]
    s = v.astype(np.float32) @ v.T.astype(np.float32)
    np.fill_diagonal(s, -np.inf)
    k = min(CANDIDATES, n - 1)
    cand = np.argpartition(-s, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(s, cand, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
    open_, rows = np.ones((n, k), bool), np.arange(n)
    np.fill_diagonal(s, 1.0)
    links: list[list[int]] = [[] for _ in range(n)]
    for _ in range(DEGREE):
        first = np.argmax(open_, 1)
        live = np.flatnonzero(open_[rows, first])
        if len(live) == 0:
            break
        p = cand[live, first[live]]
        for i, j in zip(live.tolist(), p.tolist(), strict=True):
            links[i].append(j)
        # squared distances are 2 - 2 cos: drop what is closer to the pick than to the node, by the slack
        far = ALPHA**2 * (1 - s[p[:, None], cand[live]]) <= 1 - near[live]
        open_[live] &= ~far
        open_[live, first[live]] = False
    both: list[set[int]] = [set(x) for x in links]
    for i, x in enumerate(links):
        for j in x:
            if len(both[j]) < 3 * DEGREE:
                both[j].add(i)
    return [np.array(sorted(x), np.int64) for x in both]


def search(v: np.ndarray, pointers: np.ndarray, flat: np.ndarray, q: np.ndarray, start: tuple[np.ndarray, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within the range.  ``start``: pairs to begin with beside the medoid.

    All queries advance together: greedy steps with a beam, then expansion of everything in range.
    """
    n, m = len(v), len(q)
    seen = np.zeros((m, n), bool)
    sims = np.full((m, n), -np.inf)

    def visit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verify pairs not seen yet; returns them."""
        keys = np.unique(a * n + b)
        a, b = keys // n, keys % n
        new = ~seen[a, b]
        a, b = a[new], b[new]
        seen[a, b] = True
        for i in range(0, len(a), 65536):
            x, y = a[i : i + 65536], b[i : i + 65536]
            sims[x, y] = np.einsum("ij,ij->i", q[x], v[y])
        return a, b

    def spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query with the neighbours of its node."""
        count = pointers[b + 1] - pointers[b]
        at = np.repeat(pointers[b], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(a, count), flat[at]

    medoid = int(np.argmax(v @ v.sum(0)))
    everyone = np.arange(m)
    visit(everyone, np.full(m, medoid))
    visit(*start)
    expanded = np.zeros((m, n), bool)
    width = min(BEAM, n)
    for _ in range(4 * BEAM):
        beam = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ready = seen[everyone[:, None], beam] & ~expanded[everyone[:, None], beam]
        value = np.where(ready, np.take_along_axis(sims, beam, 1), -np.inf)
        best = np.argsort(-value, axis=1)[:, :4]
        live = np.take_along_axis(ready, best, 1)
        a, b = np.repeat(everyone, best.shape[1])[live.ravel()], np.take_along_axis(beam, best, 1)[live]
        if len(a) == 0:
            break
        expanded[a, b] = True
        visit(*spread(a, b))
    while True:
        a, b = np.nonzero((sims >= cosine) & ~expanded)
        if len(a) == 0:
            break
        expanded[a, b] = True
        visit(*spread(a, b))
    return np.nonzero(sims >= cosine)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    column = column.combine_chunks()
    return np.asarray(column.value_lengths().fill_null(0)), np.asarray(column.flatten())


def _built(dtype: type):
    def run(table: pa.Table) -> pa.Table:
        rep = table["rep"].to_numpy()
        order = np.argsort(rep)
        adj = build(_unit(table["vec"].to_pylist(), dtype)[order])
        rep = rep[order]
        return pa.table({"rep": rep, "near": pa.array([rep[x] for x in adj], pa.list_(pa.int64()))})

    return run


def _searched(cosine: float, dtype: type, walk: bool):
    """Two blocks of a shard, or one with itself: counts and a forest of the links between them."""

    def run(table: pa.Table) -> pa.Table:
        shard, i, j = (table[c][0].as_py() for c in ("shard", "i", "j"))
        block, rep = table["block"].to_numpy(), table["rep"].to_numpy()
        order = np.lexsort((rep, block))
        table, block, rep = table.take(pa.array(order)), block[order], rep[order]
        vec, mult = _unit(table["vec"].to_pylist(), dtype), table["mult"].to_numpy()
        lens, values = _lists(table["clusters"])
        clusters = np.full((len(rep), max(int(lens.max()), 1)), -1)
        clusters[np.repeat(np.arange(len(rep)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
        asks, nodes = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(asks) == 0 or len(nodes) == 0:
            asks = asks[:0]
        # the united lists, cut to the block of nodes; where rows stand is found by their rep
        lens, near = _lists(table["near"])
        here = rep[nodes]
        at = np.minimum(np.searchsorted(here, near), max(len(here) - 1, 0))
        inside = here[at] == near if len(here) else np.zeros(len(near), bool)
        row, to = np.repeat(np.arange(len(rep)), lens)[inside], at[inside]
        per_row = np.bincount(row, minlength=len(rep))
        first = np.concatenate([[0], np.cumsum(per_row)])
        pointers = np.concatenate([[0], np.cumsum(per_row[nodes])])
        flat = np.concatenate([to[first[x] : first[x + 1]] for x in nodes.tolist()] or [to[:0]])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(asks), AT_ONCE):
            part = asks[k : k + AT_ONCE]
            if walk:
                begin = np.repeat(np.arange(len(part)), per_row[part]), np.concatenate([to[first[x] : first[x + 1]] for x in part.tolist()])
                if i == j:
                    begin = np.append(begin[0], np.arange(len(part))), np.append(begin[1], np.arange(k, k + len(part)))
                x, y = search(vec[nodes], pointers, flat, vec[part], begin, cosine)
            else:
                x, y = np.nonzero(vec[part] @ vec[nodes].T >= cosine)
            x, y = part[x], nodes[y]
            # a pair counts in the first cluster that both have
            other = rep[x] != rep[y]
            for p in range(clusters.shape[1]):
                for r in range(clusters.shape[1]):
                    other &= ~((clusters[x, p] == clusters[y, r]) & (clusters[x, p] >= 0) & (clusters[x, p] < shard))
            a.append(np.minimum(x, y)[other])
            b.append(np.maximum(x, y)[other])
        # whichever end found it
        pairs = np.unique(np.concatenate(a) * len(rep) + np.concatenate(b))
        a, b = pairs // max(len(rep), 1), pairs % max(len(rep), 1)
        counts = np.zeros(len(rep), np.int64)
        np.add.at(counts, a, mult[b])
        np.add.at(counts, b, mult[a])
        some, (u, v) = np.flatnonzero(counts), forest(len(rep), a, b)
        none_n, none_u = pa.nulls(len(some), pa.int64()), pa.nulls(len(u), pa.int64())
        return pa.table({
            "rep": pa.chunked_array([pa.array(rep[some]), none_u]), "n": pa.chunked_array([pa.array(counts[some]), none_u]),
            "u": pa.chunked_array([none_n, pa.array(rep[u])]), "v": pa.chunked_array([none_n, pa.array(rep[v])]),
        })

    return run


def linked(groups: DataFrame, middle: dict[int, np.ndarray], overlap: int, cosine: float, dtype: type, walk: bool = True) -> DataFrame:
    """``rep, n`` (links of a class to other classes, copies counted) and, in other rows, ``u, v`` of a spanning forest.

    Without ``walk`` the blocks of a cluster are compared exactly.
    """
    members = cut(assigned(groups, middle, overlap, dtype))
    spread = members.select("*", F.explode("clusters").alias("shard"))
    sizes = spread.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = spread.join(F.broadcast(cut(sizes)), "shard").withColumn("block", F.expr("pmod(xxhash64(rep, 77), blocks)").cast("int"))  # sizes: a row a cluster
    if walk:
        built = spread.select("shard", "block", "rep", "vec").groupBy("shard", "block").applyInArrow(_built(dtype), "rep long, near array<long>")
        united = cut(built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        spread = members.join(united, "rep").select("*", F.explode("clusters").alias("shard")).join(F.broadcast(cut(sizes)), "shard").withColumn("block", F.expr("pmod(xxhash64(rep, 77), blocks)").cast("int"))
    else:
        spread = spread.withColumn("near", F.expr("cast(array() as array<long>)"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("k")
    tasks = spread.select("shard", "block", other, "rep", "mult", "vec", "clusters", "near").withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")}).drop("k")
    return tasks.groupBy("shard", "i", "j").applyInArrow(_searched(cosine, dtype, walk), "rep long, n long, u long, v long")


def exact(groups: DataFrame, asked: list, cosine: float, dtype: type) -> dict[int, int]:
    """For the classes ``asked(rep, vec)`` the true number of links, by comparison with all vectors."""
    reps = np.array([r.rep for r in asked])
    sizes = np.array([len(r.vec) for r in asked])
    by_size = {int(size): (np.flatnonzero(sizes == size), _unit([bytes(r.vec) for r in asked if len(r.vec) == size], dtype)) for size in np.unique(sizes)}
    sent = groups.sparkSession.sparkContext.broadcast((reps, by_size))  # at most DRAWN vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, by_size = sent.value
        total = np.zeros(len(reps), np.int64)
        for batch in batches:
            rep, mult, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            lens = np.array([len(x) for x in raw])
            for size, (at, q) in by_size.items():
                rows = np.flatnonzero(lens == size)
                for i in range(0, len(rows), 512):
                    part = rows[i : i + 512]
                    near = q @ _unit([raw[x] for x in part], dtype).T >= cosine
                    total[at] += (near & (reps[at][:, None] != rep[part])) @ mult[part]
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(total)], names=["rep", "n"])

    rows = groups.select("rep", "mult", "vec").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()
    return {r.rep: r.n for r in rows}


def audited(groups: DataFrame, cosine: float, dtype: type) -> dict[int, int]:
    """The true number of links of AUDIT classes that have links, or of all that have if there are fewer.

    Ids divisible by 50 are drawn first.
    """
    rank = F.xxhash64("rep", F.lit(1)).bitwiseAND(F.lit((1 << 62) - 1)) + F.when(F.col("rep") % 50 == 0, 0).otherwise(1 << 62)
    ranked = groups.select("rep", "vec", rank.alias("rank"))
    true: dict[int, int] = {}
    last, n = None, AUDIT
    while len(true) < AUDIT:
        rest = ranked if last is None else ranked.where((F.col("rank") > last.rank) | ((F.col("rank") == last.rank) & (F.col("rep") > last.rep)))
        asked = rest.orderBy("rank", "rep").limit(n).collect()
        if not asked:
            break
        links = exact(groups, asked, cosine, dtype)
        true |= {r.rep: links[r.rep] for r in asked if links[r.rep]}
        last, n = asked[-1], min(4 * n, DRAWN)
    return dict(list(true.items())[:AUDIT])


def recall(found: DataFrame, true: dict[int, int]) -> float:
    """Share of the true links of the audited classes that were found."""
    if not true:
        return 1.0  # all classes were drawn, none has a link
    got = {r.rep: r.n for r in found.where(F.col("rep").isin(list(true))).groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    # a link counts once however many copies stand behind it
    return sum(min(got.get(k, 0), n) / n for k, n in true.items()) / len(true)


def near_duplicates(df: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector."""
    dtype = _dtype(df)
    rows, groups = classes(df)
    found = None
    if not groups.isEmpty():
        middle, true = centres(groups, dtype), audited(groups, cosine, dtype)
        found = cut(linked(groups, middle, overlap, cosine, dtype))
        while recall(found, true) < RECALL:
            drop_cut(found)
            if overlap >= LAST:  # one cluster a length, all its blocks
                found = cut(linked(groups, {size: c[:1] for size, c in middle.items()}, 1, cosine, dtype, walk=False))
                break
            overlap *= 2
            found = cut(linked(groups, middle, overlap, cosine, dtype))
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.where("u is not null").select("u", "v")).withColumnRenamed("node", "rep")
    known = groups.select("cls", "rep", "mult").join(n, "rep", "left").join(comp, "rep", "left")
    known = known.select("cls", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(known, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def digest(df: DataFrame) -> DataFrame:
    """As ``near_duplicates``, with a row for vectors without a vec_id too (no links, no component, not kept)."""
    lost = df.where("vec_id is null").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept"))
    return near_duplicates(df).unionByName(lost)
