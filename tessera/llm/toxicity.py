"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the terms i that a text has.
The pairwise part learns what the sum of single weights can't, such as an insult that
counts only next to the mention of a group, or a word that makes another harmless.

Terms are lower-cased runs of letters and digits and the beginnings of longer ones
(compounds), hashed.  Two ways lead into the machine, for ``TERMS`` terms at most:

* alone: the share of toxic documents that have the term differs from the average by
  ``SIGNIFICANT`` standard errors, upwards or downwards;
* in a pair: among ``CANDIDATES`` terms (the strongest alone, then the most informative by
  frequency) an additive model is fitted, and of every pair the residuals of the documents
  that have both are summed; a sum of ``PAIR_SIGNIFICANT`` standard errors takes both in.

So rare words of single documents aren't learnt by heart.  Single weights start at the
additive model; the penalty of the factors is the one of ``PENALTIES`` with the least loss
on a fifth of the sample that is left out for that.  The machine is fitted on a bounded
sample of labelled documents and sent to the tasks (TERMS x (FACTORS + 1) numbers); every
document is scored as a whole.

Defined results: null or empty texts have no term and score sigmoid(w0); without usable
labels every score is 0; labelled rows that repeat a doc_id count once (the smaller
label), and so do documents that repeat one (the least list of terms); labels with nulls
are ignored; rows without a doc_id are scored and never learnt from.  Among equally strong
terms the lesser hash enters first.  A column ``score`` of the input is replaced if kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _features, _text
from ._cluster import cut
from .quality import remainder, sampled

DIM = 1 << 18
#: Labelled documents to learn from, at most: those with the least hash of doc_id.
SAMPLE = 20_000
TERMS, CANDIDATES = 1024, 2048
SIGNIFICANT, PAIR_SIGNIFICANT = 4.0, 6.0
LEAST_DOCUMENTS = 5
FACTORS = 8
STEPS = 300
RATE = 0.05
#: Penalty of single weights, and those of factors to choose from.
SHRINK, PENALTIES = 1e-5, (1e-3, 1e-4, 1e-5)
THRESHOLD = 0.3
#: Documents that the driver's arithmetic takes at once.
BLOCK = 2048


@dataclass
class Machine:
    slot: np.ndarray  # of each hashed term its place in the machine, or -1
    w0: float
    w: np.ndarray
    v: np.ndarray


def selected(c: _text.Chunk, slot: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(row pointers, places) of the different machine terms of each text."""
    rows, hashed = _features.stem_terms(c, DIM)
    place = slot[hashed]
    got = place >= 0
    keys = np.unique(rows[got] * terms + place[got])
    return np.searchsorted(keys, np.arange(len(c) + 1) * terms), (keys % terms).astype(np.int64)


def _sums(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[pointers[1:]] - total[pointers[:-1]]


def raw(pointers: np.ndarray, places: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value before the sigmoid, and the factor sums of each text."""
    own = v[places]
    s = _sums(own, pointers)
    return w0 + _sums(w[places], pointers) + 0.5 * ((s * s).sum(1) - _sums((own * own).sum(1), pointers)), s


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, start: tuple[float, np.ndarray], penalty: float | None, steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """Full-batch Adam on the logistic loss with quadratic penalties over rows ``x`` of 0 and 1; no ``penalty``: no factors."""
    terms = x.shape[1]
    v = np.zeros((terms, 0)) if penalty is None else np.random.default_rng(3).normal(0, 0.1, (terms, FACTORS))
    params = [np.array([start[0]]), np.array(start[1], float), v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        grads = [np.zeros_like(p) for p in params]
        # one product a block: the sums of factors, of their squares, and of single weights
        right = np.concatenate([params[2], (params[2] ** 2).sum(1, keepdims=True), params[1][:, None]], 1).astype(np.float32)
        for i in range(0, len(y), BLOCK):
            rows = x[i : i + BLOCK]
            both = rows @ right
            s = both[:, :-2]
            z = params[0] + both[:, -1] + 0.5 * ((s * s).sum(1) - both[:, -2])
            g = ((sigmoid(z) - y[i : i + BLOCK]) / len(y)).astype(np.float32)
            back = rows.T @ np.concatenate([g[:, None], g[:, None] * s], 1)
            grads[0] += g.sum()
            grads[1] += back[:, 0]
            grads[2] += back[:, 1:] - back[:, :1] * params[2]
        grads[1] += SHRINK * params[1]
        grads[2] += (penalty or 0.0) * params[2]
        for k, d in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def dense_raw(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``raw`` over rows of 0 and 1."""
    s = x @ v.astype(np.float32)
    return w0 + x @ w.astype(np.float32) + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1).astype(np.float32))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean()) if len(y) else 0.0


def log_odds(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Where the additive model starts: the prior, and of each term the difference that it makes."""
    base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    n, k = x.sum(0, dtype=np.float64), x.T @ y.astype(np.float32)
    odds = np.log((k + 0.5) / (n - k + 0.5)) - np.log(base / (1 - base))
    return float(np.log(base / (1 - base))), np.where(n > 0, np.clip(odds, -4, 4), 0)


def pair_strength(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For every two columns the summed residuals of the rows that have both, in standard errors.

    0 for pairs in too few rows, and where one column all but implies the other, so that their product says nothing new.
    """
    terms = x.shape[1]
    r, q, n = (np.zeros((terms, terms), np.float32) for _ in range(3))
    for i in range(0, len(y), BLOCK):
        rows = x[i : i + BLOCK].astype(np.float32)
        part = p[i : i + BLOCK]
        r += rows.T @ (rows * (y[i : i + BLOCK] - part).astype(np.float32)[:, None])
        q += rows.T @ (rows * np.maximum(part * (1 - part), 1e-3).astype(np.float32)[:, None])
        n += rows.T @ rows
    alone = np.diag(n).copy()
    open_ = (n >= LEAST_DOCUMENTS) & (n <= 0.95 * np.minimum(alone[:, None], alone[None, :]))
    return np.where(open_, r / np.sqrt(np.maximum(q, 1e-9)), 0)


def chosen(x: np.ndarray, y: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The columns that enter the machine: those of ``alone`` (in order of strength), then those of the strongest pairs."""
    start = log_odds(x[:, alone], y)
    w0, w, v = train(x[:, alone].astype(np.float32), y, start, None, 100)
    z = pair_strength(x, y, sigmoid(dense_raw(x[:, alone].astype(np.float32), w0, w, v)))
    a, b = np.nonzero(np.triu(np.abs(z) >= PAIR_SIGNIFICANT, 1))
    order = np.lexsort((b, a, -np.abs(z[a, b])))
    paired = np.stack([a[order], b[order]], 1).ravel()
    _, at = np.unique(paired, return_index=True)
    paired = paired[np.sort(at)][: TERMS // 2]  # half of the places at least are for pairs, if these fill them
    rest = alone[~np.isin(alone, paired)][: TERMS - len(paired)]
    return np.sort(np.concatenate([paired, rest]).astype(np.int64))


def machine(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights and factors for rows of 0 and 1; the penalty is chosen on every fifth row."""
    x = x.astype(np.float32)
    test = np.arange(len(y)) % 5 == 4
    penalty = PENALTIES[0]
    if test.any() and not test.all():
        start = log_odds(x[~test], y[~test])
        penalty = min(PENALTIES, key=lambda c: loss(dense_raw(x[test], *train(x[~test], y[~test], start, c, STEPS // 2)), y[test]))
    return train(x, y, log_odds(x, y), penalty)


def fit(df: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", size: int = SAMPLE) -> Machine | None:
    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _text.chunks(batch.column(1)):
                rows, hashed = _features.stem_terms(c, DIM)
                p, terms, _ = _features.sparse(rows, hashed, len(c), DIM)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[c.first : c.first + len(c)], batch.column(2)[c.first : c.first + len(c)], _features.lists(p, terms)],
                    names=["doc_id", "y", "terms"],
                )

    found = sampled(df, labels, label, learn, size).mapInArrow(terms_of, "doc_id long, y int, terms array<int>")
    found = cut(found.groupBy("doc_id").agg(F.min(F.struct("y", "terms")).alias("r")).select("doc_id", "r.*"))
    # at most ``size`` documents; their terms are counted on the executors
    n, pos = found.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n == 0:
        return None
    rate = min(max(pos / n, 1 / (n + 1)), n / (n + 1))
    seen = cut(found.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("k")).where(f"n >= {LEAST_DOCUMENTS}"))
    strength = f"abs(k - n * {rate}D) / sqrt(n * {rate * (1 - rate)}D)"
    strong = [r.term for r in seen.where(f"{strength} >= {SIGNIFICANT}").orderBy(F.expr(strength).desc(), "term").limit(TERMS).collect()]
    frequent = [r.term for r in seen.orderBy(F.expr(f"n * ({n}L - n)").desc(), "term").limit(CANDIDATES).collect()]
    terms = np.array(list(dict.fromkeys(strong + frequent))[:CANDIDATES], np.int64)
    slot = np.full(DIM, -1, np.int32)
    slot[terms] = np.arange(len(terms))
    sent = df.sparkSession.sparkContext.broadcast(slot)

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lens = np.diff(np.asarray(lists.offsets))
            place = sent.value[np.asarray(lists.flatten())]
            row = np.repeat(np.arange(len(lens)), lens)
            dense = np.zeros((len(lens), CANDIDATES), bool)
            dense[row[place >= 0], place[place >= 0]] = True
            packed = [x.tobytes() for x in np.packbits(dense, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "y", "bits"])

    # CANDIDATES bits for each of at most ``size`` documents; in order, so that fits agree
    rows = found.mapInArrow(bits_of, "doc_id long, y int, bits binary").toArrow().sort_by("doc_id").combine_chunks()
    y = rows["y"].to_numpy().astype(float)
    x = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(y), -1), axis=1)[:, : len(terms)]
    picked = chosen(x, y, np.arange(len(strong)))
    slot = np.full(DIM, -1, np.int32)
    slot[terms[picked]] = np.arange(len(picked))
    return Machine(slot, *machine(x[:, picked], y))


def score(df: DataFrame, machine: Machine | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and its ``score``."""
    own = df.select(*keep, F.col("text").cast("string").alias("__text"))
    if machine is None:
        return own.drop("__text").withColumn("score", F.lit(0.0))
    sent = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [np.zeros(0)]
            for c in _text.chunks(batch.column(batch.num_columns - 1)):
                got.append(sigmoid(raw(*selected(c, m.slot, len(m.w)), m.w0, m.w, m.v)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(got))], names=[*keep, "score"])

    return own.mapInArrow(run, own.drop("__text").withColumn("score", F.lit(0.0)).schema)


def digest(df: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    machine = fit(df, labels, remainder("doc_id", parts) != held)
    out = score(df, machine, ["doc_id"])
    return out.select(F.col("doc_id").cast("long"), (remainder("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
