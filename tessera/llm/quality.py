"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become TF-IDF vectors of hashed words, word shapes and levels of repetition; the
inverse document frequencies are counted over all documents.  A bounded sample of
labelled documents gives the singular vectors; its projections, with labels, go to every
task (``SAMPLE`` x ``RANK`` floats, a proven bound).  Every document is projected, its
cosines with all labelled vectors are computed exactly in blocks, and the ``NEIGHBOURS``
nearest vote with the power ``SHARPNESS`` of their similarity.

Defined results: texts without words score the share of label 1 in the sample; without any
usable label every score is 0.5; labelled rows that repeat a doc_id count once (the
smaller label), and so do documents that repeat one (the least counts); labels with nulls are ignored; rows without a
doc_id are scored, and never learnt from; among equally near vectors at the last place of the vote it is open which one
votes (the same one in every run).  A column ``score`` of the input is replaced if kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _features, _text

DIM = 4096
RANK = 48
#: Labelled documents to learn from, at most: those with the least hash of doc_id.
SAMPLE = 5000
NEIGHBOURS = 21
SHARPNESS = 4.0
THRESHOLD = 0.3
#: Documents whose cosines are computed at once.
BLOCK = 256


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def remainder(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def tfidf(pointers: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, basis: np.ndarray | None, dim: int = DIM) -> np.ndarray:
    """Rows of unit length, dense or projected on ``basis`` (then scaled to unit length again)."""
    n = len(pointers) - 1
    values = ((1 + np.log(counts)) * idf[terms]).astype(np.float32)
    dense = np.zeros((n, dim), np.float32)
    dense[np.repeat(np.arange(n), np.diff(pointers)), terms] = values
    out = dense if basis is None else dense @ basis
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def document_counts(df: DataFrame, dim: int = DIM) -> np.ndarray:
    """In how many documents each hashed term stands, then the number of documents, over all rows of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)
        for batch in batches:
            for c in _text.chunks(batch.column(0)):
                total[:dim] += np.bincount(_features.surface_terms(c, dim)[1], minlength=dim)
                total[dim] += len(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(total)], names=["term", "n"])

    rows = df.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(dim + 1, np.int64)
    for r in rows:  # one row a term: dim + 1, whatever the input
        out[r.term] = r.n
    return out


def sampled(df: DataFrame, labels: DataFrame, label: str, learn: Column, size: int) -> DataFrame:
    """``doc_id, text, y`` of a bounded sample of the labelled documents; a repeated doc_id has all its rows."""
    y = labels.where(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    there = df.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    y = y.where(learn).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    own = df.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(y), F.col("__id") == F.col("doc_id")).select("doc_id", "text", "y")


def fit(df: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", size: int = SAMPLE) -> Model | None:
    counts = document_counts(df)
    idf = np.log((1 + counts[DIM]) / (1 + counts[:DIM])).astype(np.float32) + 0.1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _text.chunks(batch.column(1)):
                p, terms, n = _features.surface_terms(c, DIM)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[c.first : c.first + len(c)], batch.column(2)[c.first : c.first + len(c)], _features.lists(p, terms), _features.lists(p, n)],
                    names=["doc_id", "y", "terms", "counts"],
                )

    found = sampled(df, labels, label, learn, size).mapInArrow(run, "doc_id long, y int, terms array<int>, counts array<float>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("y", "terms", "counts")).alias("r")).select("doc_id", "r.*")
    # at most ``size`` documents with at most DIM terms each; ordered, so that fits agree
    table = found.toArrow().sort_by("doc_id").combine_chunks()
    if table.num_rows == 0:
        return None
    terms, n = table["terms"].combine_chunks(), table["counts"].combine_chunks()
    x = tfidf(np.asarray(terms.offsets) - terms.offsets[0].as_py(), np.asarray(terms.flatten()), np.asarray(n.flatten()), idf, None)
    rank = min(RANK, len(x))
    q = np.random.default_rng(5).standard_normal((DIM, rank + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ vt.T)[:, :rank])
    v = x @ basis
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    return Model(idf, basis, v, table["y"].to_numpy().astype(np.float32))


def vote(model: Model, v: np.ndarray) -> np.ndarray:
    """Scores of projected unit rows."""
    prior = float(model.labels.mean())
    out = np.full(len(v), prior)
    k = min(NEIGHBOURS, len(model.labels))
    for i in range(0, len(v), BLOCK):
        sims = v[i : i + BLOCK] @ model.vectors.T
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = w.sum(1)
        got = total > 0
        out[i : i + BLOCK][got] = (w * model.labels[near]).sum(1)[got] / total[got]
    return np.clip(out, 0, 1)


def score(df: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and its ``score``."""
    own = df.select(*keep, F.col("text").cast("string").alias("__text"))
    if model is None:
        return own.drop("__text").withColumn("score", F.lit(0.5))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [np.zeros(0)]
            for c in _text.chunks(batch.column(batch.num_columns - 1)):
                got.append(vote(m, tfidf(*_features.surface_terms(c, DIM), m.idf, m.basis)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(got))], names=[*keep, "score"])

    schema = own.drop("__text").withColumn("score", F.lit(0.0)).schema
    return own.mapInArrow(run, schema)


def digest(df: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    model = fit(df, labels, remainder("doc_id", parts) != held)
    out = score(df, model, ["doc_id"])
    return out.select(F.col("doc_id").cast("long"), (remainder("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(df: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    model = fit(df, labels, remainder("doc_id", parts) != held)
    own = df.select(F.struct(*df.columns).alias("__row"), "text")
    return score(own, model, ["__row"]).where(F.col("score") >= THRESHOLD).select("__row.*")
