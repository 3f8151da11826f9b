"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Three kinds of spans of a text are sparse TF-IDF vectors over words, compared with every
template: its lines, the text as a whole, whatever its length, and sliding windows of about
the templates' lengths over all its words, which find notices inside longer lines and texts
that are wrapped.  Document frequencies of the template words are counted over all files;
words that no template has only lengthen a vector.  The best template above ``COSINE``
(``WINDOW_COSINE``, ``SHORT_COSINE`` for windows) that shares two different words with the
span is the file's own licence.

Most spans aren't compared: the share of a vector's length that known words have bounds its
cosine with any template (Cauchy-Schwarz), and ``_may`` bounds that share from sums alone, so
that no span above the threshold is left out.

A file is a licence file of its directory if its name says so or if licence statements
make up ``SHARE`` of its words.  Files without a licence of their own inherit that of the
nearest directory on their path that has a licence file: directories are expanded into
their ancestors once, joined, and the deepest hit wins.

Defined results: null and empty texts have no own licence and may inherit; a null path has
no directory; several licence files in a directory: the highest share, then the least path
wins; equally near licences: the least name wins; repeated rows are scanned one by one.
Columns of the input named like those of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._cluster import cut
from .license_texts import TEMPLATES

COSINE = 0.6
SHARE = 0.1
#: Lengths of windows in words; of each template the longest that isn't longer.  A window moves by an eighth of its length.
WINDOWS = (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Least cosines of windows; the second for those under SHORT words, which a change of subject resembles too easily.
WINDOW_COSINE, SHORT_COSINE, SHORT = 0.75, 0.9, 12
#: Words of spans that are compared at once.
AT_ONCE = 1 << 19
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)(\..*|-.*)?$"


def _hashes(texts: list[str]) -> list[np.ndarray]:
    (c,) = _text.chunks(pa.array(texts), 1 << 30)
    buf = _text.lower_ascii(c.buf)
    starts, ends, first = _text.word_bounds(buf, c.offsets, letters=True)
    h = _text.span_hashes(buf, starts, ends)
    return [h[a:b] for a, b in zip(first, first[1:], strict=False)]


class Matcher:
    """The templates as unit rows over their own words."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        names = [(k, t) for k, v in sorted(templates.items()) for t in v]
        self.names = [k for k, _ in names]
        words = _hashes([t for _, t in names])
        self.windows = sorted({max((w for w in WINDOWS if w <= len(x)), default=len(x)) for x in words})
        self.vocabulary = np.unique(np.concatenate(words))
        self.counts = np.zeros((len(words), len(self.vocabulary)))
        for i, w in enumerate(words):
            np.add.at(self.counts[i], np.searchsorted(self.vocabulary, w), 1)

    def weigh(self, documents: np.ndarray, total: int) -> None:
        """Sets the weights from document frequencies of the vocabulary."""
        self.idf = np.log((1 + total) / (1 + documents)) + 1
        self.other = np.log(1 + total) + 1  # of words that no template has
        rows = np.where(self.counts > 0, 1 + np.log(np.maximum(self.counts, 1)), 0) * self.idf
        self.rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary place of each word, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def best(self, h: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, template) of the nearest template to each of these spans of words; 0 where none shares two words."""
        n, size = len(starts), len(self.vocabulary)
        lens = ends - starts
        span = np.repeat(np.arange(n), lens)
        at = np.repeat(starts, lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        p = place[at]
        known = p >= 0
        keys, times = np.unique(span[known] * size + p[known], return_counts=True)
        x = np.zeros((n, size))
        x[keys // size, keys % size] = (1 + np.log(times)) * self.idf[keys % size]
        order = np.lexsort((h[at[~known]], span[~known]))
        other, owner = h[at[~known]][order], span[~known][order]
        new = np.ones(len(other), bool)
        new[1:] = (other[1:] != other[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(other)))
        norm = np.sqrt((x * x).sum(1) + np.bincount(owner[first], ((1 + np.log(times)) * self.other) ** 2, minlength=n))
        sims = np.round(np.divide(x @ self.rows.T, norm[:, None], out=np.zeros((n, len(self.names))), where=norm[:, None] > 0), 9)
        sims[(x > 0).astype(np.float32) @ (self.counts > 0).T.astype(np.float32) < 2] = 0
        k = np.argmax(sims, axis=1)
        return sims[np.arange(n), k], k

    def scan(self, c: _text.Chunk) -> list[tuple[str, float, float] | None]:
        """For each text (licence, cosine, share of its words in licence statements), or None."""
        buf = _text.lower_ascii(c.buf)
        starts, ends, first = _text.word_bounds(buf, c.offsets, letters=True)
        found: list[tuple[str, float, float] | None] = [None] * len(c)
        if len(starts) == 0:
            return found
        h = _text.span_hashes(buf, starts, ends)
        place = self.places(h)
        # lines are numbered over the whole chunk; a text always opens a new one
        opens = np.zeros(len(buf) + 1, np.int64)
        opens[1:][buf == 10] = 1
        opens[c.offsets[:-1]] = 1
        line = np.flatnonzero(np.diff(np.cumsum(opens)[starts], prepend=-1))
        texts = np.flatnonzero(np.diff(first))
        spans = [(line, np.append(line[1:], len(h)), COSINE), (first[texts], first[texts + 1], COSINE)]
        own = _text.owners(first)
        for w in self.windows:
            step = max(1, w // 8)
            at = np.arange(0, max(len(h) - w + 1, 0))
            at = at[(at + w <= first[own[at] + 1]) & (((at - first[own[at]]) % step == 0) | (at + w == first[own[at] + 1]))]
            spans.append((at, at + w, SHORT_COSINE if w < SHORT else WINDOW_COSINE))
        weight = np.zeros(len(h) + 1)
        np.cumsum(np.where(place >= 0, self.idf[place] ** 2, 0), out=weight[1:])
        known = np.zeros(len(h) + 1, np.int64)
        np.cumsum(place >= 0, out=known[1:])
        hits: list[tuple[int, int, float, int]] = []
        for a, b, least in spans:
            may = self._may(weight[b] - weight[a], known[b] - known[a], b - a, least)
            a, b = a[may], b[may]
            part = np.cumsum(b - a) // AT_ONCE
            for k in np.unique(part).tolist():
                x, y = a[part == k], b[part == k]
                sims, name = self.best(h, place, x, y)
                for i in np.flatnonzero(sims >= least).tolist():
                    hits.append((int(x[i]), int(y[i]), float(sims[i]), int(name[i])))
        covered: dict[int, tuple[int, int]] = {}  # words in statements so far, and where they end
        for a, b, sim, k in sorted(hits):
            i = int(own[a])
            n, end = covered.get(i, (0, 0))
            covered[i] = n + max(0, b - max(a, end)), max(end, b)
            old = found[i]
            name = self.names[k]
            if old is None or (-sim, name) < (-old[1], old[0]):
                found[i] = (name, sim, 0.0)
        for i, (n, _) in covered.items():
            found[i] = (*found[i][:2], n / float(first[i + 1] - first[i]))
        return found

    def _may(self, weight: np.ndarray, known: np.ndarray, words: np.ndarray, least: float) -> np.ndarray:
        """Whether spans can reach the cosine, by the summed squared weights and the number of their known words.

        A cosine is at most the known part of the vector's length.  A word that stands c times weighs (1 + ln c) ** 2 <= 4 c / e
        times its square; u unknown words weigh at least as much as one word that stands u times.
        """
        other = words - known
        rest = np.where(other > 0, ((1 + np.log(np.maximum(other, 1))) * self.other) ** 2, 0)
        return (known >= 2) & (4 / np.e * weight >= least**2 / (1 - least**2) * rest * (1 - 1e-9))


def matcher(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Matcher:
    """Templates with the word weights of all ``files``."""
    m = Matcher(templates)
    size = len(m.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for c in _text.chunks(batch.column(0)):
                buf = _text.lower_ascii(c.buf)
                starts, ends, first = _text.word_bounds(buf, c.offsets, letters=True)
                place = m.places(_text.span_hashes(buf, starts, ends))
                keys = np.unique(_text.owners(first)[place >= 0] * size + place[place >= 0])
                total[:size] += np.bincount(keys % size, minlength=size)
                total[size] += len(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], names=["term", "n"])

    rows = files.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size + 1, np.int64)
    for r in rows:  # one row a template word, whatever the input
        counts[r.term] = r.n
    m.weigh(counts[:size], int(counts[size]))
    return m


def own(files: DataFrame, m: Matcher, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every file, ``own_license``, ``score`` and ``share``."""
    keep = [k for k in keep if k not in ("own_license", "score", "share")]
    sent = files.sparkSession.sparkContext.broadcast(m)  # some hundred words a template

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for c in _text.chunks(batch.column(batch.num_columns - 1)):
                found += sent.value.scan(c)
            name, score, share = zip(*(x or (None, 0.0, 0.0) for x in found), strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], names=[*keep, "own_license", "score", "share"])

    rows = files.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = rows.drop("__text").withColumns({"own_license": F.lit(None).cast("string"), "score": F.lit(0.0), "share": F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)


def scan(files: DataFrame, keep: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """For every row of ``files(path, text, ...)`` the columns ``keep``, path, own_license, score, inherited_from, license."""
    keep = [k for k in keep if k not in ("path", "own_license", "score", "share", "inherited_from", "license", "dir", "at", "granted")]
    rows = cut(own(files, matcher(files, templates), [*keep, "path"]))
    folder = F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), r"/+$", "")
    rows = rows.withColumn("dir", folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    grants = rows.where(F.col("own_license").isNotNull() & (name.rlike(FILE_NAME) | (F.col("share") >= SHARE)))
    grants = grants.groupBy("dir").agg(F.min(F.struct((-F.col("share")).alias("s"), "path", "own_license")).alias("g")).select(F.col("dir").alias("at"), F.col("g.own_license").alias("granted"))
    # every directory with its ancestors, the root being the empty string
    steps = F.expr("transform(sequence(0, size(split(dir, '/'))), n -> array_join(slice(split(dir, '/'), 1, n), '/'))")
    above = rows.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(steps)).alias("at"))
    nearest = above.join(grants, "at").groupBy("dir").agg(F.max_by(F.struct("at", "granted"), F.length("at")).alias("n")).select("dir", "n.at", "n.granted")
    out = rows.join(nearest, "dir", "left")
    mine = F.col("own_license").isNotNull()
    return out.select(*keep, "path", "own_license", "score", F.when(~mine, F.col("at")).alias("inherited_from"), F.coalesce("own_license", "granted").alias("license"))


def digest(df: DataFrame) -> DataFrame:
    """``documents`` as files ``source/lang/<doc_id div 50>/<doc_id>.txt``."""
    path = F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 50 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(df.select(F.col("doc_id").cast("long"), path.alias("path"), "text"), ["doc_id"])
