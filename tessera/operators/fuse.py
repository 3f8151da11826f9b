"""Interval fusion of pattern, ner and language-model candidates.

The assignments are greedy and order-dependent, so they are folds over a document's
candidate arrays, not joins: everything of one document stays in one row, documents are
independent, and no shuffle is needed beyond bringing the candidates of a document together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import iou, overlaps
from ..functions.text import let
from ..schemas import CANDIDATE, MATCH, PROVENANCE


def _source(c: Column) -> Column:
    return F.struct(*[c[k].alias(k) for k in ("detector_id", "detector_kind", "pii_type", "confidence", "raw_label", "rationale")]).cast(PROVENANCE)


def _match(c: Column, level: Column, confidence: Column, sources: Column) -> Column:
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), c["pii_type"].alias("pii_type"), confidence.alias("confidence"), level.alias("level"), sources.alias("sources")).cast(MATCH)


def _single(c: Column, level: str) -> Column:
    return _match(c, F.lit(level), c["confidence"], F.array(_source(c)))


def _best(span: Column, among: Column, ratio: float, allowed=None) -> Column:
    """Index of the highest IoU at or over ``ratio``, lowest index on ties; null without one."""
    scored = F.transform(among, lambda y, j: F.struct((-iou(span, y)).alias("v"), j.alias("j")))
    fit = F.filter(scored, lambda z: (z["v"] <= -ratio) & (F.lit(True) if allowed is None else allowed(z["j"])))
    return F.array_min(fit)["j"]


def fuse(regex: Column, ner: Column, ai: Column | None = None, ratio: float = 0.5, bonus: float = 0.15) -> Column:
    """``array<match>`` from three ``array<candidate>`` of one document."""
    if not (0 <= ratio <= 1 and 0 <= bonus <= 1):
        raise ValueError("ratio and bonus must be in [0, 1]")
    none = F.array().cast(f"array<{CANDIDATE}>")
    r, n = F.coalesce(regex, none).cast(f"array<{CANDIDATE}>"), F.coalesce(ner, none).cast(f"array<{CANDIDATE}>")
    a = none if ai is None else F.coalesce(ai, none).cast(f"array<{CANDIDATE}>")
    ints = "array<int>"

    def pair(acc: Column, x: Column) -> Column:
        best = _best(x, n, ratio, lambda j: ~F.array_contains(acc["u"], j))
        return let(best, lambda b: F.struct(
            F.when(b.isNull(), acc["u"]).otherwise(F.array_append(acc["u"], b)).cast(ints).alias("u"),
            F.array_append(acc["p"], F.coalesce(b, F.lit(-1))).cast(ints).alias("p"),
        ))

    start = F.struct(F.array().cast(ints).alias("u"), F.array().cast(ints).alias("p"))
    paired = F.aggregate(r, start, pair)

    def one(x: Column, b: Column) -> Column:
        y = F.get(n, b)
        double = _match(x, F.lit("double_confirmed"), F.least(F.lit(1.0), F.greatest(x["confidence"], y["confidence"]) + bonus), F.array(_source(x), _source(y)))
        return (
            F.when(b < 0, F.array(_single(x, "single_source")))
            .when(x["pii_type"] == y["pii_type"], F.array(double))
            .otherwise(F.array(_single(x, "conflicting"), _single(y, "conflicting")))
        )

    def assemble(p: Column) -> Column:
        of_regex = F.flatten(F.zip_with(r, p["p"], one)).cast(f"array<{MATCH}>")
        free = F.filter(F.transform(n, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda z: ~F.array_contains(p["u"], z["j"]))
        return F.concat(of_regex, F.transform(free, lambda z: _single(z["y"], "single_source")).cast(f"array<{MATCH}>"))

    before = let(paired, assemble)
    if ai is None:
        return before

    def absorb(m: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            def act(b: Column) -> Column:
                y = F.get(acc, b)
                known = F.exists(y["sources"], lambda s: s["detector_id"] == x["detector_id"])
                level = F.when(y["level"] == "single_source", F.lit("double_confirmed")).otherwise(y["level"])
                confirmed = F.when(known, y).otherwise(_match(y, level, F.least(F.lit(1.0), y["confidence"] + bonus), F.array_append(y["sources"], _source(x))))
                demoted = _match(y, F.when(y["level"] == "single_source", F.lit("conflicting")).otherwise(y["level"]), y["confidence"], y["sources"])
                put = lambda v: F.transform(acc, lambda z, i: F.when(i == b, v).otherwise(z))
                return (
                    F.when(b.isNull(), F.array_append(acc, _single(x, "ai_discovered")))
                    .when(y["pii_type"] == x["pii_type"], put(confirmed))
                    .otherwise(F.array_append(put(demoted), _single(x, "conflicting")))
                    .cast(f"array<{MATCH}>")
                )

            # only what stood before the language model pass is a target
            return let(_best(x, F.slice(acc, F.lit(1), F.size(m)), ratio), act)

        return F.aggregate(a, m.cast(f"array<{MATCH}>"), step)

    return let(before, absorb)


def gather(candidates: DataFrame, name: str) -> DataFrame:
    """The candidates of each document as one ordered array."""
    fields = ["start", "end", "text", "pii_type", "confidence", "detector_id", "detector_kind", "raw_label", "rationale"]
    key = ["detector_no", "ord"] if "detector_no" in candidates.columns else ["ord"]
    rows = F.array_sort(F.collect_list(F.struct(*key, F.struct(*fields).cast(CANDIDATE).alias("c"))))
    return candidates.groupBy("document_id").agg(F.transform(rows, lambda x: x["c"]).alias(name))


def fused(regex: DataFrame, ner: DataFrame, ai: DataFrame | None = None, ratio: float = 0.5, bonus: float = 0.15) -> DataFrame:
    """``document_id, ord, match fields`` of three candidate tables."""
    rows = gather(regex, "r").join(gather(ner, "n"), "document_id", "full")
    if ai is not None:
        rows = rows.join(gather(ai, "a"), "document_id", "full")
    made = fuse(F.col("r"), F.col("n"), None if ai is None else F.col("a"), ratio, bonus)
    return rows.select("document_id", F.posexplode(made).alias("ord", "m")).select("document_id", "ord", "m.*")


def overlap_pairs(a: DataFrame, b: DataFrame, ratio: float = 0.0) -> DataFrame:
    """Pairs of candidates of one document that overlap with IoU >= ratio: an equi-join with a range condition."""
    x = a.select("document_id", F.struct("ord", "start", "end", "pii_type").alias("a"))
    y = b.select("document_id", F.struct("ord", "start", "end", "pii_type").alias("b"))
    out = x.join(y, "document_id").where(overlaps(F.col("a"), F.col("b"))).withColumn("iou", iou(F.col("a"), F.col("b")))
    return out.where(F.col("iou") >= ratio)


def ordered(matches: DataFrame) -> DataFrame:
    """Scan output: by document, start, then the order of detection."""
    return matches.orderBy("document_id", "start", "ord")
