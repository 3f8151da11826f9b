"""Scoring of detectors against annotations."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import iou
from ..functions.text import normal_value

SPAN = "array<struct<start:int,end:int,pii_type:string>>"


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def metrics(df: DataFrame) -> DataFrame:
    """Adds support, precision, recall and f1 to tp, fp, fn; a zero denominator gives 0."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = df.withColumns({"support": F.col("tp") + F.col("fn"), "precision": p, "recall": r})
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(counts: DataFrame, overall: str = "OVERALL") -> DataFrame:
    """tp, fp, fn and metrics for each pii_type and for all, from counts with those columns."""
    rows = counts.rollup("pii_type").agg(F.grouping("pii_type").alias("g"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return metrics(rows.select(F.when(F.col("g") == 1, F.lit(overall)).otherwise(F.col("pii_type")).alias("pii_type"), "tp", "fp", "fn"))


def _islands(detected: DataFrame, gold: DataFrame, ratio: float) -> DataFrame:
    """``document_id, pii_type, d, g``: the spans of both sides, in order of ``ord``, that reach one another by overlaps.

    Only spans of one type that overlap can be matched, so islands are independent, however long a document is.
    """
    side = lambda df, name: df.select("document_id", "pii_type", "start", "end", "ord", F.lit(name).alias("side"))
    w = Window.partitionBy("document_id", "pii_type").orderBy("start", "end", "side", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(False)) if ratio > 0 else F.lit(False)  # at 0 all spans match
    rows = side(detected, "d").unionByName(side(gold, "g")).withColumn("apart", apart.cast("int"))
    rows = rows.withColumn("island", F.sum("apart").over(w))

    def own(name: str):
        cells = F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct("ord", "start", "end", "pii_type"))))
        return F.transform(cells, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pii_type"].alias("pii_type"))).cast(SPAN).alias(name)

    return rows.groupBy("document_id", "pii_type", "island").agg(own("d"), own("g"))


def span_counts(detected: DataFrame, gold: DataFrame, ratio: float = 0.5) -> DataFrame:
    """tp, fp, fn a document and type: greedy one to one, best IoU first, ties to the highest places."""
    rows = _islands(detected, gold, ratio)
    pairs = F.flatten(F.transform("d", lambda x, i: F.transform("g", lambda y, j: F.struct(F.when(x["pii_type"] == y["pii_type"], iou(x, y)).otherwise(-1.0).alias("v"), i.alias("i"), j.alias("j")))))
    best = F.sort_array(F.filter(pairs, lambda z: z["v"] >= ratio), asc=False)
    ints = F.array().cast("array<int>")

    def step(acc: Column, z: Column) -> Column:
        free = ~F.array_contains(acc["i"], z["i"]) & ~F.array_contains(acc["j"], z["j"])
        return F.when(free, F.struct(F.array_append(acc["i"], z["i"]).cast("array<int>").alias("i"), F.array_append(acc["j"], z["j"]).cast("array<int>").alias("j"))).otherwise(acc)

    hits = F.aggregate(best, F.struct(ints.alias("i"), ints.alias("j")), step, lambda acc: F.size(acc["i"]))
    counts = rows.select("document_id", "pii_type", F.size("d").alias("nd"), F.size("g").alias("ng"), hits.alias("tp"))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return counts.groupBy("document_id", "pii_type").agg(total("tp", "tp"), total(F.col("nd") - F.col("tp"), "fp"), total(F.col("ng") - F.col("tp"), "fn"))


def _multisets(detected: DataFrame, gold: DataFrame, keys: list[str], how: str) -> DataFrame:
    d = detected.groupBy(*keys).agg(F.count("*").alias("nd"))
    g = gold.groupBy(*keys).agg(F.count("*").alias("ng"))
    both = d.join(g, keys, how).na.fill(0, ["nd", "ng"])
    same = F.least("nd", "ng")
    return both.select(*keys, same.alias("tp"), (F.col("nd") - same).alias("fp"), (F.col("ng") - same).alias("fn"))


def value_counts(detected: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn by multiset of (document, type, normalized value): ``document_id, pii_type, value``."""
    norm = lambda df: df.select("document_id", "pii_type", normal_value("value").alias("value"))
    return _multisets(norm(detected), norm(gold), ["document_id", "pii_type", "value"], "full")


def type_counts(registry: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn by multiset of types, over the documents of ``gold`` only (those without a type included)."""
    docs = gold.select("document_id").distinct()
    own = registry.join(docs, "document_id", "left_semi").select("document_id", "pii_type")
    return _multisets(own, gold.where("pii_type is not null").select("document_id", "pii_type"), ["document_id", "pii_type"], "full")


def mapper_counts(cases: DataFrame) -> DataFrame:
    """Micro tp, fp, fn of ``cases(got, expected)`` as sets."""
    got, exp = F.array_distinct("got"), F.array_distinct("expected")
    out = cases.select(F.size(F.array_intersect(got, exp)).alias("tp"), F.size(F.array_except(got, exp)).alias("fp"), F.size(F.array_except(exp, got)).alias("fn"))
    return metrics(out.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]))


def extraction_tax(clean: DataFrame, extracted: DataFrame, gold: DataFrame) -> DataFrame:
    """F1 on clean text, on extracted text, and the difference; both value by value."""
    one = lambda d, name: report(value_counts(d, gold)).where("pii_type = 'OVERALL'").select(F.col("f1").alias(name))
    return one(clean, "f1_clean").crossJoin(one(extracted, "f1_extracted")).withColumn("tax", F.col("f1_clean") - F.col("f1_extracted"))


def handling(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents that should be in the registry and aren't (missing), or are and shouldn't (unexpected)."""
    seen = registry.select("document_id").distinct()
    due = manifest.where("expectation = 'scannable'").select("document_id")
    missing = due.join(seen, "document_id", "left_anti").select("document_id", F.lit("missing").alias("fault"))
    return missing.unionByName(seen.join(due, "document_id", "left_anti").select("document_id", F.lit("unexpected").alias("fault")))


def retention_check(expected: DataFrame, overdue: DataFrame) -> DataFrame:
    """Expected prefixes without an overdue document (silent), and overdue documents under no expected prefix (unexpected)."""
    pairs = overdue.select("document_id").join(F.broadcast(expected.select("prefix")), F.expr("prefix = '' or startswith(document_id, prefix || '/')"), "left")
    silent = expected.select("prefix").join(pairs.select("prefix").distinct(), "prefix", "left_anti").select(F.col("prefix").alias("what"), F.lit("silent").alias("fault"))
    return silent.unionByName(pairs.where("prefix is null").select(F.col("document_id").alias("what"), F.lit("unexpected").alias("fault")))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``key, n``: places 0, 1, ... in the order of ``key``.

    A range-partitioned sort; the only thing brought together is a count a partition.
    """
    rows = df.select(key).orderBy(key).select(key, F.monotonically_increasing_id().alias("id")).withColumn("part", F.shiftright("id", 33))
    offsets = rows.groupBy("part").agg(F.count("*").alias("c")).select("part", F.expr("coalesce(sum(c) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    return rows.join(F.broadcast(offsets), "part").select(key, (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("n"))


def sample_documents(df: DataFrame, size: int, seed: int = 42, key: str = "document_id") -> DataFrame:
    """A reproducible draw of ``size`` documents: places are drawn on the driver, ids stay where they are."""
    if size <= 0:
        raise ValueError("size must be positive")
    total = df.count()
    if size >= total:
        return df
    picked = df.sparkSession.createDataFrame([(i,) for i in sorted(random.Random(seed).sample(range(total), size))], "n long")
    return df.join(numbered(df, key).join(picked, "n", "left_semi").select(key), key, "left_semi")


def benchmark(runs: dict[str, tuple[DataFrame, float, float | None]], gold: DataFrame, documents: int) -> DataFrame:
    """A row a configuration: label, metrics over all, seconds and watt-hours a document."""
    out = None
    for label, (detected, seconds, energy) in runs.items():
        row = report(span_counts(detected, gold)).where("pii_type = 'OVERALL'").select(
            F.lit(label).alias("label"), "precision", "recall", "f1", F.lit(seconds / documents).alias("s_doc"), F.lit(None if energy is None else energy / documents).cast("double").alias("wh_doc"))
        out = row if out is None else out.unionByName(row)
    return out
