"""Folder rules: documents to activities by path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_prefix(prefix: Column) -> Column:
    """Blanks and slashes at both ends removed; the empty prefix is the root."""
    return F.regexp_replace(F.regexp_replace(prefix, r"(?U)\A\s+|\s+\z", ""), r"\A/+|/+\z", "")


def ancestors(document_id: Column) -> Column:
    """The prefixes that match a path: the root, every directory above it, the path itself."""
    parts = F.split(document_id, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), steps))


def matches(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """``document_id, prefix, activity_ids`` of every rule that matches: ancestors exploded, so an equi-join."""
    each = documents.select("document_id", F.explode(ancestors(F.col("document_id"))).alias("prefix"))
    return each.join(rules.select(normal_prefix(F.col("prefix")).alias("prefix"), "activity_ids"), "prefix")


def inherited(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """``document_id, activity_ids``: of all matching rules in order of prefix, first seen first."""
    rows = F.array_sort(F.collect_list(F.struct("prefix", "activity_ids")))
    return matches(documents, rules).groupBy("document_id").agg(F.array_distinct(F.flatten(F.transform(rows, lambda x: x["activity_ids"]))).alias("activity_ids"))


def reconcile(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents with new ``activity_ids, association_source`` and ``outcome``.

    Manual associations stay; a match makes a rule association; a rule association without a match is cleared.
    """
    own = F.coalesce("activity_ids", F.array().cast("array<string>"))
    rows = documents.withColumn("activity_ids", own).join(inherited(documents, rules).withColumnRenamed("activity_ids", "__new"), "document_id", "left")
    manual, hit = F.coalesce(F.col("association_source") == "manual", F.lit(False)), F.col("__new").isNotNull()
    lapsed = F.coalesce(F.col("association_source") == "rule", F.lit(False))
    outcome = F.when(manual, "skipped_manual").when(hit, "associated").when(lapsed, "cleared").otherwise("unmatched")
    out = rows.withColumn("outcome", outcome)
    ids = F.when(F.col("outcome") == "associated", F.col("__new")).when(F.col("outcome") == "cleared", F.array().cast("array<string>")).otherwise(F.col("activity_ids"))
    source = F.when(F.col("outcome") == "associated", F.lit("rule")).when(F.col("outcome") == "cleared", F.lit(None)).otherwise(F.col("association_source"))
    return out.withColumn("activity_ids", ids).withColumn("association_source", source).drop("__new")


def outcome_counts(reconciled: DataFrame) -> DataFrame:
    names = ("associated", "skipped_manual", "cleared", "unmatched")
    return reconciled.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def rule_counts(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """How many documents each rule matches, rules without any included."""
    n = matches(documents, rules).groupBy("prefix").agg(F.count("*").alias("documents"))
    return rules.select(normal_prefix(F.col("prefix")).alias("prefix")).join(n, "prefix", "left").na.fill(0, ["documents"]).orderBy("prefix")


def activity_names(rules: DataFrame, activities: DataFrame) -> DataFrame:
    """``prefix, names`` with the id where an activity is unknown."""
    each = rules.select("prefix", F.posexplode("activity_ids").alias("k", "id")).join(activities.select("id", "name"), "id", "left")
    rows = F.array_sort(F.collect_list(F.struct("k", F.coalesce("name", "id").alias("n"))))
    return each.groupBy("prefix").agg(F.transform(rows, lambda x: x["n"]).alias("names"))
