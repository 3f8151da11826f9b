"""Declared against detected: verdicts over all documents at once.

Inputs: ``documents(document_id, activity_ids, reference_date)``, ``instances(document_id,
id, pii_type)``, and the register as ``activities(id)``, ``macros`` and ``categories``.
All comparisons are set-wise joins on activity or document; the register is the smaller
side and joins by activity id, documents are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_months

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def associations(documents: DataFrame) -> DataFrame:
    """``document_id, pos, activity_id``."""
    return documents.select("document_id", F.posexplode("activity_ids").alias("pos", "activity_id"))


def unknown_activities(documents: DataFrame, activities: DataFrame) -> DataFrame:
    """``document_id, unknown_activity_ids`` in order of association."""
    lost = associations(documents).join(activities.select(F.col("id").alias("activity_id")), "activity_id", "left_anti")
    rows = F.array_sort(F.collect_list(F.struct("pos", "activity_id")))
    return lost.groupBy("document_id").agg(F.transform(rows, lambda x: x["activity_id"]).alias("unknown_activity_ids"))


def live_categories(macros: DataFrame, categories: DataFrame, include_proposed: bool) -> DataFrame:
    """Categories with their activity and retention; proposed ones only if asked for."""
    own = categories if include_proposed else categories.where("mapping_state = 'confirmed'")
    m = macros.select(F.col("id").alias("macro_category_id"), "activity_id", F.col("raw_text").alias("macro_text"), "retention_months", F.col("position").alias("macro_position"))
    return own.select(F.col("id").alias("category_id"), "macro_category_id", F.col("raw_text").alias("category_text"), "pii_types", F.col("position").alias("category_position")).join(m, "macro_category_id")


def declared_types(macros: DataFrame, categories: DataFrame, include_proposed: bool = False) -> DataFrame:
    """``activity_id, declared`` (sorted set)."""
    rows = live_categories(macros, categories, include_proposed)
    return rows.groupBy("activity_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pii_types")))).alias("declared"))


def detected_types(instances: DataFrame) -> DataFrame:
    return instances.groupBy("document_id").agg(F.array_sort(F.collect_set("pii_type")).alias("detected"))


def type_sets(documents: DataFrame, instances: DataFrame, macros: DataFrame, categories: DataFrame, include_proposed: bool = False) -> DataFrame:
    """``document_id, orphan, covered, missing`` (sorted) of documents with an association."""
    d = associations(documents).join(declared_types(macros, categories, include_proposed), "activity_id", "left")
    d = d.groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list("declared"))).alias("declared"))
    rows = d.join(detected_types(instances), "document_id", "left").select("document_id", F.coalesce("declared", _none()).alias("s"), F.coalesce("detected", _none()).alias("t"))
    return rows.select(
        "document_id",
        F.array_sort(F.array_except("t", "s")).alias("orphan"),
        F.array_sort(F.array_intersect("t", "s")).alias("covered"),
        F.array_sort(F.array_except("s", "t")).alias("missing"),
    )


def unresolved(documents: DataFrame, macros: DataFrame, categories: DataFrame, include_proposed: bool = False) -> DataFrame:
    """``document_id, unresolved``: wordings declared without a type, in the order of associations and sheets, repeats kept."""
    rows = live_categories(macros, categories, include_proposed).where("size(pii_types) = 0")
    each = associations(documents).join(rows, "activity_id")
    listed = F.array_sort(F.collect_list(F.struct("pos", "macro_position", "category_position", "category_text")))
    return each.groupBy("document_id").agg(F.transform(listed, lambda x: x["category_text"]).alias("unresolved"))


def coverage(documents: DataFrame, instances: DataFrame, macros: DataFrame, categories: DataFrame, include_proposed: bool = False) -> DataFrame:
    """``document_id, id, activity_id``: the first associated activity that declares the instance's type, or null."""
    declares = declared_types(macros, categories, include_proposed).select("activity_id", F.explode("declared").alias("pii_type"))
    first = associations(documents).join(declares, "activity_id").groupBy("document_id", "pii_type").agg(F.min_by("activity_id", "pos").alias("activity_id"))
    own = instances.select("document_id", "id", "pii_type").join(documents.where("size(activity_ids) > 0").select("document_id"), "document_id", "left_semi")
    return own.join(first, ["document_id", "pii_type"], "left").select("document_id", "id", "activity_id")


def retention(documents: DataFrame, instances: DataFrame, macros: DataFrame, categories: DataFrame, now: Column, include_proposed: bool = False) -> DataFrame:
    """One row a macro category that a document holds data of: with ``flag`` (kept too long) or ``unverifiable`` (no months declared)."""
    rows = live_categories(macros, categories, include_proposed)
    m = rows.groupBy("activity_id", "macro_category_id", "macro_position", F.col("macro_text").alias("category"), "retention_months").agg(F.array_distinct(F.flatten(F.collect_list("pii_types"))).alias("types"))
    docs = documents.select("document_id", age_months(F.col("reference_date"), now).alias("age_months"))
    held = associations(documents).join(m, "activity_id").join(detected_types(instances), "document_id").join(docs, "document_id")
    held = held.withColumn("pii_types", F.array_sort(F.array_intersect("types", "detected"))).where("size(pii_types) > 0")
    flag = F.coalesce(F.col("age_months") > F.col("retention_months"), F.lit(False))
    out = held.withColumn("flag", flag).withColumn("unverifiable", F.col("retention_months").isNull()).where("flag or unverifiable")
    return out.select("document_id", "pos", "activity_id", "macro_category_id", "macro_position", "category", "retention_months", "age_months", "pii_types", (F.col("age_months") - F.col("retention_months")).alias("overdue_months"), "flag", "unverifiable")


def report(documents: DataFrame, instances: DataFrame, activities: DataFrame, macros: DataFrame, categories: DataFrame, now: Column, include_proposed: bool = False) -> DataFrame:
    """One verdict a document with an association."""
    kept = retention(documents, instances, macros, categories, now, include_proposed)
    flag = F.struct("activity_id", "category", "retention_months", "age_months", "pii_types", "overdue_months")
    order = F.array_sort(F.collect_list(F.struct("pos", "macro_position", flag.alias("f"))))
    flags = kept.where("flag").groupBy("document_id").agg(F.transform(order, lambda x: x["f"]).alias("retention_flags"))
    names = F.array_sort(F.collect_list(F.struct("pos", "macro_position", "category")))
    loose = kept.where("unverifiable").groupBy("document_id").agg(F.transform(names, lambda x: x["category"]).alias("retention_unresolved"))
    out = type_sets(documents, instances, macros, categories, include_proposed)
    for part in (unknown_activities(documents, activities), unresolved(documents, macros, categories, include_proposed), flags, loose):
        out = out.join(part, "document_id", "left")
    for name in ("unknown_activity_ids", "unresolved", "retention_unresolved"):
        out = out.withColumn(name, F.coalesce(name, _none()))
    n = F.coalesce(F.size(F.when(F.col("retention_flags").isNotNull(), F.col("retention_flags"))), F.lit(0))
    n = F.when(F.col("retention_flags").isNull(), 0).otherwise(n)
    worst = F.coalesce(F.array_max(F.transform("retention_flags", lambda f: f["overdue_months"])), F.lit(0))
    return out.withColumn("n_flags", n).withColumn("worst_overdue_months", worst).withColumn("compliant", (F.size("orphan") == 0) & (F.col("n_flags") == 0))


def overview(documents: DataFrame, instances: DataFrame, activities: DataFrame, macros: DataFrame, categories: DataFrame, now: Column, include_proposed: bool = True) -> DataFrame:
    """Retention over the corpus: documents with a flag or something unverifiable, worst first."""
    rows = report(documents, instances, activities, macros, categories, now, include_proposed)
    rows = rows.where("n_flags > 0 or size(retention_unresolved) > 0")
    return rows.select("document_id", "n_flags", "worst_overdue_months", "retention_unresolved").orderBy(F.desc("worst_overdue_months"), "document_id")


def breach_share(overview_rows: DataFrame) -> DataFrame:
    return overview_rows.agg(F.count_if(F.col("n_flags") > 0).alias("breaches"), F.count("*").alias("rows"))


def check_document(document_id: str, documents: DataFrame, instances: DataFrame, activities: DataFrame, macros: DataFrame, categories: DataFrame, now: Column, include_proposed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(report, coverage) of one document; unknown documents and documents without an association are errors."""
    one = documents.where(F.col("document_id") == document_id)
    found = one.select("activity_ids").first()
    if found is None:
        raise KeyError(document_id)
    if not found[0]:
        raise ValueError(f"{document_id!r} has no activity")
    own = instances.where(F.col("document_id") == document_id)
    return report(one, own, activities, macros, categories, now, include_proposed), coverage(one, own, macros, categories, include_proposed)
