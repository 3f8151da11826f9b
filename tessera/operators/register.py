"""Register of processing activities: sheets to the three-level declared model, and edits of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.phrases import map_categories, retention_months
from ..functions.text import slug


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A\s+|\s+\z", "")


def _cell(k: int) -> Column:
    return _strip(F.get("cells", F.lit(k)))


def labelled(grids: DataFrame, label: str) -> DataFrame:
    """The second cell of the first row whose first cell is ``label``, a sheet: ``sheet, value``."""
    return grids.where(_cell(0) == label).groupBy("sheet").agg(F.min_by(_cell(1), "row_no").alias("value"))


def sections(grids: DataFrame) -> DataFrame:
    """Rows of the category section of ``grids(sheet, row_no, cells)``: after the first header to the first blank."""
    rows = grids.select("sheet", "row_no", _cell(0).alias("c0"), _cell(1).alias("c1"), _cell(2).alias("c2"))
    head = rows.where(F.col("c0") == config.SHEET_SECTION).groupBy("sheet").agg(F.min("row_no").alias("head"))
    after = rows.join(head, "sheet").where("row_no > head")
    stop = F.min(F.when(F.col("c0") == "", F.col("row_no"))).over(_by_sheet())
    return after.withColumn("stop", stop).where("stop is null or row_no < stop").select("sheet", "row_no", "c0", "c1", "c2")


def _by_sheet():
    from pyspark.sql import Window

    return Window.partitionBy("sheet")


def accepted_sheets(grids: DataFrame) -> DataFrame:
    """``sheet, id, name, purpose`` of the sheets that describe an activity: with a name and a section."""
    name = labelled(grids, config.SHEET_NAME_LABEL).where("value <> ''").select("sheet", F.col("value").alias("name"))
    purpose = labelled(grids, config.SHEET_PURPOSE_LABEL).select("sheet", F.col("value").alias("purpose"))
    has = grids.where(_cell(0) == config.SHEET_SECTION).select("sheet").distinct()
    out = name.join(has, "sheet", "left_semi").join(purpose, "sheet", "left")
    return out.select("sheet", slug("name").alias("id"), "name", F.coalesce("purpose", F.lit("")).alias("purpose"))


def ingest(grids: DataFrame) -> dict[str, DataFrame]:
    """Activities, macro categories and proposed categories of a workbook's sheets; other sheets are skipped."""
    sheets = accepted_sheets(grids)
    rows = sections(grids).join(sheets.select("sheet", "id"), "sheet")
    # ids follow the content, not a counter: reruns agree and no row waits for another
    key = F.xxhash64("id", "row_no")
    macro = rows.select(key.alias("id"), F.col("id").alias("activity_id"), F.col("c0").alias("raw_text"), F.col("c2").alias("retention_text"), retention_months("c2").alias("retention_months"), F.col("row_no").cast("int").alias("position"), "c1")
    categories = macro.select(F.xxhash64("id", F.lit(0)).alias("id"), F.col("id").alias("macro_category_id"), F.col("c1").alias("raw_text"), F.array().cast("array<string>").alias("pii_types"), F.lit("proposed").alias("mapping_state"), F.array().cast("array<int>").alias("position"))
    return {"activities": sheets.select("id", "name", "purpose"), "macros": macro.drop("c1"), "categories": categories}


def save(old: DataFrame, new: DataFrame) -> DataFrame:
    """Appends activities; an id that exists already is an error."""
    clash = new.join(old.select("id"), "id", "left_semi").select("id").unionByName(new.groupBy("id").count().where("count > 1").select("id"))
    if (hit := clash.first()) is not None:
        raise ValueError(f"activity {hit[0]!r} exists already")
    return old.unionByName(new)


def map_pass(categories: DataFrame, table=None) -> DataFrame:
    """The dictionary pass: proposed categories without types become one row a part.

    Rows stay as they are if nothing was split or the only part is unknown; a second pass changes nothing.
    """
    parts = map_categories("raw_text", table)
    todo = (F.col("mapping_state") == "proposed") & (F.size("pii_types") == 0)
    rows = categories.withColumn("__p", F.when(todo, parts))
    same = F.col("__p").isNull() | (F.size("__p") == 0) | ((F.size("__p") == 1) & (F.size(F.element_at("__p", 1)["pii_types"]) == 0))
    old = rows.where(same).drop("__p")
    new = rows.where(~same).select("*", F.posexplode("__p").alias("__k", "__x"))
    made = new.select(F.xxhash64("id", F.col("__k") + 1).alias("id"), "macro_category_id", F.col("__x.text").alias("raw_text"), F.col("__x.pii_types").alias("pii_types"), F.lit("proposed").alias("mapping_state"), F.array_append("position", F.col("__k") + 1).alias("position"))
    return old.unionByName(made)


def mapped_count(categories: DataFrame, table=None) -> int:
    """How many rows a dictionary pass would replace."""
    gone = categories.select("id").join(map_pass(categories, table).select("id"), "id", "left_anti")
    return gone.count()


def _known(types: list[str]) -> None:
    if bad := [t for t in types if t not in config.catalog_ids()]:
        raise ValueError(f"unknown types {bad}")


def _has(categories: DataFrame, column: str, key: int) -> None:
    if categories.where(F.col(column) == key).limit(1).isEmpty():
        raise KeyError(key)


def update_category(categories: DataFrame, key: int, types: list[str], state: str = "confirmed") -> DataFrame:
    _known(types)
    _has(categories, "id", key)
    hit = F.col("id") == key
    new = F.array(*[F.lit(t) for t in types]).cast("array<string>")
    return categories.withColumn("pii_types", F.when(hit, new).otherwise(F.col("pii_types"))).withColumn("mapping_state", F.when(hit, F.lit(state)).otherwise(F.col("mapping_state")))


def split_category(categories: DataFrame, key: int, parts: list[tuple[str, list[str]]]) -> DataFrame:
    """Replaces one row by proposed rows."""
    for _, types in parts:
        _known(types)
    _has(categories, "id", key)
    spark = categories.sparkSession
    rows = spark.createDataFrame([(i + 1, t, ty) for i, (t, ty) in enumerate(parts)], "k int, t string, ty array<string>")
    one = categories.where(F.col("id") == key).crossJoin(F.broadcast(rows))  # the parts of one row
    made = one.select(F.xxhash64("id", "k").alias("id"), "macro_category_id", F.col("t").alias("raw_text"), F.col("ty").alias("pii_types"), F.lit("proposed").alias("mapping_state"), F.array_append("position", F.col("k")).alias("position"))
    return categories.where(F.col("id") != key).unionByName(made)


def confirm_macro(categories: DataFrame, macro_id: int) -> DataFrame:
    return categories.withColumn("mapping_state", F.when(F.col("macro_category_id") == macro_id, F.lit("confirmed")).otherwise(F.col("mapping_state")))


def llm_parts(texts: DataFrame, backend: Callable[[], Callable[[str], list[tuple[str, list[str]]]]]) -> DataFrame:
    """``text, parts`` by a model made on the executor; null where it fails; unknown types are dropped."""
    known = set(config.catalog_ids())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = backend()

        def one(t: str):
            try:
                return [{"text": p, "pii_types": [x for x in types if x in known]} for p, types in ask(t)]
            except Exception:  # the next mapper of the chain gets it
                return None

        for pdf in batches:
            yield pd.DataFrame({"text": pdf["text"], "parts": pdf["text"].map(one)})

    return texts.select("text").mapInPandas(run, "text string, parts array<struct<text:string,pii_types:array<string>>>")


def map_texts(texts: DataFrame, mapper: str = "dictionary", backend=None, table=None) -> DataFrame:
    """``text, parts``: by dictionary, by model, or hybrid (the model where it answers, else the dictionary)."""
    if mapper == "dictionary":
        return texts.select("text", map_categories("text", table).alias("parts"))
    if mapper not in ("llm", "hybrid") or backend is None:
        raise ValueError(f"no mapper {mapper!r}")
    answered = llm_parts(texts, backend)
    raw = F.array(F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("pii_types")))
    return answered.withColumn("parts", F.coalesce("parts", map_categories("text", table) if mapper == "hybrid" else raw))


def flat(activities: DataFrame, macros: DataFrame, categories: DataFrame) -> DataFrame:
    """The register as one table, a row a category (activities without any included)."""
    m = macros.select(F.col("id").alias("macro_category_id"), "activity_id", F.col("raw_text").alias("macro_text"), "retention_text", "retention_months")
    c = categories.select("macro_category_id", F.col("id").alias("category_id"), F.col("raw_text").alias("category_text"), "pii_types", "mapping_state")
    return activities.join(m, activities["id"] == m["activity_id"], "left").drop("activity_id").withColumnRenamed("id", "activity_id").join(c, "macro_category_id", "left")


def shortest_retention(macros: DataFrame) -> DataFrame:
    return macros.groupBy("activity_id").agg(F.min("retention_months").alias("retention_months"))


def declared_order(declared: DataFrame) -> DataFrame:
    """Different declared types of each activity in order of declaration, from ``declared(activity_id, ord, pii_types)``."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "pii_types")))
    return declared.groupBy("activity_id").agg(F.array_distinct(F.flatten(F.transform(rows, lambda x: x["pii_types"]))).alias("pii_types"))
