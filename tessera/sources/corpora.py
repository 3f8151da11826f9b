"""Annotated corpora, gold and side files; their writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import annotated

GOLD = "document_id string, pii array<struct<pii_type:string,value:string>>"
MANIFEST = "document_id string, kind string, size_class string, format string, modified_at string, expectation string"
SOURCES = "document_id string, annotated string"

#: A small corpus of our own with every type.
PACKAGED = (
    ("sample_01", "Dear {{person_name:Anna Keller}}, write to {{email:anna.keller@example.org}} or call {{phone:+41 44 555 01 13}}."),
    ("sample_02", "Pay {{iban:CH93 0076 2011 6238 5295 7}} with {{credit_card:4111 1111 1111 1111}}; AVS {{swiss_avs:756.9217.0769.85}}, from {{ip_address:192.0.2.17}}."),
    ("sample_03", "{{person_name:Luca Bianchi}}, born {{date_of_birth:12.03.1980}}, {{italian_id:BNCLCU80C12F205Q}}, lives at {{address:Via Roma 10, Milano}}; diagnosis: {{health_data:asthma}}."),
)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one is an error that names it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select("value", place.alias("at"))
    wide = lines.where("trim(value) <> ''").select("at", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = wide.where("r is null or r._bad is not null or r.document_id is null").agg(F.min("at").alias("at")).first().at
    if bad is not None:
        # ids grow within a block of a file, and blocks by where they start; lines are counted only now
        before = (F.col("at.block") < bad.block) | ((F.col("at.block") == bad.block) & (F.col("at.id") < bad.id))
        n = lines.where((F.col("at.file") == bad.file) & before).count()
        raise ValueError(f"{path}, line {n + 1}: not a valid record")
    return wide.select("r.*").drop("_bad")


def load_dir(spark: SparkSession, path: str) -> DataFrame:
    """``*.txt`` of one directory by name: document_id (the stem), text, spans."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(path)
    rows = files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("document_id"), annotated("value").alias("a"))
    return rows.select("document_id", "a.text", "a.spans").orderBy("document_id")


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, SOURCES).select("document_id", annotated("annotated").alias("a")).select("document_id", "a.text", "a.spans")


def load_corpus(spark: SparkSession, source: str | None = None) -> DataFrame:
    """The packaged corpus, a directory, or a file of JSON lines."""
    if source is None:
        rows = spark.createDataFrame(list(PACKAGED), SOURCES)
        return rows.select("document_id", annotated("annotated").alias("a")).select("document_id", "a.text", "a.spans")
    if os.path.isdir(source):
        return load_dir(spark, source)
    if os.path.isfile(source):
        return load_jsonl(spark, source)
    raise FileNotFoundError(source)


def gold_spans(corpus: DataFrame) -> DataFrame:
    """``document_id, ord, start, end, pii_type``."""
    return corpus.select("document_id", F.posexplode("spans").alias("ord", "s")).select("document_id", "ord", "s.*")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, pii_type, value``; a document without findings has one row of nulls."""
    return _json(spark, path, GOLD).select("document_id", F.explode_outer("pii").alias("p")).select("document_id", "p.pii_type", "p.value")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, MANIFEST)


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, SOURCES)


def to_gold(corpus: DataFrame) -> DataFrame:
    """Gold records of an annotated corpus."""
    pii = F.transform("spans", lambda s: F.struct(s["pii_type"].alias("pii_type"), F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("value")))
    return corpus.select("document_id", pii.alias("pii"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with every character as it is."""
    df.write.mode("overwrite").json(path, encoding="UTF-8")
