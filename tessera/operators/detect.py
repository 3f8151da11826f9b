"""Text to candidate spans: pattern rules, recognizer engine and language-model seams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx
from ..schemas import CANDIDATE

_COLUMNS = ["document_id", "ord", "start", "end", "text", "pii_type", "confidence", "detector_id", "detector_kind", "raw_label", "rationale"]


def candidate(start: Column, end: Column, text: Column, pii_type: Column, confidence: Column, detector_id: Column, kind: Column, raw_label: Column | None = None, rationale: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), pii_type.alias("pii_type"), confidence.cast("double").alias("confidence"),
        detector_id.alias("detector_id"), kind.alias("detector_kind"), (none if raw_label is None else raw_label).alias("raw_label"), (none if rationale is None else rationale).alias("rationale"),
    )


def rule_candidates(text: Column | str, rules: Iterable[config.Rule] = config.DEFAULT_RULES) -> Column:
    """``array<candidate>`` of all rules, rule by rule, each leftmost first: one expression, one scan of the table."""
    made = [_of_rule(text, r) if isinstance(text, str) else _rule(text, r) for r in rules]
    return F.concat(*made) if made else F.array().cast(f"array<{CANDIDATE}>")


def _rule(text: Column | str, r: config.Rule) -> Column:
    return F.transform(tx.spans(text, r.java, r.needs), lambda s: candidate(s["start"], s["end"], s["text"], F.lit(r.pii_type), F.lit(r.base_confidence), F.lit(f"regex.{r.rule_id}"), F.lit("regex")))


def _of_rule(text: str, r: config.Rule) -> Column:
    """A column is a description that any query can use; as making one takes hundreds of calls to the JVM, it is kept."""
    return _kept(text, r, id(SparkContext._gateway))


@lru_cache(maxsize=256)
def _kept(text: str, r: config.Rule, jvm: int) -> Column:
    return _rule(text, r)


def explode_candidates(df: DataFrame, column: str) -> DataFrame:
    """One row a candidate, with ``ord``: its place in the array, which later folds rely on."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(column).alias("ord", "__c")).select(*others, "ord", "__c.*")


def regex_detect(documents: DataFrame, rules: Iterable[config.Rule] = config.DEFAULT_RULES) -> DataFrame:
    """Candidates of ``documents(document_id, text)``."""
    return explode_candidates(documents.select("document_id", rule_candidates("text", rules).alias("c")), "c").select(*_COLUMNS)


def composite(*detected: DataFrame) -> DataFrame:
    """Concatenation of detectors in order, nothing removed; ``detector_no`` comes before ``ord``."""
    parts = [d.withColumn("detector_no", F.lit(i)) for i, d in enumerate(detected)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checked(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """The candidates, failing on spans that aren't inside their text or confidences outside [0, 1]."""
    lengths = documents.select("document_id", F.length("text").alias("__n"))
    ok = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("__n")) & F.col("confidence").between(0, 1)
    rows = candidates.join(lengths, "document_id")
    return rows.withColumn("start", F.when(ok, F.col("start")).otherwise(F.raise_error(F.concat(F.lit("bad span in "), "document_id")).cast("int"))).drop("__n")


#: What a recognition engine gives for a text: (start, end, entity, score, recognizer).
Engine = Callable[[str], list[tuple[int, int, str, float, str]]]


FOUND = "array<struct<start:int,end:int,entity:string,score:double,recognizer:string>>"


def engine_found(documents: DataFrame, engine: Callable[[], Engine]) -> DataFrame:
    """``documents(document_id, text)`` with ``found``, what the engine gives for the text.

    The engine is built on the executor and runs once a document; all that is made of its answer stays in the row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognize = engine()
        names = ("start", "end", "entity", "score", "recognizer")
        for pdf in batches:
            yield pdf.assign(found=[[dict(zip(names, r, strict=True)) for r in recognize(t or "")] for t in pdf["text"]])

    return documents.select("document_id", "text").mapInPandas(run, f"document_id string, text string, found {FOUND}")


def engine_half(text: Column | str, found: Column | str, ner: bool) -> Column:
    """``array<candidate>``: the pattern or the ner half of what an engine found; unmapped entities and empty spans go."""
    text, found = tx.as_column(text), tx.as_column(found)
    types = F.create_map(*[F.lit(x) for pair in config.ENTITY_MAP for x in pair])
    kind, who = ("ner", "presidio.ner") if ner else ("regex", "pattern.composite")
    kept = F.filter(found, lambda x: (x["recognizer"].isin(list(config.NER_RECOGNIZERS)) == F.lit(ner)) & (x["end"] > x["start"]) & F.try_element_at(types, x["entity"]).isNotNull())
    return F.transform(kept, lambda x: candidate(x["start"], x["end"], F.substring(text, x["start"] + 1, x["end"] - x["start"]), F.try_element_at(types, x["entity"]), x["score"], F.lit(who), F.lit(kind), x["entity"] if ner else None))


def gazetteer(terms: dict[str, tuple[str, ...]], score: float = 0.85) -> Callable[[], Engine]:
    """An engine that knows words by heart: entity -> words.  Stands in where no model is installed."""

    def build() -> Engine:
        import re

        pats = [(entity, re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")\b")) for entity, words in terms.items()]
        return lambda text: [(m.start(), m.end(), entity, score, "SpacyRecognizer") for entity, p in pats for m in p.finditer(text)]

    return build


PROMPT = "Find personal data in the text. Answer with a JSON array of objects with the keys value, pii_type, rationale; pii_type is one of: {types}. Quote every value exactly as it stands.\n\nText:\n{chunk}"

_ANSWER = "array<struct<value:variant,pii_type:variant,rationale:variant>>"


def windows(documents: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    return documents.select("document_id", F.explode(tx.windows("text", size, overlap)).alias("w")).select("document_id", "w.*")


def prompt(chunk: Column | str, types: tuple[str, ...] | None = None) -> Column:
    head, tail = PROMPT.replace("{types}", ", ".join(types or config.catalog_ids())).split("{chunk}")
    return F.concat(F.lit(head), tx.as_column(chunk), F.lit(tail))


def ask(chunks: DataFrame, backend: Callable[[], Callable[[str], str]], types: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``answer`` (null where the backend fails) to windows; one backend a partition, made on the executor."""
    rows = chunks.withColumn("prompt", prompt("chunk", types))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = backend()

        def one(p: str) -> str | None:
            try:
                return chat(p)
            except Exception:  # a window that fails is skipped and counted
                return None

        for pdf in batches:
            yield pdf.drop(columns="prompt").assign(answer=pdf["prompt"].map(one).astype(object))

    return rows.mapInPandas(run, chunks.withColumn("answer", F.lit(None).cast("string")).schema)


def parse_answers(answers: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``items`` (value, pii_type, rationale), null where a window's answer holds no valid array.

    The array is from the first bracket to the last; values must be non-empty strings and types known.
    """
    inner = F.regexp_extract("answer", r"(?s)\[.*\]", 0)
    made = F.try_parse_json(inner)
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    valid = F.schema_of_variant(made).startswith("ARRAY<OBJECT") | (F.trim(inner) == "[]")
    parsed = F.when(valid, F.from_json(inner, _ANSWER))
    items = F.transform(parsed, lambda x: F.struct(text(x["value"]).alias("value"), text(x["pii_type"]).alias("pii_type"), text(x["rationale"]).alias("rationale")))
    kept = F.filter(items, lambda x: F.coalesce((x["value"] != "") & x["pii_type"].isin(list(types or config.catalog_ids())), F.lit(False)))
    return answers.withColumn("items", kept)


def locate(answers: DataFrame, confidence: float = 0.6, detector_id: str = "ai.llm") -> DataFrame:
    """Candidates of parsed windows: every verbatim occurrence of a value, once a document and type."""
    rows = answers.select("document_id", "chunk_no", "offset", "chunk", F.posexplode("items").alias("item_no", "x"))
    at = rows.select("document_id", "chunk_no", "item_no", "x", F.explode(tx.occurrences("chunk", "x.value")).alias("k"), "offset")
    found = at.select("document_id", "chunk_no", "item_no", (F.col("offset") + F.col("k")).alias("start"), (F.col("offset") + F.col("k") + F.length("x.value")).alias("end"), "x")
    first = found.groupBy("document_id", "start", "end", F.col("x.pii_type").alias("pii_type")).agg(F.min(F.struct("chunk_no", "item_no", "x")).alias("f"))
    made = candidate(F.col("start"), F.col("end"), F.col("f.x.value"), F.col("pii_type"), F.lit(confidence), F.lit(detector_id), F.lit("ai"), None, F.col("f.x.rationale"))
    rank = F.expr("cast(row_number() over (partition by document_id order by f.chunk_no, f.item_no, start) - 1 as int)")
    return first.select("document_id", rank.alias("ord"), made.alias("c")).select("document_id", "ord", "c.*").select(*_COLUMNS)


def llm_detect(documents: DataFrame, backend: Callable[[], Callable[[str], str]], size: int = 2000, overlap: int = 200) -> DataFrame:
    return locate(parse_answers(ask(windows(documents, size, overlap), backend)))


def chunk_health(answers: DataFrame) -> DataFrame:
    """Windows seen and failed."""
    return parse_answers(answers).agg(F.count("*").alias("chunks_seen"), F.count_if(F.col("items").isNull()).alias("chunks_failed"))


def sampling_rate(raw: str | None) -> int:
    """The one-in-N rate from a setting: missing, malformed or negative is off."""
    try:
        return max(0, int(raw or ""))
    except ValueError:
        return 0


def token_cap(raw: str | None, default: int = 1024) -> int:
    try:
        value = int(raw or "")
    except ValueError:
        return default
    return value if value > 0 else default


def ai_sample(documents: DataFrame, rate: int) -> DataFrame:
    """The documents that get the language-model pass: all of rate 1, none of rate 0, else a stable 1 in ``rate``.

    Keyed by the unsigned 8-byte BLAKE2b of the id, for which there is no built-in: an Arrow-batched UDF over ids only.
    """
    if rate <= 0:
        return documents.limit(0)
    if rate == 1:
        return documents

    @F.pandas_udf("boolean")
    def chosen(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") % rate == 0)

    return documents.where(chosen("document_id"))
