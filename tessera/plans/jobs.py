"""The three entry points: folder scan, register ingestion, compliance; and text reports of small frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import dates
from ..functions import text as tx
from ..operators import comply, detect, freshness, fuse, register, registry, rules
from ..sources import files as fs

Backend = Callable[[], Callable[[str], str]]


def scan_documents(documents: DataFrame, pattern_rules: Iterable[config.Rule] = config.DEFAULT_RULES, engine: Callable[[], detect.Engine] | None = None, backend: Backend | None = None, ai_rate: int = 1) -> DataFrame:
    """``document_id, ord, match fields`` of ``documents(document_id, text)``.

    Patterns and the engine's halves are one row expression: no shuffle, and the engine runs
    once a document.  A backend adds the language-model pass over a sample.
    """
    none = F.array().cast(f"array<{detect.CANDIDATE}>")
    regex, ner = detect.rule_candidates("text", pattern_rules), none
    rows = documents
    if engine is not None:
        rows = detect.engine_found(documents, engine)
        regex = F.concat(regex, detect.engine_half("text", "found", ner=False))
        ner = detect.engine_half("text", "found", ner=True)
    if backend is None:
        made = fuse.fuse(regex, ner)
        return rows.select("document_id", F.posexplode(made).alias("ord", "m")).select("document_id", "ord", "m.*")
    ai = fuse.gather(detect.llm_detect(detect.ai_sample(documents, ai_rate), backend), "a")
    both = rows.select("document_id", regex.alias("r"), ner.alias("n")).join(ai, "document_id", "left")
    made = fuse.fuse(F.col("r"), F.col("n"), F.col("a"))
    return both.select("document_id", F.posexplode(made).alias("ord", "m")).select("document_id", "ord", "m.*")


def scan_text(spark: SparkSession, text: str, **options) -> DataFrame:
    """One document, in order of start."""
    return fuse.ordered(scan_documents(spark.createDataFrame([("document", text)], "document_id string, text string"), **options))


def scan_folder(store: registry.Store, folder: str, *, full: bool = False, prune: bool = True, apply_rules: bool = True, engine=None, backend: Backend | None = None, ai_rate: int = 0, config_dir: str | None = None, now: datetime | None = None) -> dict[str, object]:
    """Incremental scan of a folder into the registry; returns the counters and the inventory by type.

    Unchanged files are skipped (time, size, engine), a faulty file is an error of its own,
    files that have gone lose their findings and their stamp.
    """
    spark, now = store.spark, now or datetime.now(UTC)
    at = F.lit(now).cast("timestamp")
    sig = freshness.signature(["pattern.composite", *(["presidio.ner"] if engine else [])], config_dir, {"ai_rate": ai_rate if backend else 0})
    plan = fs.plan_folder(spark, folder).persist()
    documents, scans, instances = store.read("document"), store.read("scan"), store.read("instance")
    seen = plan.where("scannable")
    state = freshness.compare(seen, documents, sig).withColumn("todo", F.lit(True) if full else F.col("todo"))
    todo = state.where("todo").drop("todo", "scannable")
    read = fs.extract(fs.load(todo)).persist()
    good = read.where("error is null")
    matches = scan_documents(good.select("document_id", "text"), engine=engine, backend=backend, ai_rate=ai_rate or 1) if backend is None or ai_rate else scan_documents(good.select("document_id", "text"), engine=engine)
    ref = dates.reference_date(F.col("candidates"), F.col("mtime"), at)
    scanned = good.withColumn("r", ref).select("document_id", "path", F.col("r.value").alias("reference_date"), F.col("r.source").alias("reference_date_source"), F.col("mtime").alias("source_mtime"), F.col("size").alias("source_size"), F.lit(sig).alias("detector_signature"), at.alias("at"), F.lit(False).alias("clear_stamp"))
    removed = freshness.prune(seen, documents, instances) if prune else documents.select("document_id").limit(0)
    gone = removed.select("document_id", *[F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("reference_date", "timestamp"), ("reference_date_source", "string"), ("source_mtime", "timestamp"), ("source_size", "long"), ("detector_signature", "string"))], at.alias("at"), F.lit(True).alias("clear_stamp"))
    new = registry.record_scan(documents, scans, instances, scanned.unionByName(gone), matches.select("document_id", "ord", "pii_type", "start", "end", "confidence", "level", "sources"))
    docs = new["document"]
    if apply_rules:
        docs = rules.reconcile(docs, store.read("rule")).drop("outcome")
    counters = plan.agg(F.count_if(~F.col("scannable")).alias("skipped")).first().asDict()
    counters |= state.agg(F.count_if(~F.col("todo")).alias("unchanged")).first().asDict()
    counters |= read.agg(F.count_if(F.col("error").isNull()).alias("scanned"), F.count_if(F.col("error").isNotNull()).alias("errors")).first().asDict()
    counters["removed"] = removed.count()
    counters["ai_documents"] = detect.ai_sample(good.select("document_id"), ai_rate).count() if backend else 0
    counters["error_list"] = [(r.document_id, r.error) for r in read.where("error is not null").select("document_id", "error").orderBy("document_id").limit(1000).collect()]
    # instances first: a reader between the writes sees findings without a document, never a stamp without findings
    for table, rows in (("instance", new["instance"]), ("scan", new["scan"]), ("document", docs)):
        store.write(table, rows)
    counters["by_type"] = {r.pii_type: r.n for r in registry.inventory(store.read("instance"), seen).collect()}
    plan.unpersist()
    read.unpersist()
    return counters


def preview(store: registry.Store, folder: str) -> dict[str, int]:
    """What a scan would find: scannable and skipped files, unchanged ones."""
    plan = fs.plan_folder(store.spark, folder)
    seen = plan.where("scannable")
    counts = plan.agg(F.count_if("scannable").alias("scannable"), F.count_if(~F.col("scannable")).alias("skipped")).first().asDict()
    return counts | freshness.unchanged(seen, store.read("document")).first().asDict()


def ingest_register(store: registry.Store, workbooks: DataFrame, replace: bool = False, table=None) -> int:
    """Reads workbooks (document_id, content), maps their categories and stores the register; the number of activities."""
    made = register.ingest(fs.grids(workbooks).withColumn("sheet", F.concat_ws("/", "file", "sheet")))
    categories = register.map_pass(made["categories"], table)
    parts = {"activity": made["activities"], "macro": made["macros"], "category": categories}
    if not replace:
        parts["activity"] = register.save(store.read("activity"), parts["activity"])
        parts |= {t: store.read(t).unionByName(parts[t]) for t in ("macro", "category")}
    for t, rows in parts.items():
        store.write(t, rows)
    return store.read("activity").count()


def _tables(store: registry.Store) -> tuple[DataFrame, ...]:
    return tuple(store.read(t) for t in ("document", "instance", "activity", "macro", "category"))


def check(store: registry.Store, document_id: str, now: Column, include_proposed: bool = False, write: bool = False) -> DataFrame:
    """The verdict of one document; ``write`` stores which activity covers each instance."""
    verdict, covered = comply.check_document(document_id, *_tables(store), now, include_proposed)
    if write:
        store.write("instance", registry.apply_coverage(store.read("instance"), covered.select("id", "activity_id")))
    return verdict


def overview(store: registry.Store, now: Column, include_proposed: bool = True) -> DataFrame:
    return comply.overview(*_tables(store), now, include_proposed)


def format_table(df: DataFrame, widths: dict[str, int], limit: int = 1000) -> str:
    """A fixed-width text table of a small frame."""
    shown = df.select(*[tx.cell(F.coalesce(F.col(c).cast("string"), F.lit("-")), w).alias(c) for c, w in widths.items()])
    head = " ".join(c.ljust(w) for c, w in widths.items()).rstrip()
    return "\n".join([head, *(" ".join(v.ljust(w) for v, w in zip(r, widths.values(), strict=True)).rstrip() for r in shown.limit(limit).collect())])


def format_matches(matches: DataFrame) -> str:
    span = F.concat(F.lit("["), F.col("start"), F.lit(","), F.col("end"), F.lit(")"))
    return format_table(fuse.ordered(matches).select(span.alias("span"), "pii_type", "level", F.format_number("confidence", 2).alias("conf"), F.col("text").alias("value")), {"span": 14, "pii_type": 14, "level": 17, "conf": 5, "value": 32})


def format_scores(report: DataFrame) -> str:
    two = [F.format_number(c, 2).alias(c) for c in ("precision", "recall", "f1")]
    return format_table(report.select("pii_type", "support", "tp", "fp", "fn", *two).orderBy(F.col("pii_type") == "OVERALL", "pii_type"), {"pii_type": 16, "support": 8, "tp": 6, "fp": 6, "fn": 6, "precision": 9, "recall": 7, "f1": 6})


def format_overview(rows: DataFrame) -> str:
    return format_table(rows.select("document_id", "n_flags", "worst_overdue_months", F.array_join("retention_unresolved", ", ").alias("unverifiable")), {"document_id": 48, "n_flags": 8, "worst_overdue_months": 21, "unverifiable": 32})
