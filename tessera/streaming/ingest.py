"""Continuous ingest: new documents are scanned as they arrive and replace their findings in the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..operators import detect, registry
from ..plans.jobs import scan_documents


def scan_stream(documents: DataFrame, rules=config.DEFAULT_RULES) -> DataFrame:
    """Candidates of a stream of ``document_id, text``, with its other columns (``at``): a stateless projection."""
    kept = [c for c in documents.columns if c != "text"]
    return detect.explode_candidates(documents.select(*kept, detect.rule_candidates("text", rules).alias("c")), "c")


def deduplicated(documents: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream with ``at``: repeats of a document's version within the watermark are dropped, and state is bounded by it."""
    return documents.withWatermark("at", delay).dropDuplicatesWithinWatermark(["document_id", "source_mtime", "source_size"])


def counts_by_window(candidates: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Findings a type and tumbling window of a stream with ``at``; late rows beyond the watermark are left out."""
    return candidates.withWatermark("at", delay).groupBy(F.window("at", width), "pii_type").agg(F.count("*").alias("n"))


def into_registry(documents: DataFrame, store: registry.Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a stream of document_id, path, text, source_mtime, source_size, at into the registry.

    A batch replaces the findings of its documents, so one that is run again leaves the same tables; of several
    versions in a batch the latest counts.  Only the parts of the tables that hold its documents are read and written.
    """

    def write(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("document_id").agg(F.max_by(F.struct("path", "text", "source_mtime", "source_size", "at"), "at").alias("d")).select("document_id", "d.*").persist()
        none = F.lit(None)
        scanned = last.select("document_id", "path", F.col("source_mtime").alias("reference_date"), F.lit("file_mtime").alias("reference_date_source"), "source_mtime", "source_size", none.cast("string").alias("detector_signature"), "at", F.lit(False).alias("clear_stamp"))
        matches = scan_documents(last.select("document_id", "text")).select("document_id", "ord", "pii_type", "start", "end", "confidence", "level", "sources")
        parts = store.parts_of(last)
        documents, scans, instances = (store.read(t, parts) for t in registry.OF_DOCUMENTS)
        again = scanned.select("document_id", F.col("at").alias("created_at"))
        scans = scans.join(again, ["document_id", "created_at"], "left_anti").select("id", "document_id", "created_at")
        new = registry.record_scan(documents, scans, instances, scanned, matches)
        for table in ("instance", "scan", "document"):
            store.write(table, new[table], parts=parts)
        last.unpersist()

    return documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
