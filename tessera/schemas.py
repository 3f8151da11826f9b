"""The relations of the engine.  Registry tables hold references to findings, never values."""

from __future__ import annotations

from pyspark.sql import DataFrame

PROVENANCE = "struct<detector_id:string,detector_kind:string,pii_type:string,confidence:double,raw_label:string,rationale:string>"
CANDIDATE = "struct<start:int,end:int,text:string,pii_type:string,confidence:double,detector_id:string,detector_kind:string,raw_label:string,rationale:string>"
MATCH = f"struct<start:int,end:int,text:string,pii_type:string,confidence:double,level:string,sources:array<{PROVENANCE}>>"

DOCUMENT = "document_id string, path string, first_seen timestamp, activity_ids array<string>, association_source string, reference_date timestamp, reference_date_source string, source_mtime timestamp, source_size long, last_scanned_at timestamp, detector_signature string"
SCAN = "id long, document_id string, created_at timestamp"
INSTANCE = "id long, document_id string, pii_type string, start int, end int, confidence double, confirmation_level string, sources array<string>, processing_activity_id string, last_scan_id long"
RULE = "prefix string, activity_ids array<string>, created_at timestamp"

#: ``position`` keeps the order of the sheet: the row of a macro category, and of a category the path of its parts.
ACTIVITY = "id string, name string, purpose string"
MACRO = "id long, activity_id string, raw_text string, retention_text string, retention_months int, position int"
CATEGORY = "id long, macro_category_id long, raw_text string, pii_types array<string>, mapping_state string, position array<int>"

#: What may never be written to the registry.
FORBIDDEN = ("text", "value", "rationale", "raw_label")


def minimized(instances: DataFrame) -> DataFrame:
    """The columns of an instance and nothing else."""
    columns = [c.split()[0] for c in INSTANCE.split(", ")]
    out = instances.select(*[c for c in columns if c in instances.columns])
    assert not set(out.columns) & set(FORBIDDEN)
    return out
