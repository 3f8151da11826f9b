"""Which files need a scan, and which documents have gone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature(detector_ids: Iterable[str], config_dir: str | None = None, settings: dict[str, object] | None = None) -> str:
    """16 hex digits over the sorted detector ids and the configuration files.

    ``settings`` adds what else decides the result (model, thresholds, passes switched on); without it only ids and
    files count.
    """
    h = hashlib.sha256()
    for i in sorted(detector_ids):
        h.update(i.encode() + b"\0")
    for f in sorted(Path(config_dir).glob("*.yaml")) if config_dir else ():
        h.update(f.name.encode())
        h.update(f.read_bytes())
    for k, v in sorted((settings or {}).items()):
        h.update(f"{k}={v}\0".encode())
    return h.hexdigest()[:16]


def needs_rescan(mtime: Column, size: Column, old_mtime: Column, old_size: Column, signature: Column | None = None, old_signature: Column | None = None, tolerance: float = 1.0) -> Column:
    """A file without a record, or whose engine, size or time (either way, beyond the tolerance) differs."""
    drift = F.abs(F.unix_micros(mtime) - F.unix_micros(old_mtime)) > int(tolerance * 1_000_000)
    changed = old_mtime.isNull() | old_size.isNull() | (size != old_size) | drift
    if signature is not None:
        changed = changed | (signature.isNotNull() & ~signature.eqNullSafe(old_signature))
    return F.coalesce(changed, F.lit(True))


def compare(files: DataFrame, documents: DataFrame, signature: str | None = None) -> DataFrame:
    """``files(document_id, mtime, size, ...)`` with ``todo``."""
    old = documents.select("document_id", F.col("source_mtime").alias("__m"), F.col("source_size").alias("__s"), F.col("detector_signature").alias("__g"))
    rows = files.join(old, "document_id", "left")
    sig = None if signature is None else F.lit(signature)
    return rows.withColumn("todo", needs_rescan(F.col("mtime"), F.col("size"), F.col("__m"), F.col("__s"), sig, F.col("__g"))).drop("__m", "__s", "__g")


def unchanged(files: DataFrame, documents: DataFrame) -> DataFrame:
    """How many files a scan would skip, whatever the engine."""
    return compare(files, documents).agg(F.count_if(~F.col("todo")).alias("unchanged"))


def prune(seen: DataFrame, documents: DataFrame, instances: DataFrame) -> DataFrame:
    """Documents of the registry that weren't seen and still have findings."""
    return documents.select("document_id").join(seen.select("document_id"), "document_id", "left_anti").join(instances.select("document_id"), "document_id", "left_semi")
