"""The registry of references: snapshots of its tables, and the writes as frame to frame functions.

Plain Parquet has no MERGE, so every write makes a new folder of data and then a small
pointer file that names the folders of the version; readers see the old or the new version,
never half of one.  Tables of documents are cut into parts by a hash of the document: a
write of some parts takes the folders of the others over from the version before.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TABLES = {"document": schemas.DOCUMENT, "scan": schemas.SCAN, "instance": schemas.INSTANCE, "rule": schemas.RULE, "activity": schemas.ACTIVITY, "macro": schemas.MACRO, "category": schemas.CATEGORY}
OF_DOCUMENTS = ("document", "scan", "instance")


class Conflict(RuntimeError):
    """Another writer has made a version since this store read the table."""


class Store:
    """Versioned tables under one root, in any file system that Spark knows and that creates a file only once.

    ``parts``: into how many a table of documents is cut; ``grace``: seconds that a version stays for its readers after
    it was replaced.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 64, grace: float = 3600) -> None:
        self.spark, self.root, self.parts, self.grace = spark, root.rstrip("/"), parts, grace
        self._seen: dict[str, int] = {}

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self, table: str) -> dict[int, float]:
        """Versions with the second they were made in."""
        p, fs = self._path(f"{self.root}/{table}")
        listed = fs.listStatus(p) if fs.exists(p) else []
        return {int(s.getPath().getName()[8:]): s.getModificationTime() / 1000 for s in listed if s.getPath().getName().startswith("CURRENT-")}

    def _manifest(self, table: str, v: int) -> dict | None:
        """``parts`` and ``folders`` of a version; null if its writer ended before the pointer was whole."""
        p, fs = self._path(f"{self.root}/{table}/CURRENT-{v}")
        stream = fs.open(p)
        raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            return None

    def _current(self, table: str) -> tuple[int, dict]:
        for v in sorted(self._pointers(table), reverse=True):
            if (found := self._manifest(table, v)) is not None:
                return v, found
        return 0, {"parts": self.parts, "folders": {}}

    def version(self, table: str) -> int:
        return self._current(table)[0]

    def part(self, table: str) -> Column:
        """The part of a row's document."""
        return F.pmod(F.xxhash64("document_id"), F.lit(self._current(table)[1]["parts"])).cast("int")

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The parts that ``rows(document_id)`` touch; the tables of documents are cut alike."""
        return [r.p for r in rows.select(self.part("document").alias("p")).distinct().collect()]

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        v, found = self._current(table)
        self._seen[table] = v
        empty = self.spark.createDataFrame([], TABLES[table])
        folders = [f for k, f in found["folders"].items() if parts is None or int(k) in parts]
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.root}/{table}/{f}" for f in folders]) if folders else empty

    def write(self, table: str, rows: DataFrame, keep: int = 2, parts: list[int] | None = None) -> int:
        """A new version with exactly the columns of the table; the pointer is created last, old versions go.

        ``parts``: only these are replaced, by ``rows``.  Fails with ``Conflict`` if the table has changed since this
        store read it.
        """
        fields = [c.split(maxsplit=1) for c in TABLES[table].split(", ")]
        v, found = self._current(table)
        if self._seen.get(table, v) != v:
            raise Conflict(f"{table}: version {v} is newer than {self._seen[table]}, which was read")
        data, kept = f"data-{uuid.uuid4().hex}", {}
        cells = rows.select(*[F.col(c).cast(t).alias(c) for c, t in fields])
        if table in OF_DOCUMENTS:
            # Spark joins small parts in a task and splits great ones
            cells.withColumn("part", self.part(table)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{table}/{data}")
            p, fs = self._path(f"{self.root}/{table}/{data}")
            made = {n[5:]: f"{data}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("part=")}
            if parts is not None:
                kept = {k: f for k, f in found["folders"].items() if int(k) not in parts}
                if not set(map(int, made)) <= set(parts):
                    raise ValueError(f"{table}: rows outside of the parts that are replaced")
        else:
            cells.write.parquet(f"{self.root}/{table}/{data}")
            made = {"0": data}
        new = max(self._pointers(table), default=0) + 1
        p, fs = self._path(f"{self.root}/{table}/CURRENT-{new}")
        try:
            out = fs.create(p, False)  # fails if there is one
        except Py4JJavaError as e:
            raise Conflict(f"{table}: version {new} was made by another writer") from e
        out.write(bytearray(json.dumps({"parts": found["parts"], "folders": kept | made}).encode()))
        out.close()
        self._seen[table] = new
        self._clean(table, keep)
        return new

    def _clean(self, table: str, keep: int) -> None:
        """Versions but the last ``keep`` go once they are replaced for ``grace`` seconds, and folders that no other version names."""
        made = self._pointers(table)
        order = sorted(made)
        old = [v for v, after in zip(order, order[1:]) if v in order[:-keep] and made[after] < time.time() - self.grace]
        if not old:
            return
        folders = {v: set((self._manifest(table, v) or {"folders": {}})["folders"].values()) for v in order}
        used = set().union(*(folders[v] for v in order if v not in old))
        for v in old:
            for name in (f"CURRENT-{v}", *(folders[v] - used)):
                p, fs = self._path(f"{self.root}/{table}/{name}")
                fs.delete(p, True)

    def clear(self, *tables: str) -> None:
        for t in tables or TABLES:
            self._seen.pop(t, None)
            self.write(t, self.spark.createDataFrame([], TABLES[t]))


def record_scan(documents: DataFrame, scans: DataFrame, instances: DataFrame, scanned: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """Replaces the findings of every scanned document.

    ``scanned``: document_id, path, reference_date, reference_date_source, source_mtime,
    source_size, detector_signature (each may be null: then the old value stays; the path
    is taken on creation only), at, and ``clear_stamp`` (true: a pruned file loses its stamp,
    so that it counts as new if it comes back).  ``matches``: document_id, ord, pii_type,
    start, end, confidence, level, sources.
    """
    s = scanned.select(*[F.col(c).alias(f"n_{c}") if c != "document_id" else F.col(c) for c in scanned.columns])
    both = documents.join(s, "document_id", "full")
    fresh = F.col("n_at").isNotNull()
    clear = F.coalesce(F.col("n_clear_stamp"), F.lit(False))

    def newer(c: str, stamp: bool = False):
        value = F.coalesce(F.col(f"n_{c}"), F.col(c))
        return (F.when(clear, None).otherwise(value) if stamp else value).alias(c)

    docs = both.select(
        "document_id", F.coalesce("path", "n_path").alias("path"), F.coalesce("first_seen", "n_at").alias("first_seen"),
        F.coalesce("activity_ids", F.array().cast("array<string>")).alias("activity_ids"), "association_source",
        newer("reference_date"), newer("reference_date_source"), newer("source_mtime", True), newer("source_size", True),
        F.when(fresh, F.col("n_at")).otherwise(F.col("last_scanned_at")).alias("last_scanned_at"), newer("detector_signature", True),
    )
    run = scanned.select(F.xxhash64("document_id", F.col("at")).alias("id"), "document_id", F.col("at").alias("created_at"))
    new = matches.join(run.select("document_id", F.col("id").alias("last_scan_id")), "document_id").select(
        F.xxhash64("last_scan_id", "ord").alias("id"), "document_id", "pii_type", "start", "end", "confidence", F.col("level").alias("confirmation_level"),
        F.transform("sources", lambda x: x["detector_id"]).alias("sources"), F.lit(None).cast("string").alias("processing_activity_id"), "last_scan_id",
    )
    kept = instances.join(scanned.select("document_id"), "document_id", "left_anti")
    return {"document": docs, "scan": scans.unionByName(run), "instance": schemas.minimized(kept.unionByName(new))}


def apply_coverage(instances: DataFrame, coverage: DataFrame) -> DataFrame:
    """Sets the activity of the instances that ``coverage(id, activity_id)`` names; others stay."""
    c = coverage.select("id", F.col("activity_id").alias("__a"), F.lit(True).alias("__hit"))
    rows = instances.join(c, "id", "left")
    return rows.withColumn("processing_activity_id", F.when(F.col("__hit"), F.col("__a")).otherwise(F.col("processing_activity_id"))).drop("__a", "__hit").select(*instances.columns)


def assign_activities(documents: DataFrame, document_id: str, ids: list[str], source: str = "manual") -> DataFrame:
    if not ids or any(not i.strip() for i in ids):
        raise ValueError("activity ids must be given and not blank")
    if documents.where(F.col("document_id") == document_id).limit(1).isEmpty():
        raise KeyError(document_id)
    hit = F.col("document_id") == document_id
    new = F.array(*[F.lit(i) for i in ids])
    return documents.withColumn("activity_ids", F.when(hit, new).otherwise(F.col("activity_ids"))).withColumn("association_source", F.when(hit, F.lit(source)).otherwise(F.col("association_source")))


def save_rule(rules: DataFrame, prefix: str, ids: list[str], at) -> DataFrame:
    if not ids or any(not i.strip() for i in ids):
        raise ValueError("activity ids must be given and not blank")
    p = prefix.strip().strip("/")
    return rules.where(F.col("prefix") != p).unionByName(rules.sparkSession.createDataFrame([(p, ids, at)], schemas.RULE))


def delete_rule(documents: DataFrame, rules: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(documents reconciled with the remaining rules, rules)."""
    from .rules import reconcile

    left = rules.where(F.col("prefix") != prefix.strip().strip("/"))
    return reconcile(documents, left).drop("outcome"), left


def instances_for(instances: DataFrame, document_id: str) -> DataFrame:
    return instances.where(F.col("document_id") == document_id).orderBy("start", "id")


def folder_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("prefix")


def inventory(instances: DataFrame, seen: DataFrame) -> DataFrame:
    """Instances a type over the documents of ``seen``."""
    return instances.join(seen.select("document_id"), "document_id", "left_semi").groupBy("pii_type").agg(F.count("*").alias("n"))


def counts_per_document(documents: DataFrame, instances: DataFrame) -> DataFrame:
    n = instances.groupBy("document_id").agg(F.count("*").alias("pii_count"))
    return documents.select("document_id").join(n, "document_id", "left").na.fill(0, ["pii_count"])


def formats(plan: DataFrame) -> DataFrame:
    return plan.groupBy(F.lower(F.regexp_extract("document_id", r"(\.[^./]+)$", 1)).alias("format")).agg(F.count("*").alias("n"))
