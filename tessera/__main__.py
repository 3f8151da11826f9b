"""Command line: python -m tessera scan|extract|scan-folder|preview|register|assign|rule|check|retention|map ..."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.phrases import map_categories
from .operators import fuse, registry
from .plans import jobs
from .sources import chat, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--store", default="registry", help="root of the registry's tables")
    s = p.add_subparsers(dest="what", required=True)
    for name in ("scan", "extract"):
        s.add_parser(name).add_argument("file")
    f = s.add_parser("scan-folder")
    f.add_argument("folder")
    f.add_argument("--full", action="store_true")
    f.add_argument("--no-prune", action="store_true")
    f.add_argument("--no-apply-rules", action="store_true")
    f.add_argument("--ai-rate", type=int, default=0)
    s.add_parser("preview").add_argument("folder")
    r = s.add_parser("register")
    r.add_argument("workbook")
    r.add_argument("--replace", action="store_true")
    a = s.add_parser("assign")
    a.add_argument("document")
    a.add_argument("activities", nargs="+")
    u = s.add_parser("rule")
    u.add_argument("prefix")
    u.add_argument("activities", nargs="*", help="none: delete the rule")
    c = s.add_parser("check")
    c.add_argument("document")
    c.add_argument("--include-proposed", action="store_true")
    c.add_argument("--write", action="store_true")
    s.add_parser("retention").add_argument("--strict", action="store_true")
    s.add_parser("map").add_argument("text")
    return p


def _one(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    return files.extract(spark.createDataFrame([(path.rpartition("/")[2], bytearray(raw))], "document_id string, content binary"))


def main(argv: list[str] | None = None) -> str:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, now = registry.Store(spark, a.store), F.lit(datetime.now(UTC)).cast("timestamp")
    if a.what in ("scan", "extract"):
        row = _one(spark, a.file)
        bad = row.first()
        if bad.error:
            return f"error: {bad.error}"
        return bad.text if a.what == "extract" else jobs.format_matches(fuse.ordered(jobs.scan_documents(row.select("document_id", "text"))))
    if a.what == "scan-folder":
        endpoint = chat.from_env() if a.ai_rate else None
        out = jobs.scan_folder(store, a.folder, full=a.full, prune=not a.no_prune, apply_rules=not a.no_apply_rules, backend=chat.backend(endpoint) if endpoint else None, ai_rate=a.ai_rate if endpoint else 0)
        return "\n".join(f"{k}: {v}" for k, v in out.items())
    if a.what == "preview":
        return "\n".join(f"{k}: {v}" for k, v in jobs.preview(store, a.folder).items())
    if a.what == "register":
        with open(a.workbook, "rb") as f:
            raw = f.read()
        n = jobs.ingest_register(store, spark.createDataFrame([(a.workbook.rpartition("/")[2], bytearray(raw))], "document_id string, content binary"), a.replace)
        return f"{n} activities"
    if a.what == "assign":
        store.write("document", registry.assign_activities(store.read("document"), a.document, a.activities))
        return "ok"
    if a.what == "rule":
        rules = store.read("rule")
        if a.activities:
            store.write("rule", registry.save_rule(rules, a.prefix, a.activities, datetime.now(UTC)))
        else:
            documents, left = registry.delete_rule(store.read("document"), rules, a.prefix)
            store.write("document", documents)
            store.write("rule", left)
        return "ok"
    if a.what == "check":
        return str(jobs.check(store, a.document, now, a.include_proposed, a.write).first().asDict(recursive=True))
    if a.what == "retention":
        return jobs.format_overview(jobs.overview(store, now, not a.strict))
    parts = spark.range(1).select(F.explode(map_categories(F.lit(a.text))).alias("x")).collect()
    return "\n".join(f"{r.x.text}: {', '.join(r.x.pii_types) or '-'}" for r in parts)


if __name__ == "__main__":
    print(main())
