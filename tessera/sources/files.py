"""Files to text: enumeration, format dispatch, readers, reference-date candidates."""

from __future__ import annotations

import io
import os
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta, timezone
from pathlib import Path, PurePosixPath
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx

#: Columns that one repeated cell of an open document sheet may stand for.
REPEAT = 40


class UnsupportedFormat(ValueError):
    pass


def supported_suffixes() -> tuple[str, ...]:
    return config.SUFFIXES


def plan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below ``folder`` by path: ``document_id`` (relative, slashes), path, size, mtime, scannable.

    Enumerated with the file system's own listing: the binaryFile source leaves out empty files and names that begin
    with a dot or an underscore, which must be planned.
    """
    if "://" not in folder:
        root = Path(folder)
        if not root.is_dir():
            raise NotADirectoryError(folder)
        found = []
        for d, _, names in os.walk(root):
            for n in names:
                p = Path(d, n)
                st = p.stat()
                found.append((p.relative_to(root).as_posix(), str(p), st.st_size, datetime.fromtimestamp(st.st_mtime, UTC)))
    else:
        jvm = spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(folder)
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
            raise NotADirectoryError(folder)
        base, found, it = fs.getFileStatus(top).getPath().toUri().getPath().rstrip("/"), [], fs.listFiles(top, True)
        while it.hasNext():
            s = it.next()
            full = s.getPath().toUri().getPath()
            found.append((full[len(base) + 1 :], s.getPath().toString(), s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000, UTC)))
    rows = spark.createDataFrame(sorted(found), "document_id string, path string, size long, mtime timestamp")
    suffix = F.lower(F.regexp_extract("document_id", r"(\.[^./]+)$", 1))
    return rows.withColumn("scannable", suffix.isin(list(config.SUFFIXES)))


def stem(path: str) -> str:
    return PurePosixPath(path).stem


def safe_relative(path):
    """An uploaded relative path, or null if it is absolute, empty or climbs out; as a Column or for a str."""
    if isinstance(path, str):
        p = path.replace("\\", "/").strip()
        bad = not p or p.startswith("/") or re.match(r"[A-Za-z]:", p) or ".." in p.split("/")
        return None if bad else "/".join(x for x in p.split("/") if x not in ("", "."))
    p = F.trim(F.regexp_replace(path, r"\\", "/"))
    parts = F.split(p, "/")
    bad = (p == "") | p.startswith("/") | F.rlike(p, F.lit("^[A-Za-z]:")) | F.array_contains(parts, "..")
    return F.when(~bad, F.array_join(F.filter(parts, lambda x: ~x.isin("", ".")), "/"))


# --- readers: bytes to text -------------------------------------------------------------


def read_txt(raw: bytes) -> str:
    return raw.decode("utf-8")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_docx(raw: bytes) -> str:
    """Paragraphs of the body, one a line; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(x for x in ET.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")
    lines = []
    for p in body:
        if _local(p.tag) != "p":
            continue
        out = []
        for x in p.iter():
            kind = _local(x.tag)
            out.append(x.text or "" if kind == "t" else "\t" if kind == "tab" else "\n" if kind in ("br", "cr") else "")
        lines.append("".join(out))
    return "\n".join(lines)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _strip_end(cells: list[str]) -> list[str]:
    while cells and cells[-1] == "":
        cells.pop()
    return cells


def _xlsx(raw: bytes) -> dict[str, list[list[str]]]:
    """Sheets of a workbook by name: cached values, dates as ISO text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")):
                # phonetic runs aren't part of the value
                shared.append("".join(t.text or "" for r in si for t in ([r] if _local(r.tag) == "t" else r if _local(r.tag) == "r" else []) if _local(t.tag) == "t"))
        dated = _date_styles(z) if "xl/styles.xml" in names else set()
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out: dict[str, list[list[str]]] = {}
        for s in (s for e in book if _local(e.tag) == "sheets" for s in e):
            target = rels[next(v for k, v in s.attrib.items() if _local(k) == "id")].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str]] = []
            for row in (r for d in root if _local(d.tag) == "sheetData" for r in d):
                at = int(row.get("r", len(rows) + 1)) - 1
                while len(rows) < at:
                    rows.append([])
                cells: list[str] = []
                for c in row:
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (k - len(cells))
                    cells.append(_xlsx_value(c, shared, dated).strip())
                rows.append(_strip_end(cells))
            out[s.get("name")] = rows
    return out


def _date_styles(z: zipfile.ZipFile) -> set[str]:
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {f.get("numFmtId"): f.get("formatCode", "") for e in root if _local(e.tag) == "numFmts" for f in e}
    builtin = {str(i) for i in (*range(14, 23), 45, 46, 47)}
    is_date = lambda i: i in builtin or bool(re.search(r"[ymdhs]", re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.", "", own.get(i, ""))))
    return {str(k) for e in root if _local(e.tag) == "cellXfs" for k, x in enumerate(e) if is_date(x.get("numFmtId", "0"))}


def _xlsx_value(c: ET.Element, shared: list[str], dated: set[str]) -> str:
    v = next((x for x in c if _local(x.tag) == "v"), None)
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind == "n":
        if c.get("s") in dated:
            return str(datetime(1899, 12, 30) + timedelta(days=float(v.text)))
        return v.text[:-2] if re.fullmatch(r"-?\d+\.0", v.text) else v.text
    return v.text


def _ods_text(cell: ET.Element) -> str:
    """Paragraphs of a cell without those of its comments."""

    def flat(x: ET.Element) -> str:
        kind = _local(x.tag)
        head = " " * int(next((v for k, v in x.attrib.items() if _local(k) == "c"), 1)) if kind == "s" else "\t" if kind == "tab" else ""
        return head + (x.text or "") + "".join(flat(y) + (y.tail or "") for y in x)

    def paragraphs(x: ET.Element) -> Iterator[str]:
        for y in x:
            if _local(y.tag) == "p":
                yield flat(y)
            elif _local(y.tag) != "annotation":
                yield from paragraphs(y)

    return "".join(paragraphs(cell)).strip()


def _ods(raw: bytes) -> dict[str, list[list[str]]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("content.xml"))
    attr = lambda x, name: next((v for k, v in x.attrib.items() if _local(k) == name), None)
    out: dict[str, list[list[str]]] = {}
    for table in (t for t in root.iter() if _local(t.tag) == "table"):
        rows = []
        for tr in (r for r in table.iter() if _local(r.tag) == "table-row"):
            cells: list[str] = []
            for tc in (c for c in tr if _local(c.tag) == "table-cell"):
                cells += [_ods_text(tc)] * min(int(attr(tc, "number-columns-repeated") or 1), REPEAT)
            rows.append(_strip_end(cells))
        out[attr(table, "name")] = rows
    return out


def read_workbook(raw: bytes, suffix: str) -> dict[str, list[list[str]]]:
    """Sheets by name, in order."""
    if suffix in (".xlsx", ".xlsm"):
        return _xlsx(raw)
    if suffix == ".ods":
        return _ods(raw)
    raise ValueError(f"not a spreadsheet: {suffix}")


def sheet_names(raw: bytes, suffix: str) -> list[str]:
    return list(read_workbook(raw, suffix))


def read_sheet(raw: bytes, suffix: str, name: str) -> list[list[str]]:
    return read_workbook(raw, suffix)[name]


def read_spreadsheet(raw: bytes, suffix: str) -> str:
    """Cells by tab, rows by line, sheets by an empty line."""
    return "\n\n".join("\n".join("\t".join(r) for r in rows) for rows in read_workbook(raw, suffix).values())


def read_pdf(raw: bytes) -> str:
    try:
        import fitz
    except ImportError:
        raise UnsupportedFormat("no PDF library is installed") from None
    with fitz.open(stream=raw, filetype="pdf") as d:
        return "\n".join(page.get_text() for page in d)


def read_doc(raw: bytes) -> str:
    if shutil.which("antiword") is None:
        raise UnsupportedFormat("antiword is not installed")
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:
        f.write(raw)
        f.flush()
        return subprocess.run(["antiword", f.name], capture_output=True, check=True, timeout=60).stdout.decode("utf-8", "replace")


READERS: dict[str, Callable[[bytes], str]] = {
    ".txt": read_txt,
    ".docx": read_docx,
    ".pdf": read_pdf,
    ".doc": read_doc,
    ".xlsx": lambda raw: read_spreadsheet(raw, ".xlsx"),
    ".xlsm": lambda raw: read_spreadsheet(raw, ".xlsm"),
    ".ods": lambda raw: read_spreadsheet(raw, ".ods"),
}


def parse_content(raw: bytes, suffix: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> str:
    reader = (readers or READERS).get(suffix.lower())
    if reader is None:
        raise UnsupportedFormat(suffix)
    return reader(raw)


# --- dates inside files -----------------------------------------------------------------


def _iso(text: str) -> datetime:
    value = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)


def date_candidates(raw: bytes, suffix: str) -> list[tuple[str, datetime]]:
    """(field, instant) of the dates that a file carries, best first; unreadable metadata gives none."""
    try:
        if suffix in (".docx", ".xlsx", ".xlsm"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                core = {_local(x.tag): x.text for x in ET.fromstring(z.read("docProps/core.xml"))}
            kind = "docx:core_properties" if suffix == ".docx" else "xlsx:properties"
            return [(f"{kind}.{k}", _iso(core[k])) for k in ("modified", "created") if core.get(k)]
        if suffix == ".pdf":
            out = []
            for key, name in ((b"/ModDate", "pdf:modDate"), (b"/CreationDate", "pdf:creationDate")):
                if (m := re.search(re.escape(key) + rb"\s*\(([^)]*)\)", raw)) and (d := _pdf_date(m[1].decode("latin-1"))):
                    out.append((name, d))
            return out
    except Exception:  # any fault of the metadata: the file's own time is used
        return []
    return []


def _pdf_date(text: str) -> datetime | None:
    m = re.match(r"D?:?(\d{4})(\d\d)(\d\d)(\d\d)?(\d\d)?(\d\d)?\s*(?:([Zz])|([+-])(\d\d)'?(\d\d)?)?", text.strip())
    if not m:
        return None
    try:
        shift = timedelta(hours=int(m[9] or 0), minutes=int(m[10] or 0))
        zone = timezone(-shift if m[8] == "-" else shift)
        return datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), tzinfo=zone).astimezone(UTC)
    except ValueError:
        return None


# --- frames -----------------------------------------------------------------------------


def load(plan: DataFrame) -> DataFrame:
    """Adds ``content`` to planned files, read on the executors through Spark's file systems.

    The binaryFile source leaves out empty files and hidden names (a dot or an underscore in front): empty ones get
    empty content, hidden ones of a mounted folder are opened where they are, and of a remote store have no content,
    which extraction reports.
    """
    spark = plan.sparkSession
    local = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    hidden = F.rlike("path", F.lit(r"/[_.][^/]*$"))
    paths = [r.path for r in plan.where(~hidden & (F.col("size") > 0)).select("path").collect()]  # as many as were listed
    if paths:
        raw = spark.read.format("binaryFile").load(paths).select(local("path").alias("__p"), "content")
        found = plan.join(raw, local("path") == F.col("__p"), "left").drop("__p")
    else:
        found = plan.withColumn("content", F.lit(None).cast("binary"))

    @F.pandas_udf("binary")
    def opened(names: pd.Series) -> pd.Series:
        return names.map(lambda n: Path(n).read_bytes() if "://" not in n else None)

    return found.withColumn("content", F.when(F.col("size") == 0, F.lit(b"").cast("binary")).when(hidden, opened(local("path"))).otherwise(F.col("content")))


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``files(document_id, content, ...)`` with normalized ``text``, ``error`` and date ``candidates``; a bad file is a row with an error."""
    table = readers or READERS
    kind = "text string, error string, candidates array<struct<field:string,value:timestamp>>"
    out = files.columns + ["text", "error", "candidates"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors, dates = [], [], []
            for name, raw in zip(pdf["document_id"], pdf["content"], strict=True):
                suffix = PurePosixPath(name).suffix.lower()
                try:
                    if raw is None:
                        raise FileNotFoundError(name)
                    texts.append(parse_content(bytes(raw), suffix, table))
                    errors.append(None)
                except Exception as e:  # one file's fault is its own
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
                dates.append([{"field": f, "value": v.replace(tzinfo=None)} for f, v in date_candidates(bytes(raw or b""), suffix)])
            yield pdf.assign(text=pd.Series(texts, index=pdf.index, dtype=object), error=pd.Series(errors, index=pdf.index, dtype=object), candidates=pd.Series(dates, index=pdf.index, dtype=object))[out]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{fields}, {kind}").withColumn("text", tx.normalize("text")).drop("content")


def grids(files: DataFrame) -> DataFrame:
    """``file, sheet, row_no, cells`` of spreadsheets ``files(document_id, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["document_id"], pdf["content"], strict=True):
                for sheet, grid in read_workbook(bytes(raw), PurePosixPath(name).suffix.lower()).items():
                    rows += [(name, sheet, i, cells) for i, cells in enumerate(grid)]
            yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells"])

    return files.select("document_id", "content").mapInPandas(run, "file string, sheet string, row_no int, cells array<string>")
