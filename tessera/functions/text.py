"""Text expressions: normalization, spans of a pattern, annotations, windows, occurrences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text: Column | str) -> Column:
    """Line ends to LF, blanks before them removed, at most one empty line in a row, white space stripped at both ends."""
    t = F.regexp_replace(as_column(text), "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+\n", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\A[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+\z", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Offsets are summed in blocks of this many, so that the time is near to proportional to the number of matches.
BLOCK = 256


def _placed(gaps: Column, sizes: Column, kind: str, make) -> Column:
    """``make(k, start, end)`` for the k-th of ``sizes``, each of which stands behind its gap."""
    empty = F.array().cast(kind)

    def blocks(both: Column) -> Column:
        n = F.size(both)
        cut = F.transform(F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int")), lambda b: F.slice(both, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(n > 0, cut).otherwise(F.array().cast("array<array<struct<k:int,gap:int,size:int>>>"))

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda at, x: at + x["gap"] + x["size"]))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda at, t: F.array_append(at, F.element_at(at, -1) + t))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["size"]
            return F.struct(end.alias("at"), F.array_append(acc["out"], make(x["k"], start, end)).cast(kind).alias("out"))

        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))

    rows = F.transform(sizes, lambda x, k: F.struct(k.alias("k"), F.get(gaps, k).alias("gap"), x.alias("size")))
    return let(rows, lambda r: let(blocks(r), summed))


def spans(text: Column | str, pattern: str | Column, needs: str = "") -> Column:
    """All leftmost non-overlapping matches as (start, end, text), half-open, in code points.

    The gaps between matches give the offsets: start of match i is the length of all gaps
    up to it and all matches before it.  Texts without a match cost one search, and that
    only if they hold ``needs``, which every match must.
    """
    t = F.coalesce(as_column(text), F.lit(""))
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(SPANS)

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(t, p, -1), lambda g: F.length(g))
        span = lambda k, start, end: F.struct(start.alias("start"), end.alias("end"), F.get(found, k).alias("text"))
        return F.filter(let(gaps, lambda g: _placed(g, F.transform(found, lambda m: F.length(m)), SPANS, span)), lambda s: s["end"] > s["start"])

    hit = F.contains(t, F.lit(needs)) & F.rlike(t, p) if needs else F.rlike(t, p)
    return F.when(hit, let(F.regexp_extract_all(t, p, F.lit(0)), place)).otherwise(none)


ANNOTATION = r"(?s)\{\{(.*?):(.*?)\}\}"


def annotated(text: Column | str) -> Column:
    """``{{type:value}}`` markers as struct(text without markers, spans (start, end, pii_type) in it)."""
    t = as_column(text)
    types = F.regexp_extract_all(t, F.lit(ANNOTATION), F.lit(1))
    sizes = F.transform(F.regexp_extract_all(t, F.lit(ANNOTATION), F.lit(2)), lambda v: F.length(v))
    gaps = F.transform(F.split(t, ANNOTATION, -1), lambda g: F.length(g))
    kind = "array<struct<start:int,end:int,pii_type:string>>"

    def place(known: Column) -> Column:
        span = lambda k, start, end: F.struct(start.alias("start"), end.alias("end"), F.trim(F.get(known, k)).alias("pii_type"))
        return let(gaps, lambda g: _placed(g, sizes, kind, span))

    return F.struct(F.regexp_replace(t, ANNOTATION, "$2").alias("text"), let(types, place).alias("spans"))


def annotate(pii_type: Column | str, value: Column | str) -> Column:
    return F.concat(F.lit("{{"), as_column(pii_type), F.lit(":"), as_column(value), F.lit("}}"))


def windows(text: Column | str, size: int = 2000, overlap: int = 200) -> Column:
    """Sliding windows as (chunk_no, offset, chunk); the first window that reaches the end is the last one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    t, step = as_column(text), size - overlap
    n = F.length(t)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    made = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("chunk_no"), (k * step).alias("offset"), F.substring(t, k * step + 1, F.lit(size)).alias("chunk")),
    )
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<chunk_no:int,offset:int,chunk:string>>"))


def occurrences(text: Column | str, value: Column | str) -> Column:
    """Offsets of every occurrence of ``value``, overlapping ones included.

    A match is the first character with the rest ahead of it, so matches never overlap though occurrences do.
    """
    t, v = as_column(text), as_column(value)
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit("(?s)"), quoted(F.substring(v, 1, 1)), F.lit("(?="), quoted(F.substring(v, F.lit(2), F.length(v))), F.lit(")"))
    found = F.transform(spans(t, pattern), lambda s: s["start"])
    return F.when((F.length(v) > 0) & (F.instr(t, v) > 0), found).otherwise(F.array().cast("array<int>"))


def normal_value(value: Column | str) -> Column:
    """White space collapsed, case folded; as far as lower() folds: a sharp s stays."""
    return F.lower(F.regexp_replace(F.regexp_replace(as_column(value), r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " "))


def slug(name: Column | str) -> Column:
    s = F.regexp_replace(normal_value(name), " ", "-")
    return F.when(s == "", F.lit("activity")).otherwise(s)


def cell(value: Column | str, width: int = 32) -> Column:
    """One line for a report: white space collapsed, longer values cut to width - 3 and dots."""
    v = F.trim(F.regexp_replace(as_column(value), r"(?U)\s+", " "))
    return F.when(F.length(v) > width, F.concat(F.substring(v, 1, width - 3), F.lit("..."))).otherwise(v)
