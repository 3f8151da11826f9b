"""Dates of documents; all instants are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

_PDF = r"^\s*D?:?(\d{4})(\d{2})(\d{2})(?:(\d{2})(?:(\d{2})(\d{2})?)?)?\s*(?:([Zz])|([+-])(\d{2})'?(?:(\d{2})'?)?)?"
_DAYS_IN_MONTH = 30.44


def pdf_date(raw: Column | str) -> Column:
    """``D:YYYYMMDDHHmmSS+01'00'``, all after the day optional, as a UTC timestamp; null where impossible."""
    t = as_column(raw)

    def part(k: int) -> Column:
        x = F.regexp_extract(t, _PDF, k)
        return F.when(x == "", F.lit(0)).otherwise(x.cast("int"))

    base = F.try_make_timestamp(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(8,6)"), F.lit("UTC"))
    minutes = part(9) * 60 + part(10)
    shift = F.when(F.regexp_extract(t, _PDF, 8) == "-", minutes).otherwise(-minutes)
    # an offset of a day or more, and second 60, aren't dates
    ok = F.rlike(t, F.lit(_PDF)) & (minutes < 24 * 60) & (part(6) < 60) & (part(4) < 24) & (part(1) > 0)
    return F.when(ok, F.timestamp_seconds(F.unix_micros(base) / 1e6 + shift * 60))


def plausible(value: Column, now: Column) -> Column:
    return F.coalesce(value.between(F.lit("1990-01-01 00:00:00").cast("timestamp"), now + F.expr("interval 1 day")), F.lit(False))


def reference_date(candidates: Column, mtime: Column, now: Column) -> Column:
    """The first plausible of ``array<struct<field, value>>``, else the file's time: struct(value, source, field)."""
    first = F.get(F.filter(F.coalesce(candidates, F.array().cast("array<struct<field:string,value:timestamp>>")), lambda c: plausible(c["value"], now)), F.lit(0))
    found = F.struct(first["value"].alias("value"), F.lit("content_metadata").alias("source"), first["field"].alias("field"))
    return F.when(first.isNotNull(), found).otherwise(F.struct(mtime.alias("value"), F.lit("file_mtime").alias("source"), F.lit("fs:mtime").alias("field")))


def age_months(reference: Column, now: Column) -> Column:
    """Whole months from whole days, never negative."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(reference)) / 86400)
    return F.greatest(F.lit(0), F.floor(days / F.lit(_DAYS_IN_MONTH))).cast("int")
