"""Wordings of a register: retention, category lists, phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .text import as_column, normal_value

_UNITS = "|".join(sorted(config.RETENTION_UNITS, key=len, reverse=True))
RETENTION = rf"(?iU)(\d+)\s*({_UNITS})\b"
SEPARATORS = r"(?iU)[;,/&]|\b(?:e|ed|and)\b"


def retention_months(text: Column | str) -> Column:
    """Months of the first number with a unit of years or months; null without one."""
    t = as_column(text)
    n, unit = F.regexp_extract(t, RETENTION, 1), F.lower(F.regexp_extract(t, RETENTION, 2))
    years = [u for u, m in config.RETENTION_UNITS.items() if m == 12]
    return F.when(n != "", n.cast("int") * F.when(unit.isin(years), 12).otherwise(1))


def split_categories(text: Column | str) -> Column:
    """The parts of an enumeration, in order, without empty ones."""
    parts = F.transform(F.split(as_column(text), SEPARATORS, -1), lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", ""))
    return F.filter(parts, lambda p: p != "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def resolve(part: Column | str, table: list[tuple[str, list[str], int]] | None = None) -> Column:
    """The types of one part: an exact phrase wins; else phrases with most words first take their first free place.

    A fold over the phrases, longest first; each replaces the words that it takes by a mark, so that no word counts
    twice, and adds its types in order.
    """
    table = config.phrase_table() if table is None else table
    key = normal_value(part)
    exact = F.create_map(*[x for p, types, _ in table for x in (F.lit(p), _strings(types))])
    longest = sorted(table, key=lambda r: -len(r[0].split()))
    entries = F.array(*[F.struct(F.lit(f" {p} ").alias("p"), _strings(types).alias("t"), F.lit(" " + "\x00 " * len(p.split())).alias("gone")) for p, types, _ in longest])
    start = F.struct(F.concat(F.lit(" "), key, F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        at = F.instr(acc["left"], e["p"])
        rest = F.concat(F.substring(acc["left"], F.lit(1), at - 1), e["gone"], F.substring(acc["left"], at + F.length(e["p"]), F.length(acc["left"])))
        taken = F.struct(rest.alias("left"), F.concat(acc["out"], e["t"]).alias("out"))
        return F.when(at > 0, taken).otherwise(acc)

    spotted = F.aggregate(entries, start, step, lambda acc: F.array_distinct(acc["out"]))
    return F.coalesce(exact[key], spotted)


def map_categories(text: Column | str, table: list[tuple[str, list[str], int]] | None = None) -> Column:
    """``array<struct<text, pii_types>>`` of a free-text cell."""
    return F.transform(split_categories(text), lambda p: F.struct(p.alias("text"), resolve(p, table).alias("pii_types")))
