"""Half-open spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    """Adjacent spans don't overlap."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; the union is the hull, disjoint spans have 0."""
    inter = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(inter > 0, inter / hull).otherwise(F.lit(0.0))


def valid(start: Column, end: Column, length: Column | None = None) -> Column:
    ok = (start >= 0) & (end > start)
    return ok if length is None else ok & (end <= length)
