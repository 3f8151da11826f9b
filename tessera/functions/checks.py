"""Checksum expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column


def luhn(number: Column | str) -> Column:
    """Luhn over the digits; other characters are ignored, no digits are valid."""
    digits = F.regexp_replace(as_column(number), r"\D", "")
    return F.when(digits == "", F.lit(True)).otherwise(F.call_function("luhn_check", digits))


def mod97(iban: Column | str) -> Column:
    """Remainder of an IBAN, blanks ignored; 1 is valid.  Null where it holds other characters."""
    raw = F.upper(F.regexp_replace(as_column(iban), " ", ""))
    turned = F.concat(F.substring(raw, 5, 100000), F.substring(raw, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return F.pmod(acc * F.when(value >= 10, 100).otherwise(10) + value, F.lit(97)).cast("int")

    return F.when(F.rlike(raw, F.lit("^[0-9A-Z]{4,}$")), F.aggregate(F.split(turned, ""), F.lit(0), step))


def iban_valid(iban: Column | str) -> Column:
    return F.coalesce(mod97(iban) == 1, F.lit(False))


def ean13_digit(twelve: Column | str) -> Column:
    """The check digit of twelve digits."""
    digits = F.transform(F.split(as_column(twelve), ""), lambda d: d.cast("int"))
    weighted = F.transform(digits, lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("int")


def avs_valid(number: Column | str) -> Column:
    """A Swiss AVS number: 13 digits from 756 with their EAN-13 digit, points ignored."""
    raw = F.regexp_replace(as_column(number), r"\.", "")
    ok = F.rlike(raw, F.lit("^756[0-9]{10}$"))
    return F.coalesce(F.when(ok, ean13_digit(F.substring(raw, 1, 12)) == F.substring(raw, 13, 1).cast("int")), F.lit(False))


_ODD = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23), strict=True))


def tax_code_valid(code: Column | str) -> Column:
    """The check letter of an Italian tax code (public rule: odd places by table, even places by value, modulo 26)."""
    raw = F.upper(as_column(code))
    odd = F.create_map(*[F.lit(x) for kv in _ODD.items() for x in kv])
    even = F.create_map(*[F.lit(x) for i, ch in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for x in (ch, i if i < 10 else i - 10)])
    chars = F.split(F.substring(raw, 1, 15), "")
    total = F.aggregate(F.transform(chars, lambda ch, i: F.when(i % 2 == 0, odd[ch]).otherwise(even[ch])), F.lit(0), lambda a, x: a + x)
    shape = F.rlike(raw, F.lit(r"^[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]$"))
    return F.coalesce(F.when(shape, F.char(total % 26 + 65) == F.substring(raw, 16, 1)), F.lit(False))
