"""A generator of annotated documents: valid identifiers in templates, reproducible by seed and row number.

Rows are made where they stand (``mapInPandas`` over a range), so a corpus of any size needs no driver.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Names and places for invented documents.
NAMES = ("Anna", "Luca", "Sofia", "Marco", "Elena", "Paul", "Marie", "Jonas")
FAMILY = ("Keller", "Bianchi", "Moser", "Dubois", "Ferrari", "Meier", "Rossi", "Weber")
STREETS = ("Via Roma", "Bahnhofstrasse", "Rue du Lac", "High Street")
CITIES = ("Lugano", "Milano", "Bern", "Lyon")
CONDITIONS = ("asthma", "diabetes", "hypertension", "migraine")

_VALUES = {c: i for i, c in enumerate("0123456789")} | {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def _luhn_digit(body: str) -> str:
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


class Values:
    """One value of each type a call, from one seed."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def _digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def person_name(self) -> str:
        return f"{self.r.choice(NAMES)} {self.r.choice(FAMILY)}"

    def email(self) -> str:
        return f"{self.r.choice(NAMES)}.{self.r.choice(FAMILY)}{self.r.randrange(100)}@example.org".lower()

    def phone(self) -> str:
        return f"+41 {self.r.randrange(10, 99)} {self._digits(3)} {self._digits(2)} {self._digits(2)}"

    def iban(self) -> str:
        body = self._digits(17)
        check = 98 - int(body + "121700") % 97  # C = 12, H = 17
        raw = f"CH{check:02}{body}"
        return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4))

    def credit_card(self) -> str:
        body = "4" + self._digits(14)
        raw = body + _luhn_digit(body)
        return " ".join(raw[i : i + 4] for i in range(0, 16, 4))

    def swiss_avs(self) -> str:
        body = "756" + self._digits(9)
        check = -sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(body)) % 10
        return f"756.{body[3:7]}.{body[7:11]}.{body[11]}{check}"

    def ip_address(self) -> str:
        return ".".join(str(self.r.randrange(1, 255)) for _ in range(4))

    def address(self) -> str:
        return f"{self.r.choice(STREETS)} {self.r.randrange(1, 200)}, {self.r.choice(CITIES)}"

    def date_of_birth(self) -> str:
        return f"{self.r.randrange(1, 29):02}.{self.r.randrange(1, 13):02}.{self.r.randrange(1940, 2005)}"

    def italian_id(self) -> str:
        from ..functions.checks import _ODD

        letters = "".join(self.r.choices("BCDFGLMNPRST", k=6))
        raw = f"{letters}{self._digits(2)}{self.r.choice('ABCDEHLMPRST')}{self.r.randrange(1, 29):02}{self.r.choice('ABCDEFGHIL')}{self._digits(3)}"
        total = sum(_ODD[c] if i % 2 == 0 else _VALUES[c] for i, c in enumerate(raw))
        return raw + chr(65 + total % 26)

    def health_data(self) -> str:
        return self.r.choice(CONDITIONS)


TEMPLATES = (
    "Dear {person_name},\nplease confirm by {email} or {phone}.\n",
    "Payment from {iban}, card {credit_card}.\nInsured no. {swiss_avs}.\n",
    "Patient {person_name}, born {date_of_birth}, lives at {address}: {health_data}.\nTax code {italian_id}.\n",
    "Login from {ip_address} by {email}.\n",
    "Minutes of the meeting: nothing personal was said.\n",
)


def annotated_text(seed: int, paragraphs: int) -> str:
    """Some paragraphs with ``{{type:value}}`` markers."""
    v = Values(seed)
    out = []
    for _ in range(paragraphs):
        t = v.r.choice(TEMPLATES)
        for kind in [x.partition("}")[0] for x in t.split("{")[1:]]:
            t = t.replace("{" + kind + "}", "{{" + kind + ":" + getattr(v, kind)() + "}}", 1) if "{{" + kind not in t else t
        out.append(t)
    return "\n".join(out)


def corpus(spark: SparkSession, size: int, seed: int = 42, paragraphs: int = 4) -> DataFrame:
    """``document_id, annotated`` of ``size`` documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"document_id": [f"doc_{i:08}" for i in pdf["id"]], "annotated": [annotated_text(seed * 1_000_003 + i, paragraphs) for i in pdf["id"]]})

    return spark.range(size).mapInPandas(run, "document_id string, annotated string")
