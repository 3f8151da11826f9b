"""Declarative tables: personal-data catalog, detection rules, entity map, phrase map; validated loaders."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    """Any fault of a configuration: missing, empty, malformed, unknown key, out of range, duplicate, orphan type."""


# --- fixed values -----------------------------------------------------------------------
# These tables are what results depend on; ids, patterns, confidences and wordings are given.

DETECTOR_KINDS = ("regex", "ner", "ai")
LEVELS = ("single_source", "double_confirmed", "conflicting", "ai_discovered")
ASSOCIATION_SOURCES = ("manual", "rule")
MAPPING_STATES = ("proposed", "confirmed")
DATE_SOURCES = ("content_metadata", "file_mtime")

#: id, label, frameworks, special category
CATALOG = (
    ("email", "Email address", ("gdpr", "nlpd"), False),
    ("phone", "Phone number", ("gdpr", "nlpd"), False),
    ("iban", "IBAN", ("gdpr", "nlpd"), False),
    ("credit_card", "Credit card number", ("gdpr", "nlpd", "pci_dss"), False),
    ("swiss_avs", "Swiss AVS", ("nlpd",), False),
    ("ip_address", "IP address", ("gdpr", "nlpd"), False),
    ("person_name", "Person's name", ("gdpr", "nlpd"), False),
    ("address", "Address", ("gdpr", "nlpd"), False),
    ("date_of_birth", "Date of birth", ("gdpr", "nlpd"), False),
    ("italian_id", "Italian tax code (codice fiscale)", ("gdpr",), False),
    ("health_data", "Health related data", ("gdpr", "nlpd"), True),
)

#: rule id, type, pattern, base confidence
GENERIC_RULES = (
    ("email", "email", r"\b((?!\.)[\w\-_.]*[^.])(@\w+)(\.\w+(\.\w+)?[^.\W])\b", 0.7),
    ("iban", "iban", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Za-z0-9]){11,30}\b", 0.6),
    ("credit_card", "credit_card", r"\b(?:\d[ -]?){13,19}\b", 0.5),
    ("ip_address", "ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.5),
    ("italian_id", "italian_id", r"\b[A-Z]{6}[0-9]{2}[ABCDEHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", 0.7),
)
CUSTOM_RULES = (("swiss_avs", "swiss_avs", r"\b756\.?\d{4}\.?\d{4}\.?\d{2}\b", 0.6),)

#: what an entity of the recognition engine means
ENTITY_MAP = (
    ("EMAIL_ADDRESS", "email"),
    ("PHONE_NUMBER", "phone"),
    ("IBAN_CODE", "iban"),
    ("CREDIT_CARD", "credit_card"),
    ("IP_ADDRESS", "ip_address"),
    ("IT_FISCAL_CODE", "italian_id"),
    ("PERSON", "person_name"),
    ("LOCATION", "address"),
    ("DATE_TIME", "date_of_birth"),
    ("MEDICAL_CONDITION", "health_data"),
)
#: label, type, threshold
NER_LABELS = (("person", "person_name", 0.5), ("full address", "address", 0.5), ("date of birth", "date_of_birth", 0.6), ("phone number", "phone", 0.5))
#: recognizers of the engine that count as ner; all others are patterns
NER_RECOGNIZERS = ("SpacyRecognizer", "StanzaRecognizer", "TransformersRecognizer", "GLiNERRecognizer")

#: phrases of a register and the types they stand for, in order
PHRASES = {
    "nome": ("person_name",),
    "cognome": ("person_name",),
    "nominativo": ("person_name",),
    "generalità": ("person_name",),
    "name": ("person_name",),
    "names": ("person_name",),
    "last name": ("person_name",),
    "last names": ("person_name",),
    "first name": ("person_name",),
    "surname": ("person_name",),
    "full name": ("person_name",),
    "indirizzo": ("address",),
    "residenza": ("address",),
    "domicilio": ("address",),
    "indirizzo di residenza": ("address",),
    "indirizzo postale": ("address",),
    "addresses": ("address",),
    "address": ("address",),
    "postal address": ("address",),
    "residential address": ("address",),
    "email": ("email",),
    "e-mail": ("email",),
    "pec": ("email",),
    "posta elettronica": ("email",),
    "indirizzo email": ("email",),
    "indirizzo di posta elettronica": ("email",),
    "email address": ("email",),
    "telefono": ("phone",),
    "cellulare": ("phone",),
    "numero di telefono": ("phone",),
    "recapito telefonico": ("phone",),
    "phone number": ("phone",),
    "mobile": ("phone",),
    "iban": ("iban",),
    "coordinate bancarie": ("iban",),
    "conto corrente": ("iban",),
    "conto bancario": ("iban",),
    "estremi bancari": ("iban",),
    "dati bancari": ("iban",),
    "bank account": ("iban",),
    "bank account details": ("iban",),
    "carta di credito": ("credit_card",),
    "numero di carta di credito": ("credit_card",),
    "credit card": ("credit_card",),
    "credit card number": ("credit_card",),
    "data di nascita": ("date_of_birth",),
    "nascita": ("date_of_birth",),
    "date of birth": ("date_of_birth",),
    "codice fiscale": ("italian_id",),
    "tax code": ("italian_id",),
    "fiscal code": ("italian_id",),
    "avs": ("swiss_avs",),
    "numero avs": ("swiss_avs",),
    "numero di previdenza sociale": ("swiss_avs",),
    "social security number": ("swiss_avs",),
    "social security numbers": ("swiss_avs",),
    "ip": ("ip_address",),
    "indirizzo ip": ("ip_address",),
    "ip address": ("ip_address",),
    "dati sanitari": ("health_data",),
    "dati relativi alla salute": ("health_data",),
    "informazioni mediche": ("health_data",),
    "cartella clinica": ("health_data",),
    "diagnosi": ("health_data",),
    "health data": ("health_data",),
    "contatti": ("email", "phone"),
    "recapiti": ("email", "phone"),
    "dati anagrafici": ("person_name", "date_of_birth"),
}

#: months of a unit of retention, in English, Italian and French
RETENTION_UNITS = {"year": 12, "years": 12, "anno": 12, "anni": 12, "an": 12, "ans": 12, "month": 1, "months": 1, "mese": 1, "mesi": 1, "mois": 1}

SHEET_NAME_LABEL = "Name of the processing operation"
SHEET_PURPOSE_LABEL = "Main purpose"
SHEET_SECTION = "Categories of personal data"

SUFFIXES = (".pdf", ".docx", ".txt", ".xlsx", ".xlsm", ".ods", ".doc")
# --- end of fixed values ----------------------------------------------------------------

#: Flags of a rule and the inline letters that say the same; ASCII drops the default U.
FLAGS = {"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s", "UNICODE": "U", "VERBOSE": "x", "ASCII": ""}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pii_type: str
    pattern: str
    base_confidence: float = 0.6
    flags: tuple[str, ...] = ("UNICODE",)

    @property
    def needs(self) -> str:
        """Text that every match of a known pattern holds; looking for it first spares most texts the pattern."""
        return _NEEDS.get(self.pattern, "")

    @property
    def java(self) -> str:
        """The pattern with its flags inline."""
        letters = "".join(sorted({FLAGS[f] for f in self.flags} - {""} | (set() if "ASCII" in self.flags else {"U"})))
        return f"(?{letters}){self.pattern}" if letters else self.pattern


_NEEDS = {GENERIC_RULES[0][2]: "@", GENERIC_RULES[3][2]: ".", CUSTOM_RULES[0][2]: "756"}


def rules(table=GENERIC_RULES) -> tuple[Rule, ...]:
    return tuple(Rule(*row) for row in table)


DEFAULT_RULES = rules(GENERIC_RULES + CUSTOM_RULES)


def phrase_table() -> list[tuple[str, list[str], int]]:
    """(phrase, types, order) of the phrase map."""
    return [(p, list(types), i) for i, (p, types) in enumerate(PHRASES.items())]


def catalog_ids() -> tuple[str, ...]:
    return tuple(row[0] for row in CATALOG)


def catalog_frame(spark: SparkSession) -> DataFrame:
    rows = [(i, label, list(fw), special) for i, label, fw, special in CATALOG]
    return spark.createDataFrame(rows, "id string, label string, frameworks array<string>, special_category boolean")


def rules_frame(spark: SparkSession, table: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    rows = [(i, r.rule_id, r.pii_type, r.java, list(r.flags), r.base_confidence) for i, r in enumerate(table)]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, pii_type string, pattern string, flags array<string>, base_confidence double")


# --- loaders ----------------------------------------------------------------------------


@dataclass(frozen=True)
class _Field:
    kind: type | tuple[type, ...]
    required: bool = True
    default: object = None
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class _Table:
    """The layout of one file: the top key and the fields of its rows."""

    key: str
    unique: str
    fields: dict[str, _Field] = field(default_factory=dict)


_SHARE = _Field((int, float), False, 0.6, 0.0, 1.0)
CATALOG_FILE = _Table("categories", "id", {"id": _Field(str), "label": _Field(str), "frameworks": _Field(list, False, ()), "special_category": _Field(bool, False, False), "description": _Field(str, False)})
RULES_FILE = _Table("rules", "rule_id", {"rule_id": _Field(str), "pii_type": _Field(str), "pattern": _Field(str), "flags": _Field(list, False, ("UNICODE",)), "base_confidence": _SHARE})
ENTITIES_FILE = _Table("entities", "entity", {"entity": _Field(str), "pii_type": _Field(str)})
LABELS_FILE = _Table("labels", "label", {"label": _Field(str), "pii_type": _Field(str), "threshold": _Field((int, float), False, 0.5, 0.0, 1.0)})


def read_yaml(path: str | Path) -> object:
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not data:
        raise ConfigError(f"{path}: empty")
    return data


def load_table(path: str | Path, layout: _Table, known_types: tuple[str, ...] | None = None) -> list[dict]:
    """The rows of a YAML table, checked against its layout and, for types, against the catalog."""
    data = read_yaml(path)
    if not isinstance(data, dict) or set(data) != {layout.key} or not isinstance(data[layout.key], list):
        raise ConfigError(f"{path}: the only key must be {layout.key!r}, a list")
    out, seen = [], set()
    for n, row in enumerate(data[layout.key]):
        at = f"{path}, row {n}"
        if not isinstance(row, dict):
            raise ConfigError(f"{at}: not a mapping")
        if extra := set(row) - set(layout.fields):
            raise ConfigError(f"{at}: unknown keys {sorted(extra)}")
        made = {}
        for name, f in layout.fields.items():
            value = row.get(name, f.default)
            if name not in row and f.required:
                raise ConfigError(f"{at}: {name} is missing")
            if name in row and (not isinstance(value, f.kind) or isinstance(value, bool) and f.kind is not bool):
                raise ConfigError(f"{at}: {name} has the wrong type")
            if f.low is not None and not f.low <= value <= f.high:
                raise ConfigError(f"{at}: {name} is out of range")
            made[name] = tuple(value) if isinstance(value, list) else value
        if made[layout.unique] in seen:
            raise ConfigError(f"{at}: duplicate {made[layout.unique]!r}")
        seen.add(made[layout.unique])
        if known_types is not None and made["pii_type"] not in known_types:
            raise ConfigError(f"{at}: unknown type {made['pii_type']!r}")
        for flag in made.get("flags", ()):
            if flag not in FLAGS:
                raise ConfigError(f"{at}: unknown flag {flag!r}")
        if "pattern" in made:
            try:
                re.compile(made["pattern"])
            except re.error as e:
                raise ConfigError(f"{at}: {e}") from e
        out.append(made)
    return out


def load_rules(path: str | Path, known_types: tuple[str, ...] | None = None) -> tuple[Rule, ...]:
    return tuple(Rule(r["rule_id"], r["pii_type"], r["pattern"], float(r["base_confidence"]), tuple(r["flags"])) for r in load_table(path, RULES_FILE, known_types or catalog_ids()))


def load_phrases(path: str | Path, known_types: tuple[str, ...] | None = None) -> list[tuple[str, list[str], int]]:
    data = read_yaml(path)
    known = set(known_types or catalog_ids())
    if not isinstance(data, dict) or set(data) != {"mappings"} or not isinstance(data["mappings"], dict):
        raise ConfigError(f"{path}: the only key must be 'mappings', a mapping")
    out = []
    for i, (phrase, types) in enumerate(data["mappings"].items()):
        if not isinstance(types, list) or (bad := [t for t in types if t not in known]):
            raise ConfigError(f"{path}: {phrase!r} has unknown types {bad if isinstance(types, list) else types}")
        out.append((" ".join(str(phrase).lower().split()), types, i))
    return out


def load_cases(path: str | Path, known_types: tuple[str, ...] | None = None) -> list[tuple[str, list[str]]]:
    """Mapper evaluation cases: (text, expected types)."""
    known = set(known_types or catalog_ids())
    layout = _Table("cases", "text", {"text": _Field(str), "expected": _Field(list, False, ())})
    out = [(r["text"], list(r["expected"])) for r in load_table(path, layout)]
    for text, expected in out:
        if bad := [t for t in expected if t not in known]:
            raise ConfigError(f"{path}: {text!r} expects unknown types {bad}")
    return out
