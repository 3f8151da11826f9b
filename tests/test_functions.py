import random
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import checks, dates, phrases
from tessera.functions import text as tx

LITERALS = [
    "perché.rossi@società.it, x a.b@c.de", "IT60X0542811101000000123456 and CH93 0076 2011 6238 5295 7", "4111 1111 1111 1111", "10.0.0.1 999.1.2.3", "RSSMRA85T10A562S", "756.9217.0769.85", "",
    "😀 é 192.168.1.1 😀 mario@example.com.", "a@b.co", "....@x.yz", None,
]


def test_rule_spans_equal_finditer(spark, sf):
    texts = LITERALS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for rule in config.DEFAULT_RULES:
        got = {r.i: [(s.start, s.end, s.text) for s in r.s] for r in df.select("i", tx.spans("t", rule.java).alias("s")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(m.start(), m.end(), m[0]) for m in re.finditer(rule.pattern, t or "")], (rule.rule_id, t)


def test_flags():
    assert config.Rule("x", "email", "a", 0.5, ("IGNORECASE", "ASCII")).java == "(?i)a"
    assert config.Rule("x", "email", "a").java == "(?U)a"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize(spark):
    cases = {"a  \n\n\n\nb\r\nc\n": "a\n\nb\nc", "\x1c\u00a0 x \u2003\n": "x", "\r\r\r\ra": "a", "": "", "a \t\r\n b": "a\n b"}
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select(tx.normalize("t").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_windows_and_occurrences(spark):
    rng = random.Random(0)
    rows = [("".join(rng.choices("ab.\\E(x é", k=n)), v) for n in (0, 1, 5, 39, 40, 41, 100) for v in ("a", "aa", "\\E", "é", "zz", "ab.")]
    got = spark.createDataFrame(rows, "t string, v string").select("t", "v", tx.windows("t", 10, 4).alias("w"), tx.occurrences("t", "v").alias("o")).collect()
    for r in got:
        want, k = [], 0
        while r.t:
            want.append((k, k * 6, r.t[k * 6 : k * 6 + 10]))
            if k * 6 + 10 >= len(r.t):
                break
            k += 1
        assert [tuple(w) for w in r.w] == want
        assert r.o == [i for i in range(len(r.t)) if r.t.startswith(r.v, i)]
    with pytest.raises(ValueError):
        tx.windows("t", 10, 10)


def test_annotations(spark):
    a = one(spark, tx.annotated(F.lit("Hi {{person_name:Ada\nLovelace}} at {{ email :a@b.it}}!")))
    assert a.text == "Hi Ada\nLovelace at a@b.it!"
    assert [(s.start, s.end, s.pii_type) for s in a.spans] == [(3, 15, "person_name"), (19, 25, "email")]


def test_checksums(spark):
    ok = {"DE89 3704 0044 0532 0130 00": True, "DE89 3704 0044 0532 0130 01": False, "CH9300762011623852957": True, "x!": False, "": False}
    rows = spark.createDataFrame(list(ok.items()), "t string, want boolean").select(checks.iban_valid("t").alias("g"), "want").collect()
    assert all(r.g == r.want for r in rows)
    assert [one(spark, checks.luhn(F.lit(x))) for x in ("4111 1111 1111 1111", "4111-1111-1111-1112", "")] == [True, False, True]
    assert one(spark, checks.ean13_digit(F.lit("756921707698"))) == 5
    assert [one(spark, checks.avs_valid(F.lit(x))) for x in ("756.9217.0769.85", "756.9217.0769.84", "x")] == [True, False, False]
    assert [one(spark, checks.tax_code_valid(F.lit(x))) for x in ("RSSMRA85T10A562S", "RSSMRA85T10A562A", "RSS")] == [True, False, False]


@given(st.text("0123456789", min_size=1, max_size=19))
@settings(max_examples=25, deadline=None)
def test_luhn_property(spark, digits):
    total = sum((d * 2 - 9 if d > 4 else d * 2) if (len(digits) - i) % 2 == 0 else d for i, d in enumerate(map(int, digits)))
    assert one(spark, checks.luhn(F.lit(digits))) == (total % 10 == 0)


RETENTION = {"5 years from the payment of the salary": 60, "2 anni": 24, "6 months": 6, "24 mesi": 24, "1 year": 12, "5 ans à compter du versement du salaire": 60, "1 an": 12, "6 mois": 6, "2 anni e 6 mesi": 24, "a criterio": None, "N/A": None, "": None, "1 annata": None}


def test_retention(spark):
    rows = spark.createDataFrame(list(RETENTION.items()), "t string, m int").select(phrases.retention_months("t").alias("g"), "m", "t").collect()
    assert all(r.g == r.m for r in rows), rows


CASES = [
    ("Last names, names and addresses", ["person_name", "address"]), ("Bank account details", ["iban"]), ("dati anagrafici", ["person_name", "date_of_birth"]), ("nome, cognome e indirizzo di residenza", ["person_name", "address"]),
    ("indirizzo email e numero di telefono", ["email", "phone"]), ("estremi della carta di credito", ["credit_card"]), ("indirizzo IP del dispositivo", ["ip_address"]), ("luogo e data di nascita", ["date_of_birth"]), ("fotografia del dipendente", []), ("partita IVA", []),
]


def test_phrases(spark):
    rows = spark.createDataFrame(CASES, "t string, want array<string>").select("t", "want", F.array_distinct(F.flatten(F.transform(phrases.map_categories("t"), lambda x: x["pii_types"]))).alias("g")).collect()
    assert all(r.g == r.want for r in rows), rows
    assert [r.text for r in one(spark, phrases.map_categories(F.lit("e-mail; pec / nome")))] == ["-mail", "pec", "nome"]


def test_greedy_phrases_take_words_once(spark):
    table = [("a b", ["email"], 0), ("b c", ["phone"], 1), ("c", ["iban"], 2), ("a", ["address"], 3)]
    assert one(spark, phrases.resolve(F.lit("A  b c a"), table)) == ["email", "iban", "address"]
    assert one(spark, phrases.resolve(F.lit("b c"), table)) == ["phone"]


def test_pdf_dates(spark):
    cases = {"D:20190312101500+01'00'": (9, 15), "D:20190312101500-05'00'": (15, 15), "D:20190312101500Z": (10, 15), "D:20190312": (0, 0), "D:201903121015": (10, 15), "20190312101500": (10, 15)}
    for raw, (h, m) in cases.items():
        assert one(spark, dates.pdf_date(F.lit(raw)).cast("string")) == f"2019-03-12 {h:02}:{m:02}:00", raw
    for raw in ("", "not a date", "D:2019", "D:20191332000000Z"):
        assert one(spark, dates.pdf_date(F.lit(raw))) is None


def test_reference_date_and_age(spark):
    now, old = F.lit("2024-06-01").cast("timestamp"), F.lit("2023-01-01").cast("timestamp")
    cand = lambda *v: F.array(*[F.struct(F.lit(f"f{i}").alias("field"), F.lit(x).cast("timestamp").alias("value")) for i, x in enumerate(v)])
    pick = lambda c: one(spark, dates.reference_date(c, old, now))
    assert pick(cand("1980-01-01", "2020-02-02")).field == "f1"
    assert pick(cand("2024-06-01 12:00:00")).source == "content_metadata"
    assert pick(cand("2024-06-03")).source == "file_mtime" and pick(F.lit(None).cast("array<struct<field:string,value:timestamp>>")).field == "fs:mtime"
    age = lambda s: one(spark, dates.age_months(F.lit(s).cast("timestamp"), now))
    assert (age("2024-07-01"), age("2024-05-02"), age("2024-05-01"), age("2023-06-01")) == (0, 0, 1, 12)


def test_config_errors(tmp_path):
    def load(text, layout=config.RULES_FILE, known=None):
        (tmp_path / "x.yaml").write_text(text)
        return config.load_table(tmp_path / "x.yaml", layout, known)

    good = "rules:\n- {rule_id: a, pii_type: email, pattern: x, base_confidence: 0.5}\n"
    assert load(good, known=("email",))[0]["flags"] == ("UNICODE",)
    for bad in ("", "rules: 3", "other: []", good.replace("0.5", "1.5"), good.replace("pattern: x", "pattern: '('"), good + good.split("\n")[1], good.replace("x,", "x, checksum: luhn,"), good.replace("x,", "x, flags: [NOPE],"), good.replace("rule_id: a, ", ""), "rules: [1"):
        with pytest.raises(config.ConfigError):
            load(bad, known=("email",))
    with pytest.raises(config.ConfigError):
        load(good, known=("phone",))
    with pytest.raises(config.ConfigError):
        config.load_table(tmp_path / "none.yaml", config.RULES_FILE)
    (tmp_path / "p.yaml").write_text("mappings:\n  Bank  Account: [iban]\n")
    assert config.load_phrases(tmp_path / "p.yaml") == [("bank account", ["iban"], 0)]
    (tmp_path / "c.yaml").write_text("cases:\n- {text: x, expected: [nope]}\n")
    with pytest.raises(config.ConfigError):
        config.load_cases(tmp_path / "c.yaml")


def test_dates_are_utc(spark):
    assert one(spark, dates.pdf_date(F.lit("D:20190312101500Z"))).replace(tzinfo=None) == datetime(2019, 3, 12, 10, 15)
