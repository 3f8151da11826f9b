import io
import json
import random
import re
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import config, schemas
from tessera.functions.text import annotate
from tessera.operators import comply, detect, freshness, fuse, register, registry, rules, score
from tessera.plans import jobs
from tessera.sources import corpora, files

C = "array<" + schemas.CANDIDATE + ">"


def cand(start, end, pii_type, confidence=0.6, who="regex.x", kind="regex"):
    return (start, end, "t", pii_type, confidence, who, kind, None, None)


def ner(start, end, pii_type, confidence=0.8):
    return cand(start, end, pii_type, confidence, "presidio.ner", "ner")


def ai(start, end, pii_type, who="ai.llm"):
    return cand(start, end, pii_type, 0.6, who, "ai")


def plain_fuse(r, n, a, ratio=0.5, bonus=0.15):
    """The rules of fusion, one document, in plain loops."""

    def iou(x, y):
        inter = min(x[1], y[1]) - max(x[0], y[0])
        return inter / (max(x[1], y[1]) - min(x[0], y[0])) if inter > 0 else 0.0

    def best(x, ys, skip=()):
        ranked = [(-iou(x, y), j) for j, y in enumerate(ys) if j not in skip and iou(x, y) >= ratio]
        return min(ranked)[1] if ranked else None

    made, used = [], set()
    for x in r:
        j = best(x, n, used)
        if j is None:
            made.append([*x[:2], x[3], x[4], "single_source", [x[5]]])
            continue
        used.add(j)
        y = n[j]
        if x[3] == y[3]:
            made.append([*x[:2], x[3], min(1.0, max(x[4], y[4]) + bonus), "double_confirmed", [x[5], y[5]]])
        else:
            made += [[*z[:2], z[3], z[4], "conflicting", [z[5]]] for z in (x, y)]
    made += [[*y[:2], y[3], y[4], "single_source", [y[5]]] for j, y in enumerate(n) if j not in used]
    targets = list(made)
    for x in a:
        j = best(x, targets)
        if j is None:
            made.append([*x[:2], x[3], x[4], "ai_discovered", [x[5]]])
        elif targets[j][2] == x[3]:
            if x[5] not in targets[j][5]:
                targets[j][5].append(x[5])
                targets[j][3] = min(1.0, targets[j][3] + bonus)
                targets[j][4] = "double_confirmed" if targets[j][4] == "single_source" else targets[j][4]
        else:
            targets[j][4] = "conflicting" if targets[j][4] == "single_source" else targets[j][4]
            made.append([*x[:2], x[3], x[4], "conflicting", [x[5]]])
    return [(m[0], m[1], m[2], round(m[3], 6), m[4], m[5]) for m in made]


def run_fuse(spark, docs, **options):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], f"i int, r {C}, n {C}, a {C}")
    out = df.select("i", fuse.fuse(F.col("r"), F.col("n"), F.col("a"), **options).alias("m")).collect()
    return [[(m.start, m.end, m.pii_type, round(m.confidence, 6), m.level, [s.detector_id for s in m.sources]) for m in r.m] for r in sorted(out, key=lambda r: r.i)]


def test_fusion_cases(spark):
    i, p, ad = "iban", "person_name", "address"
    docs = [
        ([cand(0, 10, i)], [ner(0, 10, i)], []), ([cand(0, 10, i, 0.95)], [ner(0, 10, i, 0.9)], []), ([cand(2, 12, i)], [ner(0, 14, i)], []), ([cand(0, 10, p)], [ner(0, 10, ad)], []),
        ([cand(0, 10, i)], [ner(8, 20, i)], []), ([cand(0, 10, i)], [ner(0, 5, i), ner(0, 10, i)], []), ([cand(0, 10, i), cand(0, 10, i)], [ner(0, 10, i)], []),
        ([cand(0, 10, i)], [], [ai(50, 60, "health_data")]), ([cand(0, 10, i)], [], [ai(0, 10, i)]), ([cand(0, 10, i)], [ner(0, 10, i)], [ai(0, 10, i)]), ([cand(0, 10, p)], [ner(0, 10, ad)], [ai(0, 10, p)]),
        ([cand(0, 10, p)], [], [ai(0, 10, ad)]), ([cand(0, 10, i)], [ner(0, 10, i)], [ai(0, 10, p)]), ([cand(0, 10, i)], [], [ai(8, 20, i)]), ([], [], []), (None, None, None),
    ]
    got = run_fuse(spark, docs)
    assert got == [plain_fuse(r or [], n or [], a or []) for r, n, a in docs]
    assert got[0] == [(0, 10, i, 0.95, "double_confirmed", ["regex.x", "presidio.ner"])]
    assert [m[4] for m in got[4]] == ["single_source", "single_source"] and [m[4] for m in got[11]] == ["conflicting", "conflicting"]
    assert [m[4] for m in run_fuse(spark, [docs[4]], ratio=0.05)[0]] == ["double_confirmed"]
    for bad in ({"ratio": -0.1}, {"bonus": 1.1}):
        with pytest.raises(ValueError):
            fuse.fuse(F.col("r"), F.col("n"), **bad)


def test_fusion_random(spark):
    rng = random.Random(3)

    def some(k, make, *who):
        out = []
        for _ in range(rng.randrange(k)):
            s = rng.randrange(30)
            out.append(make(s, s + rng.randrange(1, 12), rng.choice(["a", "b"]), *([rng.choice(who)] if who else [])))
        return out

    docs = [(some(6, cand), some(6, ner), some(5, ai, "ai.1", "ai.2")) for _ in range(400)]
    assert run_fuse(spark, docs) == [plain_fuse(*d) for d in docs]


def test_score_cases(spark):
    cases = [
        ([(0, 10, "iban")], [(0, 10, "iban")], (1, 0, 0)), ([(0, 10, "credit_card")], [(0, 10, "iban")], (0, 1, 1)), ([], [(0, 10, "iban")], (0, 0, 1)), ([(0, 10, "iban")], [], (0, 1, 0)),
        ([(0, 4, "iban")], [(0, 10, "iban")], (0, 1, 1)), ([(0, 6, "iban")], [(0, 10, "iban")], (1, 0, 0)), ([(0, 10, "iban"), (0, 9, "iban")], [(0, 10, "iban")], (1, 1, 0)), ([(0, 10, "iban")], [(0, 10, "iban"), (0, 9, "iban")], (1, 0, 1)),
        ([(0, 20, "iban"), (30, 40, "email"), (50, 62, "credit_card")], [(0, 20, "iban"), (30, 45, "email"), (50, 62, "phone")], (2, 1, 1)),
    ]
    side = lambda k: spark.createDataFrame([(str(d), i, *s) for d, c in enumerate(cases) for i, s in enumerate(c[k])], "document_id string, ord int, start int, end int, pii_type string")
    counts = score.span_counts(side(0), side(1))
    got = {r.document_id: (r.tp, r.fp, r.fn) for r in counts.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
    assert got == {str(d): c[2] for d, c in enumerate(cases)}
    last = score.report(counts.where("document_id = '8'")).where("pii_type = 'OVERALL'").first()
    assert (last.precision, last.recall, last.f1) == pytest.approx((2 / 3, 2 / 3, 2 / 3))


def test_score_random(spark):
    """Ties go to the highest places."""
    rng = random.Random(5)
    docs = [[[(s := rng.randrange(12), s + rng.randrange(1, 8), rng.choice("ab")) for _ in range(rng.randrange(6))] for _ in range(2)] for _ in range(200)]

    def plain(d, g):
        def iou(x, y):
            inter = min(x[1], y[1]) - max(x[0], y[0])
            return inter / (max(x[1], y[1]) - min(x[0], y[0])) if inter > 0 else 0.0

        ud, ug = set(), set()
        for _, i, j in sorted(((iou(x, y), i, j) for i, x in enumerate(d) for j, y in enumerate(g) if x[2] == y[2] and iou(x, y) >= 0.5), reverse=True):
            if i not in ud and j not in ug:
                ud.add(i)
                ug.add(j)
        return (len(ud), len(d) - len(ud), len(g) - len(ug))

    side = lambda k: spark.createDataFrame([(str(n), i, *s) for n, c in enumerate(docs) for i, s in enumerate(c[k])], "document_id string, ord int, start int, end int, pii_type string")
    got = {r.document_id: (r.tp, r.fp, r.fn) for r in score.span_counts(side(0), side(1)).groupBy("document_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
    assert got == {str(n): plain(*c) for n, c in enumerate(docs) if c[0] or c[1]}


def test_value_and_type_scores(spark):
    v = "document_id string, pii_type string, value string"
    d = spark.createDataFrame([("a", "person_name", "Mario\n  Rossi"), ("b", "iban", "X"), ("b", "iban", "X"), ("c", "iban", "Y")], v)
    g = spark.createDataFrame([("a", "person_name", "mario rossi"), ("b", "iban", "x"), ("d", "iban", "Y"), ("e", None, None)], v)
    total = lambda c: tuple(c.agg(*[F.sum(x) for x in ("tp", "fp", "fn")]).first())
    assert total(score.value_counts(d, g.where("value is not null"))) == (2, 2, 1)
    assert total(score.type_counts(d, g)) == (2, 1, 1)
    tax = score.extraction_tax(d, d, g.where("value is not null")).first()
    assert tax.tax == 0
    cases = spark.createDataFrame([(["a", "b"], ["a"]), ([], ["c"])], "got array<string>, expected array<string>")
    assert tuple(score.mapper_counts(cases).select("tp", "fp", "fn").first()) == (1, 1, 1)


def test_checks_and_sampling(spark):
    m = spark.createDataFrame([("a.txt", "scannable"), ("b.txt", "scannable"), ("c.png", "skipped")], "document_id string, expectation string")
    got = {(r.document_id, r.fault) for r in score.handling(m, spark.createDataFrame([("a.txt",), ("c.png",)], "document_id string")).collect()}
    assert got == {("b.txt", "missing"), ("c.png", "unexpected")}
    e, o = spark.createDataFrame([("HR",), ("IT",)], "prefix string"), spark.createDataFrame([("HR/x",), ("HRoom/x",)], "document_id string")
    assert {(r.what, r.fault) for r in score.retention_check(e, o).collect()} == {("IT", "silent"), ("HRoom/x", "unexpected")}
    ids = [f"d{i:02}" for i in range(30)]
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(ids, 30)], "document_id string")
    assert sorted(r[0] for r in score.sample_documents(df, 7, 42).collect()) == sorted(ids[k] for k in random.Random(42).sample(range(30), 7))
    with pytest.raises(ValueError):
        score.sample_documents(df, 0)


# --- language model ---------------------------------------------------------------------


def scripted(answers):
    def backend():
        def chat(prompt):
            for key, value in answers.items():
                if key in prompt:
                    if value is None:
                        raise OSError("down")
                    return value
            return "[]"

        return chat

    return backend


def test_llm(spark):
    item = lambda **k: json.dumps([k])
    docs = {
        "one": ("Signor: Mario Rossi qui", "prose " + item(value="Mario Rossi", pii_type="person_name", rationale="r") + " end", [(8, 19)]),
        "two": ("Rossi aaa Rossi", item(value="Rossi", pii_type="person_name"), [(0, 5), (10, 15)]),
        "type": ("Uno", item(value="Uno", pii_type="nope"), []), "absent": ("Due", item(value="Zzz", pii_type="email"), []), "number": ("5 Tre", item(value=5, pii_type="email"), []),
        "broken": ("Quattro", "[{", None), "object": ("Cinque", "[1, 2]", None), "down": ("Sei", None, None),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in docs.items()], "document_id string, text string")
    backend = scripted({t: a for t, a, _ in docs.values()})
    got = {}
    for r in detect.llm_detect(df, backend).collect():
        got.setdefault(r.document_id, []).append((r.start, r.end))
        assert r.confidence == 0.6 and r.detector_kind == "ai"
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, (_, _, w) in docs.items() if w}
    health = detect.chunk_health(detect.ask(detect.windows(df), backend)).first()
    assert (health.chunks_seen, health.chunks_failed) == (8, 3)
    over = spark.createDataFrame([("w", "0123456789abRoss")], "document_id string, text string")
    rows = detect.llm_detect(over, scripted({"Ross": '[{"value": "Ross", "pii_type": "email"}]'}), 10, 4).collect()
    assert [(r.start, r.end) for r in rows] == [(12, 16)]


def test_ai_sampling(spark):
    import hashlib

    ids = [f"doc {i}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "document_id string")
    want = {i for i in ids if int.from_bytes(hashlib.blake2b(i.encode(), digest_size=8).digest(), "big") % 7 == 0}
    assert {r[0] for r in detect.ai_sample(df, 7).collect()} == want
    assert detect.ai_sample(df, 0).count() == 0 and detect.ai_sample(df, 1).count() == 200
    assert [detect.sampling_rate(x) for x in (None, "x", "-3", "5")] == [0, 0, 0, 5] and [detect.token_cap(x) for x in (None, "0", "x", "9")] == [1024, 1024, 1024, 9]


def test_engine_splits(spark):
    engine = lambda: lambda t: [(0, 3, "PERSON", 0.9, "SpacyRecognizer"), (0, 3, "EMAIL_ADDRESS", 0.5, "EmailRecognizer"), (0, 3, "NRP", 0.9, "SpacyRecognizer"), (2, 2, "PERSON", 0.9, "GLiNERRecognizer")]
    df = spark.createDataFrame([("d", "Ada x")], "document_id string, text string")
    found = detect.engine_found(df, engine)
    n, p = (found.select(F.inline(detect.engine_half("text", "found", ner))).collect() for ner in (True, False))
    assert [(r.pii_type, r.text, r.raw_label) for r in n] == [("person_name", "Ada", "PERSON")]
    assert [(r.pii_type, r.detector_id, r.raw_label) for r in p] == [("email", "pattern.composite", None)]
    bad = detect.regex_detect(df, [config.Rule("x", "email", "Ada")]).withColumn("end", F.lit(99))
    with pytest.raises(Exception, match="bad span"):
        detect.checked(bad, df).collect()


@pytest.mark.parametrize("with_ai", [False, True])
def test_engine_runs_once_a_document(spark, tmp_path, with_ai):
    calls = tmp_path / "calls"

    def engine():
        def recognize(text):
            with open(calls, "a") as f:
                f.write("x")
            return [(0, 3, "PERSON", 0.9, "SpacyRecognizer"), (4, 7, "EMAIL_ADDRESS", 0.5, "EmailRecognizer")]

        return recognize

    df = spark.createDataFrame([(str(i), f"Ada {i:03d} x") for i in range(20)], "document_id string, text string").repartition(3)
    backend = (lambda: lambda prompt: '[{"value": "Ada", "pii_type": "person_name", "rationale": ""}]') if with_ai else None
    got = jobs.scan_documents(df, engine=engine, backend=backend).collect()
    assert len(got) == 40 and sum(r.level == "double_confirmed" for r in got) == 20 * with_ai
    assert calls.read_text() == "x" * 20


# --- rules, verdicts --------------------------------------------------------------------


def test_folder_rules(spark):
    docs = spark.createDataFrame([(x,) for x in ("HR", "HR/contratti/mario.pdf", "HRoom/x.pdf", "payroll/HR/x.pdf", "hr/x")], "document_id string")
    r = spark.createDataFrame([("HR", ["payroll"]), ("/HR/contratti/ ", ["contracts", "payroll"]), ("legal", ["legal"])], "prefix string, activity_ids array<string>")
    got = {x.document_id: x.activity_ids for x in rules.inherited(docs, r).collect()}
    assert got == {"HR": ["payroll"], "HR/contratti/mario.pdf": ["payroll", "contracts"]}
    assert rules.matches(docs, spark.createDataFrame([("", ["x"])], r.schema)).count() == 5
    state = docs.withColumn("activity_ids", F.array(F.lit("o"))).withColumn("association_source", F.when(F.col("document_id") == "HR", "manual").when(F.col("document_id") == "HRoom/x.pdf", "rule"))
    once = rules.reconcile(state, r)
    assert tuple(rules.outcome_counts(once).first()) == (1, 1, 1, 2)
    again = rules.reconcile(once.drop("outcome"), r)
    cols = ["document_id", "activity_ids", "association_source"]
    assert sorted(again.select(cols).collect()) == sorted(once.select(cols).collect())


def now():
    return F.lit("2024-06-01").cast("timestamp")


def verdict(spark, declared, found, age=None, ids=None, proposed=False):
    """``declared``: (activity, types, months, state) rows."""
    acts = list(dict.fromkeys(d[0] for d in declared))
    a = spark.createDataFrame([(x, x, "") for x in acts], schemas.ACTIVITY)
    m = spark.createDataFrame([(i, d[0], "macro", "", d[2], i) for i, d in enumerate(declared)], schemas.MACRO)
    c = spark.createDataFrame([(i, i, f"words {i}", d[1], d[3], []) for i, d in enumerate(declared)], schemas.CATEGORY)
    date = F.lit(None).cast("timestamp") if age is None else F.timestamp_seconds(F.unix_timestamp(now()) - age * 86400)
    d = spark.createDataFrame([("d", ids or acts)], "document_id string, activity_ids array<string>").withColumn("reference_date", date)
    i = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(found)], "document_id string, id long, pii_type string")
    r, cov = comply.check_document("d", d, i, a, m, c, now(), proposed)
    return r.first(), {x.id: x.activity_id for x in cov.collect()}


def test_verdicts(spark):
    r, cov = verdict(spark, [("paghe", ["person_name", "iban", "email"], None, "confirmed")], ["person_name", "iban", "health_data"])
    assert (r.orphan, r.covered, r.missing, cov) == (["health_data"], ["iban", "person_name"], ["email"], {1: "paghe", 2: "paghe", 3: None})
    _, cov = verdict(spark, [("A", ["person_name"], None, "confirmed"), ("B", ["iban", "person_name"], None, "confirmed")], ["person_name", "iban"])
    assert cov == {1: "A", 2: "B"}
    prop = [("A", ["iban"], 12, "proposed")]
    r, _ = verdict(spark, prop, ["iban"], 400)
    assert r.orphan == ["iban"] and r.n_flags == 0 and not r.compliant
    r, _ = verdict(spark, prop, ["iban"], 400, proposed=True)
    assert r.covered == ["iban"] and r.n_flags == 1
    r, _ = verdict(spark, [("A", [], None, "confirmed")], ["iban"], ids=["A", "ghost"])
    assert r.unresolved == ["words 0"] and r.unknown_activity_ids == ["ghost"]
    conf = lambda months: [("A", ["iban"], months, "confirmed")]
    r, _ = verdict(spark, conf(12), ["iban"], 1825)
    assert r.worst_overdue_months == int(1825 // 30.44) - 12 and r.retention_flags[0].pii_types == ["iban"]
    r, _ = verdict(spark, conf(12), ["iban"], 90)
    assert r.compliant and r.n_flags == 0
    r, _ = verdict(spark, conf(None), ["iban"])
    assert r.retention_unresolved == ["macro"] and r.compliant
    r, _ = verdict(spark, conf(None), [], 4000)
    assert r.retention_unresolved == [] and r.missing == ["iban"]


def test_unresolved_keep_the_order_of_the_sheet(spark):
    rows = [["Name of the processing operation", "Pay"], ["Categories of personal data"], *[["Group", f"unknown{i % 6}", "1 year"] for i in range(12)]]
    grid = spark.createDataFrame([("s", k, r) for k, r in enumerate(rows)], "sheet string, row_no int, cells array<string>").repartition(3)
    made = register.ingest(grid)
    cats = register.map_pass(made["categories"])
    docs = spark.createDataFrame([("d", ["pay"])], "document_id string, activity_ids array<string>")
    got = comply.unresolved(docs, made["macros"], cats, include_proposed=True).first().unresolved
    assert got == [f"unknown{i % 6}" for i in range(12)]
    key = cats.where("raw_text = 'unknown3'").first().id
    parts = register.split_category(cats, key, [("z part", []), ("a part", [])])
    got = comply.unresolved(docs, made["macros"], parts, include_proposed=True).first().unresolved
    assert [x for x in got if "part" in x] == ["z part", "a part"] and got.index("z part") in (3, 9)


def test_verdict_errors(spark):
    d = spark.createDataFrame([("d", [], None)], "document_id string, activity_ids array<string>, reference_date timestamp")
    none = [spark.createDataFrame([], s) for s in (schemas.INSTANCE, schemas.ACTIVITY, schemas.MACRO, schemas.CATEGORY)]
    with pytest.raises(KeyError):
        comply.check_document("x", d, *none, now())
    with pytest.raises(ValueError):
        comply.check_document("d", d, *none, now())


# --- register ---------------------------------------------------------------------------


def workbook_xlsx(sheets):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:created>2020-01-02T03:04:05Z</d:created></c>')
    return buf.getvalue()


def workbook_ods(sheets):
    cell = lambda v: v if v.startswith("<") else f"<t:table-cell><x:p>{v}</x:p></t:table-cell>"
    body = "".join(f'<t:table t:name="{n}">' + "".join("<t:table-row>" + "".join(map(cell, r)) + "</t:table-row>" for r in rows) + "</t:table>" for n, rows in sheets.items())
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("content.xml", f'<o:document xmlns:o="o" xmlns:t="t" xmlns:x="x">{body}</o:document>')
    return buf.getvalue()


SHEET = [["Name of the processing operation", "Payroll  Management"], ["Main purpose", "Pay"], ["Categories of personal data", "d", "r"], ["Identity", "nome e iban", "5 years"], ["Photo", "fotografia", "n/a"], [""], ["Late", "x", "1 year"]]


def test_sheets():
    raw = workbook_ods({"s": [["a", '<t:table-cell t:number-columns-repeated="99"/>'], ['<t:table-cell t:number-columns-repeated="99"><o:annotation><x:p>no</x:p></o:annotation><x:p>b</x:p></t:table-cell>']]})
    assert files.read_sheet(raw, ".ods", "s") == [["a"], ["b"] * files.REPEAT]
    with pytest.raises(KeyError):
        files.read_sheet(raw, ".ods", "none")
    with pytest.raises(ValueError):
        files.read_workbook(b"", ".csv")
    assert files.sheet_names(workbook_xlsx({"A": SHEET, "B": []}), ".xlsx") == ["A", "B"]
    assert files.read_spreadsheet(workbook_xlsx({"A": [["x", "y"], ["z"]], "B": [["q"]]}), ".xlsx") == "x\ty\nz\n\nq"
    assert files.date_candidates(workbook_xlsx({"A": []}), ".xlsx")[0][0] == "xlsx:properties.created"


def test_register(spark, tmp_path):
    store = registry.Store(spark, str(tmp_path / "reg"))
    books = spark.createDataFrame([("b.xlsx", bytearray(workbook_xlsx({"A": SHEET, "Tutorial": [["Hello"]]})))], "document_id string, content binary")
    assert jobs.ingest_register(store, books) == 1
    a = store.read("activity").first()
    assert (a.id, a.purpose) == ("payroll-management", "Pay")
    m = {r.raw_text: r.retention_months for r in store.read("macro").collect()}
    assert m == {"Identity": 60, "Photo": None}
    cats = store.read("category")
    assert sorted((r.raw_text, r.pii_types, r.mapping_state) for r in cats.collect()) == [("fotografia", [], "proposed"), ("iban", ["iban"], "proposed"), ("nome", ["person_name"], "proposed")]
    assert sorted(register.map_pass(cats).collect()) == sorted(cats.collect()) and register.mapped_count(cats) == 0
    with pytest.raises(ValueError):
        jobs.ingest_register(store, books)
    assert jobs.ingest_register(store, books, replace=True) == 1
    key = cats.where("raw_text = 'fotografia'").first()
    done = register.update_category(cats, key.id, ["health_data"])
    assert done.where(F.col("id") == key.id).first().mapping_state == "confirmed"
    with pytest.raises(ValueError):
        register.update_category(cats, key.id, ["nope"])
    with pytest.raises(KeyError):
        register.update_category(cats, -1, [])
    assert register.split_category(cats, key.id, [("x", ["email"]), ("y", [])]).count() == 4
    assert register.confirm_macro(cats, key.macro_category_id).where("mapping_state = 'confirmed'").count() == 1


def test_mappers(spark):
    t = spark.createDataFrame([("nome",), ("xyz",), ("down",)], "text string")

    def backend():
        def ask(x):
            if x == "down":
                raise OSError
            return [(x.upper(), ["email", "nope"])]

        return ask

    got = lambda kind: {r.text: [(p.text, p.pii_types) for p in r.parts] for r in register.map_texts(t, kind, backend).collect()}
    assert got("dictionary")["nome"] == [("nome", ["person_name"])] and got("llm")["down"] == [("down", [])]
    assert got("hybrid") == {"nome": [("NOME", ["email"])], "xyz": [("XYZ", ["email"])], "down": [("down", [])]}
    with pytest.raises(ValueError):
        register.map_texts(t, "other")


# --- registry and folders ---------------------------------------------------------------


def test_freshness(spark):
    t = datetime(2024, 1, 1)
    rows = [("new", None, None, "s"), ("same", 0, 5, "s"), ("size", 0, 6, "s"), ("older", -3600, 5, "s"), ("near", 0.4, 5, "s"), ("far", 5, 5, "s"), ("engine", 0, 5, "old")]
    from datetime import timedelta

    f = spark.createDataFrame([(n, t, 5) for n, *_ in rows], "document_id string, mtime timestamp, size long")
    d = spark.createDataFrame([(n, t + timedelta(seconds=s), z, g) for n, s, z, g in rows if s is not None], "document_id string, source_mtime timestamp, source_size long, detector_signature string")
    got = {r.document_id for r in freshness.compare(f, d, "s").where("todo").collect()}
    assert got == {"new", "size", "older", "far", "engine"}
    assert freshness.unchanged(f, d).first()[0] == 3
    assert freshness.signature(["a", "b"]) == freshness.signature(["b", "a"]) != freshness.signature(["a"]) and len(freshness.signature([])) == 16


def test_folder_scan(spark, tmp_path):
    root = tmp_path / "in"
    (root / "hr").mkdir(parents=True)
    (root / "hr" / "a.txt").write_text("mail bob@example.com and 192.168.1.10")
    (root / "empty.txt").write_text("")
    (root / "bad.txt").write_bytes(b"\xe9\xff")
    (root / "_x.TXT").write_text("perché.rossi@società.it")
    (root / "n#1 & co.csv").write_text("x")
    (root / "broken.pdf").write_bytes(b"%PDF")
    store = registry.Store(spark, str(tmp_path / "reg"))
    store.write("rule", registry.save_rule(store.read("rule"), " /hr/ ", ["payroll"], datetime(2024, 1, 1)))
    first = jobs.scan_folder(store, str(root))
    assert (first["scanned"], first["errors"], first["skipped"], first["unchanged"], first["removed"]) == (3, 2, 1, 0, 0)
    assert first["by_type"] == {"email": 2, "ip_address": 1}
    docs = {r.document_id: r for r in store.read("document").collect()}
    assert set(docs) == {"hr/a.txt", "empty.txt", "_x.TXT"} and docs["hr/a.txt"].activity_ids == ["payroll"]
    assert not set(store.read("instance").columns) & set(schemas.FORBIDDEN)
    second = jobs.scan_folder(store, str(root))
    assert (second["scanned"], second["unchanged"], second["by_type"]) == (0, 3, first["by_type"])
    (root / "hr" / "a.txt").rename(tmp_path / "away")
    third = jobs.scan_folder(store, str(root))
    assert third["removed"] == 1 and third["by_type"] == {"email": 1}
    (tmp_path / "away").rename(root / "hr" / "a.txt")  # the same time and size, and yet its findings are back
    assert jobs.scan_folder(store, str(root))["by_type"] == first["by_type"]
    assert jobs.preview(store, str(root)) == {"scannable": 5, "skipped": 1, "unchanged": 3}
    with pytest.raises(NotADirectoryError):
        files.plan_folder(spark, str(root / "none"))


def test_registry_edits(spark):
    d = spark.createDataFrame([("a", ["x"], None)], "document_id string, activity_ids array<string>, association_source string")
    assert registry.assign_activities(d, "a", ["y"]).first().association_source == "manual"
    for ids, error in (([], ValueError), ([" "], ValueError)):
        with pytest.raises(error):
            registry.assign_activities(d, "a", ids)
    with pytest.raises(KeyError):
        registry.assign_activities(d, "b", ["y"])
    r = registry.save_rule(spark.createDataFrame([], schemas.RULE), "a/", ["x"], datetime(2024, 1, 1))
    r = registry.save_rule(r, "a", ["z"], datetime(2024, 1, 1))
    assert [(x.prefix, x.activity_ids) for x in r.collect()] == [("a", ["z"])]
    docs, left = registry.delete_rule(d.withColumn("association_source", F.lit("rule")), r, "a")
    assert left.count() == 0 and docs.first().activity_ids == []


def test_upload_paths(spark):
    cases = {"a/b.txt": "a/b.txt", "./a//b": "a/b", "/etc/x": None, "a/../b": None, "": None, "C:\\x": None, "a\\b": "a/b"}
    got = {r.p: r.s for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", files.safe_relative(F.col("p")).alias("s")).collect()}
    assert got == cases == {p: files.safe_relative(p) for p in cases}


def test_docx():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>A</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:p><w:r><w:t>no</w:t></w:r></w:p></w:tbl><w:p/></w:body></w:document>')
    assert files.read_docx(buf.getvalue()) == "A\tb\n"
    with pytest.raises(files.UnsupportedFormat):
        files.parse_content(b"", ".png")


# --- corpora ----------------------------------------------------------------------------


def test_corpora(spark, tmp_path):
    c = corpora.load_corpus(spark)
    assert {s.pii_type for r in c.collect() for s in r.spans} == set(config.catalog_ids())
    for r in c.collect():
        assert all(0 <= s.start < s.end <= len(r.text) for s in r.spans)
    (tmp_path / "b.txt").write_text("x {{email:a@b.it}}")
    (tmp_path / "a.txt").write_text("none")
    assert [r.document_id for r in corpora.load_corpus(spark, str(tmp_path)).collect()] == ["a", "b"]
    f = tmp_path / "c.jsonl"
    f.write_text('{"document_id": "d", "annotated": "{{iban:X}}"}\n\n')
    assert corpora.load_corpus(spark, str(f)).first().text == "X"
    f.write_text('{"document_id": "d", "annotated": "y"}\n{bad\n')
    with pytest.raises(ValueError, match="line 2"):
        corpora.load_corpus(spark, str(f)).collect()
    with pytest.raises(FileNotFoundError):
        corpora.load_corpus(spark, str(tmp_path / "none"))
    out = str(tmp_path / "gold")
    corpora.write_jsonl(corpora.to_gold(c), out)
    assert corpora.load_gold(spark, out).where("pii_type = 'email'").first().value == "anna.keller@example.org"
    spark.range(1).select(annotate(F.lit("email"), F.lit("x")).alias("a")).first().a == "{{email:x}}"


def test_malformed_lines_are_named_behind_the_first_split(spark, tmp_path):
    lines = ["", *[f'{{"document_id": "{i}", "annotated": "x"}}' for i in range(40)]]
    lines[33] = '{"document_id": '
    lines[37] = "no record"
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert spark.read.text(str(tmp_path / "s.jsonl")).rdd.getNumPartitions() > 2
        with pytest.raises(ValueError, match="line 34:"):
            corpora.load_sources(spark, str(tmp_path / "s.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_spans_over_blocks_of_matches(spark):
    from tessera.functions import text as tx

    text = "".join("ab"[i % 3 == 0] * (i % 5 + 1) + " " * (i % 4) for i in range(3000))
    want = [(m.start(), m.end(), m.group()) for m in re.finditer("a+b?", text)]
    got = spark.createDataFrame([(text,)], "t string").select(tx.spans("t", "a+b?").alias("s")).first().s
    assert len(want) > 3 * tx.BLOCK and [tuple(s) for s in got] == want


def test_scores_by_islands(spark):
    """A long document of many spans, some touching, some nested, against the plain greedy rule over all pairs."""
    rng = random.Random(5)
    side = lambda: [(i, s, s + rng.randint(1, 9), rng.choice(["a", "b"])) for i, s in enumerate(sorted(rng.randint(0, 600) for _ in range(120)))]
    d, g = side(), side()
    pairs = sorted(((min(x[2], y[2]) - max(x[1], y[1])) / (max(x[2], y[2]) - min(x[1], y[1])), x[0], y[0]) for x in d for y in g if x[3] == y[3])
    for ratio in (0.5, 0.1):
        i, j = {}, set()
        for v, x, y in reversed(pairs):
            if v >= ratio and x not in i and y not in j:
                i[x] = y
                j.add(y)
        want = {k: (sum(x[3] == k and x[0] in i for x in d), sum(x[3] == k and x[0] not in i for x in d), sum(y[3] == k and y[0] not in j for y in g)) for k in "ab"}
        frame = lambda rows: spark.createDataFrame([("x", *r) for r in rows], "document_id string, ord int, start int, end int, pii_type string")
        assert {r.pii_type: (r.tp, r.fp, r.fn) for r in score.span_counts(frame(d), frame(g), ratio).collect()} == want


def test_stream(spark, tmp_path):
    from tessera.streaming import ingest

    src = tmp_path / "src"
    rows = [("a", "/a", "bob@example.com 10.0.0.1", datetime(2024, 1, 1), 5, datetime(2024, 1, 1, 1)), ("a", "/a", "bob@example.com", datetime(2024, 1, 2), 6, datetime(2024, 1, 2, 1))]
    schema = "document_id string, path string, text string, source_mtime timestamp, source_size long, at timestamp"
    store = registry.Store(spark, str(tmp_path / "reg"))
    for r, want in ((rows[0], {"email": 1, "ip_address": 1}), (rows[1], {"email": 1})):
        spark.createDataFrame([r], schema).write.mode("append").parquet(str(src))
        ingest.into_registry(spark.readStream.schema(schema).parquet(str(src)), store, str(tmp_path / "cp")).awaitTermination(120)
        assert {x.pii_type: x.n for x in store.read("instance").groupBy("pii_type").agg(F.count("*").alias("n")).collect()} == want
    assert store.read("scan").count() == 2
    found = ingest.scan_stream(spark.read.schema(schema).parquet(str(src)).select("document_id", "text", "at"))
    assert {(r.pii_type, r.n) for r in ingest.counts_by_window(found).groupBy("pii_type").agg(F.sum("n").alias("n")).collect()} == {("email", 2), ("ip_address", 1)}


def test_stream_replaces_parts_of_its_documents(spark, tmp_path):
    store = registry.Store(spark, str(tmp_path / "reg"), parts=4)
    row = lambda d: (d, "/" + d, *[None] * 9)
    store.write("document", spark.createDataFrame([row(str(i)) for i in range(20)], schemas.DOCUMENT))
    folders = lambda: store._current("document")[1]["folders"]
    before = folders()
    one = spark.createDataFrame([("3",)], "document_id string")
    parts = store.parts_of(one)
    assert len(parts) == 1 and len(before) == 4
    own = store.read("document", parts)
    store.write("document", own.where("document_id <> '3'"), parts=parts)
    after = folders()
    assert {k for k in before if before[k] != after[k]} == {str(parts[0])}
    assert {r.document_id for r in store.read("document").collect()} == {str(i) for i in range(20)} - {"3"}
    with pytest.raises(ValueError):
        store.write("document", store.read("document"), parts=parts)


def test_two_writers_of_the_registry(spark, tmp_path):
    a, b = (registry.Store(spark, str(tmp_path / "reg"), grace=g) for g in (3600, 0))
    rule = lambda p: spark.createDataFrame([(p, ["x"], None)], schemas.RULE)
    rows = a.read("rule")
    b.write("rule", rule("b"))
    with pytest.raises(registry.Conflict):
        a.write("rule", rows.unionByName(rule("a")))
    old = a.read("rule")
    assert a.write("rule", rule("a")) == 2 and old.first().prefix == "b"
    # a pointer that its writer didn't end counts for nothing
    (tmp_path / "reg" / "rule" / "CURRENT-3").write_text('{"par')
    assert b.version("rule") == 2 and b.read("rule").first().prefix == "a"
    assert b.write("rule", rule("c"), keep=1) == 4 and b.read("rule").first().prefix == "c"
    assert len(list((tmp_path / "reg" / "rule").glob("data-*"))) == 1


def test_reports(spark):
    text = jobs.format_matches(jobs.scan_text(spark, "mail bob@example.com and 192.168.1.10"))
    assert text.splitlines()[1].split()[:3] == ["[5,20)", "email", "single_source"]
    from tessera.functions.text import cell

    assert spark.range(1).select(cell(F.lit("a\n b" + "x" * 40)).alias("c")).first().c == "a b" + "x" * 26 + "..."
