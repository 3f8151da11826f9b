import json

from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.functions import checks
from tessera.functions.text import annotated
from tessera.operators import detect, score
from tessera.sources import chat as ch
from tessera.sources import corpora, generate


def test_generated_corpus_is_valid(spark):
    c = generate.corpus(spark, 60).select("document_id", annotated("annotated").alias("a")).select("document_id", "a.text", "a.spans")
    gold = corpora.to_gold(c).select("document_id", F.explode("pii").alias("p")).select("p.*")
    assert {r.pii_type for r in gold.collect()} == {"person_name", "email", "phone", "iban", "credit_card", "swiss_avs", "ip_address", "address", "date_of_birth", "italian_id", "health_data"}
    for kind, ok in (("iban", checks.iban_valid), ("credit_card", checks.luhn), ("swiss_avs", checks.avs_valid), ("italian_id", checks.tax_code_valid)):
        rows = gold.where(F.col("pii_type") == kind)
        assert rows.where(~ok("value")).count() == 0 and rows.count() > 0, kind
    assert sorted(generate.corpus(spark, 5).collect()) == sorted(generate.corpus(spark, 5).collect())
    found = detect.regex_detect(c.select("document_id", "text"))
    report = {r.pii_type: r for r in score.report(score.span_counts(found, corpora.gold_spans(c))).collect()}
    assert report["italian_id"].recall == 1.0 and report["iban"].recall == 1.0 and report["email"].recall > 0.9


def test_chat():
    seen = []

    def send(url, body, timeout):
        seen.append((url, json.loads(body)))
        return json.dumps({"message": {"content": "hi"}}).encode()

    chat = ch.Chat("http://x/", "m", 9, send=send)
    assert ch.backend(chat)()("q") == "hi" and chat.complete("q", "s") == "hi"
    assert seen[0][0] == "http://x/api/chat" and seen[0][1]["options"] == {"temperature": 0, "num_predict": 9}
    assert [m["role"] for m in seen[1][1]["messages"]] == ["system", "user"]


def test_chat_is_off_by_default(monkeypatch):
    monkeypatch.delenv(ch.HOST, raising=False)
    assert ch.from_env() is None
    monkeypatch.setenv(ch.HOST, "http://y")
    monkeypatch.setenv(ch.CAP, "-1")
    assert ch.from_env().cap == 1024


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    f = tmp_path / "in" / "a.txt"
    f.write_text("mail bob@example.com  \r\n")
    run = lambda *a: cli.main(["--store", str(tmp_path / "reg"), *a])
    assert run("extract", str(f)) == "mail bob@example.com"
    assert "email" in run("scan", str(f))
    assert "scanned: 1" in run("scan-folder", str(tmp_path / "in"))
    assert "unchanged: 1" in run("preview", str(tmp_path / "in"))
    assert run("assign", "a.txt", "payroll") == "ok"
    assert "'orphan': ['email']" in run("check", "a.txt")
    assert run("rule", "x", "legal") == "ok" and run("rule", "x") == "ok"
    assert run("retention").startswith("document_id")
    assert run("map", "nome e iban") == "nome: person_name\niban: iban"
