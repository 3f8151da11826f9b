"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL
schemes and identifier cues.  Deterministic local parsers expand each anchor to the
boundaries of an email, address, card, phone number, street address or account and
validate it.  The parsers move forward only, so a text takes linear time however it is
made.

Base kinds are the leftmost non-overlapping matches of fixed patterns, kind by kind:
email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits).
Added kinds need a cue: ``account`` (IBAN by mod 97, or a number after an account cue),
``address`` (number and street word, or post box), ``login`` (URL with user and password),
``secret`` (a value assigned to a token, key or password; a private key block).

Defined results: null or empty texts have no spans (the digest is that of the empty
string); rows that repeat are scanned one by one.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address", "login", "secret")

#: Words that introduce account numbers, and street words, in the languages of the corpora.
ACCOUNT_CUES = ("iban", "account", "acct", "kontonummer", "konto-nr", "compte", "cuenta")
STREET_CUES = ("street", "avenue", "boulevard", "road", "lane", "straße", "strasse", "rue", "calle", "avenida", "p.o. box", "postfach")
#: Names to which secrets are assigned, and how private keys begin.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key", "secret_key", "auth_key")
KEY_BLOCK = "-----BEGIN "

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_RUN = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\s:.#-]{0,6}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|num\.?))?[\s:.#-]{1,6}([0-9](?:[\x20-]?[0-9]){7,16})(?![0-9A-Za-z])", re.I)
_BEFORE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?,?\x20(?:[A-ZÀ-Þ][\w'-]{0,30}\x20){1,3}\Z")
_AFTER = re.compile(r"\x20(?:[A-ZÀ-Þ][\w'-]{0,30}\x20){1,3}[0-9]{1,5}(?![0-9A-Za-z])")
_JOINED = re.compile(r"\x20[0-9]{1,5}(?![0-9A-Za-z])")
_LOGIN = re.compile(r"[^\s/:@<>\"']{1,64}:[^\s/@<>\"']{1,64}@[A-Za-z0-9.-]{1,253}")
_ASSIGNED = re.compile(r"[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}(?:bearer\s{1,4})?([\"']?)([A-Za-z0-9+/_=.~$!@#%^&*-]{8,512})\1", re.I)
_BLOCK = re.compile(r"[A-Z ]{0,32}PRIVATE KEY-----[^-]{0,20000}(?:-----END [A-Z ]{0,32}PRIVATE KEY-----)?")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEMES = ("http", "https", "ftp", "ssh", "postgres", "mysql", "mongodb")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    raw = iban.replace(" ", "")
    return 15 <= len(raw) <= 34 and int("".join(str(int(x, 36)) for x in raw[4:] + raw[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    a.add_word(KEY_BLOCK, ("block", len(KEY_BLOCK)))
    for kind, cues in (("account", ACCOUNT_CUES), ("street", STREET_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _account(text: str, at: int) -> tuple[int, int] | None:
    if m := _IBAN.match(text, at):
        # the longest valid ending: a word after the number may look like more of it
        a, b = m.span(1)
        while b > a:
            if mod97(text[a:b]):
                return a, b
            b = a + text[a:b].rstrip().rfind(" ") if " " in text[a:b] else a
    if m := _NUMBER.match(text, at):
        return m.span(1)
    return None


def _address(text: str, start: int, end: int, cue: str) -> tuple[int, int] | None:
    if "box" in cue or cue == "postfach":
        m = _JOINED.match(text, end)
        return (start, m.end()) if m else None
    if m := _BEFORE.search(text, max(0, start - 110), start):
        return m.start(), end
    if cue in ("rue", "calle", "avenida") and (m := _AFTER.match(text, end)):
        return start, m.end()
    if cue in ("straße", "strasse") and (m := _JOINED.match(text, end)):
        while start and text[start - 1].isalpha() and end - start < 40:
            start -= 1
        return (start, m.end()) if text[start].isupper() else None
    return None


def find(text: str, a: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    done = dict.fromkeys(("email", "ip", "card", "phone"), 0)
    for last, (kind, size) in a.iter(text):
        i = last - size + 1
        if kind == "digit":
            if i >= done["card"]:
                end = _CARD.match(text, i).end()
                done["card"] = end
                if end - i >= 13 and 13 <= len(d := _digits(text[i:end])) <= 19 and luhn(d):
                    out["card"].append((i, end))
            if i >= done["ip"]:
                if m := _IP.match(text, i):
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    done["ip"] = _RUN.match(text, i).end()
        elif kind == "at":
            start = i
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < i and (m := _DOMAIN.match(text, i + 1)):
                out["email"].append((start, m.end()))
                done["email"] = m.end()
            else:
                done["email"] = i + 1
        elif kind == "plus":
            if i >= done["phone"] and (m := _PHONE.match(text, i)):
                done["phone"] = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out["phone"].append(m.span())
        elif kind == "scheme":
            start = i
            while start and i - start < 10 and text[start - 1].isalnum():
                start -= 1
            if text[start:i].lower() in _SCHEMES and (m := _LOGIN.match(text, last + 1)):
                out["login"].append((start, m.end()))
        elif kind == "block":
            if m := _BLOCK.match(text, last + 1):
                out["secret"].append((i, m.end()))
        elif kind == "secret":
            # the value is what counts: it looks random, a word doesn't
            if (m := _ASSIGNED.match(text, last + 1)) and (m[1] or any("0" <= x <= "9" for x in m[2])) and len(set(m[2])) > 4:
                out["secret"].append(m.span(2))
        else:
            joined = i and text[i - 1].isalnum()
            cue = text[i : last + 1].lower()
            if kind == "account" and not joined:
                span = _account(text, last + 1)
                if span:
                    out["account"].append(span)
            elif kind == "street" and (not joined or cue in ("straße", "strasse")) and not text[last + 1 : last + 2].isalnum():
                span = _address(text, i, last + 1, cue)
                if span:
                    out["address"].append(span)
    for kind in ADDED:  # two cues may lead to one span or to overlapping ones: the first stays
        kept: list[tuple[int, int]] = []
        for span in sorted(set(out[kind])):
            if not kept or span[0] >= kept[-1][1]:
                kept.append(span)
        out[kind] = kept
    return out


def spans(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row and ``found``, an array of (kind, start, end) by kind, then start."""
    keep = df.columns if keep is None else keep
    kind = "array<struct<kind:string,start:int,end:int>>"
    own = df.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        typ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for t in batch.column(batch.num_columns - 1):
                text = t.as_py()
                rows.append([{"kind": k, "start": s, "end": e} for k, x in find(text, a).items() for s, e in x] if text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, typ)], names=[*keep, "found"])

    return own.mapInArrow(run, own.drop("__text").withColumn("found", F.array().cast(kind)).schema)


def digest(df: DataFrame) -> DataFrame:
    rows = spans(df.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    line = "concat(x.kind, ':', x.start, ':', x.end)"
    base = "'" + "','".join(BASE) + "'"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE + ADDED]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(f"cast(array_join(transform(filter(found, x -> x.kind in ({base})), x -> {line}), ',') as binary)"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(found, x -> {line}), ',')").alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def brute(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], str]:
    """The base spans by whole-text patterns, for tests."""
    text = text or ""
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(_digits(s)) <= 19 and luhn(_digits(s)),
        "phone": lambda s: 9 <= len(_digits(s)) <= 15,
    }
    found = {k: [m.span() for m in re.finditer(p, text) if ok[k](m[0])] for k, p in pats.items()}
    line = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in found[k])
    return found, hashlib.sha256(line.encode()).hexdigest()
