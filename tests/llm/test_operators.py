"""Each operator against brute force on small tables, and on the awkward rows."""

import random
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _text, decontam, licenses, mixing, passages, pii, quality, queries, sharding, simhash, toxicity, vectors

from .test_text import brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, shard string, fp string"


def words(rng, n, vocab=5000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with names that operators use."""
    rng = random.Random(1)
    long = words(rng, 20_000)
    texts = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: long, 6: long, 7: words(rng, 80), 8: words(rng, 80)}
    rows = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, None, "s", "c", "h", "f") for i, t in texts.items()]
    rows += [rows[-1], rows[-1], (None, "no id here", "en", "a", 3, "s", "c", "h", "f"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def oracle(sql, sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.sql(sql).df()


# --- mixing -----------------------------------------------------------------------------


def test_mixing_equals_sql(spark, sf):
    got = queries.op1_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = oracle(mixing.ORACLE, sf).sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])
    assert (got.taken <= 2 * got["size"]).all()
    assert got.taken.sum() == pytest.approx(1.5 * got["size"].sum(), rel=0.1)


def test_mixing_targets(spark):
    rows = [("sa", 100), ("sb", 1), ("sc", 1000), ("t", 0)]
    got = {r["__s"]: r.target for r in mixing.targets(spark.createDataFrame(rows, "__s string, source_size long")).collect()}
    # the excess goes round until no target is over twice its size
    weights, left, want = {"sa": 5, "sb": 2, "sc": 1, "t": 5}, 1.5 * 1101, {}
    free = dict(weights)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * dict(rows)[s]]
        if not over:
            want |= {s: level * w for s, w in free.items()}
            break
        for s in over:
            want[s] = 2.0 * dict(rows)[s]
            left -= want[s]
            del free[s]
    assert got == pytest.approx(want)


def test_mixing_odd_rows(odd, empty):
    rows = mixing.digest(odd).collect()
    assert len(rows) == odd.count()
    assert {r["size"] for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert sorted(mixing.digest(odd).collect(), key=str) == sorted(rows, key=str)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() <= 2 * odd.count()
    assert mixing.digest(empty).count() == 0 and mixing.mixed(empty).count() == 0


# --- sharding ---------------------------------------------------------------------------


def feistel(x, n, seed=sharding.SEED):
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)

    def f(v, k):
        y = (v + k) * sharding.MUL1 % sharding.PRIME
        z = (y ^ (y >> 15)) * sharding.MUL2 % sharding.PRIME
        return z ^ (z >> 13)

    while True:
        left, right = x % a, x // a
        for i, k in enumerate(sharding.keys(seed)):
            if i % 2 == 0:
                left = (left + f(right, k)) % a
            else:
                right = (right + f(left, k)) % b
        x = right * a + left
        if x < n:
            return x


def test_sharding_is_the_permutation(spark, sf):
    import hashlib

    got = queries.op2_sharding(spark, sf).collect()
    n = len(got)
    order = sorted(got, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    for i, r in enumerate(order):
        p = feistel(i, n)
        assert (r.shard, r.slot) == (p % 8, p // 8)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 50])
def test_sharding_small(spark, n):
    rows = sharding.place(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).collect()
    assert sorted(r.slot * 8 + r.shard for r in rows) == list(range(n))


def test_sharding_odd_rows(odd, empty):
    rows = sharding.digest(odd).collect()
    n = odd.count()
    assert sorted(r.slot * 8 + r.shard for r in rows) == list(range(n))
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    assert sharding.digest(empty).count() == 0
    assert set(sharding.place(odd).columns) == set(odd.columns) | {"slot"}


# --- simhash ----------------------------------------------------------------------------


def brute_components(fps, distance):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_components(spark, sf):
    got = {r.doc_id: r for r in queries.op10_simhash(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    fps = [brute_fingerprint(docs[i]) for i in ids]
    assert [int(got[i].fingerprint, 16) for i in ids] == fps
    assert [got[i].component_id for i in ids] == [ids[k] for k in brute_components(fps, 4)]


def test_simhash_loses_no_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for d in range(1, 7):
            x = b
            for k in rng.sample(range(64), d):
                x ^= 1 << k
            fps.add(x)
    # one crowded bucket: the lowest 22 bits are the same
    fps |= {(rng.getrandbits(6) << 58) | (rng.getrandbits(8) << 30) | 77 for _ in range(300)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x, x) for x in signed], "id long, w0 long")
    order = sorted(range(len(fps)), key=lambda i: signed[i])
    want = brute_components([fps[i] for i in order], 4)
    for bucket in (8, 10_000):
        got = {r.id: r.comp for r in simhash.together(df, "bit_count(q.w0 ^ t.w0) <= 4", simhash.SEGMENTS, 5, bucket).collect()}
        assert [got[signed[i]] for i in order] == [signed[order[k]] for k in want]
        # without anything put together before, every pair leaves the join
        pairs = simhash.crossing(df.withColumnRenamed("id", "comp"), "bit_count(q.w0 ^ t.w0) <= 4", simhash.SEGMENTS, 5, bucket).collect()
        true = {(max(a, b), min(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
        assert {(max(r), min(r)) for r in pairs} == true


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("block", [7, 512])
def test_near_copies_are_similar_sets(spark, monkeypatch, block):
    """Groups of near copies against all pairs of sets; what isn't 0.8 similar by links stays apart."""
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    rng = random.Random(21)
    docs = []
    for g in range(40):
        base = words(rng, 150).split()
        docs.append(" ".join(base))
        for n in (1, 2, 3, 8):  # words changed: 0.94, 0.88, 0.82, 0.6 or so
            t = list(base)
            for k in rng.sample(range(150), n):
                t[k] = "changed"
            docs.append(" ".join(t))
        docs.append(" ".join(base).upper())
    docs += [None, "", "one", "One", "two"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [shingles(t) for t in docs]
    up = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = up[i], up[j]
                up = [min(a, b) if x == max(a, b) else x for x in up]
    comp = {r.doc_id: r.comp for r in simhash.near_copies(df).collect()}
    first = {}
    for i in range(len(docs)):
        first.setdefault(comp[i], i)
    got = [first[comp[i]] for i in range(len(docs))]
    assert all(up[x] == up[i] for i, x in enumerate(got))  # nothing but links
    assert sum(g == w for g, w in zip(got, up, strict=True)) >= 0.95 * len(docs)
    assert [got[i] for i in range(240, 245)] == [240, 240, 242, 242, 244]
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(got)


def test_simhash_odd_rows(odd, empty):
    got = simhash.digest(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == "0" * 16 and by[2].component_id == 1 and by[3].component_id == 1
    assert by[6].component_id == 5
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # the row without text and id is a copy of 1; the repeats of 8 are one document; the text of 6 is that of 5
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8] and kept.where("doc_id is null").first().text == "no id here"
    other = kept.where("doc_id = 7").withColumn("text", F.lit("another text of this id"))
    assert simhash.keep_one(kept.unionByName(other)).where("doc_id = 7").count() == 2
    assert simhash.digest(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# --- decontamination --------------------------------------------------------------------


def test_decontamination(spark, odd, empty):
    rng = random.Random(5)
    item = words(rng, 30)
    fuzzy = item.split()
    for k in (4, 11, 19, 26):
        fuzzy[k] = "changed"
    docs = [(1, words(rng, 50) + " " + item.upper() + ", " + words(rng, 20)), (2, words(rng, 9) + "\n" + " ".join(fuzzy)), (3, words(rng, 80)), (4, " ".join(item.split()[:11]))]
    tests = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item), (10, item)], "item_id long, text string")
    got = decontam.digest(spark.createDataFrame(docs, "doc_id long, text string"), tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 2) for i in (7, 10, None)}
    one = next(r for r in got if (r.doc_id, r.item_id) == (1, 7))
    assert (one.start, one.end, one.matched) == (50, 80, 30)
    assert next(r for r in got if (r.doc_id, r.item_id) == (2, 7)).matched >= 22
    clean = decontam.clean(odd, tests)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert decontam.digest(empty, tests).count() == 0
    assert decontam.digest(odd, tests.limit(0)).count() == 0
    # the odd rows against an item that two of them hold, one without an id that is a whole text, and one that no text is
    odd_tests = spark.createDataFrame([(1, odd.where("doc_id = 7").first().text), (None, "ONE!"), (3, "no id")], "item_id long, text string")
    found = sorted(decontam.digest(odd, odd_tests).collect(), key=str)
    assert [(r.doc_id, r.item_id, r.start, r.end, r.matched) for r in found] == [(4, None, 0, 1, 1), (7, 1, 0, 80, 80)]
    assert sorted(r.doc_id or 0 for r in decontam.clean(odd, odd_tests).collect()) == sorted([0, 0, 1, 2, 3, 5, 6, 8, 8, 8])


def brute_overlaps(docs, items):
    """Every shift of every document and item, every maximal run by its definition."""
    import re

    tok = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower())
    out = set()
    for d, text in docs:
        a = tok(text)
        for i, item in items:
            b = tok(item)
            if len(b) < decontam.MIN_MATCH:
                if b and (len(b) >= decontam.LEAST or a == b):
                    out |= {(d, i, x, x + len(b), len(b)) for x in range(len(a) - len(b) + 1) if a[x : x + len(b)] == b}
                continue
            for shift in range(-len(b), len(a)):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                todo = [(lo, hi)]
                while todo:  # the best run of a stretch, then what is left and right of it
                    x, y = todo.pop()
                    same = [b[k] == a[k + shift] for k in range(x, y)]
                    best = max(((sum(1 if s else -decontam.PENALTY for s in same[p:q]), -p, -q) for p in range(len(same)) if same[p] for q in range(p + 1, len(same) + 1) if same[q - 1]), default=None)
                    if best is None:
                        continue
                    p, q = x - best[1], x - best[2]
                    n = sum(b[k] == a[k + shift] for k in range(p, q))
                    if n >= decontam.MIN_MATCH:
                        out.add((d, i, p + shift, q + shift, n))
                    todo += [(x, p), (q, y)]
    return out


def test_decontamination_as_brute_force(spark):
    rng = random.Random(14)
    items = [(i, words(rng, n, 800)) for i, n in enumerate([3, 5, 11, 12, 15, 30, 45])] + [(7, None), (None, words(rng, 9, 800))]
    docs = []
    for d in range(40):
        text = words(rng, rng.randrange(12), 800).split()
        for _ in range(2):
            t = (rng.choice(items)[1] or "").split()
            x = rng.randrange(3)
            part = t[x:] if rng.random() < 0.3 else t
            text += ["changed" if rng.random() < 0.05 and len(t) > 20 else w for w in part] + words(rng, rng.randrange(1, 15), 800).split()
        docs.append((d, " ".join(text)))
    two = items[6][1].split()
    docs += [(50, " ".join(two[:16] + ["x"] * 12 + two[28:])), (51, items[0][1]), (52, None)]
    got = decontam.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_overlaps(docs, items)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(w[0] == 50 for w in want) == 2 and any(w[1] == 2 for w in want) and any(w[1] is None for w in want)


def test_decontamination_in_slices(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, words(rng, 30)) for i in range(6)]
    docs = spark.createDataFrame([(i, words(rng, 5) + " " + t + " " + u) for (i, t), (_, u) in zip(items, items[1:], strict=False)], "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontam.digest(docs, tests).collect())
    monkeypatch.setattr(decontam, "SLICE_TOKENS", 100)
    assert sorted(decontam.digest(docs, tests).collect()) == whole and len(whole) == 10


# --- classifiers ------------------------------------------------------------------------


def labelled(spark, bad, n=160, seed=9):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        y = i % 4 == 0
        t = words(rng, 60, 400)
        docs.append((i, bad(rng, t) if y else t))
        labels.append((i, int(not y), int(y)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, odd, empty):
    docs, labels = labelled(spark, lambda rng, t: " ".join(w.upper() + "!!" for w in t.split()))
    got = {r.doc_id: r for r in quality.digest(docs, labels).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held and all(got[i].predicted == int(i % 4 != 0) for i in held)
    assert {r.doc_id: r.score for r in quality.digest(docs, labels).collect()} == {i: r.score for i, r in got.items()}
    own = quality.digest(odd, labels.unionByName(spark.createDataFrame([(None, 1, 0), (4, None, None)], labels.schema))).collect()
    assert len(own) == odd.count() and all(0 <= r.score <= 1 for r in own)
    assert quality.accepted(odd, labels.limit(0)).columns == odd.columns
    assert {r.score for r in quality.digest(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.digest(empty, labels).count() == 0


def test_quality_votes_are_exact(spark):
    """The blocked cosines against a plain loop."""
    docs, labels = labelled(spark, lambda rng, t: t.replace(" ", " | "), n=80)
    m = quality.fit(docs, labels, quality.remainder("doc_id", 5) != 0)
    rng = np.random.default_rng(0)
    v = rng.standard_normal((50, m.basis.shape[1])).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = quality.vote(m, v)
    for x, s in zip(v, got, strict=True):
        sims = m.vectors @ x
        near = np.sort(np.argsort(-sims, kind="stable")[: quality.NEIGHBOURS])
        w = np.maximum(sims[near], 0).astype(float) ** quality.SHARPNESS
        assert s == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-4)


def pair_case(spark, toxic, n=1200, share=0.5, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        a, b = rng.random() < share, rng.random() < share
        t = words(rng, 20, 300).split() + ["insult"] * a + ["group"] * b
        rng.shuffle(t)
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic(a, b))))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("toxic", [lambda a, b: a and b, lambda a, b: a != b, lambda a, b: a and not b], ids=["both", "one of two", "unless"])
def test_toxicity_learns_pairs(spark, toxic):
    _, labels, d, la = pair_case(spark, toxic)
    got = {r.doc_id: r for r in toxicity.digest(d, la).collect()}
    held = [(y, got[i].predicted) for i, _, y in labels if got[i].held_out]
    assert np.mean([y == p for y, p in held]) > 0.97


def test_toxicity_by_factors_and_by_a_plain_loop(spark):
    """No sum of single weights tells one of two words from both; every score equals the double loop over pairs."""
    docs, labels, d, la = pair_case(spark, lambda a, b: a != b)
    m = toxicity.fit(d, la, quality.remainder("doc_id", 4) != 2)
    got = {r.doc_id: r.score for r in toxicity.score(d, m, ["doc_id"]).collect()}
    flat = {r.doc_id: r.score for r in toxicity.score(d, toxicity.Machine(m.slot, m.w0, m.w, m.v * 0), ["doc_id"]).collect()}
    y = {i: v for i, _, v in labels}
    assert np.mean([(s >= 0.3) == y[i] for i, s in flat.items()]) < 0.8
    for i, text in docs[:200]:
        terms = set()
        for w in text.split():
            raw = w.encode()
            for part, salt in [(raw, 0)] + [(raw[:k], 0x5851F42D4C957F2D) for k in (5, 6, 7, 8) if len(raw) > k]:
                (h,) = _text.span_hashes(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)])).tolist()
                terms.add(int(m.slot[(h ^ salt) % toxicity.DIM]))
        terms = sorted(terms - {-1})
        z = m.w0 + sum(m.w[t] for t in terms)
        for k, t in enumerate(terms):
            for u in terms[:k]:
                z += m.v[t] @ m.v[u]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_toxicity_rare_pairs():
    """A pair in 0.3 % of the rows, each word in 5 %, two such pairs crosswise."""
    rng = np.random.default_rng(6)
    x = rng.random((20_000, 300)) < 0.05
    y = ((x[:, 0] & x[:, 2]) | (x[:, 1] & x[:, 3])).astype(float)
    picked = toxicity.chosen(x.astype(np.uint8), y, np.zeros(0, np.int64))
    assert {0, 1, 2, 3} <= set(picked.tolist())
    w0, w, v = toxicity.machine(x[:, picked], y)
    sure = toxicity.sigmoid(toxicity.dense_raw(x[:, picked].astype(np.float32), w0, w, v)) >= 0.3
    assert (sure == (y == 1)).mean() > 0.999 and sure[y == 1].mean() > 0.98


def test_learnt_documents_that_repeat_an_id(spark):
    """One labelled id stands in 300 rows: it counts once, and the other documents are learnt too."""
    docs, labels = labelled(spark, lambda rng, t: t + " vile")
    again = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(300)).select("doc_id", "text"))
    m = quality.fit(again, labels, quality.remainder("doc_id", 5) != 0, size=100)
    assert len(m.labels) == 100 and 0.6 < m.labels.mean() < 0.9
    t = toxicity.fit(again, labels, quality.remainder("doc_id", 4) != 2, size=100)
    assert len(t.w) >= 1


def test_toxicity_odd_rows(spark, odd, empty):
    docs, labels = labelled(spark, lambda rng, t: t + " vile")
    got = toxicity.digest(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.digest(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.digest(empty, labels).count() == 0
    held = [r for r in toxicity.digest(docs, labels).collect() if r.held_out]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held)


# --- licences ---------------------------------------------------------------------------


def test_licenses(spark, odd, empty):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
    rng = random.Random(8)
    body = words(rng, 120)
    files = [
        (1, "a/LICENSE", mit), (2, "a/x.txt", body), (3, "a/b/c/y.txt", body), (4, "a/b/COPYING", gpl + "\n" + body), (5, "a/b/z.txt", body + "\n" + mit.upper() + "\n" + body),
        (6, "ab/x.txt", body), (7, "top.txt", None), (8, None, gpl), (9, "a/q.txt", "the license was released under water"),
    ]
    got = {r.doc_id: (r.own_license, r.inherited_from, r.license) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string"), ["doc_id"]).collect()}
    assert got[1] == ("MIT", None, "MIT") and got[2] == (None, "a", "MIT") and got[3] == (None, "a/b", "GPL-3.0")
    assert got[5] == ("MIT", None, "MIT") and got[6] == (None, None, None) and got[7] == (None, None, None) and got[8][0] == "GPL-3.0"
    assert got[9][0] is None
    assert licenses.digest(odd).count() == odd.count() and licenses.digest(empty).count() == 0


def test_licences_in_texts_of_any_length(spark):
    rng = random.Random(10)
    gpl, mit = licenses.TEMPLATES["GPL-3.0"][0], licenses.TEMPLATES["MIT"][3]
    body = words(rng, 300)
    files = [
        (1, "\n".join((gpl + " ") .split() * 2)), (2, "\n".join(gpl.split() * 40)), (3, body + " " + " ".join(mit.split()) + " " + body),
        (4, licenses.TEMPLATES["MIT"][0] + " zzz" * 50), (5, body.replace(" ", "\n")), (6, body + " " + " ".join(licenses.TEMPLATES["Zlib"][2].split()).replace(" ", "\n") + "\n" + body * 30),
    ]
    got = {r.doc_id: r.own_license for r in licenses.scan(spark.createDataFrame(files, "doc_id long, text string").withColumn("path", F.lit("a/b")), ["doc_id"]).collect()}
    assert got == {1: "GPL-3.0", 2: "GPL-3.0", 3: "MIT", 4: "MIT", 5: None, 6: "Zlib"}


def brute_licences(docs, templates):
    """Every line, text and window of every document against every template, in dictionaries."""
    import math
    import re

    tok = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower())
    names = [(k, tok(t)) for k, v in sorted(templates.items()) for t in v]
    vocab = {w for _, t in names for w in t}
    df = {w: sum(w in set(tok(t)) for _, t in docs) for w in vocab}
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1 if w in vocab else math.log(1 + len(docs)) + 1
    vec = lambda ws: {w: (1 + math.log(ws.count(w))) * idf(w) for w in set(ws)}
    size = lambda x: math.sqrt(sum(v * v for v in x.values()))
    rows = [(k, vec(t)) for k, t in names]
    lengths = {max(w for w in licenses.WINDOWS if w <= len(t)) for _, t in names}
    out = {}
    for d, text in docs:
        ws = tok(text)
        spans = [(tok(x), licenses.COSINE) for x in (text or "").split("\n")] + [(ws, licenses.COSINE)]
        for n in lengths:
            least = licenses.SHORT_COSINE if n < licenses.SHORT else licenses.WINDOW_COSINE
            spans += [(ws[a : a + n], least) for a in range(len(ws) - n + 1) if a % max(1, n // 8) == 0 or a + n == len(ws)]
        found = []
        for span, least in spans:
            x = vec(span)
            for k, y in rows:
                if len(x.keys() & y.keys()) >= 2:
                    sim = round(sum(v * x.get(w, 0) for w, v in y.items()) / (size(x) * size(y)), 9)
                    if sim >= least:
                        found.append((-sim, k))
        out[d] = min(found, default=None)
    return out


def test_licences_as_brute_force(spark):
    rng = random.Random(20)
    templates = {k: licenses.TEMPLATES[k] for k in ("MIT", "ISC", "GPL-3.0", "Apache-2.0", "Proprietary")}
    docs = []
    for d in range(25):
        text = words(rng, rng.randrange(40), 60).split()
        for _ in range(rng.randrange(3)):
            t = rng.choice(templates[rng.choice(sorted(templates))]).split()
            text += [w for w in t if rng.random() < rng.choice((0.6, 1))] + words(rng, rng.randrange(9), 60).split()
        docs.append((d, "".join(w + rng.choice(" \n    ") for w in text)))
    docs += [(30, None), (31, "all rights reserved"), (32, "license license license")]
    want = brute_licences(docs, templates)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("path", F.col("doc_id").cast("string"))
    got = {r.doc_id: r for r in licenses.own(df, licenses.matcher(df, templates), ["doc_id"]).collect()}
    assert {d: r.own_license for d, r in got.items()} == {d: x and x[1] for d, x in want.items()}
    assert all(got[d].score == pytest.approx(-x[0], abs=1e-8) for d, x in want.items() if x)
    assert sum(x is not None for x in want.values()) > 8


# --- passages ---------------------------------------------------------------------------


def test_passages(spark, odd, empty):
    rng = random.Random(2)
    p = words(rng, 70)
    fuzzy = p.split()
    fuzzy[35] = "x"
    del fuzzy[50]
    docs = [(1, words(rng, 100) + " " + p + " " + words(rng, 30)), (2, words(rng, 20) + "\n" + p + " " + words(rng, 50)), (3, " ".join(fuzzy) + " " + words(rng, 40)), (4, words(rng, 200)), (5, " ".join(p.split()[:40]) + " " + words(rng, 60)), (6, "of " * 120), (7, "so " * 30 + "of " * 90)]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {2, 3}  # what 6 and 7 share is one word again and again
    assert (got[2].start, got[2].end, got[2].src_doc_id, got[2].src_start, got[2].src_end, got[2].equal_words) == (20, 90, 1, 100, 170, 70)
    assert got[3].src_doc_id == 1 and got[3].start == 0 and got[3].end == 69 and got[3].equal_words == 68
    copies = passages.repeated(odd).collect()
    assert {(r.doc_id, r.src_doc_id, r.end) for r in copies} == {(6, 5, 20_000)}
    assert passages.repeated(empty).count() == 0


def test_passages_star(spark):
    """A passage in many documents gives a row a document, not all pairs."""
    rng = random.Random(7)
    p = words(rng, 60)
    docs = spark.createDataFrame([(i, words(rng, 30) + " " + p + " " + words(rng, 30)) for i in range(60)], "doc_id long, text string")
    got = passages.repeated(docs).collect()
    assert len(got) == 59 and {r.src_doc_id for r in got} == {0}


def test_passages_behind_partial_holders(spark):
    """The first documents of all seeds hold parts of the passage only, too short to be passages."""
    rng = random.Random(11)
    p = words(rng, 60).split()
    parts = [(5, p[:40]), (6, p[20:]), (7, p[5:45]), *[(i, p) for i in range(100, 104)]]
    docs = [(i, words(rng, 30) + " " + " ".join(x) + " " + words(rng, 30)) for i, x in parts]
    docs += [(200 + i, words(rng, 30) + " " + " ".join(p[:17]) + " " + words(rng, 30)) for i in range(20)]
    got = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.src_doc_id, r.start, r.end, r.src_start, r.equal_words) for r in got} == {(i, 100, 30, 90, 30, 60) for i in (101, 102, 103)}


def test_passages_of_words_as_brute_force(spark):
    """Every 50 words that a document with a lesser doc_id has lie in reported passages, whatever holds parts of them.

    Only stretches of fewer than ten different words aren't passages.
    """
    rng = random.Random(12)
    pool = [words(rng, 150).split() for _ in range(4)]
    docs = []
    for i in range(80):
        text = words(rng, rng.randrange(20)).split()
        for _ in range(3):
            p, a = rng.choice(pool), rng.randrange(100)
            text += p[a : a + rng.randrange(20, 90)] + words(rng, rng.randrange(1, 10)).split()
        docs.append((i, text))
    docs += [(80, ["of"] * 52), (81, words(rng, 20).split() + ["of"] * 79), (82, ["of", "so"] * 60), (83, words(rng, 9).split() + ["of", "so"] * 99)]
    got = passages.repeated(spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")).collect()
    seen = set()
    for i, text in docs:
        held = [tuple(text[a : a + 50]) for a in range(len(text) - 49)]
        inside = [set(range(r.start, r.end)) for r in got if r.doc_id == i]
        for a, w in enumerate(held):
            assert w not in seen or len(set(w)) < 10 or set(range(a, a + 50)) <= set().union(*inside)
        seen |= set(held)


def test_passages_of_two_holders_behind_halves(spark):
    """3 and 4 share 80 words, of which 1 and 2 hold one half each."""
    rng = random.Random(15)
    p = words(rng, 80).split()
    parts = [(1, p[:40]), (2, p[40:]), (3, p), (4, p)]
    docs = [(i, words(rng, 30) + " " + " ".join(x) + " " + words(rng, 30)) for i, x in parts]
    got = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.src_doc_id, r.start, r.end, r.equal_words) for r in got] == [(4, 3, 30, 110, 80)]


def test_passages_leave_no_shuffle_files(spark):
    """What a written step has shuffled and what later steps don't read goes before the result is read."""
    rng = random.Random(22)
    p = words(rng, 80)
    docs = spark.createDataFrame([(i, words(rng, 30) + " " + p + " " + words(rng, 30)) for i in range(20)], "doc_id long, text string")
    local = [Path(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    files = lambda: {f for top in local for f in top.rglob("shuffle_*.data")}
    cuts = lambda: set(shared.glob("cut-*"))
    before, cuts_before = files(), cuts()
    out = passages.repeated(docs)
    for _ in range(50):
        if len(left := files() - before) <= 8:
            break
        time.sleep(0.1)
    assert len(left) <= 8  # of the two filters
    assert len(cuts() - cuts_before) <= 2
    assert {r.doc_id for r in out.collect()} == set(range(1, 20))


def test_aligned_keeps_the_core():
    """What lies beyond the anchors agrees too little for a passage; the words between them are one."""
    a = np.arange(170, dtype=np.uint32)
    b = a.copy()
    b[:60:3] += 1000
    b[112::3] += 1000
    assert passages.aligned(a, b, [60, 104], [60, 104]) == [(60, 110, 60, 110, 50)]


# --- personal data ----------------------------------------------------------------------


def test_pii_query(spark, sf, odd, empty):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_pii(spark, sf).collect():
        found, digest = pii.brute(docs[r.doc_id])
        assert r.base_sha256 == digest
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(found[k]) for k in pii.BASE)
    assert pii.digest(odd).count() == odd.count() and pii.digest(empty).count() == 0


def test_pii_added_kinds():
    a = pii.automaton()
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'x token = "{key}" and PASSWORD: hunter2x, the token = of the secret: sharing; -----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY----- ftp://me:pw@host.org IBAN DE89 3704 0044 0532 0130 00'
    got = {k: [text[x:y] for x, y in v] for k, v in pii.find(text, a).items()}
    assert got["secret"] == [key, "hunter2x", text[text.index("-----BEGIN") : text.index(" ftp")]]
    assert got["login"] == ["ftp://me:pw@host.org"] and got["account"] == ["DE89 3704 0044 0532 0130 00"]
    assert pii.find("token = " * 20_000, a)["secret"] == []  # in linear time


def test_pii_odd_rows(odd):
    got = {r.doc_id: r for r in pii.digest(odd.withColumn("found", F.lit(1)).withColumn("spans", F.lit("x"))).collect()}
    empty_sha = pii.brute("")[1]
    assert all(got[i].spans == "" and got[i].n_found == 0 and got[i].base_sha256 == empty_sha for i in (1, 2, 3, 4))


# --- embeddings -------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.9):
    v = {}
    for i, x in rows:
        if i is None:
            continue
        a = np.array([np.nan if c is None else c for c in x], float) if x else np.zeros(1)
        if np.isfinite(a).all() and np.linalg.norm(a) > 0:
            v[i] = a / np.linalg.norm(a)
    return {i: {j for j in v if i in v and j != i and len(v[i]) == len(v[j]) and v[i] @ v[j] >= cosine} for i, _ in rows if i is not None}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(30):
        c = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (c + rng.standard_normal(16) * 0.12).tolist()))
    hot = rng.standard_normal(16)
    rows += [(len(rows) + k, hot.tolist()) for k in range(40)]  # equal copies
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [1.0, None] + [0.0] * 14), (n + 4, [float("nan")] * 16), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int")
    want = brute_vectors([(r.vec_id, r.embedding) for r in df.collect()])
    got = {r.vec_id: r for r in vectors.digest(df).collect()}
    assert len(got) == len(rows)
    found, true = sum(got[i].n_links for i in want), sum(len(x) for x in want.values())
    assert 0.95 * true <= found <= true and all(got[i].n_links <= len(want[i]) for i in want)
    for k in (0, 1, 2, 3, 4):
        assert got[n + k].n_links == 0 and got[n + k].component_id == n + k and got[n + k].kept
    assert got[n + 5].n_links == 1 and got[n + 6].component_id == n + 5
    assert got[None].component_id is None
    assert vectors.digest(df.limit(0)).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    """A cluster of several blocks loses nothing between its blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(3)
    c = rng.standard_normal(12)
    rows = [(i, (c + rng.standard_normal(12) * 0.05).tolist()) for i in range(150)]
    got = vectors.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute_vectors(rows)
    assert sum(r.n_links for r in got) >= 0.95 * sum(map(len, want.values()))
    assert {r.component_id for r in got} == {0}


def test_vectors_that_the_shards_part(spark, monkeypatch):
    """Few classes have links, and no shard has both ends of one: the audit sees it, and the comparison is exact."""
    real = vectors.assigned

    def parted(groups, middle, overlap, dtype):
        out = real(groups, middle, overlap, dtype)
        return out if all(len(c) == 1 for c in middle.values()) else out.withColumn("clusters", F.expr("array(51200000 + rep % 4)"))

    monkeypatch.setattr(vectors, "assigned", parted)
    monkeypatch.setattr(vectors, "BLOCK", 300)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 64))
    x[501] = x[500] + rng.standard_normal(64) * 0.01
    x[703] = x[701] + rng.standard_normal(64) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), overlap=32).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(v) for i, v in brute_vectors(rows).items()}
    assert {i for i, r in got.items() if not r.kept} == {501, 703} and got[703].component_id == 701


def test_robust_pruned_graph_finds_neighbours():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 24))
    v[200:] = v[:200] + rng.standard_normal((200, 24)) * 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    adj = vectors.build(v)
    pointers = np.concatenate([[0], np.cumsum([len(x) for x in adj])])
    none = np.zeros(0, np.int64)
    a, b = vectors.search(v, pointers, np.concatenate(adj), v, (none, none), 0.9)
    true = {(i, j) for i, j in zip(*np.nonzero(v @ v.T >= 0.9), strict=True)}
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert got <= true and len(got) >= 0.9 * len(true)
