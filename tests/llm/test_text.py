import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import _text, decontam, passages, pii, simhash

TEXTS = st.lists(st.text(alphabet=" \t\n\r\x0b\x0cabAB.é,0@+- ", max_size=40), min_size=1, max_size=6)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_hashes_agree_with_bytes_split(texts):
    for c in _text.chunks(pa.array(texts), 32):
        starts, ends, first = _text.word_bounds(c.buf, c.offsets)
        h = _text.span_hashes(c.buf, starts, ends)
        raw = c.buf.tobytes()
        for i in range(len(c)):
            own = [raw[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            assert own == texts[c.first + i].encode().split()
        seen = {}
        for a, b, x in zip(starts.tolist(), ends.tolist(), h.tolist(), strict=True):
            assert seen.setdefault(raw[a:b], x) == x
        assert len(set(seen.values())) == len(seen)


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_fingerprints(texts):
    texts = [*texts, None, "", " ".join(f"w{i % 37}" for i in range(700))]
    got = np.concatenate([simhash.chunk_fingerprints(c) for c in _text.chunks(pa.array(texts), 64)])
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


@given(st.text(alphabet="0123456789 .-+()@aB_%é,:x", max_size=60))
@settings(max_examples=600, deadline=None)
def test_pii_base_spans(text):
    found = pii.find(text, pii.automaton())
    want, _ = pii.brute(text)
    assert {k: found[k] for k in pii.BASE} == want


def test_pii_added_spans():
    a = pii.automaton()
    got = lambda t, k: [t[s:e] for s, e in pii.find(t, a)[k]]
    assert got("My IBAN: DE89 3704 0044 0532 0130 00 is here", "account") == ["DE89 3704 0044 0532 0130 00"]
    assert got("account number 12345678901 ok", "account") == ["12345678901"]
    assert got("I live at 221 Baker Street now", "address") == ["221 Baker Street"]
    assert got("rue Victor Hugo 12", "address") == ["rue Victor Hugo 12"]
    assert got("ssh://bob:pw@db.example.com/x", "login") == ["ssh://bob:pw@db.example.com"]
    assert not any(pii.find("the account of the street and 12 roads", a).values())


def test_pii_is_linear_on_hostile_text():
    a = pii.automaton()
    for t in ("a" * 200_000 + "@", "1" * 200_000, "+1" * 50_000, "1.1." * 50_000, "@" * 100_000, "+1" + "(" * 100_000):
        pii.find(t, a)


def test_seeds_hit_every_window_with_three_substitutions():
    from itertools import combinations

    for subs in combinations(range(15), 3):
        assert any(not any(o + k in subs for k in m) for m in decontam.MASKS for o in range(15 - max(m)))


def test_best_run():
    same = np.array([0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1], bool)
    assert decontam.best_run(same) == (1, 7, 5)  # as good as (4, 7, 3), and first
    assert decontam.best_run(np.zeros(4, bool)) is None


def test_runs_of_equal_scores_as_brute_force():
    """Ten equal tokens, five others and eleven: as good as the eleven alone, and the first."""

    def brute(same, at=0):
        score = lambda p, q: sum(1 if s else -decontam.PENALTY for s in same[p:q])
        spans = [(score(p, q), -p, -q) for p in range(len(same)) if same[p] for q in range(p + 1, len(same) + 1) if same[q - 1]]
        if not spans:
            return []
        _, p, q = max(spans)
        return [*brute(same[:-p], at), (at - p, at - q, int(sum(same[-p:-q]))), *brute(same[-q:], at - q)]

    assert decontam.runs(np.array([1] * 10 + [0] * 5 + [1] * 11, bool)) == [(0, 26, 21)]
    rng = np.random.default_rng(3)
    for _ in range(500):
        same = rng.random(rng.integers(0, 22)) < 0.6
        assert decontam.runs(same) == brute(same.tolist())


def brute_chain(pos, other):
    """Best score of a chain by all predecessors."""
    idx = sorted(range(len(pos)), key=lambda i: (pos[i], other[i]))
    best = {}
    for i in idx:
        best[i] = passages.K
        for j in best:
            if pos[j] < pos[i] and other[j] < other[i]:
                gap = passages.GAP * (pos[i] - pos[j] + other[i] - other[j])
                best[i] = max(best[i], best[j] + passages.K - gap)
    return max(best.values())


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
@settings(max_examples=200, deadline=None)
def test_fenwick_chains_are_the_best(points):
    pos, other = np.array([p for p, _ in points]), np.array([o for _, o in points])
    found = passages.chains(pos, other)
    best = brute_chain(pos.tolist(), other.tolist())
    if best > passages.K + 1e-9:
        c = found[0]
        assert all(pos[a] < pos[b] and other[a] < other[b] for a, b in zip(c, c[1:], strict=False))
        gaps = sum(pos[b] - pos[a] + other[b] - other[a] for a, b in zip(c, c[1:], strict=False))
        assert abs(len(c) * passages.K - passages.GAP * gaps - best) < 1e-6


def test_minimizers_cover_every_common_run():
    rng = np.random.default_rng(0)
    run = rng.integers(1, 1 << 60, passages.WINDOW + passages.K - 1).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(1, 1 << 60, 40).astype(np.uint64), run, rng.integers(1, 1 << 60, 40).astype(np.uint64)]) for _ in range(2))
        sets = [set(passages.minimizers(x, np.array([0, len(x)]))[2].tolist()) for x in (a, b)]
        assert sets[0] & sets[1]
