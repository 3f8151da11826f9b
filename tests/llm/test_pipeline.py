import corpus_pipeline
from tessera.llm import decontam, mixing, queries, simhash

from .test_operators import empty, feistel, jaccard, odd, shingles  # noqa: F401


def test_pipeline_stage_by_stage(spark, sf):
    from tessera.llm._cluster import cut

    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for _, f in corpus_pipeline.STAGES:
        docs = cut(f(spark, docs, sf))
        kept.append(docs)
    assert all(d.columns == columns for d in kept[:-1])
    good, single, clean, mixed, shards = kept
    score = {r.doc_id: r.predicted for r in queries.op5_quality(spark, sf).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in score.items() if p}
    rows = {r.doc_id: shingles(r.text) for r in good.collect()}
    left = {r.doc_id for r in single.collect()}
    groups = {}
    for r in simhash.near_copies(good).collect():
        groups.setdefault(r.comp, []).append(r.doc_id)
    assert left == {min(g) for g in groups.values()}
    for g in groups.values():  # whatever goes is similar to another document of its group
        assert len(g) == 1 or all(any(jaccard(rows[i], rows[j]) >= 0.8 for j in g if j != i) for i in g)
    twins = [(i, j) for i in left for j in left if i < j and rows[i] & rows[j] and jaccard(rows[i], rows[j]) >= 0.8]
    assert len(twins) <= 0.1 * (len(rows) - len(left))
    tests = spark.read.parquet(f"{sf}/benchmark.parquet")
    dirty = {r.doc_id for r in decontam.digest(single, tests).collect()}
    assert {r.doc_id for r in clean.collect()} == left - dirty
    copies = {r.doc_id: r.copies for r in mixing.sample(clean).collect()}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: c for i, c in copies.items() if c}
    n = mixed.count()
    places = sorted(r.slot * 8 + r.shard for r in shards.collect())
    assert places == list(range(n)) == sorted(feistel(i, n) for i in range(n))


def test_run_is_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert "shard" in got.columns and got.count() > 0


def test_stages_on_odd_rows(spark, sf, odd, empty):
    """Nulls, repeats, long texts and other columns through all the stages, one after the other; and no rows at all."""
    from tessera.llm._cluster import cut

    docs, counts = odd, [odd.count()]
    for _, f in corpus_pipeline.STAGES:
        docs = cut(f(spark, docs, sf))
        counts.append(docs.count())
        assert docs.columns[: len(odd.columns)] == [c for c in odd.columns if c != "shard"] + ["shard"] * ("slot" in docs.columns) or docs.columns == odd.columns
    assert counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5]
    single = corpus_pipeline.drop_near_copies(spark, odd, sf)
    assert sorted(r.doc_id or 0 for r in single.collect()) == [0, 1, 4, 5, 7, 8]
    clean = corpus_pipeline.drop_contaminated(spark, single, sf)
    assert clean.columns == odd.columns and clean.count() == 6
    docs = empty
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
    assert docs.count() == 0
