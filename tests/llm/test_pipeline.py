"""Every stage against a plain version of it, on the rows that its predecessor kept."""

import corpus_pipeline as C
from recsift.llm import decontaminate as D
from recsift.llm import packing as P
from recsift.llm import quality as Q
from tests.llm.test_decontaminate import distance
from tests.llm.test_exact_dedup import LOWER
from tests.llm.test_near_dedup import brute as near_groups


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    bench = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "packing"]
    stage = dict(C.STAGES)

    good = C.materialize(stage["quality_classifier"](spark, docs, small_dir), "t")
    want = {r["doc_id"] for r in Q.score(docs, labels).filter("predicted = 1").collect()}
    assert set(rows_of(good)) == want and good.columns == docs.columns and good.dtypes == docs.dtypes
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [i for i, q in quality.items() if q == 1]
    assert sum(i in want for i in clean) >= 0.9 * len(clean)

    exact = C.materialize(stage["exact_dedup"](spark, good, small_dir), "t")
    last = {}
    for i, t in sorted(rows_of(good).items()):
        last[t.translate(LOWER)] = i
    assert set(rows_of(exact)) == set(last.values()) and exact.dtypes == docs.dtypes

    near = C.materialize(stage["near_dedup"](spark, exact, small_dir), "t")
    groups = near_groups(sorted(rows_of(exact).items()))
    assert set(rows_of(near)) == {i for i, _, c in groups if i == c} and near.dtypes == docs.dtypes

    pure = C.materialize(stage["decontamination"](spark, near, small_dir), "t")
    items = [w for r in bench.collect() if len(w := D.words_of(r["text"])) >= D.MIN_WORDS]
    for i, t in rows_of(near).items():
        words = D.words_of(t)
        verbatim = any(f" {' '.join(b)} " in f" {' '.join(words)} " for b in items)
        if i not in rows_of_cache(pure):
            assert any(distance(b, words) <= D.allowed(len(b)) for b in items)
        else:
            assert not verbatim
    assert pure.dtypes == docs.dtypes

    packed = stage["packing"](spark, pure, small_dir).collect()
    assert {r["doc_id"] for r in packed} == set(rows_of(pure))
    assert all(r["offset"] + r["length"] <= P.WINDOW for r in packed)


_CACHE = {}


def rows_of_cache(df):
    if id(df) not in _CACHE:
        _CACHE[id(df)] = rows_of(df)
    return _CACHE[id(df)]


def test_run(spark, small_dir):
    out = C.run(spark, small_dir)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "sequence_id", "offset", "length"}


def test_empty_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, small_dir), "t")
        assert docs.count() == 0
