"""Learned text vectors against numpy's SVD of the same matrix."""

import random

import numpy as np

from recsift.operators import svd as SV


def _texts(spark, n=120):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    # topics give the matrix a falling spectrum
    rows = [(i, " ".join(rng.choice(words[(i % 6) * 12:(i % 6) * 12 + 20]) for _ in range(rng.randrange(6, 25)))) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, ""), (n + 2, "...")], "doc long, text string")


def test_singular_values_and_vectors(spark):
    df = _texts(spark)
    model = SV.fit(df, "doc", "text", 6, rounds=6)
    postings = SV.weigh(SV.counts(df, "doc", "text"), model.idf).collect()
    ids, terms = sorted({r["id"] for r in postings}), sorted({r["term"] for r in postings})
    a = np.zeros((len(ids), len(terms)))
    for r in postings:
        a[ids.index(r["id"]), terms.index(r["term"])] = r["w"]
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.singular, s[:6], rtol=0.01)
    right = np.array([dict((r["term"], r["v"]) for r in model.terms.collect())[t] for t in terms])
    assert np.allclose(right.T @ right, np.eye(6), atol=1e-8)
    # what the vectors keep of the matrix is what the best six keep
    assert np.linalg.norm(a @ right) ** 2 >= 0.99 * (s[:6] ** 2).sum()
    got = {r["doc"]: np.array(r["v"]) for r in SV.encode(model, df, "doc", "text").collect()}
    assert len(got) == df.count() and not any(got[k].any() for k in (120, 121, 122))
    want = a @ right
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert all(np.allclose(got[i], want[n], atol=1e-8) for n, i in enumerate(ids))


def test_low_rank_and_unknown_words(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc long, text string")
    model = SV.fit(df, "doc", "text", 5)
    assert sum(x > 1e-6 for x in model.singular) == 2
    got = {r["doc"]: np.array(r["v"]) for r in SV.encode(model, df.unionByName(
        spark.createDataFrame([(4, "z z")], "doc long, text string")), "doc", "text").collect()}
    assert np.allclose(got[1], got[2]) and abs(got[1] @ got[3]) < 1e-8 and not got[4].any()
