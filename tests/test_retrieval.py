"""Exact and approximate search against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.operators import ann
from recsift.operators import retrieval as R


def _vecs(rng, n, d, start=0):
    return [(start + i, rng.normal(size=d).tolist()) for i in range(n)]


def _brute(q, it, k, metric, ex=None):
    ex = ex or set()
    out = {}
    ids = np.array([i for i, _ in it])
    I = np.array([v for _, v in it])
    for qid, qv in q:
        qv = np.array(qv)
        if metric == "cosine":
            s = (I / np.linalg.norm(I, axis=1, keepdims=True)) @ (qv / np.linalg.norm(qv))
            key = np.round(s, 9)
        elif metric == "dot":
            s = I @ qv
            key = np.round(s, 9)
        else:
            s = ((I - qv) ** 2).sum(axis=1)
            key = -np.round(s, 9)
        order = sorted(range(len(ids)), key=lambda j: (-key[j], ids[j]))
        out[qid] = [int(ids[j]) for j in order if (qid, int(ids[j])) not in ex][:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_knn_matches_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    q, it = _vecs(rng, 37, 8), _vecs(rng, 211, 8, start=1000)
    ex = {(q[0][0], it[5][0]), (q[1][0], it[7][0])}
    qdf = spark.createDataFrame(q, "qid long, v array<double>")
    idf = spark.createDataFrame(it, "item_id long, v array<double>")
    exdf = spark.createDataFrame(list(ex), "qid long, item_id long")
    # small blocks force several query and item blocks
    got = R.knn(qdf, idf, 5, metric, exclusions=exdf, q_block=8, i_block=50, score_chunk=3).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        res.setdefault(r["qid"], []).append(r["item_id"])
    assert res == _brute(q, it, 5, metric, ex)


def test_top_k_unseen_matches_brute_force(spark):
    ranked = spark.createDataFrame([(100 + i, i + 1, float(100 - i)) for i in range(50)],
                                   "item_id long, prank long, score double")
    seen_rows = [(1, 100), (1, 101), (1, 103), (2, 149)] + [(3, 100 + i) for i in range(48)]
    seen = spark.createDataFrame(seen_rows, "user_id long, item_id long")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    got = R.top_k_unseen(ranked, 50, seen, users, 3, chunk=4).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["user_id"], r["rank"])):
        res.setdefault(r["user_id"], []).append(r["item_id"])
    s = {}
    for u, i in seen_rows:
        s.setdefault(u, set()).add(i)
    exp = {u: [100 + i for i in range(50) if 100 + i not in s.get(u, set())][:3] for u in (1, 2, 3, 4)}
    assert res == exp


def test_normalize_and_valid(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "item_id long, v array<double>")
    rows = {r["item_id"]: r for r in df.select("item_id", V.l2_normalize("v").alias("u"),
                                              V.is_valid("v").alias("ok")).collect()}
    assert rows[1]["u"] == pytest.approx([0.6, 0.8]) and rows[1]["ok"]
    assert rows[2]["u"] is None and not rows[2]["ok"]


def test_ivf_full_probe_is_exact(spark):
    rng = np.random.default_rng(3)
    it = _vecs(rng, 300, 6)
    idf = spark.createDataFrame(it, "item_id long, v array<double>")
    idx = ann.build_ivf(idf, nlist=10, nprobe=10)
    q = idf.select(F.col("item_id").alias("qid"), "v")
    exact = R.knn(q, idf, 5, "cosine")
    assert ann.recall_at_k(ann.search_ivf(q, idx, 5, nprobe=idx.nlist), exact).first()["recall"] == 1.0
    partial = ann.recall_at_k(ann.search_ivf(q, idx, 5, nprobe=3), exact).first()["recall"]
    assert 0.3 < partial <= 1.0


def test_ivf_save_load(spark, tmp_path):
    rng = np.random.default_rng(4)
    idf = spark.createDataFrame(_vecs(rng, 120, 4), "item_id long, v array<double>")
    idx = ann.build_ivf(idf, nlist=5, nprobe=2)
    ann.save_ivf(idx, str(tmp_path / "ivf"))
    back = ann.load_ivf(spark, str(tmp_path / "ivf"))
    assert back.nlist == idx.nlist and back.items.count() == 120 and len(back.centroids) == idx.nlist


def test_lsh_recall(spark):
    rng = np.random.default_rng(5)
    idf = spark.createDataFrame(_vecs(rng, 200, 6), "item_id long, v array<double>")
    q = idf.select(F.col("item_id").alias("qid"), "v")
    exact = R.knn(q, idf, 5, "cosine")
    found = ann.search_lsh(q, idf, 5)
    assert ann.recall_at_k(found, exact).first()["recall"] > 0.9
    assert found.count() == 200 * 5


def test_every_query_gets_k_rows(spark):
    """Isolated queries have no neighbours in their cells or buckets; the exact search answers them."""
    rng = np.random.default_rng(6)
    items = [(i, (np.eye(8)[i % 8] + rng.normal(size=8) * 1e-3).tolist()) for i in range(80)] + [(900, [0.0] * 8)]
    idf = spark.createDataFrame(items, "item_id long, v array<double>")
    q = spark.createDataFrame([(1, (-np.ones(8)).tolist()), (2, np.ones(8).tolist()), (3, [0.0] * 8)], "qid long, v array<double>")
    exact = R.knn(q, idf, 12, "cosine")
    idx = ann.build_ivf(idf, nlist=8, nprobe=1)
    for found in (ann.search_lsh(q, idf, 12, bits=8), ann.search_ivf(q, idx, 12)):
        assert sorted(tuple(r) for r in found.groupBy("qid").count().collect()) == [(1, 12), (2, 12)]
        # what is filled in is exact: a query without neighbours in its cells has the exact answer
        assert {r["item_id"] for r in found.collect()} <= set(range(80))
    assert ann.recall_at_k(ann.search_lsh(q, idf, 12), exact).first()["recall"] > 0.9


def test_calibrated_probes_reach_the_target(spark):
    rng = np.random.default_rng(7)
    idf = spark.createDataFrame(_vecs(rng, 600, 8), "item_id long, v array<double>")
    q = idf.select(F.col("item_id").alias("qid"), "v")
    idx = ann.build_ivf(idf, nlist=30, nprobe=1)
    n = ann.calibrate_nprobe(q, idx, 5)
    assert 1 < n < idx.nlist
    exact = R.knn(q, idf, 5, "cosine")
    assert ann.recall_at_k(ann.search_ivf(q, idx, 5, nprobe=n, i_block=7, q_block=16), exact).first()["recall"] >= 0.9


def test_best_of_rows_with_ties_and_excluded():
    key = np.array([[0.5, 0.9, 0.9 + 4e-10, 0.1, 0.5], [-np.inf, -np.inf, 2.0, -np.inf, 1.0]])
    rows, cols = R._best(key, 3)
    # 0.9 and 0.9 + 4e-10 are one score after rounding: the smaller column first; -inf is never taken
    assert list(zip(rows, cols)) == [(0, 1), (0, 2), (0, 0), (1, 2), (1, 4)]


def test_vectors_are_not_joined_with_exclusions(spark):
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "qid long, v array<double>")
    it = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "item_id long, v array<double>")
    ex = spark.createDataFrame([(i, j) for i in range(20) for j in range(i)], "qid long, item_id long")
    plan = R.knn(q, it, 3, "dot", exclusions=ex)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan  # exclusions reach the blocks as rows of their own


def test_nearest_cells_hold_few_scores_at_once():
    """10,000 queries against 4,000 cells: the whole matrix has 320 MB, its sorted copies as much each."""
    import tracemalloc
    rng = np.random.default_rng(5)
    Q, C = rng.normal(size=(10_000, 16)), rng.normal(size=(4_000, 16))
    C[7] = C[3]  # a tie goes to the lower number
    tracemalloc.start()
    one = ann.nearest_cells(Q, C, 1)
    three = ann.nearest_cells(Q[:2_000], C, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for a in range(0, 2_000, 500):
        want = np.argsort(-np.round(Q[a:a + 500] @ C.T, 12), axis=1, kind="stable")
        assert (one[a:a + 500, 0] == want[:, 0]).all() and (three[a:a + 500] == want[:, :3]).all()
    assert 3 in one and 7 not in one


def test_lsh_scores_a_bucket_in_few_blocks(spark, monkeypatch):
    """One bit makes 24 buckets of about 3,000 queries and items, or 6,000 where signs are alike: each is one block pair."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(6000, 4)) + np.array([6.0, 0, 0, 0]))]
    vecs = spark.createDataFrame(rows, "item_id long, v array<double>")
    q = vecs.filter("item_id < 50").select(F.col("item_id").alias("qid"), "v")
    calls, local = spark.sparkContext.accumulator(0), R._local_topk

    def counted(*args):
        fn = local(*args)

        def run(a, b):
            calls.add(1 if len(a) and len(b) else 0)
            return fn(a, b)
        return run
    monkeypatch.setattr(R, "_local_topk", counted)
    found = ann.search_lsh(q, vecs, 5, bits=1)
    assert found.count() == 250
    # a bucket is scored once a run; the items of a bucket were met in two blocks where it holds more than 4,096
    assert 0 < calls.value <= 24
