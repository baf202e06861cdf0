"""Ranking metrics: the reference's exact expectations, plus edge cases."""

import math

import pytest

from recsift.operators import evaluation as EV


def _recs(spark, lists):
    rows = [(u, r + 1, i) for u, items in lists.items() for r, i in enumerate(items)]
    return spark.createDataFrame(rows, "user_id long, rank long, item_id long")


def _truth(spark, truth):
    rows = [(u, i) for u, items in truth.items() for i in items]
    return spark.createDataFrame(rows, "user_id long, item_id long")


def _one(spark, rec, truth, metric, k):
    r = EV.single_metric(_recs(spark, {1: rec}), _truth(spark, {1: truth}), metric, k).collect()
    return r[0][metric]


def test_precision(spark):
    assert _one(spark, [1, 2, 3, 4, 5], [1, 3, 5], "precision", 5) == pytest.approx(0.6)


def test_precision_divides_by_k(spark):
    # a 3-item list at k=10 gives 0.3: the code divides by k
    assert _one(spark, [1, 2, 3], [1, 2, 3], "precision", 10) == pytest.approx(0.3)


def test_recall(spark):
    assert _one(spark, [1, 2, 3, 4, 5], [1, 2, 6, 7, 8], "recall", 5) == pytest.approx(0.4)


def test_ndcg_perfect(spark):
    assert _one(spark, [1, 2, 3, 4, 5], [1, 2, 3], "ndcg", 5) == pytest.approx(1.0)


def test_ndcg_partial(spark):
    v = _one(spark, [4, 5, 6, 1, 2], [1, 2], "ndcg", 5)
    expected = (1 / math.log2(5) + 1 / math.log2(6)) / (1 + 1 / math.log2(3))
    assert 0 < v < 1 and v == pytest.approx(expected)


def test_mrr(spark):
    assert _one(spark, [1, 2, 3], [2], "mrr", 3) == pytest.approx(0.5)


def test_map_counts_positions(spark):
    # hits at ranks 1 and 3: (1/1 + 2/3) / min(5, 2)
    assert _one(spark, [1, 9, 2, 8, 7], [1, 2], "map", 5) == pytest.approx((1 + 2 / 3) / 2)


def test_hit_rate(spark):
    assert _one(spark, [7, 8, 1], [1], "hit_rate", 3) == 1.0
    assert _one(spark, [7, 8, 1], [1], "hit_rate", 2) == 0.0


def test_empty_list_scores_zero(spark):
    users = spark.createDataFrame([(1,)], "user_id long")
    recs = spark.createDataFrame([], "user_id long, rank long, item_id long")
    out = EV.per_user(recs, _truth(spark, {1: [1, 2, 3]}), [5], users=users).collect()[0]
    assert out["precision"] == 0.0 and out["recall"] == 0.0 and out["ndcg"] == 0.0


def test_negative_k_rejected(spark):
    with pytest.raises(ValueError):
        EV.per_user(_recs(spark, {1: [1]}), _truth(spark, {1: [1]}), [-1])


def test_unknown_metric(spark):
    with pytest.raises(KeyError):
        EV.single_metric(_recs(spark, {1: [1]}), _truth(spark, {1: [1]}), "auc", 5)


def test_coverage(spark):
    recs = _recs(spark, {1: [1, 2], 2: [1, 3], 3: [2, 3]})
    catalog = spark.range(10).withColumnRenamed("id", "item_id")
    assert EV.coverage(recs, catalog).first()["coverage"] == pytest.approx(0.3)


def test_evaluate_all_list_of_lists(spark):
    recs = _recs(spark, {1: [1, 2], 2: [1, 3], 3: [2, 3]})
    truth = _truth(spark, {1: [2], 2: [9], 3: [3]})
    res = {(r["metric"], r["k"]): r["value"] for r in EV.evaluate_all(recs, truth, [2]).collect()}
    assert res[("hit_rate", 2)] == pytest.approx(2 / 3)
    assert res[("num_evaluated_users", None)] == 3


def test_diversity_closed_form_matches_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(6, 8))
    v = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(6)], "item_id long, v array<double>")
    recs = _recs(spark, {1: [0, 1, 2, 3, 5]})
    got = EV.diversity_per_user(recs, v).first()["diversity"]
    u = vecs[[0, 1, 2, 3, 5]] / np.linalg.norm(vecs[[0, 1, 2, 3, 5]], axis=1, keepdims=True)
    d = [1 - u[i] @ u[j] for i in range(5) for j in range(i + 1, 5)]
    assert got == pytest.approx(float(np.mean(d)))


def test_novelty_unseen_counts_one(spark):
    recs = _recs(spark, {1: [1, 2]})
    pop = spark.createDataFrame([(1, 4)], "item_id long, popularity long")
    got = EV.novelty_per_user(recs, pop, 8).first()["novelty"]
    assert got == pytest.approx((-math.log2(4 / 8) - math.log2(1 / 8)) / 2)


def test_segments_keep_empty_segment(spark):
    recs = _recs(spark, {1: [1, 2], 2: [3]})
    truth = _truth(spark, {1: [2], 2: [3]})
    train = spark.createDataFrame([(1, i) for i in range(30)] + [(2, i) for i in range(7)],
                                  "user_id long, item_id long")
    res = EV.evaluate_segments(recs, truth, train, [2]).collect()
    n = {r["segment"]: r["value"] for r in res if r["metric"] == "num_evaluated_users"}
    assert n == {"cold": 0.0, "warm": 1.0, "hot": 1.0}
    assert not [r for r in res if r["segment"] == "cold" and r["metric"] != "num_evaluated_users"]


def test_offline_ab(spark):
    a = spark.createDataFrame([("ndcg", 10, 0.2), ("num_evaluated_users", None, 5.0)],
                              "metric string, k int, value double")
    b = spark.createDataFrame([("ndcg", 10, 0.3), ("recall", 10, 0.1)], "metric string, k int, value double")
    rows = {r["metric"]: r for r in EV.offline_ab_test(a, b).collect()}
    assert rows["ndcg@10"]["winner"] == "B"
    assert rows["ndcg@10"]["lift"] == pytest.approx(50.0)
    assert rows["recall@10"]["pct_change"] == float("inf")
    assert "num_evaluated_users" not in rows
