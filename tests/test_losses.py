"""Losses and validation metrics against numpy on random triples."""

import numpy as np
import pytest

from recsift.operators import models as M


@pytest.fixture(scope="module")
def triples(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        u, p = rng.normal(size=8), rng.normal(size=8)
        negs = rng.normal(size=(3, 8))
        rows.append((i, u.tolist(), p.tolist(), negs.tolist(), float(rng.integers(1, 4))))
    df = spark.createDataFrame(rows, "row_id long, user_v array<double>, pos_v array<double>, "
                                     "neg_v array<array<double>>, weight double")
    return df, rows


def _np(rows):
    U = np.array([r[1] for r in rows])
    P = np.array([r[2] for r in rows])
    N = np.array([r[3] for r in rows])
    W = np.array([r[4] for r in rows])
    return U, P, N, W


def _lse(x):
    m = x.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=1, keepdims=True)))[:, 0]


def test_infonce(triples):
    df, rows = triples
    U, P, N, W = _np(rows)
    pos = (U * P).sum(1)
    neg = np.einsum("bd,bnd->bn", U, N)
    logits = np.concatenate([pos[:, None], neg], axis=1) / 0.1
    exp = np.mean(W * (_lse(logits) - pos / 0.1))
    assert M.loss_infonce(df).first()["loss"] == pytest.approx(exp, rel=1e-9)


def test_bpr(triples):
    df, rows = triples
    U, P, N, W = _np(rows)
    pos = (U * P).sum(1)
    neg = np.einsum("bd,bnd->bn", U, N)
    per = np.log1p(np.exp(-(pos[:, None] - neg))).mean(1)
    assert M.loss_bpr(df).first()["loss"] == pytest.approx(np.mean(W * per), rel=1e-9)


def test_sampled_softmax(triples):
    df, rows = triples
    U, P, N, W = _np(rows)
    pos = (U * P).sum(1)
    neg = np.einsum("bd,bnd->bn", U, N)
    per = _lse(np.concatenate([pos[:, None], neg], axis=1)) - pos
    assert M.loss_sampled_softmax(df).first()["loss"] == pytest.approx(np.mean(W * per), rel=1e-9)


def test_triplet(triples):
    df, rows = triples
    U, P, N, W = _np(rows)
    dp = np.linalg.norm(U - P, axis=1)
    dn = np.linalg.norm(U[:, None, :] - N, axis=2).min(1)
    per = np.maximum(dp - dn + 1.0, 0)
    assert M.loss_triplet(df).first()["loss"] == pytest.approx(np.mean(W * per), rel=1e-9)


def test_losses_positive_and_scalar(triples):
    df, _ = triples
    for fn in (M.loss_infonce, M.loss_bpr, M.loss_sampled_softmax, M.loss_triplet):
        out = fn(df).collect()
        assert len(out) == 1 and out[0]["loss"] > 0


def test_multitask(spark):
    losses = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "task string, loss double")
    w = spark.createDataFrame([("a", 0.5)], "task string, w double")
    assert M.loss_multitask(losses, w).first()["total_fixed"] == pytest.approx(0.5 * 2 + 4)
    s = spark.createDataFrame([("b", 1.0)], "task string, s double")
    r = M.loss_multitask(losses, w, s).first()
    assert r["total_uncertainty"] == pytest.approx(1.0 + np.exp(-1) * 4 + 1)
    assert r["total_fixed"] == pytest.approx(0.5 * 2 + 4)


def test_validation_metrics(triples):
    df, rows = triples
    U, P, N, W = _np(rows)
    pos = (U * P).sum(1)
    neg = np.einsum("bd,bnd->bn", U, N)
    r = M.validation_metrics(df).first()
    assert r["accuracy"] == pytest.approx(np.mean(pos > neg.mean(1)))
    assert r["mrr"] == pytest.approx(np.mean(1 / (1 + (neg >= pos[:, None]).sum(1))))
    assert r["margin"] == pytest.approx(pos.mean() - neg.mean())


def test_tower_unit_norm(spark):
    import pandas as pd  # noqa: F401
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), float(i)) for i in range(20)],
                               "id long, e array<double>, x double")
    layers = M.mlp_weights(5, (8, 6), 3, seed=1)
    out = M.tower_inference(df, "id", ["e"], ["x"], layers).collect()
    assert len(out) == 20
    for r in out:
        assert len(r["v"]) == 3 and np.linalg.norm(r["v"]) == pytest.approx(1.0, abs=1e-5)
