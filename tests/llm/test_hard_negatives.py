"""Mined negatives against all pairs; intervals against true scores."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recsift.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, a string, rank int, positive_id string"


def brute(rows):
    ok = set()
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.add((i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * x) for x in v)))
    out = set()
    for q, label, a in ok:
        if q % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i, y) for i, y, b in ok if i != q and len(a) == len(b)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and -50 * ps <= -100 * s[0] <= -95 * ps)[:3]
            out |= {(q, p, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(fits)}
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", 1, "z") for i, v, y in rows], SCHEMA)
    out = H.mine(df, F.col("vec_id") % 50 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_random_rows_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ROW_BLOCK", 100)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(H, "TRIED", 4)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(8, 20))
    rows = [(int(i), (middle[i % 8] + 0.5 * rng.normal(size=20)).tolist(), int(rng.integers(10))) for i in range(700)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "TRIED", 4)
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 1.0, 0.5], i % 2) for i in range(1, 160)]  # equal vectors: ties by id
    rows += [(200 + i, [float(x) for x in rng.integers(-2, 3, 3)], i % 3) for i in range(90)]
    rows += [(300, [0.0, 0.0, 0.0], 1), (301, [0.5, 0.5, 0.0], 9), (350, [1.0, 1.0, 0.0], 0), (400, None, 1), (401, [], 1), (450, [], 2),
             (451, [], 2), (452, [], 3), (500, [1.0, nan, 1.0], 1), (501, [inf, 1.0, 1.0], 1), (502, [None, 1.0, 1.0], 1),
             (550, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (600, [1.0, 2.0], 1), (601, [1.0, 2.0], 1), (602, [0.7, 1.0], 2),
             (350, [1.0, -1.0, 0.0], 0), (650, [-3.0, -3.0, -3.0], 4), (651, [1.0, 0.0, 0.0], 4)]
    rows += rows[:5] + rows[-3:]
    want = brute(rows)
    assert len(want) > 30 and mined(spark, rows) == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 1e5).round(3).tolist(), i % 2) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_intervals_hold_and_filter():
    rng = np.random.default_rng(6)
    for dim in (1, 5, 64, 100):
        a = np.floor(256 * rng.normal(size=(400, dim)) / np.sqrt(dim)).astype(np.int64)
        a[:3] = [[0] * dim, [256] * dim, [-1] * dim]
        bits, size, along, rest = H.codes(a)
        rows = H.Rows(pd.DataFrame({"vec_id": range(400), "label": 0, "a": [x.tobytes() for x in a], "bits": [b.tobytes() for b in bits],
                                    "size": size, "along": along, "rest": rest}))
        q = a[::20]
        _, low, high = rows.intervals(q)
        true = q @ a.T
        assert (low <= true).all() and (true <= high).all()
        if dim == 64:
            assert np.median(high - low) < 0.6 * 65536  # of unit vectors: well within the range of -1 to 1


def test_best_takes_the_bounds_of_its_own_rows():
    """Rows become doubles once a block, and ``best`` reads only the bounds of the rows it was handed."""
    rng = np.random.default_rng(8)
    a = rng.integers(-256, 256, (600, 24))
    bits, size, along, rest = H.codes(a)
    rows = H.Rows(pd.DataFrame({"vec_id": range(600), "label": np.arange(600) % 3, "a": [x.tobytes() for x in a],
                                "bits": [b.tobytes() for b in bits], "size": size, "along": along, "rest": rest}))
    assert rows.real.dtype == np.float64 and rows.largest == np.abs(a).max()
    q = a[:5]
    bounds = rows.intervals(q)
    for j in range(len(q)):
        able = np.flatnonzero(rows.labels == 1)
        score = a[able] @ q[j]
        for low, high in ((None, None), (0, 90_000), (-50_000, -10)):
            fits = np.ones(len(able), bool) if high is None else (score >= low) & (score <= high)
            want = sorted(zip(-score[fits], able[fits], strict=True))[:5]
            at, found = H.best(rows, q[j], *(b[j, able] for b in bounds), able, low, high, 5)
            assert list(zip(-found, at, strict=True)) == want


def test_large_integers_are_summed_as_integers():
    a = np.array([[1 << 40, 3], [1 << 40, -1]])
    bits, size, along, rest = H.codes(a)
    rows = H.Rows(pd.DataFrame({"vec_id": [1, 2], "label": 0, "a": [x.tobytes() for x in a], "bits": [b.tobytes() for b in bits],
                                "size": size, "along": along, "rest": rest}))
    q = np.array([1 << 20, 1])
    assert rows.scores(q, np.array([0, 1])).tolist() == [(1 << 60) + 3, (1 << 60) - 1]
