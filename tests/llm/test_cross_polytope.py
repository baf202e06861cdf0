"""Cross-polytope search against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsift.llm import cross_polytope as C

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, dim long, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "s", 3, "k") for i, v in rows], SCHEMA)


def brute(rows, k=5):
    ok = {(i, tuple(np.float32(x) for x in v)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in ok:
        if q % 50 == 0:
            a = np.array(a, float)
            for i, b in ok:
                if i != q and len(b) == len(a):
                    b = np.array(b, float)
                    s = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
                    out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, -2))
    return {q: sorted(((round(s, 9), i) for i, s in m.items()), key=lambda x: (-x[0], x[1]))[:k] for q, m in out.items()}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def search(spark, rows):
    return got(C.nearest(table(spark, rows), F.col("vec_id") % 50 == 0))


def recall(found, exact):
    return sum(len({i for _, i in found.get(q, [])} & {i for _, i in e}) for q, e in exact.items()) / sum(map(len, exact.values()))


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    exact, found = brute(rows), got(C.op11_nearest_vectors(spark, d))
    assert set(found) == set(exact) and all(len(v) == 5 for v in found.values())
    assert recall(found, exact) >= 0.9
    scores = {q: dict((i, s) for s, i in e) for q, e in brute(rows, 10**9).items()}
    assert all(abs(scores[q][i] - s) < 1e-8 for q, f in found.items() for s, i in f)


def test_several_rotations_and_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS_PER_BUCKET", 1)
    monkeypatch.setattr(C, "PART", 4)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 12))
    rows = [(i, [float(x) for x in middle[i % 30] + 0.1 * rng.normal(size=12)]) for i in range(600)]
    assert recall(search(spark, rows), brute(rows)) >= 0.9


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 4)
    rng = np.random.default_rng(5)
    hot, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(i, hot) for i in range(1, 140)]  # a group of copies with queries in it
    rows += [(200 + i, [float(x) for x in rng.normal(size=3)]) for i in range(120)]
    rows += [(400, [2.0, 4.0, 6.0]), (401, [-1.0, -2.0, -3.0]), (450, [0.0, 0.0, 0.0]), (451, None), (452, []), (453, [1.0, None, 2.0]),
             (500, [nan, 1.0, 1.0]), (550, [inf, 1.0, 1.0]), (None, hot), (600, [1.0, 2.0]), (601, [1.0, 0.0]), (650, [5.0]),
             (200, hot), (700, [0.0, -0.0, 1.0]), (701, [0.0, 0.0, 1.0]), (702, [1e-30, 0.0, 1e-30]), (750, [1e30, 0.0, 1e30])]
    rows += rows[:3]
    # few rows: the fitted probes meet all or nearly all; ids of one hot class are never lost
    found, exact = search(spark, rows), brute(rows)
    assert set(found) == set(exact)
    assert found[50] == exact[50] and found[400] == exact[400] and found[600] == exact[600] and found[750][0] == exact[750][0]
    assert 450 not in found and 500 not in found and 550 not in found and 650 not in found
    assert recall(found, exact) >= 0.9


def test_empty_table(spark):
    assert search(spark, []) == {}
    assert search(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0])]) == {}
    assert search(spark, [(50, [1.0, 2.0])]) == {}


def test_hadamard_is_an_isometry():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(C.hadamard(C.hadamard(x)), x) and np.allclose((C.hadamard(x) ** 2).sum(1), (x ** 2).sum(1))


@pytest.mark.parametrize("functions", [1, 2])
def test_own_bucket_is_the_first_probe_of_its_table(functions):
    h = C.Hashes(8, functions)
    x = np.random.default_rng(2).normal(size=(20, 8))
    buckets, probes = h.buckets(x), h.probes(x)
    for b, p in zip(buckets, probes):
        assert set(b) <= set(p) and p[0] in b
