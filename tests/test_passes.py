"""Triples are scored in passes over blocks of users; the rows do not depend on how many there are."""

import pytest

from recsift.operators import retrieval as R


@pytest.mark.parametrize("most", [1, 200, 10**6])
def test_rows_do_not_depend_on_the_number_of_passes(spark, monkeypatch, most):
    monkeypatch.setattr(R, "PASS_VECTORS", most)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 30)
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(70)], "idx long, v array<double>")
    users = spark.createDataFrame([(u, [1.0, float(u)]) for u in range(90)], "user_id long, v array<double>")
    pairs = spark.createDataFrame([(u, 5, s, 1.0, (u * 7 + s) % 70) for u in range(90) for s in range(3)],
                                  "user_id long, item_id long, slot long, weight double, idx long")
    n_l, n_r = R._pair_blocks(270, 90, 70, spark)
    passes = R._passes(n_l, 90, n_r, 70)
    assert [a for a, _ in passes] == [0, *[b for _, b in passes[:-1]]] and passes[-1][1] == n_l
    assert len(passes) == (1 if most == 10**6 else n_l)
    got = {(r["user_id"], r["slot"]): r["s"] for r in R.pair_scores(pairs, users, vecs, lambda x: x.filter("slot >= 0")).collect()}
    assert got == {(u, s): float((u * 7 + s) % 70 + u) for u in range(90) for s in range(3)}
    means = {r["user_id"]: r["v"] for r in R.mean_vectors_by_block(pairs.select("user_id", "idx"), vecs).collect()}
    assert means == {u: [sum((u * 7 + s) % 70 for s in range(3)) / 3, 1.0] for u in range(90)}


def test_few_copies_of_many_vectors(spark):
    # before, 64 blocks of users for 90,000 users and 120,000 vectors: as many copies of every vector
    n_l, n_r = R._pair_blocks(12_586_370, 89_904, 120_000, spark)
    assert n_r == 1 and n_l * 120_000 <= R.PASS_VECTORS
