"""Sizes of shuffle partitions, draws that stay in their row, and scores of pairs by blocks."""

import numpy as np
from pyspark.sql import functions as F

from recsift.operators import ann
from recsift.operators import evaluation as EV
from recsift.operators import retrieval as R
from recsift.operators import split as SP
from recsift.operators.ordering import bounded_broadcast
from recsift.session import ROWS_PER_TASK, TASK_BYTES, size_shuffles

PARTS, SIZE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_partitions_follow_the_rows(spark):
    before = {k: spark.conf.get(k, None) for k in (PARTS, SIZE)}
    try:
        spark.conf.set(SIZE, "64MB")
        size_shuffles(spark, 100 * ROWS_PER_TASK + 1)
        assert spark.conf.get(PARTS) == "101" and spark.conf.get(SIZE) == str(TASK_BYTES)
        spark.conf.set(SIZE, "16k")
        size_shuffles(spark, 1)  # never fewer, never larger
        assert spark.conf.get(PARTS) == "101" and spark.conf.get(SIZE) == "16k"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_draws_by_list_and_by_join_agree(spark, monkeypatch):
    seen = [(u, "", (u * 7 + 3 * j) % 40) for u in range(6) for j in range(u * 5)]
    seen = sorted(set(seen))
    pos = [(u, i, "", [(i * 11 + 5 * j) % 40 for j in range(8)]) for u in range(6) for i in range(10)]
    s = spark.createDataFrame(seen, "user_id long, grp string, idx long")
    p = spark.createDataFrame(pos, "user_id long, item_id long, grp string, draws array<long>")
    have = {u: {i for v, _, i in seen if v == u} for u in range(6)}
    want = {(u, i): [x for x in d if x not in have[u]][:4] for u, i, _, d in pos}
    for most in (512, 12, 0):  # all users by list, some, none
        monkeypatch.setattr(SP, "SEEN_LIST", most)
        got = {(r["user_id"], r["item_id"]): r["places"] for r in SP.unseen_draws(p, s, 4).collect()}
        assert got == want


def test_negatives_make_no_row_per_draw(spark, monkeypatch):
    train = spark.createDataFrame([(u, (u * 3 + j) % 50, 1.0) for u in range(20) for j in range(6)], "user_id long, item_id long, weight double")
    seen = train.select("user_id", F.lit("").alias("grp"), F.col("item_id").alias("idx"))
    pos = train.select("user_id", "item_id", F.lit("").alias("grp"), F.lit(50).alias("size"))
    drawn = SP.unseen_draws(SP._hashed_draws(pos, 4, 42), seen, 4)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and drawn.count() == 120


def test_pair_scores_and_means_by_block(spark, monkeypatch):
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(R, "PAIRS_PER_BLOCK", 20)
    monkeypatch.setattr(R, "PAIR_CHUNK", 3)
    rng = np.random.default_rng(3)
    users, items = rng.normal(size=(11, 4)), rng.normal(size=(23, 4))
    pairs = [(u, 100 + i, k, 1.0, (u * 5 + i * 3 + k) % 25) for u in range(12) for i in range(4) for k in range(2)]  # user 11, places 23, 24: no vector
    u = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "user_id long, v array<double>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "idx long, v array<double>")
    p = spark.createDataFrame(pairs, "user_id long, item_id long, slot long, weight double, idx long")
    got = {(r["user_id"], r["item_id"], r["slot"]): (r["s"], r["d"]) for r in R.pair_scores(p, u, v).collect()}
    want = {(a, b, k): (users[a] @ items[x], np.linalg.norm(users[a] - items[x])) for a, b, k, _, x in pairs if a < 11 and x < 23}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    means = {r["user_id"]: r["v"] for r in R.mean_vectors_by_block(p.select("user_id", "idx"), v).collect()}
    for a in range(12):
        assert np.allclose(means[a], np.mean([items[x] for b, _, _, _, x in pairs if b == a and x < 23], axis=0))


def test_probes_come_in_small_frames(spark):
    rng = np.random.default_rng(5)
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "qid long, v array<double>")
    cents = rng.normal(size=(100, 4)).tolist()
    got = ann.probe_cells(q, ann.IvfIndex(cents, None, 100, 90, 4))
    assert got.count() == 300 * 90 and ann.OUT_ROWS == 16_384


def test_a_repeated_place_counts_as_in_a_join(spark):
    u = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, v array<double>")
    v = spark.createDataFrame([(5, [2.0, 0.0]), (5, [4.0, 1.0])], "idx long, v array<double>")
    p = spark.createDataFrame([(1, 9, 0, 1.0, 5)], "user_id long, item_id long, slot long, weight double, idx long")
    assert sorted(r["s"] for r in R.pair_scores(p, u, v).collect()) == [2.0, 4.0]
    assert R.mean_vectors_by_block(p.select("user_id", "idx"), v).first()["v"] == [3.0, 0.5]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_sides_are_not_broadcast_by_file_size(spark, tmp_path):
    """A file that compresses well is far below Spark's limit for broadcasts; what its rows weigh decides."""
    spark.range(20_000).selectExpr("id", "array_repeat(0.5D, 64) AS v").coalesce(1).write.parquet(str(tmp_path / "side"))
    side, keys = spark.read.parquet(str(tmp_path / "side")), spark.range(20_000)
    assert "BroadcastHashJoin" in _plan(keys.join(bounded_broadcast(side), "id"))
    out = keys.join(bounded_broadcast(side, max_bytes=1 << 20), "id")
    assert "SortMergeJoin" in _plan(out) and "Broadcast" not in _plan(out) and out.count() == 20_000


def test_lists_are_not_broadcast_to_their_vectors(spark, tmp_path):
    """Lists of few items make small files of many rows: the vectors of those items travel, not the lists."""
    spark.range(6_000).selectExpr("id AS user_id", "explode(sequence(1L, 5L)) AS item_id").coalesce(1).write.parquet(str(tmp_path / "recs"))
    spark.range(1, 3_000).selectExpr("id AS item_id", "transform(sequence(1, 32), j -> sin(id * j)) AS v").coalesce(1) \
        .write.parquet(str(tmp_path / "vectors"))
    recs, vectors = spark.read.parquet(str(tmp_path / "recs")), spark.read.parquet(str(tmp_path / "vectors"))
    out = EV.diversity_per_user(recs, vectors)
    assert "BuildLeft" not in _plan(out)
    u = np.sin(np.outer(np.arange(1, 6), np.arange(1, 33)))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = 1 - (u @ u.T)[np.triu_indices(5, 1)].mean()
    low, high, n = out.selectExpr("min(diversity)", "max(diversity)", "count(*)").first()
    assert n == 6_000 and abs(low - want) < 1e-12 and abs(high - want) < 1e-12
