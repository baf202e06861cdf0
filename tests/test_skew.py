"""A user holding a third of all rows: results stay exact and whole."""

import datetime as dt

from pyspark.sql import functions as F

from recsift.operators import evaluation as EV
from recsift.operators import retrieval as R
from recsift.operators import sessions as SS


def test_top_k_unseen_with_hot_user(spark):
    n_items = 3000
    ranked = spark.range(n_items).select(F.col("id").alias("item_id"), (F.col("id") + 1).alias("prank"),
                                         (F.lit(n_items) - F.col("id")).cast("double").alias("score"))
    # user 0 has seen 2/3 of the catalogue (a third of all rows), others a handful
    hot = spark.range(0, 2000).select(F.lit(0).cast("long").alias("user_id"),
                                      F.floor(F.col("id") * 3 / 2).cast("long").alias("item_id"))
    cold = spark.range(1, 2001).select(F.col("id").alias("user_id"), (F.col("id") % 7).alias("item_id"))
    seen = hot.unionByName(cold).distinct()
    users = seen.select("user_id").distinct()
    got = R.top_k_unseen(ranked, n_items, seen, users, 5, chunk=64)
    hot_got = [r["item_id"] for r in got.filter("user_id = 0").orderBy("rank").collect()]
    hot_seen = {i * 3 // 2 for i in range(2000)}
    assert hot_got == [i for i in range(n_items) if i not in hot_seen][:5]
    assert got.groupBy("user_id").count().filter("count != 5").count() == 0
    assert got.select("user_id").distinct().count() == 2001


def test_sessions_with_hot_user(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, i % 50, t0 + dt.timedelta(minutes=10 * i)) for i in range(3000)]      # one long session
    rows += [(u, 1, t0 + dt.timedelta(hours=u)) for u in range(1, 3001)]             # many one-event users
    ev = spark.createDataFrame(rows, "user_id long, item_id long, ts timestamp").withColumn("event", F.lit("save"))
    s = SS.sessions(ev)
    hot = s.filter("user_id = 0").collect()
    assert len(hot) == 1 and hot[0]["n_events"] == 3000 and len(hot[0]["items"]) == 50
    assert s.count() == 3001


def test_metrics_with_hot_truth(spark):
    recs = spark.createDataFrame([(0, r + 1, r) for r in range(10)] + [(1, 1, 5)],
                                 "user_id long, rank long, item_id long")
    truth = spark.range(0, 5000).select(F.lit(0).cast("long").alias("user_id"), F.col("id").alias("item_id")) \
        .unionByName(spark.createDataFrame([(1, 5)], "user_id long, item_id long"))
    per = {r["user_id"]: r for r in EV.per_user(recs, truth, [10]).collect()}
    assert per[0]["precision"] == 1.0 and per[0]["recall"] == 10 / 5000 and per[0]["ndcg"] == 1.0
    assert per[1]["precision"] == 0.1
