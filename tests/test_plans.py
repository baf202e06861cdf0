"""Plan shape: no cartesian products or nested-loop joins on fact tables, pushed
filters and pruned columns at the scan, partial top-k before shuffles."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from recsift.operators import features as FT
from recsift.operators import retrieval as R
from recsift.plans.context import Context


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_knn_has_no_cartesian(spark, small_dir):
    c = Context(spark, small_dir)
    q = c.vectors.select(F.col("item_id").alias("qid"), "v")
    p = _plan(R.knn(q, c.vectors, 5, "cosine", n_queries=500, n_items=500))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "FlatMapCoGroupsInPandas" in p


def test_trending_pushes_time_filter(spark, small_dir):
    c = Context(spark, small_dir)
    import datetime as dt
    p = _plan(FT.trending(c.events, c.items, dt.datetime(1998, 1, 1), 7, 20))
    assert "PushedFilters" in p
    assert "TakeOrderedAndProject" in p


def test_scan_prunes_columns(spark, small_dir):
    c = Context(spark, small_dir)
    p = _plan(c.interactions.groupBy("user_id").count())
    # lineitem has 11 columns; only the ones the view needs are read
    line = [x for x in p.splitlines() if "ReadSchema" in x and "l_orderkey" in x][0]
    assert "l_extendedprice" not in line and "l_shipdate" not in line


def test_top_k_per_user_uses_group_limit(spark, small_dir):
    c = Context(spark, small_dir)
    ranked = spark.createDataFrame([(i, i + 1, 1.0) for i in range(100)], "item_id long, prank long, score double")
    p = _plan(R.top_k_unseen(ranked, 100, c.train.select("user_id", "item_id"), c.train_users, 10))
    assert "WindowGroupLimit" in p


def test_a_long_ranked_list_meets_users_by_its_head(spark):
    """All users want the first places: a sort-merge join by place would meet them in a few tasks."""
    ranked = spark.createDataFrame([(i, i + 1, 1.0) for i in range(100)], "item_id long, prank long, score double")
    seen = spark.createDataFrame([(u, (u * 7 + j) % 90) for u in range(20) for j in range(5)], "user_id long, item_id long")
    p = _plan(R.top_k_unseen(ranked, 10_000_000, seen, seen.select("user_id").distinct(), 10))
    by_place = [x for x in p.split("\n\n") if "Left keys [1]: [prank" in x]
    assert by_place and not any("SortMergeJoin" in x for x in by_place)
