"""The maintained index: newest vectors, repeated batches, versions, and recall after many batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsift.operators import ann
from recsift.operators import retrieval as R
from recsift.operators.index_store import IndexStore
from recsift.sources.commits import Conflict

SCHEMA = "item_id long, v array<double>, ts timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], t) for i, v, t in rows], SCHEMA)


def test_newest_vector_wins_whenever_it_arrives(spark, tmp_path):
    rng = np.random.default_rng(1)
    store = IndexStore(spark, str(tmp_path / "i"))
    store.create(table(spark, [(i, rng.normal(size=4), day(0)) for i in range(60)]), nlist=4)
    x, y, z = np.eye(4)[:3]
    store.append(table(spark, [(1, x, day(5)), (1, y, day(3)), (2, x, day(1)), (100, z, day(1)), (101, np.zeros(4), day(1))]), "a")
    opened = store.log.last()
    store.append(table(spark, [(1, z, day(4)), (2, y, day(2))]), "b")
    store.append(table(spark, [(2, z, day(9))]), "a")  # the name of a batch that is there already
    got = {r["item_id"]: list(r["v"]) for r in store.items().collect()}
    assert len(got) == 61 and got[1] == list(x) and got[2] == list(y) and got[100] == list(z)
    # an older version reads as it was
    assert {r["item_id"]: list(r["v"]) for r in store.items(opened).collect()}[2] == list(x)


def test_recall_after_ten_batches_is_that_of_a_fresh_build(spark, tmp_path):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 12))
    point = lambda k: middle[k] + 0.5 * rng.normal(size=12)
    store = IndexStore(spark, str(tmp_path / "i"))
    rows = [(i, point(i % 10), day(0)) for i in range(800)]  # the first items know a quarter of the groups
    store.create(table(spark, rows), nlist=20)
    did = {"drifted": 0, "split": 0, "merged": 0}
    for b in range(10):
        batch = [(1000 + 100 * b + i, point(10 + (3 * b + i) % 30), day(b + 1)) for i in range(100)]
        rows += batch
        store.append(table(spark, batch), f"b{b}")
        if b in (4, 9):
            for k, n in store.maintain().items():
                did[k] += n
    assert sum(did.values()) > 0 and store.items().count() == len(rows)
    every = table(spark, rows)
    q = every.filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "v")
    exact = R.knn(q, every, 10, "cosine")
    recall = lambda index: ann.recall_at_k(ann.search_ivf(q, index, 10, 4), exact).first()["recall"]
    assert recall(store.index()) >= recall(ann.build_ivf(every, nlist=len(store.centres()))) - 0.02


def test_maintenance_gives_way_to_another_writer(spark, tmp_path):
    rng = np.random.default_rng(3)
    store = IndexStore(spark, str(tmp_path / "i"))
    store.create(table(spark, [(i, rng.normal(size=4), day(0)) for i in range(60)]), nlist=4)
    seen = store.log.last()
    store.append(table(spark, [(200, np.ones(4), day(1))]), "a")
    with pytest.raises(Conflict):
        store._snapshot(store.items().withColumn("batch", F.lit(0).cast("long")), store.centres(), seen)
    assert store.items().filter("item_id = 200").count() == 1
