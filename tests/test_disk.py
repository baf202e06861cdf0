"""What queries leave on disk: shuffle files, written tables, blocks of learned factors."""

import os
import time

from pyspark.sql import functions as F

from recsift import session as S
from recsift.operators import models as M


def shuffles(spark):
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (status.apply(i) for i in range(status.size())) if f.getName().startswith("shuffle_")}


def test_materialize_drops_its_shuffles_and_keeps_the_setting(spark):
    before, setting = shuffles(spark), spark.conf.get(S.CLEANUP, None)
    df = S.materialize(spark.range(1000).repartition(5, "id"), "t")
    for _ in range(50):  # files go a moment later
        if not shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert df.count() == 1000 and spark.conf.get(S.CLEANUP, None) == setting


def test_release_deletes_only_written_tables(spark, tmp_path):
    a, b = S.materialize(spark.range(5), "a"), S.materialize(spark.range(6), "b")
    own = str(tmp_path / "own")
    spark.range(3).write.parquet(own)
    path = a.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    S.release(a, spark.read.parquet(own))
    assert not os.path.exists(path)
    assert b.count() == 6 and spark.read.parquet(own).count() == 3


def test_blocks_of_factors_grow_with_the_ratings():
    assert M.als_blocks(0) == M.als_blocks(25_000_000) == 10
    assert M.als_blocks(150_000_000) == 60


def test_a_fit_keeps_its_vectors_and_no_ratings(spark):
    rows = spark.createDataFrame([(u, i, 1.0) for u in range(30) for i in range(u % 7, 20)], "user_id long, item_id long, weight double")
    users, items = (S.materialize(rows.select(c).distinct().withColumn(f"{c[:4]}_code", F.col(c)), "codes") for c in ("user_id", "item_id"))
    folder = S.ensure_checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    uf, itf = M.fit_als(rows, users, items, rank=3, max_iter=3)
    assert uf.count() == 30 and itf.count() == 20
    assert {n.rpartition("-")[0] for n in set(os.listdir(folder)) - before} >= {"als-users", "als-items"}
    assert not [n for n in os.listdir(folder) if n.startswith("als-ratings")]
