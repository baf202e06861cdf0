"""Preparation, features and the temporal split."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from recsift.functions import scalars as S
from recsift.operators import features as FT
from recsift.operators import ordering
from recsift.operators import prep
from recsift.operators import split as SP
from recsift.plans.context import Context


def test_parse_urls(spark):
    df = spark.createDataFrame(
        [(1, '["https://example.com/image.jpg"]'),
         (2, '["https://a.com/1.jpg", "http://b.com/2.png"]'),
         (3, ""), (4, None)], "id long, s string")
    got = {r["id"]: r["u"] for r in df.select("id", S.parse_urls("s").alias("u")).collect()}
    assert got[1] == ["https://example.com/image.jpg"]
    assert got[2] == ["https://a.com/1.jpg", "http://b.com/2.png"]
    assert got[3] == [] and got[4] == []
    first = {r["id"]: r["f"] for r in df.select("id", S.first_url(S.parse_urls("s")).alias("f")).collect()}
    assert first[3] is None and first[2] == "https://a.com/1.jpg"


def test_interaction_weights(spark):
    ev = spark.createDataFrame(
        [(1, 10, "save"), (1, 10, "order"), (1, 11, "cart"), (2, 10, "save")],
        "user_id long, item_id long, event string").withColumn("ts", F.current_timestamp())
    inter = FT.build_interactions(ev)
    w = {(r["user_id"], r["item_id"]): r["weight"] for r in inter.collect()}
    assert w == {(1, 10): 5.0, (1, 11): 3.0, (2, 10): 1.0}


def test_with_positions_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    pos, n = ordering.with_positions(df, [F.col("k"), F.col("id")], num_partitions=7)
    assert n == 5000
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("k", "id")))
    bad = pos.join(ref, ["k", "id"]).filter(F.col("pos") != F.col("rn")).count()
    assert bad == 0


def test_temporal_split(spark, small_dir):
    c = Context(spark, small_dir)
    s = c.split
    n = s.count()
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    train_end, val_end = SP.split_bounds(n, 0.2, 0.1)
    assert counts["train"] == train_end and counts["val"] == val_end - train_end
    assert sum(counts.values()) == n
    b = {r["split"]: (r["lo"], r["hi"]) for r in s.groupBy("split").agg(F.min("ts").alias("lo"),
                                                                       F.max("ts").alias("hi")).collect()}
    assert b["train"][1] <= b["val"][0] and b["val"][1] <= b["test"][0]


def test_split_bounds_float_rule():
    assert SP.split_bounds(10) == (7, 8)
    assert SP.split_bounds(60000) == (42000, 48000)
    assert SP.split_bounds(59391) == (41573, 47512)


def test_label_encoding(spark, small_dir):
    c = Context(spark, small_dir)
    enc = prep.label_encode(c.items, ["category"])
    codes = enc.agg(F.min("category_code").alias("lo"), F.countDistinct("category_code").alias("n"),
                    F.countDistinct("category").alias("m")).first()
    assert codes["lo"] == 0 and codes["n"] == codes["m"]


def test_price_normalization(spark, small_dir):
    c = Context(spark, small_dir)
    p = prep.price_normalized(c.items).agg(F.min("price_normalized").alias("lo"),
                                           F.max("price_normalized").alias("hi")).first()
    assert p["lo"] == pytest.approx(0.0) and p["hi"] == pytest.approx(1.0)


def test_constant_price_gives_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "item_id long, price double")
    assert {r["price_normalized"] for r in prep.price_normalized(df).collect()} == {0.0}


def test_clean_items_newest_row_wins(spark):
    import datetime as dt
    rows = [(1, "a", "b", 5.0, dt.datetime(2020, 1, 1), True),
            (1, "z", "b", 6.0, dt.datetime(2021, 1, 1), None),
            (2, "a", "b", -1.0, dt.datetime(2021, 1, 1), True),
            (3, None, "b", 1.0, dt.datetime(2021, 1, 1), True)]
    df = spark.createDataFrame(rows, "item_id long, category string, brand string, price double, "
                                     "created_at timestamp, is_active boolean")
    got = [tuple(r) for r in prep.clean_items(df).select("item_id", "category", "price", "is_active").collect()]
    assert got == [(1, "z", 6.0, True)]


def test_insert_if_absent(spark):
    old = spark.createDataFrame([("new", 5)], "name string, q int")
    new = spark.createDataFrame([("new", 1), ("good", 3)], "name string, q int")
    got = sorted(tuple(r) for r in prep.insert_if_absent(old, new, ["name"]).collect())
    assert got == [("good", 3), ("new", 5)]


def test_negatives_exclude_seen_and_fill(spark, small_dir):
    c = Context(spark, small_dir)
    negs = SP.negatives_random(c.train, c.items, n=4, seed=1)
    per = negs.groupBy("user_id", "item_id").count()
    assert per.filter(F.col("count") != 4).count() == 0
    assert per.count() == c.train.count()
    seen = c.train.select("user_id", F.col("item_id").alias("neg_item_id"))
    assert negs.join(seen, ["user_id", "neg_item_id"]).count() == 0
    assert negs.groupBy("user_id", "item_id", "neg_item_id").count().filter("count > 1").count() == 0
    again = SP.negatives_random(c.train, c.items, n=4, seed=1)
    assert again.exceptAll(negs).count() == 0


def test_negatives_of_heavy_users_draw_among_the_rest(spark):
    """A user who has seen nearly everything gets exactly what is left; one who has seen all gets none."""
    items = spark.createDataFrame([(i, f"c{i % 3}") for i in range(300)], "item_id long, category string")
    seen = {1: set(range(298)), 2: set(range(300)), 3: {5}, 4: set(range(0, 300, 2)), 5: set(range(0, 300, 3)) - {99}}
    train = spark.createDataFrame([(u, i) for u, s in seen.items() for i in s], "user_id long, item_id long")
    got = {}
    for r in SP.negatives_random(train, items, n=4, seed=3).collect():
        got.setdefault((r["user_id"], r["item_id"]), []).append(r["neg_item_id"])
    for u, s in seen.items():
        for i in s:
            mine = got.get((u, i), [])
            assert len(mine) == len(set(mine)) == min(4, 300 - len(s)) and not set(mine) & s
    missing = {(r["user_id"], r["missing"]) for r in SP.shortfall(train, SP.negatives_random(train, items, n=4, seed=3), 4).collect()}
    assert missing == {(1, 2), (2, 4)}
    hard = {}
    for r in SP.negatives_hard(train, items, n=4, ratio=0.5).collect():
        hard.setdefault((r["user_id"], r["item_id"]), []).append(r["neg_item_id"])
    for u, s in seen.items():
        for i in s:
            left = {j for j in range(300) if j % 3 == i % 3} - s
            mine = hard.get((u, i), [])
            assert len(mine) == len(set(mine)) == min(2, len(left)) and set(mine) <= left
    mixed = {}
    for r in SP.negatives_mixed(train, items, n=4, ratio=0.3).collect():
        mixed.setdefault((r["user_id"], r["item_id"]), []).append((r["slot"], r["neg_item_id"], r["hard"]))
    for i in seen[4]:
        rows = sorted(mixed[(4, i)])
        assert [x[0] for x in rows] == [1, 2, 3, 4] and [x[2] for x in rows] == [True, False, False, False]
        assert len({x[1] for x in rows}) == 4


def test_hard_negatives_same_category(spark, small_dir):
    c = Context(spark, small_dir)
    negs = SP.negatives_hard(c.train, c.items, n=4, ratio=0.3)
    cat = c.items.select(F.col("item_id").alias("neg_item_id"), F.col("category").alias("neg_cat"))
    j = negs.join(cat, "neg_item_id")
    assert j.count() == c.train.count() and j.filter(F.col("neg_cat") != F.col("category")).count() == 0


def test_user_segments(spark):
    inter = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 1)], "user_id long, item_id long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    seg = {r["user_id"]: r["segment"] for r in FT.user_segment(users, inter).collect()}
    assert seg == {1: "warm", 2: "cold", 3: "cold"}


def test_vocabulary_is_the_same_with_and_without_a_window(spark, monkeypatch):
    df = spark.createDataFrame([(f"b{i % 37}",) for i in range(500)], "brand string")
    one = sorted(tuple(r) for r in prep.vocabulary(df, "brand", bounded=True).collect())
    monkeypatch.setattr(prep, "MAX_WINDOW_VALUES", 5)
    assert sorted(tuple(r) for r in prep.vocabulary(df, "brand", bounded=True).collect()) == one
