"""Properties of the keys whose rows no SQL gives: learned, random or hashed results."""

import json

import __spark_entry__ as E
from recsift.operators import text as TX
from recsift.plans.context import Context


def test_text_search_finds_the_item_whose_text_is_asked_for(spark):
    texts = spark.createDataFrame([(i, f"red widget number n{i}") for i in range(40)] + [(99, "blue thing")],
                                  "item_id long, text string")
    hits = sorted(TX.text_search(texts, "item_id", "text", "red widget number n7", 5).collect(), key=lambda r: -r["score"])
    assert hits[0]["item_id"] == 7 and abs(hits[0]["score"] - 1.0) < 1e-9
    assert 99 not in {r["item_id"] for r in hits} and len(hits) == 5


def test_run_registry_has_one_active_version(spark, small_dir):
    rows = E.queries()["run_registry"](spark, small_dir).collect()
    assert {(r["name"], r["version"]) for r in rows} == {("popularity", 1), ("popularity", 2)}
    assert [r["version"] for r in rows if r["is_active"]] == [2]
    assert all(0 <= v <= 1 for r in rows for v in json.loads(r["metrics"]).values())


def test_model_select_keeps_the_lowest_and_stops(spark, small_dir):
    rows = E.queries()["model_select"](spark, small_dir).collect()
    best = [r for r in rows if r["chosen"]]
    assert len(best) == 1 and best[0]["val_loss"] == min(r["val_loss"] for r in rows)
    assert 3 <= len(rows) <= 8


def test_learned_recommendations_skip_seen_items_and_rank_by_score(spark, small_dir):
    rows = E.queries()["recommend_als"](spark, small_dir).collect()
    c = Context(spark, small_dir)
    seen = {(r["user_id"], r["item_id"]) for r in c.train.collect()}
    by_user = {}
    for r in rows:
        assert (r["user_id"], r["item_id"]) not in seen
        by_user.setdefault(r["user_id"], []).append((r["rank"], r["score"]))
    assert len(by_user) == c.train_users.count()
    for v in by_user.values():
        v.sort()
        assert [x for x, _ in v] == list(range(1, len(v) + 1)) and all(a[1] >= b[1] for a, b in zip(v, v[1:]))


def test_learned_similar_items(spark, small_dir):
    rows = E.queries()["similar_items_learned"](spark, small_dir).collect()
    assert all(r["qid"] != r["item_id"] and r["score"] <= 1 + 1e-6 for r in rows)
    n = len({r["qid"] for r in rows})
    assert len(rows) == n * min(10, n - 1)
