"""Negatives of loss rows: every row whose user has an unseen item keeps its due number."""

import random

import duckdb
import pytest

import __spark_entry__ as E
from recsift.operators import split as SP
from recsift.plans import catalog_models as CM
from recsift.plans.context import Context
from recsift.plans.oracle_views import with_views
from recsift.sources.tables import TABLES


def test_unseen_after_equals_a_walk(spark, monkeypatch):
    monkeypatch.setattr(SP, "RANK_BUCKET", 3)
    rng = random.Random(3)
    size, n = 40, 4
    seen = {(u, i) for u, k in enumerate((0, 1, 10, 30, 36, 37, 38, 39, 40)) for i in rng.sample(range(size), k)}
    # places that the user has seen, and places that they have not
    rows = {(u, i + 1000, i) for u in range(9) for i in rng.sample(range(size), 12)} | {(u, i + 1000, i) for u, i in seen if i % 3 == 0}
    got = SP.unseen_after(spark.createDataFrame(sorted(rows), "user_id long, item_id long, idx long"),
                          spark.createDataFrame(sorted(seen), "user_id long, idx long"), size, n)
    want = set()
    for u, item, i in rows:
        free = [(i + k) % size for k in range(1, size) if (u, (i + k) % size) not in seen][:n]
        want |= {(u, item, k + 1, p) for k, p in enumerate(free)}
    assert {tuple(r) for r in got.collect()} == want


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", ["loss_bpr", "loss_triplet", "loss_sampled_softmax", "loss_multitask", "validation_metrics", "session_state_stream"])
def test_against_oracle(spark, small_dir, con, key):
    df = E.queries()[key](spark, small_dir)
    want = con.execute(E.oracle_sql()[key]).df()[sorted(df.columns)]
    got = df.toPandas()[sorted(df.columns)]
    assert sorted(map(tuple, got.round(6).to_numpy().tolist())) == sorted(map(tuple, want.round(6).to_numpy().tolist()))


def test_a_user_who_has_seen_almost_everything_keeps_all_rows(spark, small_dir, con):
    c = Context(spark, small_dir)
    items = sorted(r["item_id"] for r in c.items.select("item_id").collect())
    rng = random.Random(1)
    rows = [(1, i, 1.0) for i in items[:-2]] + [(2, i, 3.0) for i in items] + [(3, i, 5.0) for i in rng.sample(items, int(0.9 * len(items)))]
    train = spark.createDataFrame(rows, "user_id long, item_id long, weight double")
    c.__dict__["train"], c.part = train, lambda name: train
    got = {(r["user_id"], r["item_id"]): len(r["_negs"]) for r in CM.triples(c).collect()}
    unseen = {u: len(items) - sum(r[0] == u for r in rows) for u in (1, 2, 3)}
    assert unseen[2] == 0
    assert got == {(u, i): min(4, unseen[u]) for u, i, _ in rows if u != 2}
