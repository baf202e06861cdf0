"""Registered queries against their DuckDB oracle at sf0.001 (a fast subset here;
scripts/check_oracle.py runs every key at any scale)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from recsift.sources.tables import TABLES

KEYS = ["evaluate_all", "temporal_split", "interactions_weighted", "popular_by_category", "trending_7d",
        "knn_cosine", "knn_exclude", "similar_items", "sessions_batch", "loss_infonce", "diversity",
        "evaluate_segments", "hybrid_recommend", "rec_lists_live", "query_key", "user_features",
        "parse_image_urls", "trending_sliding", "offline_ab_test"]


def _norm(v):
    if isinstance(v, float):
        return "inf" if math.isinf(v) else round(v, 6) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


@pytest.mark.parametrize("key", KEYS)
def test_against_oracle(spark, small_dir, con, key):
    df = E.queries()[key](spark, small_dir)
    s = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[key])
    d = _rows([x[0] for x in res.description], res.fetchall())
    assert s == d


def test_entry(spark):
    out = E.entry(spark).collect()
    assert {r["metric"] for r in out} >= {"precision", "ndcg", "num_evaluated_users"}
