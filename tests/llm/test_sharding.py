"""Shards against the laws they must keep."""

import random
import zlib

from recsift.llm import sharding as S


def check(rows, docs, shards=S.SHARDS):
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    total, largest = sum(s for _, s, _ in want), max((s for _, s, _ in want), default=0)
    for n in range(shards):
        own = [r for r in rows if r["shard"] == n]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= largest
    assert {r["shard"] for r in rows} <= set(range(shards))


def test_documents(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = S.op2_shard_documents(spark, small_dir)
    check(out.collect(), docs)
    assert dict(out.dtypes)["shard"] == "int" and dict(out.dtypes)["grown_shard"] == "int"


def test_hot_text_is_subdivided(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 10)
    rng = random.Random(1)
    docs = [(i, "the same text " * 20 if i % 3 == 0 else "y" * rng.randrange(500)) for i in range(3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, size int").repartition(5)
    records = S.keys(df)
    bounds, measured = S.splitters(records)
    share = sum(b for _, b, _ in measured) / (len(bounds) + 1)
    assert max(b for _, b, _ in measured) <= 3 * S.OVERFULL * share
    check(S.assign(df).collect(), docs)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "a"), (None, "é"), (None, None), (4, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, shard string")
    check(S.assign(df).collect(), docs)
    assert S.assign(df.limit(0)).count() == 0
    one = [(1, "only")]
    check(S.assign(spark.createDataFrame(one, "doc_id long, text string")).collect(), one)


def test_assignment_is_repeatable(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in S.assign(docs).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in S.assign(docs.repartition(5)).collect()}
    assert a == b


def test_written_shards_hold_the_assigned_rows(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    S.write_shards(docs, str(tmp_path / "out"))
    wrote = {r["doc_id"]: r["_shard"] for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "_shard").collect()}
    assert wrote == {r["doc_id"]: r["shard"] for r in S.assign(docs).collect()}


def test_written_shards_of_equal_rows_are_those_of_assign(spark, tmp_path):
    """A cut inside a group of equal rows: the shards written have as many rows as assign gives them."""
    docs = spark.createDataFrame([(1, "the same text")] * 4000 + [(2, "other"), (3, None)], "doc_id long, text string").repartition(5)
    S.write_shards(docs, str(tmp_path / "out"))
    wrote = {r["_shard"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("_shard").count().collect()}
    assert wrote == {r["shard"]: r["count"] for r in S.assign(docs).groupBy("shard").count().collect()}
    assert len(wrote) == 8 and max(wrote.values()) - min(wrote.values()) <= 3
