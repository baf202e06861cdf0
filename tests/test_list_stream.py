"""The live store of lists against a plain replay of its operations."""

import datetime as dt
import random

from recsift.plans import catalog_streams as CS
from recsift.session import scratch_path
from recsift.streaming import lists as SL
from recsift.streaming.sources import read_replay

START = dt.datetime(2024, 1, 1)
TTL = {"recs": 3600, "session": 1800}


def model(rows, until):
    held, out = {}, set()
    for seq, ts, op, kind, key, items in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind not in TTL or key is None:
            continue
        if op == "write":
            held[kind, key] = (ts + dt.timedelta(seconds=TTL[kind]), items or [])
        elif op == "delete":
            held.pop((kind, key), None)
        elif ts <= until:
            end, items = held.get((kind, key), (START, []))
            hit = ts < end and bool(items)
            out.add((seq, kind, key, hit, "|".join(map(str, items)) if hit else None))
    return out


def run(spark, rows, chunks, name, salts=4):
    root, size = scratch_path(spark, name), -(-len(rows) // chunks)
    for k in range(chunks):
        spark.createDataFrame(rows[k * size:(k + 1) * size], SL.OPERATIONS).coalesce(1).write.parquet(f"{root}/chunk={k:04d}")
    schema = spark.createDataFrame([], SL.OPERATIONS).schema
    out = CS._run_to_table(SL.serve_stream(read_replay(spark, root, schema), ttl=TTL, salts=salts), f"{name}-out").collect()
    return [(r["seq"], r["kind"], r["key"], r["hit"], r["items"]) for r in out]


def operations(seed, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choice(["write", "read", "read", "read", "delete"] if i % 7 == 0 else ["write", "read", "read"])
        # key 0 takes a third of all rows; minutes repeat, so times tie
        key = 0 if i % 3 == 0 else rng.choice([None, *range(1, 9)])
        items = rng.choice([[], None, [i], [i, i + 1]]) if op == "write" else None
        rows.append((i, START + dt.timedelta(minutes=rng.randrange(60 * 12)), op, rng.choice(["recs", "session", "other"]), key, items))
    return rows


def test_hits_and_misses_equal_a_replay(spark):
    rows = operations(1)
    end = [(9999, START + dt.timedelta(hours=13), "read", "recs", 77, None)]
    # out of order by less than the watermark delay
    rng = random.Random(2)
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 55)))
    got = run(spark, order + end, 4, "t-lists")
    want = model(rows, START + dt.timedelta(hours=12))
    assert len(got) == len(want) and set(got) == want
    assert any(r[3] for r in want) and any(not r[3] for r in want)


def test_batches_and_copies_of_keys_do_not_matter(spark):
    rows = sorted(operations(3, 120), key=lambda r: r[1]) + [(9999, START + dt.timedelta(hours=13), "read", "recs", 77, None)]
    assert sorted(run(spark, rows, 1, "t-lists-1", 1), key=repr) == sorted(run(spark, rows, 3, "t-lists-3", 3), key=repr)


def test_a_batch_calls_the_state_function_once_per_bucket(spark):
    """A call costs milliseconds whatever it holds, so calls must not grow with the keys."""
    calls = spark.sparkContext.accumulator(0)
    serve = SL._serve_fn

    def counted(ttl):
        fn = serve(ttl)

        def run_one(group, pdfs, state):
            calls.add(1)
            yield from fn(group, pdfs, state)
        return run_one
    SL._serve_fn = counted
    try:
        rows = [(i, START + dt.timedelta(seconds=i), "write" if i < 300 else "read", "recs", i % 300, [i]) for i in range(600)]
        rows.append((9999, START + dt.timedelta(hours=13), "read", "recs", 77, None))
        got = run(spark, rows, 2, "t-lists-calls")
    finally:
        SL._serve_fn = serve
    assert set(got) == model(rows, START + dt.timedelta(hours=12)) and len(got) == 300
    # two batches and the one that settles them
    assert calls.value <= 3 * SL.BUCKETS


def test_rows_of_equal_time_and_seq_and_rows_without_seq(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [(1, at(1), "write", "recs", 5, [1]), (1, at(1), "read", "recs", 5, None), (1, at(1), "delete", "recs", 5, None),
            (2, at(2), "read", "recs", 5, None), (2, at(2), "read", "recs", 5, None), (None, at(3), "read", "recs", 5, None),
            (9, at(600), "read", "recs", 77, None)]
    got = run(spark, rows, 1, "t-lists-equal")
    # equal time and seq: delete, read, write
    assert sorted(got, key=repr) == sorted([(1, "recs", 5, False, None), (2, "recs", 5, True, "1"), (2, "recs", 5, True, "1"),
                                            (None, "recs", 5, True, "1")], key=repr)
