"""Streams agree with their batch twins; state keeps the 50-item cap."""

import datetime as dt

from pyspark.sql import functions as F

from recsift.operators import sessions as SS
from recsift.plans import catalog_streams as CS
from recsift.plans.context import Context
from recsift.session import scratch_path
from recsift.streaming import sessions as SSN
from recsift.streaming import trending as TR
from recsift.streaming import updates as UP
from recsift.streaming.sources import read_replay, replay_files


def _key(rows):
    return {(r["user_id"], r["session_start"], r["n_events"], tuple(r["items"])) for r in rows}


def test_session_stream_equals_batch(spark, small_dir):
    c = Context(spark, small_dir)
    ev = c.stream_events.filter(F.col("event").isin("save", "cart", "order")).select("user_id", "item_id", "ts",
                                                                                    "event")
    batch = _key(SS.sessions(ev).collect())
    root, schema = replay_files(ev, "ts", 4, "t-sessions")
    out = CS._run_to_table(SSN.session_state_stream(read_replay(spark, root, schema)), "t-s1").collect()
    stream = _key(out)
    assert stream and stream <= batch
    # only sessions still open when the input ends are missing
    last = max(r["ts"] for r in ev.select("ts").collect())
    missing = batch - stream
    assert all(s[1] >= last - dt.timedelta(hours=2) for s in missing) or len(missing) <= 5


def test_session_cap_of_fifty(spark):
    rows = [(1, i % 60, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(120)]
    ev = spark.createDataFrame(rows, "user_id long, item_id long, ts timestamp").withColumn("event", F.lit("save"))
    root, schema = replay_files(ev, "ts", 2, "t-cap")
    late = spark.createDataFrame([(1, 999, dt.datetime(2024, 1, 3))], "user_id long, item_id long, ts timestamp") \
        .withColumn("event", F.lit("save"))
    late.write.parquet(f"{root}/chunk=9999")
    out = CS._run_to_table(SSN.session_state_stream(read_replay(spark, root, schema)), "t-cap-out").collect()
    first = [r for r in out if r["n_events"] == 120][0]
    assert len(first["items"]) == 50
    # items 0..59 seen twice: evicted ones come back as in the reference (append if absent, keep last 50)
    assert first["items"][-1] == 59


def test_trending_stream_closed_windows_match_batch(spark, small_dir):
    c = Context(spark, small_dir)
    ev = c.stream_events
    batch = {(r["window_start"], r["item_id"]): r["n"] for r in TR.trending_batch(ev).collect()}
    root, schema = replay_files(ev, "ts", 4, "t-trend")
    out = CS._run_to_table(TR.trending_stream(read_replay(spark, root, schema)), "t-s3").collect()
    stream = {(r["window_start"], r["item_id"]): r["n"] for r in out}
    assert stream and all(batch[k] == v for k, v in stream.items())


def _shuffled(spark, rows, schema, name, chunks, seed):
    """Chunks whose rows are out of order by less than the watermark delay."""
    import random
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.uniform(0, 55)))
    root = scratch_path(spark, name)
    size = -(-len(order) // chunks)
    for k in range(chunks):
        spark.createDataFrame(order[k * size:(k + 1) * size], schema).coalesce(1).write.parquet(f"{root}/chunk={k:04d}")
    return root, spark.createDataFrame([], schema).schema


def _visits(seed, end=dt.datetime(2024, 1, 9)):
    import random
    rng = random.Random(seed)
    rows = [(u, rng.randrange(30), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(86_400)))
            for u in range(12) for _ in range(rng.randrange(5, 60))]
    return rows, [(99, 1, end)]


SCHEMA = "user_id long, item_id long, ts timestamp"


def test_session_stream_with_late_rows_equals_batch(spark):
    rows, last = _visits(1)
    ev = spark.createDataFrame(rows, SCHEMA).withColumn("event", F.lit("save"))
    batch = _key(SS.sessions(ev).collect())
    for chunks in (1, 7):
        root, schema = _shuffled(spark, rows, SCHEMA, "t-late", chunks, chunks)
        spark.createDataFrame(last, SCHEMA).write.parquet(f"{root}/chunk=9999")
        out = CS._run_to_table(SSN.session_state_stream(read_replay(spark, root, schema)), "t-late-out").collect()
        assert _key(out) == batch


def test_dedup_does_not_depend_on_the_batches(spark):
    rows, _ = _visits(2)
    rows = sorted(set(rows), key=lambda r: r[2])
    want, state = [], {}
    for u, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        last, items = state.get(u, (None, []))
        items = [] if last is None or ts - last >= dt.timedelta(minutes=30) else items
        if i not in items:
            want.append((u, i, ts))
        state[u] = (ts, items if i in items else [*items, i][-50:])
    ev = spark.createDataFrame(rows, SCHEMA)
    assert len(want) < len(rows)
    for chunks in (1, 6, 20):
        root, schema = replay_files(ev, "ts", chunks, "t-dedup")
        out = CS._run_to_table(SSN.dedup_stream(read_replay(spark, root, schema)), "t-dedup-out").collect()
        assert sorted(tuple(r) for r in out) == sorted(want)


def test_repeated_and_restarted_batches_leave_the_same_tables(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "item_id long, v array<double>")
    batches = [spark.createDataFrame(b, "user_id long, item_id long") for b in
               ([(1, 1), (1, 2), (2, 3)], [(1, 2), (1, 4)], [(3, 9), (2, 3)])]

    def logs(root):
        return [UP.BatchLog(spark, f"{root}/{n}", s) for n, s in
                (("h", "user_id long, item_id long"), ("s", "user_id long, s array<double>, n long"), ("x", "user_id long"))]

    def run(root, attempts):
        for k in attempts:  # each attempt opens the logs anew, as after a restart
            UP.user_vector_updater(*logs(root), vectors)(batches[k], k)
        h, s, x = logs(root)
        return (sorted(tuple(r) for r in h.rows().collect()),
                sorted((r["user_id"], tuple(r["v"])) for r in UP.user_vectors(s).collect()),
                sorted(r["user_id"] for r in x.rows().distinct().collect()))

    once = run(scratch_path(spark, "s4a"), [0, 1, 2])
    assert once == run(scratch_path(spark, "s4b"), [0, 0, 1, 1, 1, 2, 2])
    assert once[1] == [(1, (7 / 3, 1.0)), (2, (3.0, 1.0)), (3, (9.0, 1.0))] and once[2] == [1, 2, 3]
    lists = spark.createDataFrame([(1, "a"), (7, "b")], "user_id long, item_ids string")
    assert [r["user_id"] for r in UP.remaining_lists(lists, logs(scratch_path(spark, "s4c"))[2]).collect()] != []


def test_index_appends_each_item_once(spark):
    cents = [[1.0, 0.0], [0.0, 1.0]]
    root = scratch_path(spark, "s5")
    schema = "item_id long, cell long, v array<double>"
    UP.BatchLog(spark, root, schema).write(spark.createDataFrame([(1, 0, [1.0, 0.0])], schema), -1)
    new = [spark.createDataFrame(b, "item_id long, v array<double>") for b in
           ([(1, [0.0, 1.0]), (2, [0.1, 2.0]), (2, [0.1, 2.0])], [(3, [3.0, 0.1]), (2, [5.0, 0.0]), (4, [0.0, 0.0])])]
    for k in (0, 0, 1, 1):
        UP.index_appender(UP.BatchLog(spark, root, schema), cents)(new[k], k)
    assert sorted((r["item_id"], r["cell"]) for r in UP.BatchLog(spark, root, schema).rows().collect()) == [(1, 0), (2, 1), (3, 0)]


def test_session_behind_the_watermark_stays_open_although_another_follows(spark):
    """The first session could still be met by a late row; that the user has a later one closes nothing."""
    start = dt.datetime(2024, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    rows = [(1, 5, at(0)), (1, 6, at(10)), (1, 5, at(600)), (1, 7, at(650)), (2, 1, at(661)), (3, 1, at(570))]
    ev = spark.createDataFrame(rows, SCHEMA).withColumn("event", F.lit("save"))
    root, schema = replay_files(ev, "ts", 3, "t-behind")
    out = CS._run_to_table(SSN.session_state_stream(read_replay(spark, root, schema)), "t-behind-out").collect()
    # the watermark stands at minute 601: sessions that ended by minute 571 are closed
    assert _key(out) == {(1, at(0), 2, (5, 6)), (3, at(570), 1, (1,))}


def test_a_large_chunk_has_several_files_and_one_batch_reads_them(spark, monkeypatch):
    from recsift.streaming import sources as SO
    monkeypatch.setattr(SO, "FILE_ROWS", 10)
    start = dt.datetime(2024, 1, 1)
    # three of four chunks hold rows, one of them a single row
    rows = [(i, 1, start + dt.timedelta(minutes=i)) for i in range(100)] + [(100, 1, start + dt.timedelta(minutes=250)), (101, 1, start + dt.timedelta(minutes=400))]
    root, schema = SO.replay_files(spark.createDataFrame(rows, SCHEMA), "ts", 4, "t-files")
    sizes = []
    q = (SO.read_replay(spark, root, schema).writeStream.foreachBatch(lambda b, n: sizes.append(sorted(r["user_id"] for r in b.collect())))
         .option("checkpointLocation", scratch_path(spark, "t-files-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sizes == [list(range(100)), [], [100], [101]]
    assert max(SO._files(spark.read.schema(schema).parquet(f"{root}/chunk=0000")).values()) > 1
