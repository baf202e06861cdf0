"""Stored lists with expiry as a stream (K1-K3, K5 live).

``serve_stream`` takes one stream of operations on stored lists -- write, delete and read,
each on a kind and a key -- and answers every read with the list that was stored at its
event time, if that had not expired: the time to live is that of the kind, renewed by each
write, and an empty list counts as a miss.

The keyed state holds, for a bucket of keys, each key's current list with its expiry and the operations that
the watermark has not reached; these are applied in (time, seq) order once it has, so the
answers do not depend on batches or on disorder within the watermark delay.  A list leaves
when it has expired and nothing waits for its key.  Keys share a bucket because a call of the state
function costs milliseconds whatever it holds: a batch calls it once per bucket, not once per key,
and inside it all keys are answered together.  A key read by a third of all requests (the
popular list) does not meet in one task: reads are dealt over ``SALTS`` copies of the key
and the few writes go to each copy.

Defined cases: rows without time, kind or key, and unknown kinds, take no part; a null list is
an empty one; operations of equal time apply in the order of ``seq``; a row behind the watermark
is applied on arrival.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from recsift.operators.lists import TTL_SECONDS

#: copies of each key among which its reads are dealt
SALTS = 4
#: buckets of keys; more of them keep the state of one small where there are many operations
BUCKETS = 64
OPERATIONS = "seq long, ts timestamp, op string, kind string, key long, item_ids array<long>"
OUTPUT_SCHEMA = "seq long, kind string, key long, hit boolean, items string"
STATE_SCHEMA = "rows binary"
#: codes of the operations; a list that is held comes before all operations that wait, its ``us`` is its expiry
HELD, DELETE, READ, WRITE = range(4)
NO_SEQ = -(1 << 63)
COLUMNS = ("kind", "key", "us", "seq", "op", "items")


def _pack(rows: dict) -> bytes:
    """The rows of a bucket as one Arrow batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(rows[c], pa.string() if c == "items" else pa.int64()) for c in COLUMNS], COLUMNS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> dict:
    with pa.ipc.open_stream(data) as rows:
        table = rows.read_all()
    return {c: table.column(c).to_numpy() for c in COLUMNS}


def _ordered(rows: dict) -> dict:
    """Rows by kind, key, held list first, time, seq; what is equal so far by operation and items."""
    def keys(*last):
        return *last, rows["op"], rows["seq"], rows["us"], rows["op"] != HELD, rows["key"], rows["kind"]
    order = np.lexsort(keys())
    sorted_keys = [k[order] for k in keys()]
    if len(order) > 1 and np.all([k[1:] == k[:-1] for k in sorted_keys], axis=0).any():
        order = np.lexsort(keys(pd.factorize(rows["items"], sort=True)[0]))
    return {c: v[order] for c, v in rows.items()}


def _serve_fn(ttl: dict[str, int]):
    kinds = np.array(list(ttl), dtype=object)
    lives = np.array(list(ttl.values()), dtype=np.int64) * 1_000_000

    def fn(group, pdfs, state):
        parts = [_unpack(bytes(state.get[0]))] if state.exists else []
        if not state.hasTimedOut:
            parts += [{c: p[c].to_numpy() if c == "items" else p[c].to_numpy(np.int64) for c in COLUMNS} for p in pdfs]
        if not parts:
            return
        wm = state.getCurrentWatermarkMs()
        rows = _ordered({c: np.concatenate([p[c] for p in parts]) for c in COLUMNS})
        kind, key, us, seq, op, items = (rows[c] for c in COLUMNS)
        n = len(us)
        at = np.arange(n)
        opens = np.ones(n, bool)
        opens[1:] = (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
        number = np.cumsum(opens) - 1
        first = at[opens]
        settled = (op == HELD) | (us // 1000 <= wm)
        # the settled row that sets the list of the key as of each row; -1: none
        sets = np.maximum.accumulate(np.where(settled & (op != READ), at, -1))
        sets = np.where(sets >= first[number], sets, -1)
        ends = np.where(op == WRITE, us + lives[kind], np.where(op == HELD, us, 0))
        full = np.append((ends > 0) & (items != ""), False)
        reads = at[settled & (op == READ)]
        hit = full[sets[reads]] & (us[reads] < np.append(ends, 0)[sets[reads]])
        # kept: what waits, and lists that live or whose key has something waiting
        waits = np.bincount(number[~settled], minlength=len(first)) > 0
        held = sets[np.append(first[1:], n) - 1]
        held = held[full[held] & ((np.append(ends, 0)[held] // 1000 > wm) | waits)]
        lists = {"kind": kind[held], "key": key[held], "us": ends[held], "seq": np.full(len(held), NO_SEQ), "op": np.full(len(held), HELD),
                 "items": items[held]}
        left = {c: np.concatenate([lists[c], rows[c][~settled]]) for c in COLUMNS}
        if len(left["us"]):
            state.update((_pack(left),))
            alive = ends[held] // 1000 > wm
            due = np.concatenate([ends[held][alive] // 1000 + 1, us[~settled] // 1000])
            state.setTimeoutTimestamp(int(max(due.min(), wm + 1)))
        elif state.exists:
            state.remove()
        if len(reads):
            yield pd.DataFrame({"seq": seq[reads], "kind": kinds[kind[reads]], "key": key[reads], "hit": hit,
                                "items": np.where(hit, items[sets[reads]], None)})
    return fn


def serve_stream(operations: DataFrame, watermark: str = "1 hour", ttl: dict[str, int] | None = None,
                 salts: int = SALTS, buckets: int = BUCKETS) -> DataFrame:
    """seq, kind, key, hit and items ('|'-joined, null for a miss) of every read that the watermark has passed."""
    ttl = ttl or TTL_SECONDS
    code = lambda c, *values: (F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))).alias(c)
    bucket = lambda c: F.pmod(F.xxhash64("kind", "key", c), F.lit(buckets))
    copies = F.when(F.col("op") == "read", F.array(bucket(F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int")))) \
        .otherwise(F.array_distinct(F.array(*[bucket(F.lit(i)) for i in range(salts)])))
    ops = operations.filter(F.col("kind").isin(*ttl) & F.col("key").isNotNull() & F.col("ts").isNotNull()
                            & F.col("op").isin("write", "delete", "read")) \
        .withWatermark("ts", watermark) \
        .select("ts", F.coalesce("seq", F.lit(NO_SEQ)).alias("seq"), code("op", "delete", "read", "write"),
                (code("kind", *ttl) - 1).alias("kind"), "key", F.unix_micros("ts").alias("us"), F.explode(copies).alias("bucket"),
                F.coalesce(F.array_join(F.col("item_ids").cast("array<string>"), "|"), F.lit("")).alias("items"))
    out = ops.groupBy("bucket").applyInPandasWithState(
        _serve_fn(dict(ttl)), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.nullif("seq", F.lit(NO_SEQ)).alias("seq"), "kind", "key", "hit", "items")
