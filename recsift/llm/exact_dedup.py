"""Exact deduplication as stateful streams over content digests.

Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with
the largest doc_id stays.

1. ``store_content`` hashes every text (SHA-256 of the lower-cased UTF-8 bytes) and writes
   the arrivals of a call to the content store: digest, largest doc_id, row count, bytes and
   a locator (number of the call and place in it).  Equal rows combine inside an input task,
   in a buffer of bounded bytes; all other copies are met by the state.
2. ``claims``: a stream over the store whose keyed state (RocksDB, no expiry) keeps, per
   digest, the locator of the first content that had it.  An arrival that is not the first
   is a hit, whether its predecessor came in this call or in an earlier one.
3. ``differing`` reads the bytes of each hit and of the content that the state names, by
   their locators, and compares them all.  Equal bytes confirm the key.  Differing bytes send
   the arrival on to the digest's next key (``digest#1``, ``digest#2``, ...), where it claims
   or hits again: as in a hash table with probing, no digest has to be trusted.
4. ``members``: a second stream whose state keeps, per confirmed key, the stable identifier
   (largest doc_id so far), the locator of its content and the number of rows seen.
5. Rows join their key's state by digest; where a digest has several keys, by the bytes too.

All of it lives under one ``state_path`` in the shared folder: ``content``, ``probes``,
``confirmed`` and the streams' checkpoints.  A later call on the same path goes on from the
state, so a corpus is deduplicated as it grows; arrivals that a failed call left in the
content store are taken up by the next call and need not be handed in again.  One call
at a time may use a path (a second one fails on the existing folder of its number).

Defined cases: null texts count as empty, and empty texts are equal to each other;
repeated rows (same id, same text) count each in ``group_size`` and are all marked
kept by ``groups``, while ``deduplicate`` returns one of them; a null doc_id never
stays if its group has another id; extra columns pass through ``deduplicate``; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsift.llm import ARROW_BYTES, release_memory
from recsift.operators.ordering import bounded_broadcast
from recsift.session import materialize, scratch_path
from recsift.sources.tables import read_table

_STORE = "spark.sql.streaming.stateStore."
#: Keyed state on disk.  A state table has one small store per shuffle partition: without
#: pre-allocated files, with changes instead of whole snapshots per batch, and with one
#: memory bound for all stores of an executor.
STATE_CONF = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.allowFAllocate": "false",
    _STORE + "rocksdb.changelogCheckpointing.enabled": "true",
    _STORE + "rocksdb.boundedMemoryUsage": "true",
    _STORE + "rocksdb.maxMemoryUsageMB": "64",
    _STORE + "unloadOnCommit": "true",  # closed after each batch, so later stages have their memory
}
#: micro-batches of a call, at least
BATCHES = 2
#: bytes of texts that a task holds to combine equal rows before it writes them
HELD_BYTES = 16 << 20
#: rows of a batch turned into Python objects at a time
READ_ROWS = 64
ARRIVAL = "digest string, norm binary, doc_id long, n long"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTENT = ARRIVAL + ", locator string"
PROBE = "key string, digest string, doc_id long, n long, locator string"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digest_only(digest=sha256):
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([digest((t or "").encode().lower()) for t in texts], dtype=object)
    return of


def _combined(digest):
    """Arrivals of a task: one row per text held in the buffer, handed on in batches of bounded bytes."""
    def rows(part):
        return pa.RecordBatch.from_arrays([
            pa.array([digest(x) for x, _ in part], pa.string()), pa.array([x for x, _ in part], pa.binary()),
            pa.array([i for _, (i, _) in part], pa.int64()), pa.array([n for _, (_, n) in part], pa.int64())],
            names=["digest", "norm", "doc_id", "n"])

    def emptied(held):
        """The buffer's rows; each leaves it as it is handed on, so that no second buffer builds up."""
        left, part, size = list(held.items())[::-1], [], 0
        held.clear()
        while left:
            part.append(left.pop())
            size += len(part[-1][0]) + 200
            if size > ARROW_BYTES or not left:
                batch, part, size = rows(part), [], 0
                yield batch

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for k in range(0, batch.num_rows, READ_ROWS):
                for i, text in zip(*(c.slice(k, READ_ROWS).to_pylist() for c in batch.columns), strict=True):
                    norm = (text or "").encode().lower()
                    best, n = held.get(norm, (None, 0))
                    size += 0 if n else len(norm) + 200
                    held[norm] = (i if best is None else best if i is None else max(best, i), n + 1)
                    if size > HELD_BYTES:
                        yield from emptied(held)
                        size = 0
        yield from emptied(held)
        batch = text = norm = None
        release_memory()
    return run


def _folder(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def _next_call(spark, state_path: str) -> int:
    fs, p = _folder(spark, f"{state_path}/content")
    return len(fs.listStatus(p)) if fs.exists(p) else 0


def _read(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if _exists(spark, path) \
        else spark.createDataFrame([], schema)


def store_content(docs: DataFrame, state_path: str, digest=sha256) -> int:
    """Write the arrivals of a call to the content store; returns the call's number."""
    call = _next_call(docs.sparkSession, state_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_combined(digest), ARRIVAL)
    rows.withColumn("locator", F.format_string("%08d:%020d", F.lit(call), F.monotonically_increasing_id())) \
        .write.option("compression", "zstd").parquet(f"{state_path}/content/call={call:08d}")
    return call


def keyed_state(spark, source: str, schema: str, key, aggregates: dict, state_path: str, name: str) -> DataFrame:
    """Run what is new under ``source`` through the stream ``name`` and its keyed state;
    returns the state of every key as of now."""
    out = f"{state_path}/{name}"
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true") \
            .option("maxFilesPerTrigger", _files_per_batch(spark, source)).parquet(source)
        state = stream.groupBy(key.alias("key")).agg(*[c.alias(n) for n, c in aggregates.items()])
        columns = state.schema

        def write(batch: DataFrame, batch_id: int) -> None:
            # one folder per batch: a repeated batch writes the same rows over its own
            batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        query = state.writeStream.outputMode("update").foreachBatch(write) \
            .option("checkpointLocation", f"{state_path}/{name}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
    # the last update of a key is its state
    latest = F.max_by(F.struct(*aggregates), "batch")
    return _read(spark, out, ddl + ", batch long").groupBy("key").agg(latest.alias("s")).select("key", "s.*")


def _files_per_batch(spark, path: str) -> int:
    fs, p = _folder(spark, path)
    last = max((x.getPath().toString() for x in fs.listStatus(p)))
    return max(1, -(-len([x for x in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(last))
                          if x.getPath().getName().endswith(".parquet")]) // BATCHES))


def claims(spark, source: str, schema: str, key, state_path: str, name: str) -> DataFrame:
    """(key, holder): the locator of the first content of every key.  Locators grow with the
    calls, so a claim never changes hands after its call."""
    return keyed_state(spark, source, schema, key, {"holder": F.min("locator")}, state_path, name)


def members(spark, source: str, state_path: str) -> DataFrame:
    """(key, keep_id, locator, group_size) of every confirmed key."""
    return keyed_state(spark, source, PROBE, F.col("key"), {
        "keep_id": F.max("doc_id"), "locator": F.min("locator"), "group_size": F.sum("n")}, state_path, "members")


def differing(texts: DataFrame, hits: DataFrame) -> DataFrame | None:
    """Locators of the hits (key, locator, holder) whose bytes are not those of their key's
    holder, None without any.  ``texts`` has (key, locator, norm).

    The contents of a key's hits and of its holder are grouped by their bytes, equal ones
    combining before the shuffle; no others are shuffled, as hashes of the locators preselect
    them.  Keys with one group are confirmed; only others are compared hit by hit."""
    places = hits.select("locator").union(hits.select("holder")).select(F.xxhash64("locator").alias("_h")).distinct()
    places = bounded_broadcast(materialize(places, "dedup-hit-places"))
    part = texts.withColumn("_h", F.xxhash64("locator")).join(places, "_h", "left_semi").drop("_h")
    same = part.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"))
    torn = materialize(same.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "dedup-torn")
    if torn.isEmpty():
        return None
    part = materialize(part.join(torn, "key", "left_semi"), "dedup-torn-texts")
    found = part.select("key", "locator", F.col("norm").alias("found"))
    held = part.select("key", F.col("locator").alias("holder"), F.col("norm").alias("held"))
    out = hits.join(found, ["key", "locator"]).join(held, ["key", "holder"]).filter(F.col("found") != F.col("held"))
    return materialize(out.select("locator"), "dedup-apart")


def confirm(spark, state_path: str, call: int) -> None:
    """Give every arrival of the call its key, confirmed by the bytes, in ``confirmed``."""
    content = _read(spark, f"{state_path}/content", CONTENT)
    texts = content.select(F.col("digest").alias("key"), "locator", "norm")
    open_rows = content.filter(F.col("locator") >= f"{call:08d}:").select(
        F.col("digest").alias("key"), "digest", "doc_id", "n", "locator")
    holders = claims(spark, f"{state_path}/content", CONTENT, F.col("digest"), state_path, "claims")
    step = 0
    while True:
        hits = materialize(open_rows.join(holders, "key").filter("locator <> holder").select("key", "locator", "holder"), "dedup-hits")
        apart = differing(texts, hits)
        done = f"{state_path}/confirmed/call={call:08d}-{step:04d}"
        if apart is None:
            open_rows.write.parquet(done)
            return
        open_rows.join(apart, "locator", "left_anti").select(*open_rows.columns).write.parquet(done)
        step += 1
        probes = f"{state_path}/probes/call={call:08d}-{step:04d}"
        open_rows.join(apart, "locator", "left_semi").withColumn(
            "key", F.concat("digest", F.lit(f"#{step}"))).select(*open_rows.columns).write.parquet(probes)
        open_rows = spark.read.schema(PROBE).parquet(probes)
        probed = _read(spark, f"{state_path}/probes", PROBE).select("key", "locator")
        texts = content.select("locator", "norm").join(probed, "locator")
        holders = claims(spark, f"{state_path}/probes", PROBE, F.col("key"), state_path, "probe-claims")


def groups(docs: DataFrame, digest=sha256, state_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, key.  With a
    ``state_path`` of earlier calls, groups reach over all of them."""
    spark = docs.sparkSession
    state_path = state_path or scratch_path(spark, "dedup-state")
    confirm(spark, state_path, store_content(docs, state_path, digest))
    # written before the join: adaptive execution splits a hot key only between plain shuffles
    state = materialize(members(spark, f"{state_path}/confirmed", state_path), "dedup-groups")
    rows = docs.select("doc_id", F.col("text"), digest_only(digest)(F.col("text")).alias("digest"))
    if _exists(spark, f"{state_path}/probes"):
        # each key's own bytes tell which key of its digest a row has
        keyed = _read(spark, f"{state_path}/confirmed", PROBE).select("key", "digest", "locator")
        several = keyed.filter("key <> digest").select("digest").distinct()
        places = keyed.join(several, "digest", "left_semi").groupBy("key", "digest").agg(F.min("locator").alias("locator"))
        texts = _read(spark, f"{state_path}/content", CONTENT).select("locator", "norm")
        own = places.join(texts, "locator").select("digest", "norm", F.col("key").alias("_key"))
        low = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()).cast("binary")
        rows = rows.withColumn("norm", low).join(own, ["digest", "norm"], "left").withColumn(
            "key", F.coalesce("_key", "digest"))
    else:
        rows = rows.withColumn("key", F.col("digest"))
    return rows.select("doc_id", "digest", "key").join(state, "key").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"), "key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = materialize(groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
                       .distinct(), "dedup-kept")
    hashed = docs.withColumn("_digest", digest_only()(F.col("text")))
    same = [hashed["doc_id"].eqNullSafe(kept["_id"]), hashed["_digest"] == kept["_digest"]]
    out = hashed.join(kept, same[0] & same[1], "left_semi")
    return out.dropDuplicates(["doc_id", "_digest"]).select(*docs.columns)


def op7_exact_dedup(spark, sf_dir):
    """Every document with the id that stays for its text, its group's size and digest."""
    return groups(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

ORACLE = {"op7_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""}
