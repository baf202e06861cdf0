"""Size-balanced sharding by sampled splitters.

Records are ordered by key: the hash of the text, then the hash of the id, then a row
number fixed when the keys are written, so equal texts stand next to each other and no
two records share a key.

1. A size-weighted sample: every record draws one number from its key and is taken with
   a probability in proportion to its size (``SAMPLE`` records in all).
2. Quantiles of the sample are the splitters of ``ranges`` ranges; each range then holds
   about the same number of bytes.
3. The ranges are measured over all records.  Ranges above ``OVERFULL`` times their share
   are subdivided with splitters from a sample of their own, until none is left.  The
   key's later parts let a range end inside a group of equal texts, so a text that a
   third of all rows share is subdivided as well.
4. Shards are cut at equal shares of the bytes: the sums of the ranges before it and a
   running sum inside each range give the place of every record, exactly.

Texts are read once, for their hash, size and checksum; only narrow keys are shuffled.
The driver holds the sample and one row per range.

Defined cases: a null text has size 1, like an empty one; repeated rows are records of
their own; a null doc_id is ordered like any other; extra columns are ignored by
``assign`` and written by ``write_shards``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsift.session import materialize
from recsift.sources.tables import read_table

SHARDS = 8
#: sampled records per range, records per range to aim at, and most ranges
OVERSAMPLE, RANGE_ROWS, MAX_RANGES = 30, 5_000, 4_096
OVERFULL = 2.0
MAX_ROUNDS = 12


def keys(docs: DataFrame, number: str | None = None) -> DataFrame:
    """Narrow records: doc_id, size, text_crc32 and the three parts of the key (the last from column ``number``, if given)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    third = F.col(f"`{number}`") if number else F.monotonically_increasing_id()
    return materialize(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("id"), F.col("doc_id").cast("long")).alias("k2"), third.alias("k3")), "shard-keys")


def _sample(records: DataFrame, rate_per_byte: float) -> np.ndarray:
    """Keys of records taken with probability ``rate_per_byte`` times their size."""
    draw = F.pmod(F.xxhash64(F.lit("draw"), "k1", "k2", "k3"), F.lit(1 << 40)) / float(1 << 40)
    taken = records.filter(draw < F.col("size") * F.lit(rate_per_byte)).select("k1", "k2", "k3").collect()
    return np.array(sorted((r[0], r[1], r[2]) for r in taken), dtype=np.int64).reshape(-1, 3)


def _quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    """``parts - 1`` boundaries at equal steps of the sorted sample."""
    at = (np.arange(1, parts) * len(sample)) // parts
    return sample[np.unique(at)] if len(sample) else sample


def _sorted_unique(boundaries: np.ndarray) -> np.ndarray:
    return np.unique(boundaries, axis=0) if len(boundaries) else boundaries


def range_column(boundaries: np.ndarray):
    """Number of boundaries at or below a key; boundaries are sorted by k1, k2, k3."""
    order = np.dtype([("a", "<i8"), ("b", "<i8"), ("c", "<i8")])
    flat = np.ascontiguousarray(boundaries)

    @F.pandas_udf("int")
    def of(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        if not len(flat):
            return pd.Series(np.zeros(len(k1), np.int32))
        rows = np.stack([k1.to_numpy(), k2.to_numpy(), k3.to_numpy()], axis=1).astype(np.int64)
        cuts = flat.view(order).ravel()
        # the first part decides nearly always; equal first parts compare as whole keys
        low = np.searchsorted(flat[:, 0], rows[:, 0], "left")
        high = np.searchsorted(flat[:, 0], rows[:, 0], "right")
        for i in np.flatnonzero(high > low):
            low[i] += np.searchsorted(cuts[low[i]:high[i]], rows[i:i + 1].view(order).ravel()[0], "right")
        return pd.Series(low.astype(np.int32))
    return of


def _measure(records: DataFrame, boundaries: np.ndarray) -> list:
    r = range_column(boundaries)(F.col("k1"), F.col("k2"), F.col("k3"))
    rows = records.groupBy(r.alias("r")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((x["r"], x["bytes"], x["n"]) for x in rows)


def splitters(records: DataFrame) -> tuple[np.ndarray, list]:
    """(boundaries, [(range, bytes, rows)]) with no range above ``OVERFULL`` shares."""
    total, count = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        return np.empty((0, 3), np.int64), []
    ranges = int(min(MAX_RANGES, max(8 * SHARDS, -(-count // RANGE_ROWS))))
    share = total / ranges
    bounds = _sorted_unique(_quantiles(_sample(records, OVERSAMPLE / share), ranges))
    for _ in range(MAX_ROUNDS):
        measured = _measure(records, bounds)
        overfull = {r: b for r, b, n in measured if b > OVERFULL * share and n > 1}
        if not overfull:
            return bounds, measured
        r = range_column(bounds)(F.col("k1"), F.col("k2"), F.col("k3"))
        inside = records.withColumn("r", r).filter(F.col("r").isin(list(overfull)))
        sample = _sample(inside, 4 * OVERSAMPLE / share)
        more = []
        low = [tuple(b) for b in bounds]
        for n, size in overfull.items():
            lo = low[n - 1] if n else None
            hi = low[n] if n < len(low) else None
            own = np.array([k for k in map(tuple, sample) if (lo is None or k >= lo) and (hi is None or k < hi)],
                           dtype=np.int64).reshape(-1, 3)
            more.append(_quantiles(own, int(2 * size / share) + 2))
        grown = _sorted_unique(np.concatenate([bounds, *more]))
        if len(grown) == len(bounds):
            return bounds, measured  # single records larger than a range
        bounds = grown
    return bounds, _measure(records, bounds)


def assign(docs: DataFrame, shards: int = SHARDS, number: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (its place in the shard) of every row."""
    records = keys(docs, number)
    bounds, measured = splitters(records)
    spark = docs.sparkSession
    total = sum(b for _, b, _ in measured)
    before, acc = [], 0
    for r, b, _ in measured:
        before.append((r, acc))
        acc += b
    # one row per range, at most a few thousand
    offsets = F.broadcast(spark.createDataFrame(before, "r int, before long"))
    r = range_column(bounds)(F.col("k1"), F.col("k2"), F.col("k3"))
    w = Window.partitionBy("r").orderBy("k1", "k2", "k3")
    placed = records.withColumn("r", r).join(offsets, "r").withColumn(
        "at", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # a record belongs to the shard in which its middle byte lies
    placed = placed.withColumn("shard", F.least(F.floor((F.col("at") + F.col("size") / 2) * shards / F.lit(float(max(total, 1)))),
                                                F.lit(shards - 1)).cast("int"))
    placed = materialize(placed.withColumn(
        "n", F.row_number().over(Window.partitionBy("r", "shard").orderBy("k1", "k2", "k3")) - 1), "shard-places")
    counts = placed.groupBy("shard", "r").agg(F.count(F.lit(1)).alias("rows")).collect()
    starts, acc = [], {}
    for c in sorted(counts, key=lambda c: (c["shard"], c["r"])):
        starts.append((c["shard"], c["r"], acc.get(c["shard"], 0)))
        acc[c["shard"]] = acc.get(c["shard"], 0) + c["rows"]
    starts = F.broadcast(spark.createDataFrame(starts, "shard int, r int, first long"))
    return placed.join(starts, ["shard", "r"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n")).cast("long").alias("slot"), "k1", "k2", "k3")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the rows of ``docs`` under ``path/_shard=N``, cut at the keys where ``assign`` changes shard.  The rows are
    numbered and written once before, so a cut inside a group of equal rows splits it where ``assign`` does."""
    number = "_shard_row"
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "shard-rows")
    a = assign(rows, shards, number)
    cuts = [(c["shard"], *c["k"]) for c in a.groupBy("shard").agg(F.min(F.struct("k1", "k2", "k3")).alias("k")).orderBy("shard").collect()]
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("id"), F.col("doc_id").cast("long")).alias("k2"), F.col(number).alias("k3"))
    shard = F.lit(cuts[0][0] if cuts else 0)
    for n, *c in cuts[1:]:
        shard = F.when(key >= F.struct(*[F.lit(x).cast("long").alias(f"k{i + 1}") for i, x in enumerate(c)]), F.lit(n)).otherwise(shard)
    rows.withColumn("_shard", shard.cast("int")).drop(number).write.partitionBy("_shard").parquet(path)


def op2_shard_documents(spark, sf_dir):
    """All documents in eight shards of nearly equal bytes."""
    return assign(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_shard_documents": op2_shard_documents}
