"""Global positions and bounded broadcasts.

``with_positions`` numbers rows 1..n in a global order without a single-partition
window: rows are range-partitioned on the order key (Spark samples the key to
balance partitions), sorted inside each partition, numbered locally with
``monotonically_increasing_id`` (consecutive inside a partition), and shifted by
the row counts of the preceding partitions.  Only one number per partition
reaches the driver.  The order key must be unique (callers add tie breakers), so
no key value can pile up in one range partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsift.session import materialize

# Bytes (uncompressed) above which a side is never broadcast.
MAX_BROADCAST_BYTES = 32 << 20


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def with_positions(df: DataFrame, order: list[Column], name: str = "pos",
                   num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Return (df with a 1-based ``name`` column in the given order, row count)."""
    n_parts = _partitions(df, num_partitions)
    # Written once: the range bounds come from a sample, and a shuffled input
    # may present rows in another order on a re-run, so the numbered partitions
    # must be fixed on storage before their counts are taken.
    ranged = materialize(df.repartitionByRange(n_parts, *order)
                           .sortWithinPartitions(*order)
                           .withColumn("_mid", F.monotonically_increasing_id()),
                         "positions")
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33))
    counts = sorted((r["_pid"], r["n"]) for r in
                    ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = {}, 0
    for pid, n in counts:
        offsets[pid] = acc
        acc += n
    # one row per partition
    table = F.broadcast(df.sparkSession.createDataFrame(sorted(offsets.items()) or [(-1, 0)], "_pid long, _off long"))
    ranged = ranged.withColumn("_pid", F.col("_pid").cast("long")).join(table, "_pid")
    off = F.col("_off")
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    out = ranged.withColumn(name, (local + 1 + off).cast("long")).select(*df.columns, name)
    return out, acc


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: eight per fixed-size value, the lengths of strings and arrays of numbers."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        size = (F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 8 if kind.startswith("array<") else F.lit(8))
        total = total + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 8
    return total


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES,
                      known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its size is proven below ``max_bytes``.

    ``known_rows`` is an upper bound the caller already holds (e.g. a top-k list) and is
    enough for tables of fixed-size columns; otherwise the bytes are added up.  Larger
    sides get the hint for a sort-merge join: Spark's own limit counts the bytes of compressed
    files, which may hold fifty times as much.
    """
    fixed = not any(k in ("string", "binary") or k.startswith(("array", "map", "struct")) for _, k in df.dtypes)
    if known_rows is not None and fixed:
        size = known_rows * 16 * len(df.columns)
    else:
        size = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df.hint("merge")
