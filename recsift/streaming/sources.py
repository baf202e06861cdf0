"""Stream sources for tests and replays: a table is written as time-ordered parquet
chunks under the shared folder and read back with ``readStream`` one chunk per
micro-batch, so event time advances batch by batch as in a live feed.  A chunk of many
rows has several files, as many in every chunk, and a micro-batch reads them all."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsift.session import scratch_path


#: rows that one file of a chunk is meant to hold
FILE_ROWS = 100_000


def _files(df: DataFrame) -> Counter:
    """Files read by ``df``, counted by folder."""
    return Counter(f.rsplit("/", 1)[0] for f in df.inputFiles())


def replay_files(df: DataFrame, ts_col: str, chunks: int, name: str) -> tuple[str, object]:
    """Write ``df`` in ``chunks`` consecutive time ranges (one write per range, in
    time order, so file modification times follow event time).  Returns the folder
    and the schema for ``readStream``."""
    spark = df.sparkSession
    root = scratch_path(spark, name)
    b = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = b["lo"], b["hi"]
    files = max(1, -(-b["n"] // (chunks * FILE_ROWS)))
    step = (hi - lo) / chunks
    for i in range(chunks):
        a = lo + step * i
        z = hi if i == chunks - 1 else lo + step * (i + 1)
        cond = (F.col(ts_col) >= F.lit(a)) & ((F.col(ts_col) <= F.lit(z)) if i == chunks - 1
                                               else (F.col(ts_col) < F.lit(z)))
        rows, path = df.filter(cond), f"{root}/chunk={i:04d}"
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("errorifexists").parquet(path)
        # a micro-batch is a number of files: partitions without rows wrote none
        for _ in range(files - _files(spark.read.schema(df.schema).parquet(path)).total()):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return root, df.schema


def read_replay(spark, root: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of the chunks under ``root``: by default the files of one chunk per micro-batch."""
    if files_per_trigger is None:
        chunks = _files(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root))
        files_per_trigger = max(chunks.values(), default=1)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
                 .option("recursiveFileLookup", "true").parquet(root))
