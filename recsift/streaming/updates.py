"""Incremental updates from streams via ``foreachBatch``.

A :class:`BatchLog` is a folder with one subfolder of rows per micro-batch.  A batch reads
the batches before its own id and writes its own folder, overwriting what an earlier
attempt left there: a repeated batch and a restarted stream give the same rows, no
position is kept in memory, and no earlier row is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsift.functions import vectors as V
from recsift.operators import ann


class BatchLog:
    """Rows by micro-batch under ``root``; batch -1 holds the rows from before the stream."""

    def __init__(self, spark, root: str, schema):
        self.spark, self.root = spark, root
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(self._path(-2))

    def _path(self, batch: int) -> str:
        return f"{self.root}/batch={batch}"

    def write(self, df: DataFrame, batch: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(self._path(batch))

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before ``before`` (read by folder)."""
        df = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])) \
            .option("basePath", self.root).parquet(self.root)
        return (df if before is None else df.filter(F.col("batch") < before)).drop("batch")


def user_vector_updater(history: BatchLog, sums: BatchLog, stale: BatchLog, vectors: DataFrame):
    """Log the (user, item) pairs that are new with this batch, add their vectors to the
    users' running sums (one row per user and batch, not a rewrite), and mark the users of
    the batch, whose stored lists are stale."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        b = batch.select("user_id", "item_id").distinct()
        fresh = b.join(history.rows(before=batch_id), ["user_id", "item_id"], "left_anti")
        history.write(fresh, batch_id)
        mine = history.spark.read.schema(history.schema).parquet(history._path(batch_id))
        sums.write(vector_sums(mine, vectors), batch_id)
        stale.write(b.select("user_id").distinct(), batch_id)
    return handle


def vector_sums(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id, s (sum of the vectors of the user's items), n (items with a vector)."""
    return add_up(pairs.join(vectors.select("item_id", F.col("v").alias("s")), "item_id")
                  .select("user_id", "s", F.lit(1).cast("long").alias("n")))


def add_up(sums: DataFrame) -> DataFrame:
    """Add vectors per user, slot by slot."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    g = sums.withColumn("_x", array_to_vector("s")).groupBy("user_id").agg(
        Summarizer.sum(F.col("_x")).alias("_t"), F.sum("n").alias("n"))
    return g.select("user_id", vector_to_array("_t").alias("s"), "n")


def user_vectors(sums: BatchLog) -> DataFrame:
    """user_id and the mean of its items' vectors as of now."""
    return add_up(sums.rows()).select("user_id", F.transform("s", lambda x: x / F.col("n")).alias("v"))


def remaining_lists(lists: DataFrame, stale: BatchLog) -> DataFrame:
    """Stored lists of the users that no batch has touched."""
    return lists.join(stale.rows().distinct(), "user_id", "left_anti")


def index_appender(index_items: BatchLog, centroids: list[list[float]]):
    """New item vectors are assigned to the existing IVF centroids and appended to the
    item table; items that are already there stay as they are.  A full rebuild
    (ann.build_ivf) is a separate scheduled job."""
    idx = ann.IvfIndex(centroids, None, len(centroids), 1, len(centroids[0]) if centroids else 0)

    def handle(batch: DataFrame, batch_id: int) -> None:
        q = batch.filter(V.is_valid("v")).dropDuplicates(["item_id"]) \
            .select(F.col("item_id").alias("qid"), V.l2_normalize("v").alias("v"))
        cells = ann.probe_cells(q, idx, 1).select(F.col("qid").alias("item_id"), "cell", "v")
        known = index_items.rows(before=batch_id).select("item_id")
        index_items.write(cells.join(known, "item_id", "left_anti"), batch_id)
    return handle
