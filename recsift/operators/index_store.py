"""A maintained IVF index (S5): appended batches, newest vector of an item, drift, split and merge of cells, versions.

A version is a snapshot (items by cell, centres) plus the batches appended since; a commit log names it.  Readers
see a version from its commit on, and keep reading the one they opened.

- ``append`` assigns a batch's vectors to their nearest centres and writes them beside the snapshot; of several vectors of an item
  the one with the latest ``ts`` holds (then the later batch), at whatever time it arrives.  No stored row is rewritten.
- ``state`` measures every cell: its items, and its drift, one minus the cosine of its centre and its items' mean.
- ``maintain`` writes a new snapshot where cells have drifted or are too large or too small: drifted centres move to their means, a
  cell above ``LARGE`` times the mean size is cut in two by k-means on a bounded sample of it, one below ``SMALL`` times
  it gives its items to the others.  All items then go to their nearest centre.  Centres travel with the tasks; there
  are at most ``MAX_CELLS``.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.operators import ann
from recsift.operators import retrieval as R
from recsift.session import materialize
from recsift.sources.commits import CommitLog

LARGE, SMALL, DRIFT = 2.0, 0.1, 0.05
#: rounds in which the new centres move to the means of the items nearest to them
SETTLE = 3
SAMPLE_ROWS, MAX_CELLS = 10_000, 16_384
ITEM = "item_id long, cell long, v array<double>, ts timestamp, batch long"
ENTRY = "kind string, snapshot string, batch string"


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    # ---- versions ----

    def version(self, number: int | None = None) -> tuple[str | None, list[tuple[int, str]]]:
        """(snapshot folder, [(number, batch folder)] appended to it) as of ``number`` (by default the last)."""
        rows = sorted(r for r in self.log.read(ENTRY).collect() if number is None or r["number"] <= number) if self.log.last() else []
        rows = sorted(rows, key=lambda r: r["number"])
        at = max((k for k, r in enumerate(rows) if r["kind"] == "snapshot"), default=None)
        if at is None:
            return None, []
        return rows[at]["snapshot"], [(r["number"], r["batch"]) for r in rows[at + 1:]]

    def items(self, number: int | None = None) -> DataFrame:
        """item_id, cell, v, ts: the newest vector of every item."""
        snapshot, batches = self.version(number)
        rows = self.spark.read.schema(ITEM).parquet(f"{snapshot}/items")
        for _, path in batches:
            rows = rows.unionByName(self.spark.read.schema(ITEM).parquet(path))
        if batches:
            newest = F.max_by(F.struct("cell", "v", "ts"), F.struct("ts", "batch"))
            rows = rows.groupBy("item_id").agg(newest.alias("n")).select("item_id", "n.*")
        return rows.select("item_id", "cell", "v", "ts")

    def centres(self, number: int | None = None) -> list[list[float]]:
        snapshot, _ = self.version(number)
        return [list(r["v"]) for r in self.spark.read.parquet(f"{snapshot}/centres").orderBy("cell").collect()]  # at most MAX_CELLS

    def index(self, number: int | None = None, nprobe: int = ann.DEFAULT_NPROBE) -> ann.IvfIndex:
        c = self.centres(number)
        return ann.IvfIndex(c, self.items(number).select("item_id", "cell", "v"), len(c), min(nprobe, len(c)), len(c[0]) if c else 0)

    # ---- writing ----

    def _assigned(self, rows: DataFrame, centres: list[list[float]]) -> DataFrame:
        """rows: item_id, v (unit), ts, batch."""
        near = ann.probe_cells(rows.select(F.col("item_id").alias("qid"), "v"), ann.IvfIndex(centres, None, len(centres), 1, 0), 1)
        return rows.select("item_id", "v", "ts", "batch").join(near.select(F.col("qid").alias("item_id"), "cell"), "item_id") \
            .select("item_id", "cell", "v", "ts", "batch")

    def _snapshot(self, rows: DataFrame, centres: list[list[float]], seen: int) -> None:
        """Write and commit a snapshot of ``rows``; raises :class:`Conflict` if the log has grown past ``seen``."""
        path = f"{self.root}/snapshot-{seen + 1:06d}"
        self._assigned(rows, centres).write.mode("overwrite").parquet(f"{path}/items")
        self.spark.createDataFrame(list(enumerate(centres)), "cell long, v array<double>").write.mode("overwrite").parquet(f"{path}/centres")
        self.log.publish(seen + 1, {"kind": "snapshot", "snapshot": path})

    def create(self, vectors: DataFrame, nlist: int | None = None) -> None:
        """The first snapshot from (item_id, v, ts)."""
        index = ann.build_ivf(vectors, nlist)
        ts = vectors.groupBy("item_id").agg(F.max("ts").alias("ts"))
        rows = index.items.select("item_id", "v").join(ts, "item_id").withColumn("batch", F.lit(0).cast("long"))
        self._snapshot(rows, index.centroids, self.log.last())

    def append(self, batch: DataFrame, name: str) -> None:
        """Add (item_id, v, ts).  A batch that was appended under the same ``name`` before is not added twice."""
        path = f"{self.root}/batch-{name}"
        if any(p == path for _, p in self.version()[1]) or name in {r["batch"].rsplit("/batch-", 1)[-1] for r in self.log.read(ENTRY).collect() if r["batch"]}:
            return
        newest = batch.filter(V.is_valid("v")).groupBy("item_id").agg(F.max_by(F.struct("v", "ts"), F.struct("ts", F.xxhash64("v"))).alias("n")) \
            .select("item_id", V.l2_normalize("n.v").alias("v"), F.col("n.ts").alias("ts"))
        rows = newest.withColumn("batch", F.lit(self.log.last() + 1).cast("long"))
        self._assigned(rows, self.centres()).write.mode("overwrite").parquet(path)
        self.log.commit(lambda last: {"kind": "batch", "batch": path})

    # ---- maintenance ----

    def state(self) -> DataFrame:
        """cell, n, drift (null for an empty cell), size (n over the mean of all cells)."""
        c = self.spark.createDataFrame(list(enumerate(self.centres())), "cell long, c array<double>")
        items = self.items()
        mean = R.mean_vector(items, "cell").withColumnRenamed("v", "mean")
        n = items.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        j = c.join(n, "cell", "left").join(mean, "cell", "left").fillna({"n": 0})
        return j.select("cell", "n", (1.0 - V.cosine("c", "mean")).alias("drift"), (F.col("n") / F.avg("n").over(Window.partitionBy())).alias("size"))

    def maintain(self) -> dict:
        """Write a new snapshot if cells call for it; what was done, as counts."""
        seen, items = self.log.last(), self.items()
        centres = dict(enumerate(self.centres()))
        cells = self.state().collect()  # one row a cell
        drifted = {r["cell"] for r in cells if r["drift"] is not None and r["drift"] > DRIFT}
        large = {r["cell"] for r in cells if r["size"] is not None and r["size"] > LARGE and r["n"] > 1}
        small = {r["cell"] for r in cells if r["size"] is not None and r["size"] < SMALL} - large
        if len(small) == len(centres):
            small = set()
        done = {"drifted": len(drifted - large - small), "split": len(large), "merged": len(small)}
        if not any(done.values()):
            return done
        means = {r["cell"]: list(r["v"]) for r in R.mean_vector(items.filter(F.col("cell").isin(sorted(drifted))), "cell").collect()} if drifted else {}
        new = [means.get(c, v) for c, v in centres.items() if c not in large and c not in small]
        for c in sorted(large):
            sample = items.filter(F.col("cell") == c).orderBy(F.xxhash64("item_id")).limit(SAMPLE_ROWS)
            model = KMeans(k=2, seed=7, maxIter=10, distanceMeasure="cosine", featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
            new += [[float(x) for x in m] for m in model.clusterCenters()]
        if len(new) > MAX_CELLS:
            raise ValueError(f"{len(new)} cells; build a new index")
        unit = lambda vs: [[x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for v in vs]
        rows, centres = materialize(items.withColumn("batch", F.lit(seen + 1).cast("long")), "index-rows"), unit(new)
        for _ in range(SETTLE):
            means = {r["cell"]: list(r["v"]) for r in R.mean_vector(self._assigned(rows, centres), "cell").collect()}  # one row a cell
            centres = unit([means.get(k, c) for k, c in enumerate(centres)])
        self._snapshot(rows, centres, seen)
        return done
