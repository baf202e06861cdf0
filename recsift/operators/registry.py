"""Registry of model runs (X3): an append log, one row per (name, version), one active version per name."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recsift.sources.commits import CommitLog

ENTRY = "kind string, name string, version long, metrics string, created_at string"


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def entries(self) -> DataFrame:
        return self.log.read(ENTRY)

    def register(self, name: str, metrics: dict, created_at: str, version: int | None = None, activate: bool = False) -> int:
        """Add a run; without ``version`` the next one of the name.  An existing (name, version) raises ValueError.
        ``activate`` makes it the active version in the same commit."""
        def decide(_):
            mine = [r["version"] for r in self.entries().filter((F.col("name") == name) & (F.col("kind") != "activate")).select("version").collect()]
            new = version if version is not None else max(mine, default=0) + 1
            if new in mine:
                raise ValueError(f"{name} {new} is registered")
            return {"kind": "run+activate" if activate else "run", "name": name, "version": new, "metrics": json.dumps(metrics, sort_keys=True),
                    "created_at": created_at}
        return self.log.commit(decide)["version"]

    def activate(self, name: str, version: int, created_at: str) -> None:
        """Make ``version`` the active one of ``name``; an unknown version raises ValueError."""
        def decide(_):
            known = self.entries().filter((F.col("name") == name) & (F.col("version") == version) & (F.col("kind") != "activate"))
            if known.isEmpty():
                raise ValueError(f"{name} {version} is not registered")
            return {"kind": "activate", "name": name, "version": version, "metrics": None, "created_at": created_at}
        self.log.commit(decide)

    def runs(self) -> DataFrame:
        """name, version, metrics, created_at, is_active: the last activation of a name holds."""
        e = self.entries()
        w = Window.partitionBy("name").orderBy(F.desc("number"))
        active = e.filter(F.col("kind").endswith("activate")).withColumn("_n", F.row_number().over(w)).filter("_n = 1") \
            .select("name", F.col("version").alias("_active"))
        return e.filter(F.col("kind") != "activate").join(active, "name", "left").select(
            "name", "version", "metrics", F.col("created_at").cast("timestamp").alias("created_at"),
            F.coalesce(F.col("version") == F.col("_active"), F.lit(False)).alias("is_active"))
