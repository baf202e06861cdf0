"""Shared derived tables for one query: items, events, interactions, split, lists.

A ``Context`` is built per query call; derived frames are created lazily and
reused inside that call, so a query plans each stage once.  Parameters that the
oracle SQL repeats (split ratios, k, thresholds) live here as fixed values.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsift.operators import features as FT
from recsift.operators import prep
from recsift.operators import retrieval as R
from recsift.operators import split as SP
from recsift.session import materialize, size_shuffles
from recsift.sources import tables as T

# Fixed parameters shared with recsift.plans.oracle
TEST_SIZE = 0.2
VAL_SIZE = 0.1
REC_K = 20
KS = (5, 10, 20)
TRENDING_DAYS = 7


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # ---- sources -------------------------------------------------------------
    @cached_property
    def raw_items(self) -> DataFrame:
        return T.items(self.spark, self.sf_dir)

    @cached_property
    def items(self) -> DataFrame:
        return prep.clean_items(self.raw_items)

    @cached_property
    def raw_events(self) -> DataFrame:
        size_shuffles(self.spark, T.read_table(self.spark, self.sf_dir, "lineitem").count())
        return T.user_events(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return prep.clean_events(self.raw_events, self.items)

    @cached_property
    def vectors(self) -> DataFrame:
        return T.item_vectors(self.spark, self.sf_dir)

    @cached_property
    def stream_events(self) -> DataFrame:
        size_shuffles(self.spark, T.read_table(self.spark, self.sf_dir, "events").count())
        return T.stream_events(self.spark, self.sf_dir)

    # ---- derived -------------------------------------------------------------
    @cached_property
    def interactions(self) -> DataFrame:
        return FT.build_interactions(self.events)

    @cached_property
    def as_of(self):
        """Reference time: the latest event (never the wall clock); interactions keep it, so it is read from their
        written split where there is one."""
        rows = self.split if "split" in self.__dict__ else self.events
        return rows.agg(F.max("ts")).first()[0]

    @cached_property
    def split(self) -> DataFrame:
        return SP.temporal_split(self.interactions, TEST_SIZE, VAL_SIZE)

    def part(self, name: str) -> DataFrame:
        return self.split.filter(F.col("split") == name).drop("split", "pos")

    @cached_property
    def train(self) -> DataFrame:
        return self.part("train")

    @cached_property
    def test(self) -> DataFrame:
        return self.part("test")

    @cached_property
    def truth(self) -> DataFrame:
        return FT.user_truth(self.test)

    @cached_property
    def popular_ranked(self) -> tuple[DataFrame, int]:
        pop = FT.popularity(self.train, self.items).withColumnRenamed("pop_weight", "score")
        return R.rank_items(pop, "score")

    @cached_property
    def train_users(self) -> DataFrame:
        return self.train.select("user_id").distinct()

    @cached_property
    def pop_recs(self) -> DataFrame:
        """Model A: most popular training items the user has not touched, top 20."""
        ranked, n = self.popular_ranked
        # read by several evaluations: written once to the shared folder
        return materialize(R.top_k_unseen(ranked, n, self.train.select("user_id", "item_id"),
                                          self.train_users, REC_K), "pop_recs")

    @cached_property
    def recent_ranked(self) -> tuple[DataFrame, int]:
        """Popularity over the last 365 days of training (model B's list)."""
        last = self.train.agg(F.max("ts")).first()[0]
        recent = self.train.filter(F.col("ts") > F.lit(last) - F.expr("INTERVAL 365 DAYS"))
        pop = FT.popularity(recent, self.items).withColumnRenamed("pop_weight", "score")
        return R.rank_items(pop, "score")

    @cached_property
    def recent_recs(self) -> DataFrame:
        """Model B: recently popular unseen items, top 20."""
        ranked, n = self.recent_ranked
        return materialize(R.top_k_unseen(ranked, n, self.train.select("user_id", "item_id"),
                                          self.train_users, REC_K), "recent_recs")

    @cached_property
    def unit_vectors(self) -> DataFrame:
        from recsift.functions import vectors as V
        return (self.vectors.filter(V.is_valid("v"))
                    .select("item_id", V.l2_normalize("v").alias("v"), "category"))

    @cached_property
    def user_vectors(self) -> DataFrame:
        """Mean of the vectors of the user's training items that have one."""
        j = self.train.select("user_id", "item_id").join(self.vectors.select("item_id", "v"), "item_id")
        return materialize(R.mean_vector(j, "user_id"), "user_vectors")
