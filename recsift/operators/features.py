"""Interactions, popularity and user/item features.

Every aggregate here is a plain ``groupBy``: Spark combines partially on the map
side, so a user or item that holds a third of all rows costs one partial row per
input partition, not a third of the data in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsift.functions import scalars as S
from recsift.operators import prep

SEGMENT_COLD = 5
SEGMENT_WARM = 20
SEGMENTS = ("cold", "warm", "hot")


def build_interactions(events: DataFrame, weights: dict | None = None) -> DataFrame:
    """A1: one row per (user, item); weight = max event weight, ts = latest event."""
    w = prep.with_event_weight(events, weights)
    return (w.groupBy("user_id", "item_id")
             .agg(F.max("weight").alias("weight"), F.max("ts").alias("ts")))


def popularity(interactions: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Popularity score per item: summed interaction weight and interaction count.

    With ``items`` only active catalogue items are kept (semi join)."""
    pop = interactions.groupBy("item_id").agg(F.sum("weight").alias("pop_weight"),
                                              F.count(F.lit(1)).alias("pop_count"))
    if items is not None:
        active = items.filter(F.col("is_active")).select("item_id")
        pop = pop.join(active, "item_id", "left_semi")
    return pop


def popular_by_category(interactions: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """A3: top-k items overall ('all') and per category in one aggregation pass.

    GROUPING SETS ((item), (category, item)) computes both levels from the same
    partially aggregated rows; the top-k per list is a ``row_number`` filter that
    Spark plans as a WindowGroupLimit (partial top-k before the shuffle)."""
    active = items.filter(F.col("is_active")).select("item_id", "category")
    j = interactions.select("item_id", "weight").join(active, "item_id")
    g = (j.groupingSets([["item_id"], ["category", "item_id"]], "category", "item_id")
          .agg(F.sum("weight").alias("score"), F.grouping("category").alias("_g"))
          .select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("category")).alias("list"),
                  "item_id", "score"))
    w = Window.partitionBy("list").orderBy(F.col("score").desc(), F.col("item_id"))
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
             .select("list", F.col("rank").cast("long"), "item_id", "score"))


def item_popularity(interactions: DataFrame) -> DataFrame:
    """A4: interactions per item."""
    return interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))


def user_truth(interactions: DataFrame) -> DataFrame:
    """A5: distinct (user, item) ground truth."""
    return interactions.select("user_id", "item_id").distinct()


def trending(events: DataFrame, items: DataFrame, as_of, days: int = 7, k: int = 20) -> DataFrame:
    """Event count per active item over (as_of - days, as_of], top k.

    Events are filtered before the join (the time predicate reaches the scan), the
    join is an inner join (the reference's LEFT JOIN with a WHERE on the right side)."""
    lo = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = events.filter((F.col("ts") > lo) & (F.col("ts") <= F.lit(as_of).cast("timestamp")))
    counts = recent.groupBy("item_id").agg(F.count("event_id").alias("score"))
    active = items.filter(F.col("is_active")).select("item_id")
    j = counts.join(active, "item_id")
    return (j.orderBy(F.col("score").desc(), F.col("item_id")).limit(k)
             .select("item_id", F.col("score").cast("double")))


def user_interaction_count(interactions: DataFrame) -> DataFrame:
    """distinct items per user (rows of A1)."""
    return interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_interactions"))


def segment_of(count_col, cold: int = SEGMENT_COLD, warm: int = SEGMENT_WARM):
    c = F.coalesce(count_col, F.lit(0))
    return F.when(c < cold, "cold").when(c < warm, "warm").otherwise("hot")


def user_segment(users: DataFrame, interactions: DataFrame, cold: int = SEGMENT_COLD,
                 warm: int = SEGMENT_WARM) -> DataFrame:
    """cold < 5, warm < 20, else hot; a user with no interactions counts 0."""
    cnt = user_interaction_count(interactions)
    return (users.select("user_id").distinct().join(cnt, "user_id", "left")
                 .select("user_id",
                         F.coalesce("n_interactions", F.lit(0)).cast("long").alias("n_interactions"),
                         segment_of(F.col("n_interactions"), cold, warm).alias("segment")))


def user_top_attribute(interactions: DataFrame, items: DataFrame, attribute: str,
                       top: int) -> DataFrame:
    """the user's ``top`` attribute values by summed weight (ties: value asc),
    pivoted to ``<attribute>_1..top``; missing slots are 0.

    Values are label codes from 1 (0 is the padding code)."""
    voc = prep.vocabulary(items, attribute, start=1, code="_code", bounded=True)
    it = items.select("item_id", attribute).join(voc, attribute)
    per = (interactions.select("user_id", "item_id", "weight").join(it.select("item_id", "_code"), "item_id")
           .groupBy("user_id", "_code").agg(F.sum("weight").alias("_w")))
    w = Window.partitionBy("user_id").orderBy(F.col("_w").desc(), F.col("_code"))
    ranked = per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    cols = [F.coalesce(F.max(F.when(F.col("_r") == i, F.col("_code"))), F.lit(0)).cast("long")
             .alias(f"{attribute}_{i}") for i in range(1, top + 1)]
    return ranked.groupBy("user_id").agg(*cols)


def user_price_range(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """min and max price of the user's items."""
    j = interactions.select("user_id", "item_id").join(items.select("item_id", "price"), "item_id")
    return j.groupBy("user_id").agg(F.min("price").cast("double").alias("price_min"),
                                    F.max("price").cast("double").alias("price_max"))


def user_recency(interactions: DataFrame, as_of, half_life_days: float = 30.0) -> DataFrame:
    """F5 (our formula): exp(-ln2 * days since last interaction / half-life)."""
    last = interactions.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date("last_ts"))
    return last.select("user_id", days.cast("long").alias("days_since_last"),
                       S.recency_score(days, half_life_days).alias("recency"))


def user_features(interactions: DataFrame, items: DataFrame, as_of,
                  half_life_days: float = 30.0) -> DataFrame:
    """F1-F5 side by side.  Count, price range and recency come from one
    groupBy; the two preference tables are joined on user_id."""
    j = interactions.join(items.select("item_id", "price"), "item_id", "left")
    base = j.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.min("price").cast("double").alias("price_min"),
        F.max("price").cast("double").alias("price_max"),
        F.max("ts").alias("last_ts"))
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date("last_ts"))
    base = base.select("user_id", F.col("n_interactions").cast("long"),
                       segment_of(F.col("n_interactions")).alias("segment"),
                       "price_min", "price_max", days.cast("long").alias("days_since_last"),
                       S.recency_score(days, half_life_days).alias("recency"))
    cat = user_top_attribute(interactions, items, "category", 3)
    brand = user_top_attribute(interactions, items, "brand", 2)
    return base.join(cat, "user_id", "left").join(brand, "user_id", "left")


def item_features(items: DataFrame, vectors: DataFrame | None, as_of, dim: int | None = None) -> DataFrame:
    """codes of category, brand, condition, size (from 1), scaled price, days
    listed, and the vector (zeros when missing)."""
    out = items
    for c in ("category", "brand", "condition_id", "size_id"):
        voc = prep.vocabulary(items, c, start=1, code=f"{c}_code", bounded=True)
        out = out.join(voc, c, "left")
    out = prep.price_normalized(out)
    out = prep.days_listed(out, as_of)
    cols = ["item_id", "category_code", "brand_code", "condition_id_code", "size_id_code",
            "price_normalized", "days_listed"]
    if vectors is not None:
        out = prep.vector_left_fill(out, vectors, dim)
        cols += ["v", "has_vector"]
    return out.select(*cols)
