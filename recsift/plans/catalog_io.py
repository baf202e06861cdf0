"""Registered file-source and store-summary queries (IO1-IO2, F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.plans.catalog import query, r6
from recsift.plans.context import Context
from recsift.plans.oracle_views import with_views
from recsift.session import scratch_path
from recsift.sources import files as FS


@query("scan_items_csv", with_views("""
    SELECT item_id, category AS category_id, brand AS brand_id, condition_id, size_id,
           round(price::DOUBLE, 6) AS price, coalesce(image_urls, '') AS image_urls FROM items""", "items"))
def scan_items_csv(spark, d):
    """IO1/IO2: the item view written as CSV and read back with the fixed schema
    (no inference, FAILFAST, required id and URL columns checked first)."""
    c = Context(spark, d)
    path = scratch_path(spark, "items-csv")
    (c.raw_items.select("item_id", F.col("category").alias("category_id"), F.col("brand").alias("brand_id"),
                        "condition_id", "size_id", "price", "image_urls")
        .write.option("header", True).option("escape", '"').csv(path))
    it = FS.load_items(spark, path)
    return it.select("item_id", "category_id", "brand_id", "condition_id", "size_id",
                     r6(F.col("price").cast("double")).alias("price"),
                     F.coalesce("image_urls", F.lit("")).alias("image_urls"))


@query("store_stats", with_views("""
    SELECT (SELECT count(*) FROM user_vec) AS users_with_vector,
           (SELECT count(*) FROM vec WHERE list_bool_or(list_transform(v, lambda x: x <> 0))) AS items_with_vector,
           (SELECT count(*) FROM pop_ranked) AS popular_items,
           (SELECT count(DISTINCT user_id) FROM pop_recs) AS cached_lists""",
    "user_vec", "vec", "pop_ranked", "pop_recs"))
def store_stats(spark, d):
    """F8: one row of store sizes: users and items with vectors, popular-list size,
    stored lists."""
    c = Context(spark, d)
    ranked, n_pop = c.popular_ranked
    # four single-number aggregates; each comes to the driver as one value
    row = (c.user_vectors.count(), c.vectors.filter(V.is_valid("v")).count(), n_pop,
           c.pop_recs.agg(F.countDistinct("user_id")).first()[0])
    return spark.createDataFrame([row], "users_with_vector long, items_with_vector long, popular_items long, "
                                        "cached_lists long")
