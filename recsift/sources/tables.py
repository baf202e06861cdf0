"""Readers for the driver's parquet tables and the views this library works on.

The views follow FIXTURES.md §2: ``items`` over ``part``, ``user_events`` over
``lineitem`` joined with ``orders``, ``stream_events`` over ``events``,
``item_vectors`` over ``embeddings``.  The same expressions are written as SQL in
:mod:`recsift.plans.oracle` so that DuckDB can check every query.

Every reader selects only the columns it needs so the parquet scan prunes columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values shared with the oracle views (FIXTURES.md §2).
EVENT_FROM_RETURNFLAG = {"N": "save", "A": "cart", "R": "order"}
EVENT_FROM_STREAM_TYPE = {"view": "save", "click": "cart", "purchase": "order"}
IMAGE_HOST = "https://img.example.com"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _image_urls(key: Column) -> Column:
    k = key.cast("string")
    one = F.concat(F.lit('["' + IMAGE_HOST + "/"), k, F.lit('/0.jpg"]'))
    two = F.concat(F.lit('["' + IMAGE_HOST + "/"), k, F.lit('/0.jpg", "' + IMAGE_HOST + "/"),
                   k, F.lit('/1.jpg"]'))
    m = F.pmod(key, F.lit(7))
    return (F.when(m == 0, F.lit(None).cast("string"))
             .when(m == 1, F.lit(""))
             .when(m == 2, two)
             .otherwise(one))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item catalogue: item_id, category, brand, size_id, price, condition_id,
    created_at, is_active, image_urls."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.cast("long").alias("item_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("long").alias("size_id"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        (F.pmod(k, F.lit(5)) + 1).cast("long").alias("condition_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(k, F.lit(365)).cast("int"))
         .cast("timestamp").alias("created_at"),
        (F.pmod(k, F.lit(10)) != 9).alias("is_active"),
        _image_urls(k).alias("image_urls"),
    )


def _map_expr(col: Column, mapping: dict[str, str]) -> Column:
    out = None
    for src, dst in mapping.items():
        out = (F.when(col == src, F.lit(dst)) if out is None
               else out.when(col == src, F.lit(dst)))
    return out


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: event_id, user_id, item_id, event, ts (orders x lineitem)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("event_id"),
        F.col("o_custkey").cast("long").alias("user_id"),
        F.col("l_partkey").cast("long").alias("item_id"),
        _map_expr(F.col("l_returnflag"), EVENT_FROM_RETURNFLAG).alias("event"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click stream: event_id, ts, user_id, item_id, event (signup/error kept as is)."""
    e = read_table(spark, sf_dir, "events")
    return stream_events_from(e)


def stream_events_from(e: DataFrame) -> DataFrame:
    """The same projection for a batch or a streaming ``events`` frame."""
    mapped = _map_expr(F.col("event_type"), EVENT_FROM_STREAM_TYPE)
    return e.select(
        F.col("event_id").cast("long").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("long").alias("user_id"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.coalesce(mapped, F.col("event_type")).alias("event"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual vectors: item_id, v array<double>, category int."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("long").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("long").alias("category"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
