"""Preparation: cleaning, URL parsing, weights, encodings, price scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsift.functions import scalars as S
from recsift.functions import vectors as V
from recsift.operators.ordering import with_positions

VALID_EVENTS = tuple(S.EVENT_WEIGHTS)


def clean_items(items: DataFrame) -> DataFrame:
    """Required ids, price >= 0, one row per item (latest created_at, then the
    lowest category/brand for a deterministic pick); ``is_active`` defaults to true."""
    ok = items.filter(F.col("item_id").isNotNull() & F.col("category").isNotNull()
                      & F.col("price").isNotNull() & (F.col("price") >= 0))
    if "is_active" in items.columns:
        ok = ok.withColumn("is_active", F.coalesce("is_active", F.lit(True)))
    else:
        ok = ok.withColumn("is_active", F.lit(True))
    # One row per item with min_by: an aggregate with a map-side partial step, so
    # an item id repeated in a third of all rows is reduced in every input
    # partition instead of being sorted in one task.  Order: latest created_at
    # (nulls last), then category, then brand.
    cols = [c for c in ok.columns if c != "item_id"]
    newest_first = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")),
                              F.lit(2 ** 62).cast("long"))
    order = F.struct(newest_first.alias("t"), F.col("category").alias("c"), F.col("brand").alias("b"))
    return (ok.groupBy("item_id").agg(F.min_by(F.struct(*cols), order).alias("_r"))
              .select("item_id", *[F.col(f"_r.{c}").alias(c) for c in cols]))


def clean_events(events: DataFrame, items: DataFrame) -> DataFrame:
    """Known event type, non-null user and item, item exists (left semi join)."""
    ok = events.filter(F.col("event").isin(*VALID_EVENTS)
                       & F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    return ok.join(items.select("item_id"), "item_id", "left_semi")


def with_image_urls(items: DataFrame) -> DataFrame:
    """P3 + P5: parsed URL list and its first element."""
    return (items.withColumn("urls", S.parse_urls("image_urls"))
                 .withColumn("first_url", S.first_url("urls")))


def items_with_image(items: DataFrame) -> DataFrame:
    """Only items whose URL list is non-empty."""
    return with_image_urls(items).filter(F.size("urls") > 0)


def with_event_weight(events: DataFrame, weights: dict | None = None) -> DataFrame:
    """Save 1, cart 3, order 5."""
    return events.withColumn("weight", S.event_weight("event", weights))


#: values that one task may number
MAX_WINDOW_VALUES = 100_000


def vocabulary(df: DataFrame, column: str, start: int = 0, code: str = "code",
               bounded: bool = False) -> DataFrame:
    """Distinct values of ``column`` numbered densely in sorted value order.

    Distinct values are aggregated first (partial aggregation).  ``bounded=True`` is
    for dimension attributes that are expected to be small (category, brand, size): if
    the counted values are at most ``MAX_WINDOW_VALUES`` they are numbered by
    ``dense_rank`` in one small task.  All other vocabularies are numbered by a range
    partition, never by a single-partition window.
    """
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    if bounded and distinct.limit(MAX_WINDOW_VALUES + 1).count() <= MAX_WINDOW_VALUES:
        w = Window.orderBy(F.col(column))
        return distinct.select(column, (F.dense_rank().over(w) - 1 + start).cast("long").alias(code))
    numbered, _ = with_positions(distinct, [F.col(column)], name="_p")
    return numbered.select(column, (F.col("_p") - 1 + start).cast("long").alias(code))


def label_encode(df: DataFrame, columns: list[str], start: int = 0,
                 bounded: bool = True) -> DataFrame:
    """Add ``<col>_code`` for each column, joined back on the value."""
    out = df
    for c in columns:
        voc = vocabulary(df, c, start, code=f"{c}_code", bounded=bounded)
        out = out.join(voc, c, "left")
    return out


def vocab_sizes(items: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct counts of user, item, category, brand, condition, size (long form)."""
    ev = events.agg(F.countDistinct("user_id").alias("user"))
    it = items.agg(F.countDistinct("item_id").alias("item"),
                   F.countDistinct("category").alias("category"),
                   F.countDistinct("brand").alias("brand"),
                   F.countDistinct("condition_id").alias("condition"),
                   F.countDistinct("size_id").alias("size"))
    long_ev = ev.select(F.lit("user").alias("name"), F.col("user").alias("size"))
    long_it = it.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("size"))
        for n in ("item", "category", "brand", "condition", "size")])).alias("s")
    ).select("s.name", "s.size")
    return long_ev.unionByName(long_it).select("name", F.col("size").cast("long"))


def price_normalized(items: DataFrame, column: str = "price",
                     out: str = "price_normalized") -> DataFrame:
    """(p - min) / (max - min); a constant column gives 0.

    The min/max are one aggregate row joined back on a constant key (a one-row
    broadcast), so the item table is read twice but never shuffled.
    """
    stats = items.agg(F.min(column).cast("double").alias("_lo"),
                      F.max(column).cast("double").alias("_hi")).withColumn("_k", F.lit(1))
    p = F.col(column).cast("double")
    scaled = F.coalesce(F.try_divide(p - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return (items.withColumn("_k", F.lit(1)).join(F.broadcast(stats), "_k")
                 .withColumn(out, scaled).drop("_k", "_lo", "_hi"))


def days_listed(items: DataFrame, as_of, out: str = "days_listed") -> DataFrame:
    """P10: whole days between created_at and ``as_of`` (a parameter, never now())."""
    return items.withColumn(out, F.datediff(F.lit(as_of).cast("date"), F.to_date("created_at"))
                            .cast("long"))


def vector_left_fill(items: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Every item gets a vector; items without one get zeros."""
    return (items.join(vectors.select("item_id", "v"), "item_id", "left")
                 .withColumn("v", F.coalesce(F.col("v"), V.zeros(dim)))
                 .withColumn("has_vector", V.is_valid("v")))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """IO7: ``INSERT ... ON CONFLICT DO NOTHING`` by ``key``: new rows whose key is
    absent are appended, duplicates inside ``new`` are dropped too."""
    fresh = new.join(existing.select(*key), key, "left_anti").dropDuplicates(key)
    return existing.unionByName(fresh)
