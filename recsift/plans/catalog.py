"""Registered queries: one Spark plan per SURVEY §2 key, with its DuckDB twin.

Every query reads the driver's tables (through the views in
``recsift.sources.tables``) whole; float outputs are rounded to 6 places and
timestamps rendered as text on both sides so the comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsift.functions import scalars as S
from recsift.operators import evaluation as EV
from recsift.operators import features as FT
from recsift.operators import prep
from recsift.plans.context import KS, TRENDING_DAYS, Context
from recsift.plans.metrics_sql import long_means, per_user_ctes
from recsift.plans.oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ts_text(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")



# ---------------------------------------------------------------- sources, prep


@query("scan_items", with_views("""
    SELECT item_id, category, brand, size_id, round(price::DOUBLE, 6) AS price, condition_id,
           strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, is_active, image_urls
    FROM items""", "items"))
def scan_items(spark, d):
    it = Context(spark, d).raw_items
    return it.select("item_id", "category", "brand", "size_id", r6(F.col("price").cast("double")).alias("price"),
                     "condition_id", ts_text("created_at").alias("created_at"), "is_active", "image_urls")


@query("clean_items", with_views("""
    SELECT item_id, category, brand, round(price::DOUBLE, 6) AS price, is_active FROM items_c""", "items_c"))
def clean_items(spark, d):
    it = Context(spark, d).items
    return it.select("item_id", "category", "brand", r6(F.col("price").cast("double")).alias("price"), "is_active")


@query("clean_events", with_views("""
    SELECT event_id, user_id, item_id, event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM ev""", "ev"))
def clean_events(spark, d):
    ev = Context(spark, d).events
    return ev.select("event_id", "user_id", "item_id", "event", ts_text("ts").alias("ts"))


URL_RE = S.URL_PATTERN.replace("'", "''")


@query("parse_image_urls", with_views(f"""
    SELECT item_id, len(u) AS n_urls, array_to_string(u, '|') AS urls FROM (
      SELECT item_id, coalesce(regexp_extract_all(image_urls, '{URL_RE}'), []) AS u FROM items)""", "items"))
def parse_image_urls(spark, d):
    it = prep.with_image_urls(Context(spark, d).raw_items)
    return it.select("item_id", F.size("urls").cast("long").alias("n_urls"),
                     F.array_join("urls", "|").alias("urls"))


@query("items_with_image", with_views(f"""
    SELECT item_id, len(u) AS n_urls FROM (
      SELECT item_id, coalesce(regexp_extract_all(image_urls, '{URL_RE}'), []) AS u FROM items_c)
    WHERE len(u) > 0""", "items_c"))
def items_with_image(spark, d):
    it = prep.items_with_image(Context(spark, d).items)
    return it.select("item_id", F.size("urls").cast("long").alias("n_urls"))


@query("first_image", with_views(f"""
    SELECT item_id, u[1] AS first_url FROM (
      SELECT item_id, coalesce(regexp_extract_all(image_urls, '{URL_RE}'), []) AS u FROM items)""", "items"))
def first_image(spark, d):
    it = prep.with_image_urls(Context(spark, d).raw_items)
    return it.select("item_id", "first_url")


@query("event_weights", with_views("""
    SELECT event, count(*) AS n, sum(CASE event WHEN 'save' THEN 1.0 WHEN 'cart' THEN 3.0
                                                WHEN 'order' THEN 5.0 END)::DOUBLE AS total_weight
    FROM ev GROUP BY event""", "ev"))
def event_weights(spark, d):
    ev = prep.with_event_weight(Context(spark, d).events)
    return ev.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total_weight"))


@query("label_encode", with_views("""
    SELECT item_id, (dense_rank() OVER (ORDER BY category) - 1)::BIGINT AS category_code,
           (dense_rank() OVER (ORDER BY brand) - 1)::BIGINT AS brand_code,
           (dense_rank() OVER (ORDER BY size_id) - 1)::BIGINT AS size_id_code,
           (dense_rank() OVER (ORDER BY condition_id) - 1)::BIGINT AS condition_id_code
    FROM items_c""", "items_c"))
def label_encode(spark, d):
    it = prep.label_encode(Context(spark, d).items, ["category", "brand", "size_id", "condition_id"])
    return it.select("item_id", "category_code", "brand_code", "size_id_code", "condition_id_code")


@query("label_encode_users", with_views("""
    SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1)::BIGINT AS user_code
    FROM (SELECT DISTINCT user_id FROM inter)""", "inter"))
def label_encode_users(spark, d):
    """P7 for an unbounded vocabulary: numbered by range partitions."""
    return prep.vocabulary(Context(spark, d).interactions, "user_id", code="user_code")


@query("vocab_sizes", with_views("""
    SELECT 'user' AS name, count(DISTINCT user_id)::BIGINT AS size FROM ev
    UNION ALL SELECT 'item', count(DISTINCT item_id) FROM items_c
    UNION ALL SELECT 'category', count(DISTINCT category) FROM items_c
    UNION ALL SELECT 'brand', count(DISTINCT brand) FROM items_c
    UNION ALL SELECT 'condition', count(DISTINCT condition_id) FROM items_c
    UNION ALL SELECT 'size', count(DISTINCT size_id) FROM items_c""", "items_c", "ev"))
def vocab_sizes(spark, d):
    c = Context(spark, d)
    return prep.vocab_sizes(c.items, c.events)


@query("price_normalized", with_views("""
    SELECT item_id, round(coalesce((price::DOUBLE - lo) / nullif(hi - lo, 0), 0.0), 6) AS price_normalized
    FROM items_c, (SELECT min(price)::DOUBLE AS lo, max(price)::DOUBLE AS hi FROM items_c)""", "items_c"))
def price_normalized(spark, d):
    it = prep.price_normalized(Context(spark, d).items)
    return it.select("item_id", r6("price_normalized").alias("price_normalized"))


@query("days_listed", with_views("""
    SELECT item_id, date_diff('day', CAST(created_at AS DATE), CAST((SELECT as_of FROM asof_t) AS DATE))::BIGINT
           AS days_listed FROM items_c""", "items_c", "asof_t"))
def days_listed(spark, d):
    c = Context(spark, d)
    return prep.days_listed(c.items, c.as_of).select("item_id", "days_listed")


@query("vector_left_fill", with_views("""
    SELECT i.item_id, v.item_id IS NOT NULL AND list_bool_or(list_transform(v.v, lambda x: x <> 0)) AS has_vector,
           round(coalesce(list_sum(v.v), 0.0), 6) AS v_sum, coalesce(len(v.v), 64)::BIGINT AS dim
    FROM items_c i LEFT JOIN vec v ON i.item_id = v.item_id""", "items_c", "vec"))
def vector_left_fill(spark, d):
    c = Context(spark, d)
    out = prep.vector_left_fill(c.items, c.vectors, 64)
    return out.select("item_id", "has_vector",
                      r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("v_sum"),
                      F.size("v").cast("long").alias("dim"))


@query("insert_if_absent", with_views("""
    SELECT name, quality_score FROM (VALUES ('new', 5), ('like_new', 4), ('good', 3), ('fair', 2), ('poor', 1))
         t(name, quality_score)
    UNION ALL
    SELECT DISTINCT 'size_' || size_id::VARCHAR, NULL::INTEGER FROM items_c
    WHERE 'size_' || size_id::VARCHAR NOT IN ('new', 'like_new', 'good', 'fair', 'poor')""", "items_c"))
def insert_if_absent(spark, d):
    """IO7: seed rows + one row per distinct size name derived from the catalogue,
    inserted only where the name is absent."""
    c = Context(spark, d)
    seed = spark.createDataFrame(
        [("new", 5), ("like_new", 4), ("good", 3), ("fair", 2), ("poor", 1)],
        "name string, quality_score int")
    new = (c.items.select(F.concat(F.lit("size_"), F.col("size_id").cast("string")).alias("name"))
                  .withColumn("quality_score", F.lit(None).cast("int")))
    return prep.insert_if_absent(seed, new, ["name"])


# ---------------------------------------------------------------- aggregations


@query("interactions_weighted", with_views("""
    SELECT user_id, item_id, weight, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM inter""", "inter"))
def interactions_weighted(spark, d):
    it = Context(spark, d).interactions
    return it.select("user_id", "item_id", "weight", ts_text("ts").alias("ts"))


@query("temporal_split", with_views("SELECT user_id, item_id, pos::BIGINT AS pos, split FROM split", "split"))
def temporal_split(spark, d):
    return Context(spark, d).split.select("user_id", "item_id", "pos", "split")


@query("item_popularity", with_views("""
    SELECT item_id, count(*)::BIGINT AS popularity FROM train GROUP BY item_id""", "train"))
def item_popularity(spark, d):
    return FT.item_popularity(Context(spark, d).train)


@query("user_truth", with_views("SELECT user_id, item_id FROM truth", "truth"))
def user_truth(spark, d):
    return Context(spark, d).truth


@query("user_interaction_count", with_views("""
    SELECT user_id, count(*)::BIGINT AS n_interactions FROM inter GROUP BY user_id""", "inter"))
def user_interaction_count(spark, d):
    return FT.user_interaction_count(Context(spark, d).interactions)


SEG_SQL = "CASE WHEN c < 5 THEN 'cold' WHEN c < 20 THEN 'warm' ELSE 'hot' END"


@query("user_segment", with_views(f"""
    SELECT user_id, c::BIGINT AS n_interactions, {SEG_SQL} AS segment FROM (
      SELECT u.user_id, coalesce(n.c, 0) AS c FROM (SELECT DISTINCT user_id FROM ev) u
      LEFT JOIN (SELECT user_id, count(*) AS c FROM inter GROUP BY user_id) n ON n.user_id = u.user_id)""",
    "ev", "inter"))
def user_segment(spark, d):
    c = Context(spark, d)
    return FT.user_segment(c.events, c.interactions)


@query("popular_by_category", with_views("""
    SELECT list, rank, item_id, score FROM (
      SELECT list, item_id, score, row_number() OVER (PARTITION BY list ORDER BY score DESC, item_id)::BIGINT AS rank
      FROM (SELECT 'all' AS list, i.item_id, sum(t.weight) AS score FROM inter t JOIN items_c i
              ON t.item_id = i.item_id WHERE i.is_active GROUP BY i.item_id
            UNION ALL
            SELECT i.category, i.item_id, sum(t.weight) FROM inter t JOIN items_c i
              ON t.item_id = i.item_id WHERE i.is_active GROUP BY i.category, i.item_id))
    WHERE rank <= 10""", "inter", "items_c"))
def popular_by_category(spark, d):
    c = Context(spark, d)
    return FT.popular_by_category(c.interactions, c.items, 10)


@query("trending_7d", with_views(f"""
    SELECT e.item_id, count(e.event_id)::DOUBLE AS score FROM ev e JOIN items_c i ON e.item_id = i.item_id
    WHERE i.is_active AND e.ts > (SELECT as_of FROM asof_t) - INTERVAL {TRENDING_DAYS} DAYS
      AND e.ts <= (SELECT as_of FROM asof_t)
    GROUP BY e.item_id ORDER BY score DESC, e.item_id LIMIT 20""", "ev", "items_c", "asof_t"))
def trending_7d(spark, d):
    c = Context(spark, d)
    return FT.trending(c.events, c.items, c.as_of, TRENDING_DAYS, 20)


UCAT_SQL = """SELECT user_id, coalesce(max(CASE WHEN r = 1 THEN code END), 0)::BIGINT AS category_1,
                     coalesce(max(CASE WHEN r = 2 THEN code END), 0)::BIGINT AS category_2,
                     coalesce(max(CASE WHEN r = 3 THEN code END), 0)::BIGINT AS category_3
              FROM (SELECT user_id, code, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, code) AS r
                    FROM (SELECT t.user_id, v.code, sum(t.weight) AS w FROM inter t
                          JOIN items_c i ON t.item_id = i.item_id
                          JOIN (SELECT category, dense_rank() OVER (ORDER BY category) AS code
                                FROM (SELECT DISTINCT category FROM items_c)) v ON v.category = i.category
                          GROUP BY t.user_id, v.code)) GROUP BY user_id"""
UBRAND_SQL = """SELECT user_id, coalesce(max(CASE WHEN r = 1 THEN code END), 0)::BIGINT AS brand_1,
                     coalesce(max(CASE WHEN r = 2 THEN code END), 0)::BIGINT AS brand_2
              FROM (SELECT user_id, code, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, code) AS r
                    FROM (SELECT t.user_id, v.code, sum(t.weight) AS w FROM inter t
                          JOIN items_c i ON t.item_id = i.item_id
                          JOIN (SELECT brand, dense_rank() OVER (ORDER BY brand) AS code
                                FROM (SELECT DISTINCT brand FROM items_c)) v ON v.brand = i.brand
                          GROUP BY t.user_id, v.code)) GROUP BY user_id"""


@query("user_category_prefs", with_views(UCAT_SQL, "inter", "items_c"))
def user_category_prefs(spark, d):
    c = Context(spark, d)
    return FT.user_top_attribute(c.interactions, c.items, "category", 3)


@query("user_brand_prefs", with_views(UBRAND_SQL, "inter", "items_c"))
def user_brand_prefs(spark, d):
    c = Context(spark, d)
    return FT.user_top_attribute(c.interactions, c.items, "brand", 2)


@query("user_price_range", with_views("""
    SELECT t.user_id, round(min(i.price)::DOUBLE, 6) AS price_min, round(max(i.price)::DOUBLE, 6) AS price_max
    FROM inter t JOIN items_c i ON t.item_id = i.item_id GROUP BY t.user_id""", "inter", "items_c"))
def user_price_range(spark, d):
    c = Context(spark, d)
    out = FT.user_price_range(c.interactions, c.items)
    return out.select("user_id", r6("price_min").alias("price_min"), r6("price_max").alias("price_max"))


REC_SQL = "round(exp(-ln(2) * days / 30.0), 6)"


@query("user_recency", with_views(f"""
    SELECT user_id, days::BIGINT AS days_since_last, {REC_SQL} AS recency FROM (
      SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), CAST((SELECT as_of FROM asof_t) AS DATE)) AS days
      FROM inter GROUP BY user_id)""", "inter", "asof_t"))
def user_recency(spark, d):
    c = Context(spark, d)
    out = FT.user_recency(c.interactions, c.as_of)
    return out.select("user_id", "days_since_last", r6("recency").alias("recency"))


@query("user_features", with_views(f"""
    SELECT b.user_id, b.n_interactions, b.segment, b.price_min, b.price_max, b.days_since_last, b.recency,
           coalesce(c.category_1, 0) AS category_1, coalesce(c.category_2, 0) AS category_2,
           coalesce(c.category_3, 0) AS category_3, coalesce(br.brand_1, 0) AS brand_1,
           coalesce(br.brand_2, 0) AS brand_2
    FROM (SELECT user_id, c::BIGINT AS n_interactions, {SEG_SQL} AS segment, price_min, price_max,
                 days::BIGINT AS days_since_last, {REC_SQL} AS recency FROM (
            SELECT t.user_id, count(*) AS c, round(min(i.price)::DOUBLE, 6) AS price_min,
                   round(max(i.price)::DOUBLE, 6) AS price_max,
                   date_diff('day', CAST(max(t.ts) AS DATE), CAST((SELECT as_of FROM asof_t) AS DATE)) AS days
            FROM inter t LEFT JOIN items_c i ON t.item_id = i.item_id GROUP BY t.user_id)) b
    LEFT JOIN ucat c ON c.user_id = b.user_id LEFT JOIN ubrand br ON br.user_id = b.user_id""",
    "inter", "items_c", "asof_t", extra={"ucat": UCAT_SQL, "ubrand": UBRAND_SQL}))
def user_features(spark, d):
    c = Context(spark, d)
    out = FT.user_features(c.interactions, c.items, c.as_of)
    return out.select("user_id", "n_interactions", "segment", r6("price_min").alias("price_min"),
                      r6("price_max").alias("price_max"), "days_since_last", r6("recency").alias("recency"),
                      F.coalesce("category_1", F.lit(0)).alias("category_1"),
                      F.coalesce("category_2", F.lit(0)).alias("category_2"),
                      F.coalesce("category_3", F.lit(0)).alias("category_3"),
                      F.coalesce("brand_1", F.lit(0)).alias("brand_1"),
                      F.coalesce("brand_2", F.lit(0)).alias("brand_2"))


@query("item_features", with_views("""
    SELECT i.item_id, dense_rank() OVER (ORDER BY i.category)::BIGINT AS category_code,
           dense_rank() OVER (ORDER BY brand)::BIGINT AS brand_code,
           dense_rank() OVER (ORDER BY condition_id)::BIGINT AS condition_id_code,
           dense_rank() OVER (ORDER BY size_id)::BIGINT AS size_id_code,
           round(coalesce((price::DOUBLE - lo) / nullif(hi - lo, 0), 0.0), 6) AS price_normalized,
           date_diff('day', CAST(created_at AS DATE), CAST((SELECT as_of FROM asof_t) AS DATE))::BIGINT AS days_listed,
           v.item_id IS NOT NULL AS has_vector
    FROM items_c i LEFT JOIN vec v ON v.item_id = i.item_id,
         (SELECT min(price)::DOUBLE AS lo, max(price)::DOUBLE AS hi FROM items_c)""", "items_c", "asof_t", "vec"))
def item_features(spark, d):
    c = Context(spark, d)
    out = FT.item_features(c.items, c.vectors, c.as_of, 64)
    return out.select("item_id", "category_code", "brand_code", "condition_id_code", "size_id_code",
                      r6("price_normalized").alias("price_normalized"), "days_listed", "has_vector")


# ---------------------------------------------------------------- evaluation

_EVAL = per_user_ctes("pop_recs", "truth", "train_users", KS)


def _metric_sql(metric: str, k: int) -> str:
    ctes = per_user_ctes("pop_recs", "truth", "train_users", (k,), prefix="m")
    return with_views(f"SELECT user_id, round({metric}, 6) AS {metric} FROM m_per",
                      "pop_recs", "truth", "train_users", extra=ctes)


def _metric_query(metric: str, k: int):
    def fn(spark, d):
        c = Context(spark, d)
        out = EV.single_metric(c.pop_recs, c.truth, metric, k, users=c.train_users)
        return out.select("user_id", r6(metric).alias(metric))
    fn.__name__ = f"{metric}_at_k"
    return fn


for _m in ("precision", "recall", "ndcg", "mrr", "hit_rate", "map"):
    query(f"{_m}_at_k", _metric_sql(_m, 10))(_metric_query(_m, 10))


@query("evaluate_users", with_views("""
    SELECT user_id, k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg,
           round(mrr, 6) AS mrr, round(hit_rate, 6) AS hit_rate, round(map, 6) AS map FROM m_per""",
    "pop_recs", "truth", "train_users", extra=_EVAL))
def evaluate_users(spark, d):
    c = Context(spark, d)
    out = EV.per_user(c.pop_recs, c.truth, KS, users=c.train_users)
    return out.select("user_id", "k", *[r6(m).alias(m) for m in EV.METRICS])


def _eval_all_sql(recs: str, prefix: str) -> dict[str, str]:
    ctes = {f"{prefix}_users": f"""SELECT DISTINCT user_id FROM {recs}
                                   WHERE user_id IN (SELECT user_id FROM truth)"""}
    ctes.update(per_user_ctes(recs, "truth", f"{prefix}_users", KS, prefix=prefix))
    ctes[f"{prefix}_all"] = (long_means(f"{prefix}_per") +
                             f" UNION ALL SELECT 'num_evaluated_users', NULL::INTEGER, count(*)::DOUBLE "
                             f"FROM {prefix}_users")
    return ctes


EVAL_ALL_SQL = with_views("SELECT metric, k, round(value, 6) AS value FROM a_all",
                          "pop_recs", "truth", extra=_eval_all_sql("pop_recs", "a"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Popular unseen items learned from the training part, scored on the test part."""
    c = Context(spark, d)
    out = EV.evaluate_all(c.pop_recs, c.truth, KS)
    return out.select("metric", "k", r6("value").alias("value"))


query("evaluate_all", EVAL_ALL_SQL)(flagship)


# ---------------------------------------------------------------- graded, beyond accuracy, comparison

GRADED_SQL = with_views("""
    SELECT u.user_id, round(CASE WHEN coalesce(i.idcg, 0) > 0 THEN coalesce(d.dcg, 0.0) / i.idcg ELSE 0.0 END, 6)
           AS ndcg
    FROM train_users u
    LEFT JOIN (SELECT r.user_id, sum(t.rel / log2(r.rank + 1)) AS dcg FROM pop_recs r
               JOIN g_truth t ON t.user_id = r.user_id AND t.item_id = r.item_id
               WHERE r.rank <= 10 GROUP BY r.user_id) d ON d.user_id = u.user_id
    LEFT JOIN (SELECT user_id, sum(rel / log2(i + 1)) AS idcg FROM (
                 SELECT user_id, rel, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC) AS i FROM g_truth)
               WHERE i <= 10 GROUP BY user_id) i ON i.user_id = u.user_id""",
    "train_users", "pop_recs", "test", extra={"g_truth": "SELECT user_id, item_id, weight AS rel FROM test"})


@query("ndcg_graded", GRADED_SQL)
def ndcg_graded(spark, d):
    """M3 with graded relevance: the test interaction weight (1, 3, 5) is the gain."""
    c = Context(spark, d)
    truth = c.test.select("user_id", "item_id", F.col("weight").alias("rel"))
    out = EV.single_metric(c.pop_recs, truth, "ndcg", 10, users=c.train_users, graded=True)
    return out.select("user_id", r6("ndcg").alias("ndcg"))


@query("coverage", with_views("""
    SELECT round((SELECT count(DISTINCT item_id) FROM pop_recs) / (SELECT count(*) FROM items_c), 6) AS coverage""",
    "pop_recs", "items_c"))
def coverage(spark, d):
    """M9: distinct recommended items over the catalogue."""
    c = Context(spark, d)
    return EV.coverage(c.pop_recs, c.items).select(r6("coverage").alias("coverage"))


DIV_CTES = {
    "d_items": "SELECT r.user_id, r.rank, u.v FROM pop_recs r JOIN uvec u ON u.item_id = r.item_id",
    "d_n": "SELECT user_id, count(*) AS n FROM d_items GROUP BY user_id",
    "d_pairs": """SELECT a.user_id, avg(1 - list_dot_product(a.v, b.v)) AS d FROM d_items a
                  JOIN d_items b ON a.user_id = b.user_id AND a.rank < b.rank GROUP BY a.user_id""",
    "d_user": """SELECT u.user_id, CASE WHEN coalesce(n.n, 0) >= 2 THEN p.d ELSE 0.0 END AS diversity
                 FROM (SELECT DISTINCT user_id FROM pop_recs) u LEFT JOIN d_n n ON n.user_id = u.user_id
                 LEFT JOIN d_pairs p ON p.user_id = u.user_id""",
}


@query("diversity", with_views("SELECT user_id, round(diversity, 6) AS diversity FROM d_user",
                               "pop_recs", "uvec", extra=DIV_CTES))
def diversity(spark, d):
    """Mean pairwise cosine distance of each list (closed form, no pairs)."""
    c = Context(spark, d)
    out = EV.diversity_per_user(c.pop_recs, c.vectors)
    return out.select("user_id", r6("diversity").alias("diversity"))


NOV_CTES = {
    "n_pop": "SELECT item_id, count(*) AS popularity FROM train GROUP BY item_id",
    "n_user": """SELECT r.user_id, avg(-log2(greatest(coalesce(p.popularity, 1)
                        / (SELECT count(*) FROM train_users)::DOUBLE, 1e-10))) AS novelty
                 FROM pop_recs r LEFT JOIN n_pop p ON p.item_id = r.item_id GROUP BY r.user_id""",
}


@query("novelty", with_views("SELECT user_id, round(novelty, 6) AS novelty FROM n_user",
                             "pop_recs", "train", "train_users", extra=NOV_CTES))
def novelty(spark, d):
    """Mean self-information of the recommended items (training popularity)."""
    c = Context(spark, d)
    n_users = c.train_users.agg(F.count(F.lit(1)).alias("num_users"))
    out = EV.novelty_per_user(c.pop_recs, FT.item_popularity(c.train), n_users)
    return out.select("user_id", r6("novelty").alias("novelty"))


PIVOT_SQL = with_views("""
    SELECT metric, round(max(CASE WHEN k = 5 THEN value END), 6) AS at_5,
           round(max(CASE WHEN k = 10 THEN value END), 6) AS at_10,
           round(max(CASE WHEN k = 20 THEN value END), 6) AS at_20
    FROM a_all WHERE k IS NOT NULL GROUP BY metric""", "pop_recs", "truth", extra=_eval_all_sql("pop_recs", "a"))


@query("metrics_pivot", PIVOT_SQL)
def metrics_pivot(spark, d):
    """One row per metric, a column per k."""
    c = Context(spark, d)
    out = EV.metrics_pivot(EV.evaluate_all(c.pop_recs, c.truth, KS), KS)
    return out.select("metric", *[r6(f"at_{k}").alias(f"at_{k}") for k in KS])


_FULL = dict(_eval_all_sql("pop_recs", "a"))
_FULL.update(DIV_CTES)
_FULL.update(NOV_CTES)


@query("evaluate_full", with_views("""
    SELECT metric, k, round(value, 6) AS value FROM a_all
    UNION ALL SELECT 'coverage', NULL, round((SELECT count(DISTINCT item_id) FROM pop_recs)
                                             / (SELECT count(*) FROM items_c), 6)
    UNION ALL SELECT 'diversity', NULL, round((SELECT avg(diversity) FROM d_user), 6)
    UNION ALL SELECT 'novelty', NULL, round((SELECT avg(novelty) FROM n_user), 6)""",
    "pop_recs", "truth", "uvec", "train", "train_users", "items_c", extra=_FULL))
def evaluate_full(spark, d):
    """Accuracy at 5/10/20 plus coverage, diversity and novelty."""
    c = Context(spark, d)
    n_users = c.train_users.agg(F.count(F.lit(1)).alias("num_users"))
    out = EV.evaluate_full(c.pop_recs, c.truth, c.items, c.vectors, FT.item_popularity(c.train), n_users, KS)
    return out.select("metric", "k", r6("value").alias("value"))


def _seg_sql() -> str:
    ctes = {"s_users": f"""SELECT u.user_id, CASE WHEN coalesce(n.c, 0) < 5 THEN 'cold'
                                                 WHEN coalesce(n.c, 0) < 20 THEN 'warm' ELSE 'hot' END AS segment
                           FROM (SELECT DISTINCT user_id FROM pop_recs) u
                           LEFT JOIN (SELECT user_id, count(*) AS c FROM train GROUP BY user_id) n
                             ON n.user_id = u.user_id
                           WHERE u.user_id IN (SELECT user_id FROM truth)"""}
    ctes.update(per_user_ctes("pop_recs", "truth", "s_users", KS, prefix="s"))
    ctes["s_per2"] = "SELECT p.*, u.segment FROM s_per p JOIN s_users u ON u.user_id = p.user_id"
    body = ("SELECT segment, metric, k, round(value, 6) AS value FROM (" + long_means("s_per2", "segment") +
            ") UNION ALL SELECT s.segment, 'num_evaluated_users', NULL, count(u.user_id)::DOUBLE "
            "FROM (VALUES ('cold'), ('warm'), ('hot')) s(segment) LEFT JOIN s_users u ON u.segment = s.segment "
            "GROUP BY s.segment")
    return with_views(body, "pop_recs", "truth", "train", extra=ctes)


@query("evaluate_segments", _seg_sql())
def evaluate_segments(spark, d):
    """M8 per user segment (cold / warm / hot by training interactions)."""
    c = Context(spark, d)
    out = EV.evaluate_segments(c.pop_recs, c.truth, c.train, KS)
    return out.select("segment", "metric", "k", r6("value").alias("value"))


def _ab_sql() -> str:
    ctes = dict(_eval_all_sql("pop_recs", "a"))
    ctes.update(_eval_all_sql("recent_recs", "b"))
    # model metrics are compared at 9 places (summation order differs between engines)
    ctes["a_named"] = ("SELECT CASE WHEN k IS NULL THEN metric ELSE metric || '@' || k END AS metric, "
                       "round(value, 9) AS value FROM a_all WHERE metric <> 'num_evaluated_users'")
    ctes["b_named"] = ("SELECT CASE WHEN k IS NULL THEN metric ELSE metric || '@' || k END AS metric, "
                       "round(value, 9) AS value FROM b_all WHERE metric <> 'num_evaluated_users'")
    ctes["cmp"] = """SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.value, 0.0) AS model_a,
                            coalesce(b.value, 0.0) AS model_b
                     FROM a_named a FULL JOIN b_named b ON a.metric = b.metric"""
    ctes["prim"] = """SELECT CASE WHEN coalesce(max(model_a), 0) > coalesce(max(model_b), 0) THEN 'A' ELSE 'B' END
                              AS winner,
                             CASE WHEN coalesce(max(model_a), 0) > 0
                                  THEN (coalesce(max(model_b), 0) - max(model_a)) / max(model_a) * 100
                                  ELSE 'inf'::DOUBLE END AS lift
                      FROM cmp WHERE metric = 'ndcg@10'"""
    body = """SELECT c.metric, round(model_a, 6) AS model_a, round(model_b, 6) AS model_b,
                     round(model_b - model_a, 6) AS diff,
                     round(CASE WHEN model_a > 0 THEN (model_b - model_a) / model_a * 100 ELSE 'inf'::DOUBLE END, 6)
                       AS pct_change,
                     p.winner, round(p.lift, 6) AS lift, 'ndcg@10' AS primary_metric
              FROM cmp c, prim p"""
    return with_views(body, "pop_recs", "recent_recs", "truth", extra=ctes)


@query("offline_ab_test", _ab_sql())
def offline_ab_test(spark, d):
    """Model A (all-time popular) against model B (popular in the last year)."""
    c = Context(spark, d)
    a = EV.evaluate_all(c.pop_recs, c.truth, KS).withColumn("value", F.round("value", 9))
    b = EV.evaluate_all(c.recent_recs, c.truth, KS).withColumn("value", F.round("value", 9))
    out = EV.offline_ab_test(a, b, "ndcg@10")
    return out.select("metric", r6("model_a").alias("model_a"), r6("model_b").alias("model_b"),
                      r6("diff").alias("diff"), r6("pct_change").alias("pct_change"), "winner",
                      r6("lift").alias("lift"), "primary_metric")


def _ab_log_sql() -> str:
    ctes = {}
    ctes.update(per_user_ctes("pop_recs", "truth", "train_users", (10,), prefix="pa"))
    ctes.update(per_user_ctes("recent_recs", "truth", "train_users", (10,), prefix="pb"))
    ctes["log"] = ("SELECT 'popular_vs_recent' AS experiment_name, 'A' AS variant, user_id, "
                   "'ndcg@10' AS metric_name, ndcg AS metric_value FROM pa_per UNION ALL "
                   "SELECT 'popular_vs_recent', 'A', user_id, 'precision@10', precision FROM pa_per UNION ALL "
                   "SELECT 'popular_vs_recent', 'B', user_id, 'ndcg@10', ndcg FROM pb_per UNION ALL "
                   "SELECT 'popular_vs_recent', 'B', user_id, 'precision@10', precision FROM pb_per")
    body = """SELECT experiment_name, variant, metric_name, count(*)::BIGINT AS n,
                     round(avg(metric_value), 6) AS mean, round(stddev_samp(metric_value), 6) AS stddev
              FROM log GROUP BY experiment_name, variant, metric_name"""
    return with_views(body, "pop_recs", "recent_recs", "truth", "train_users", extra=ctes)


@query("ab_results_summary", _ab_log_sql())
def ab_results_summary(spark, d):
    """An A/B result log (per-user metrics of two variants) summarised by
    experiment, variant and metric: count, mean, sample stddev."""
    c = Context(spark, d)
    rows = []
    for variant, recs in (("A", c.pop_recs), ("B", c.recent_recs)):
        per = EV.per_user(recs, c.truth, [10], users=c.train_users)
        for m in ("ndcg", "precision"):
            rows.append(per.select(F.lit("popular_vs_recent").alias("experiment_name"),
                                   F.lit(variant).alias("variant"), "user_id",
                                   F.lit(f"{m}@10").alias("metric_name"), F.col(m).alias("metric_value")))
    log = rows[0]
    for r in rows[1:]:
        log = log.unionByName(r)
    out = EV.ab_results_summary(log)
    return out.select("experiment_name", "variant", "metric_name", F.col("n").cast("long"),
                      r6("mean").alias("mean"), r6("stddev").alias("stddev"))
