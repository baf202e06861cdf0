"""Registered vector, retrieval and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.operators import bounded as B
from recsift.operators import retrieval as R
from recsift.operators import sessions as SS
from recsift.plans.catalog import ORACLE, URL_RE, query, r6
from recsift.plans.context import REC_K, Context
from recsift.plans.oracle_views import VIEWS, with_views
from recsift.session import materialize

KNN_K = 10

# session CTEs (gap >= 30 minutes starts a session, as Spark's session_window does)
VIEWS.update({
    "sv": (("sev",), "SELECT user_id, item_id, ts FROM sev WHERE event IN ('save', 'cart', 'order')"),
    "sg": (("sv",), """
        SELECT user_id, item_id, ts,
               sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sno
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM sv)"""),
    "sess": (("sg",), """
        SELECT b.user_id, b.sno, b.session_start, b.session_end, b.n_events, l.items FROM
          (SELECT user_id, sno, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events
           FROM sg GROUP BY user_id, sno) b
        JOIN (SELECT user_id, sno, list(item_id ORDER BY first_ts) AS items FROM (
                SELECT user_id, sno, item_id, min(ts) AS first_ts FROM sg GROUP BY user_id, sno, item_id
                QUALIFY row_number() OVER (PARTITION BY user_id, sno ORDER BY min(ts) DESC, item_id DESC) <= 50)
              GROUP BY user_id, sno) l
        ON b.user_id = l.user_id AND b.sno = l.sno"""),
    "sq": (("sess", "vec"), """
        SELECT user_id, session_start, list(x ORDER BY pos) AS v FROM (
          SELECT user_id, session_start, pos, avg(x) AS x FROM (
            SELECT s.user_id, s.session_start, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS pos
            FROM (SELECT user_id, session_start,
                         unnest(list_slice(items, greatest(len(items) - 2, 1), len(items))) AS item_id
                  FROM sess) s
            JOIN vec v ON v.item_id = s.item_id
            WHERE list_bool_or(list_transform(v.v, lambda x: x <> 0)))
          GROUP BY ALL)
        GROUP BY user_id, session_start"""),
})


def _knn_sql(q: str, qid: str, items: str, score: str, k: int, where: str = "", desc: bool = True,
             extra_cols: str = "") -> str:
    order = "DESC" if desc else "ASC"
    return f"""
        SELECT {extra_cols}qid, rank, item_id, round(score, 6) AS score FROM (
          SELECT {extra_cols}{qid} AS qid, i.item_id, {score} AS score,
                 row_number() OVER (PARTITION BY {qid} ORDER BY round({score}, 9) {order}, i.item_id) AS rank
          FROM {q} q, {items} i {where})
        WHERE rank <= {k}"""


def _out(df):
    return df.select("qid", "rank", "item_id", r6("score").alias("score"))


# ---------------------------------------------------------------- E1-E3


@query("l2_normalize", with_views("""
    SELECT item_id, round(sqrt(list_dot_product(v, v)), 6) AS norm,
           round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS u_sum,
           round(v[1] / sqrt(list_dot_product(v, v)), 6) AS u_first
    FROM vec""", "vec"))
def l2_normalize(spark, d):
    c = Context(spark, d)
    u = c.vectors.select("item_id", V.norm("v").alias("norm"), V.l2_normalize("v").alias("u"))
    return u.select("item_id", r6("norm").alias("norm"),
                    r6(F.aggregate("u", F.lit(0.0), lambda a, x: a + x)).alias("u_sum"),
                    r6(F.element_at("u", 1)).alias("u_first"))


PAIRS_SQL = """SELECT a.item_id AS item_a, b.item_id AS item_b, a.v AS va, b.v AS vb
               FROM vec a JOIN vec b ON b.item_id = (a.item_id * 37 + 1) % (SELECT count(*) FROM vec)"""


@query("pair_scores", with_views("""
    SELECT item_a, item_b, round(list_dot_product(va, vb), 6) AS dot,
           round(list_dot_product(va, vb) / (sqrt(list_dot_product(va, va)) * sqrt(list_dot_product(vb, vb))), 6)
             AS cosine,
           round(list_sum(list_transform(list_zip(va, vb), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS l2
    FROM pairs""", "vec", extra={"pairs": PAIRS_SQL}))
def pair_scores(spark, d):
    """Dot, cosine and squared L2 for given item pairs (each item with item
    (37 * id + 1) mod n, a pair list derived from the table)."""
    c = Context(spark, d)
    v = c.vectors.select("item_id", "v")
    n = v.count()  # one number to the driver
    a = v.select(F.col("item_id").alias("item_a"), F.col("v").alias("va"),
                 F.pmod(F.col("item_id") * 37 + 1, F.lit(n)).alias("item_b"))
    b = v.select(F.col("item_id").alias("item_b"), F.col("v").alias("vb"))
    j = a.join(b, "item_b")
    return j.select("item_a", "item_b", r6(V.dot("va", "vb")).alias("dot"),
                    r6(V.cosine("va", "vb")).alias("cosine"), r6(V.l2_sq("va", "vb")).alias("l2"))


@query("vector_valid", with_views("""
    SELECT i.item_id, coalesce(list_bool_or(list_transform(v.v, lambda x: x <> 0)), false) AS valid
    FROM items_c i LEFT JOIN vec v ON v.item_id = i.item_id""", "items_c", "vec"))
def vector_valid(spark, d):
    """E3 over the catalogue: items without a vector are zero-filled (P12), so invalid."""
    c = Context(spark, d)
    filled = c.items.select("item_id").join(c.vectors.select("item_id", "v"), "item_id", "left") \
        .withColumn("v", F.coalesce("v", V.zeros(64)))
    return filled.select("item_id", V.is_valid("v").alias("valid"))


# ---------------------------------------------------------------- R1, R3, J9

def _query_vector(c: Context, item_id: int = 0):
    """Reads one vector (64 numbers) to use as a literal query."""
    row = c.vectors.filter(F.col("item_id") == item_id).select("v", "category").first()
    return list(row["v"]), row["category"]


Q0 = "(SELECT v FROM vec WHERE item_id = 0)"


@query("top_k_one", with_views(f"""
    SELECT item_id, round(score, 6) AS score FROM (
      SELECT item_id, list_cosine_similarity(v, {Q0}) AS score FROM vec
      WHERE list_bool_or(list_transform(v, lambda x: x <> 0)))
    ORDER BY round(score, 9) DESC, item_id LIMIT {KNN_K}""", "vec"))
def top_k_one(spark, d):
    c = Context(spark, d)
    qv, _ = _query_vector(c)
    out = R.top_k_one(c.vectors, qv, KNN_K)
    return out.select("item_id", r6("score").alias("score"))


@query("similar_in_category", with_views(f"""
    SELECT item_id, round(similarity, 6) AS similarity FROM (
      SELECT v.item_id, list_cosine_similarity(v.v, {Q0}) AS similarity FROM vec v
      JOIN items_c i ON i.item_id = v.item_id
      WHERE i.is_active AND v.category = (SELECT category FROM vec WHERE item_id = 0) AND v.v IS NOT NULL)
    ORDER BY round(similarity, 9) DESC, item_id LIMIT 20""", "vec", "items_c"))
def similar_in_category(spark, d):
    """Active items of the query's category that have a vector, by similarity."""
    c = Context(spark, d)
    qv, cat = _query_vector(c)
    active = c.items.filter(F.col("is_active")).select("item_id")
    cand = c.vectors.filter((F.col("category") == cat) & F.col("v").isNotNull()).join(active, "item_id")
    out = R.top_k_one(cand, qv, 20)
    return out.select("item_id", r6("score").alias("similarity"))


@query("similar_items_detail", with_views(f"""
    SELECT h.item_id, i.category, i.brand, round(i.price::DOUBLE, 6) AS price, round(h.score, 6) AS similarity_score
    FROM (SELECT x.item_id, list_cosine_similarity(x.v, q.qv) AS score
          FROM vec x, (SELECT v AS qv FROM vec WHERE item_id = 0) q
          WHERE x.item_id <> 0
          ORDER BY round(list_cosine_similarity(x.v, q.qv), 9) DESC, x.item_id LIMIT {KNN_K}) h
    JOIN items_c i ON i.item_id = h.item_id""", "vec", "items_c"))
def similar_items_detail(spark, d):
    """The query item's nearest items (itself left out) with their details."""
    c = Context(spark, d)
    qv, _ = _query_vector(c)
    hits = R.top_k_one(c.vectors.filter(F.col("item_id") != 0), qv, KNN_K)
    out = R.similar_items_detail(hits, c.items.select("item_id", "category", "brand", "price"))
    return out.select("item_id", "category", "brand", r6(F.col("price").cast("double")).alias("price"),
                      r6("similarity_score").alias("similarity_score"))


# ---------------------------------------------------------------- R2, R4-R6


@query("knn_cosine", with_views(_knn_sql("uvec", "q.item_id", "uvec", "list_dot_product(q.v, i.v)", KNN_K),
                                "uvec"))
def knn_cosine(spark, d):
    """R2: every item's 10 nearest items by cosine (itself included)."""
    c = Context(spark, d)
    q = c.vectors.select(F.col("item_id").alias("qid"), "v")
    return _out(R.knn(q, c.vectors, KNN_K, "cosine"))


@query("knn_l2", with_views(_knn_sql(
    "vec", "q.item_id", "vec",
    "list_sum(list_transform(list_zip(q.v, i.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    KNN_K, desc=False), "vec"))
def knn_l2(spark, d):
    """R2 with squared Euclidean distance, smallest first."""
    c = Context(spark, d)
    q = c.vectors.select(F.col("item_id").alias("qid"), "v")
    return _out(R.knn(q, c.vectors, KNN_K, "l2"))


@query("knn_dot", with_views(_knn_sql("user_vec", "q.user_id", "vec", "list_dot_product(q.v, i.v)", KNN_K),
                             "user_vec", "vec"))
def knn_dot(spark, d):
    """R2 with users as queries: dot product of the user's mean item vector."""
    c = Context(spark, d)
    q = c.user_vectors.select(F.col("user_id").alias("qid"), "v")
    return _out(R.knn(q, c.vectors, KNN_K, "dot"))


@query("knn_exclude", with_views(_knn_sql(
    "user_vec", "q.user_id", "uvec",
    "list_dot_product(list_transform(q.v, lambda x: x / sqrt(list_dot_product(q.v, q.v))), i.v)", KNN_K,
    where="WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = q.user_id AND t.item_id = i.item_id)"),
    "user_vec", "uvec", "train"))
def knn_exclude(spark, d):
    """Cosine top 10 per user vector, the user's training items excluded
    before ranking."""
    c = Context(spark, d)
    q = c.user_vectors.select(F.col("user_id").alias("qid"), "v")
    ex = c.train.select(F.col("user_id").alias("qid"), "item_id")
    return _out(R.knn(q, c.vectors, KNN_K, "cosine", exclusions=ex))


@query("recommend_users", with_views(_knn_sql(
    "user_vec", "q.user_id", "vec", "list_dot_product(q.v, i.v)", REC_K,
    where="WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = q.user_id AND t.item_id = i.item_id)"),
    "user_vec", "vec", "train"))
def recommend_users(spark, d):
    """Personalised top 20 for every user: dot(user vector, item vector) over
    items the user has not touched in training."""
    c = Context(spark, d)
    q = c.user_vectors.select(F.col("user_id").alias("qid"), "v")
    ex = c.train.select(F.col("user_id").alias("qid"), "item_id")
    return _out(R.knn(q, c.vectors, REC_K, "dot", exclusions=ex))


@query("recommend_users_bounded", ORACLE["recommend_users"])
def recommend_users_bounded(spark, d):
    """R5 by blocks with upper bounds: the same rows as ``recommend_users``; a user reads only the blocks that can
    hold one of the user's best."""
    c = Context(spark, d)
    q = c.user_vectors.select(F.col("user_id").alias("qid"), "v")
    ex = c.train.select(F.col("user_id").alias("qid"), "item_id")
    return _out(B.search(q, B.build_blocks(c.vectors), REC_K, ex)[0])


@query("similar_items", with_views(_knn_sql("uvec", "q.item_id", "uvec", "list_dot_product(q.v, i.v)", KNN_K,
                                            where="WHERE i.item_id <> q.item_id"), "uvec"))
def similar_items(spark, d):
    """Every item's 10 most similar other items (self left out, exactly k)."""
    c = Context(spark, d)
    q = c.vectors.select(F.col("item_id").alias("qid"), "v")
    ex = q.select("qid", F.col("qid").alias("item_id"))
    return _out(R.knn(q, c.vectors, KNN_K, "cosine", exclusions=ex))


# ---------------------------------------------------------------- J2, J4, J5, R10


@query("unseen_candidates", with_views("""
    SELECT u.user_id, ((SELECT count(*) FROM items_c WHERE is_active) - coalesce(s.n, 0))::BIGINT AS n_unseen
    FROM train_users u LEFT JOIN (
      SELECT t.user_id, count(*) AS n FROM train t JOIN items_c i ON i.item_id = t.item_id
      WHERE i.is_active GROUP BY t.user_id) s ON s.user_id = u.user_id""", "train_users", "train", "items_c"))
def unseen_candidates(spark, d):
    """Number of active items each user has not touched, computed as
    active - seen-active per user (no user x item pairs are formed)."""
    c = Context(spark, d)
    active = c.items.filter(F.col("is_active")).select("item_id")
    n_active = active.count()  # one number to the driver
    seen = c.train.select("user_id", "item_id").join(active, "item_id").groupBy("user_id") \
        .agg(F.count(F.lit(1)).alias("n"))
    return (c.train_users.join(seen, "user_id", "left")
             .select("user_id", (F.lit(n_active) - F.coalesce("n", F.lit(0))).cast("long").alias("n_unseen")))


ORDERED_SQL = "SELECT DISTINCT user_id, item_id FROM ev WHERE event = 'order'"


@query("popularity_fallback", with_views("""
    SELECT user_id, rank, item_id, round(1.0 / rank, 6) AS score FROM (
      SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.prank) AS rank
      FROM train_users u CROSS JOIN pop_ranked p
      WHERE NOT EXISTS (SELECT 1 FROM ordered o WHERE o.user_id = u.user_id AND o.item_id = p.item_id))
    WHERE rank <= 10""", "train_users", "pop_ranked", "ev", extra={"ordered": ORDERED_SQL}))
def popularity_fallback(spark, d):
    """The popular list minus the user's exclusions (items they ordered),
    score 1/rank."""
    c = Context(spark, d)
    ranked, n = c.popular_ranked
    ex = c.events.filter(F.col("event") == "order").select("user_id", "item_id").distinct()
    out = R.popularity_fallback(ranked, ex, c.train_users, 10, n)
    return out.select("user_id", "rank", "item_id", r6("score").alias("score"))


@query("missing_vectors", with_views(f"""
    SELECT item_id FROM items_c i
    WHERE len(coalesce(regexp_extract_all(image_urls, '{URL_RE}'), [])) > 0
      AND NOT EXISTS (SELECT 1 FROM vec v WHERE v.item_id = i.item_id)""", "items_c", "vec"))
def missing_vectors(spark, d):
    """Items with an image that have no vector yet (left anti join)."""
    from recsift.operators import prep
    c = Context(spark, d)
    return prep.items_with_image(c.items).select("item_id").join(c.vectors.select("item_id"), "item_id",
                                                                  "left_anti")


@query("vectors_lookup", with_views("""
    SELECT t.item_id, round(list_sum(v.v), 6) AS v_sum FROM (SELECT DISTINCT item_id FROM truth) t
    JOIN vec v ON v.item_id = t.item_id""", "truth", "vec"))
def vectors_lookup(spark, d):
    """Vectors for a batch of ids (items in the test truth); missing ids are left out."""
    c = Context(spark, d)
    ids = c.truth.select("item_id").distinct()
    out = ids.join(c.vectors.select("item_id", "v"), "item_id")
    return out.select("item_id", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("v_sum"))


@query("vectors_upsert", with_views("""
    SELECT item_id, round(list_sum(v), 6) AS v_sum, version FROM (
      SELECT item_id, v, version, row_number() OVER (PARTITION BY item_id ORDER BY version DESC) AS r FROM (
        SELECT item_id, v, 1 AS version FROM vec
        UNION ALL
        SELECT item_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), 2 FROM vec
        WHERE category = 0))
    WHERE r = 1""", "vec"))
def vectors_upsert(spark, d):
    """E5/K4: new vectors for category-0 items (renormalised) replace the old ones;
    a repeated id keeps its newest version."""
    from recsift.operators import lists as L
    c = Context(spark, d)
    old = c.vectors.select("item_id", "v", F.lit(1).alias("version"))
    new = c.vectors.filter(F.col("category") == 0).select("item_id", V.l2_normalize("v").alias("v"),
                                                          F.lit(2).alias("version"))
    out = L.upsert_latest(old, new, ["item_id"], "version")
    return out.select("item_id", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("v_sum"), "version")


# ---------------------------------------------------------------- sessions, R9, R11


@query("sessions_batch", with_views("""
    SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start,
           strftime(session_end, '%Y-%m-%d %H:%M:%S.%f') AS session_end, n_events::BIGINT AS n_events,
           array_to_string(items, '|') AS items
    FROM sess""", "sess"))
def sessions_batch(spark, d):
    """Sessions split by a gap of 30 minutes, first-seen item lists (last 50)."""
    c = Context(spark, d)
    s = SS.sessions(c.stream_events)
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                    F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"),
                    "n_events", F.array_join(F.col("items").cast("array<string>"), "|").alias("items"))


@query("session_recommend", with_views(f"""
    SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start, rank, item_id,
           round(score, 6) AS score FROM (
      SELECT q.user_id, q.session_start, i.item_id,
             list_cosine_similarity(q.v, i.v) AS score,
             row_number() OVER (PARTITION BY q.user_id, q.session_start
                                ORDER BY round(list_cosine_similarity(q.v, i.v), 9) DESC, i.item_id) AS rank
      FROM sq q JOIN sess s ON s.user_id = q.user_id AND s.session_start = q.session_start, uvec i
      WHERE NOT list_contains(s.items, i.item_id))
    WHERE rank <= {KNN_K}""", "sq", "sess", "uvec"))
def session_recommend(spark, d):
    """Per session, cosine top 10 for the mean of the last 3 items' vectors,
    every session item excluded."""
    c = Context(spark, d)
    s = materialize(SS.sessions(c.stream_events), "sessions")
    queries = materialize(SS.session_queries(s, c.vectors), "session-queries")
    out = SS.session_recommend(s, c.vectors, KNN_K, queries=queries)
    q = queries.select("qid", "user_id", "session_start")
    return (out.join(q, "qid")
               .select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                       "rank", "item_id", r6("score").alias("score")))
