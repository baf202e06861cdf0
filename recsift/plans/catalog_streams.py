"""Registered streaming, approximate search, text and registry queries
(S1, S3-S6, R7, R8, R12, E4, E7, IO3, X3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.operators import ann
from recsift.operators import graph as GR
from recsift.operators import index_store as IS
from recsift.operators import lists as L
from recsift.operators import pq as PQ
from recsift.operators import registry as RG
from recsift.operators import retrieval as R
from recsift.operators import text as TX
from recsift.plans import catalog_vectors  # noqa: F401  (session views)
from recsift.plans.catalog import URL_RE, query, r6
from recsift.plans.context import Context
from recsift.plans.oracle_views import with_views
from recsift.session import materialize, scratch_path
from recsift.streaming import sessions as SSN
from recsift.streaming import trending as TR
from recsift.streaming import updates as UP
from recsift.streaming.sources import read_replay, replay_files

REPLAY_CHUNKS = 6
KNN_K = 10


def _run_to_table(stream_df, name: str, mode: str = "append"):
    """Run a streaming query over everything available, into parquet; return a batch read."""
    spark = stream_df.sparkSession
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ck")
    q = (stream_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream_df.schema).parquet(out)


def _valid_stream_events(c: Context):
    ev = c.stream_events.filter(F.col("event").isin("save", "cart", "order"))
    return ev.select("event_id", "user_id", "item_id", "event", "ts")


@query("session_state_stream", with_views("""
    SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start,
           strftime(session_end, '%Y-%m-%d %H:%M:%S.%f') AS session_end, n_events::BIGINT AS n_events,
           array_to_string(items, '|') AS items
    FROM sess
    WHERE session_end + INTERVAL 30 MINUTES
          <= (SELECT max(ts) FROM sev WHERE event IN ('save', 'cart', 'order')) - INTERVAL 1 HOUR""",
    "sess", "sev"))
def session_state_stream(spark, d):
    """Stateful session history over the replayed click stream (6 micro-batches,
    1 hour watermark): sessions closed by a 30-minute gap or by the timeout."""
    c = Context(spark, d)
    root, schema = replay_files(_valid_stream_events(c), "ts", REPLAY_CHUNKS, "replay-sessions")
    out = _run_to_table(SSN.session_state_stream(read_replay(spark, root, schema)), "s1")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                      F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "n_events",
                      F.array_join(F.col("items").cast("array<string>"), "|").alias("items"))


@query("dedup_stream", with_views("""
    SELECT event_id, user_id, item_id, event, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, session ORDER BY ts) AS n
          FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, item_id ROWS UNBOUNDED PRECEDING) AS session
                FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, item_id) < INTERVAL 30 MINUTES
                                     THEN 0 ELSE 1 END AS opens
                      FROM sev WHERE event IN ('save', 'cart', 'order'))))
    WHERE n = 1""", "sev"))
def dedup_stream(spark, d):
    """Events whose item is already in the user's 30-minute session are suppressed."""
    c = Context(spark, d)
    root, schema = replay_files(_valid_stream_events(c), "ts", REPLAY_CHUNKS, "replay-dedup")
    out = _run_to_table(SSN.dedup_stream(read_replay(spark, root, schema)), "s6")
    return out.select("event_id", "user_id", "item_id", "event",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("trending_sliding", with_views("""
    SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(ws + INTERVAL 7 DAYS, '%Y-%m-%d %H:%M:%S') AS window_end, item_id, count(*)::BIGINT AS n
    FROM (SELECT item_id, date_trunc('day', ts) - INTERVAL (g.i) DAY AS ws
          FROM sev CROSS JOIN range(0, 7) g(i) WHERE event IN ('save', 'cart', 'order'))
    GROUP BY ws, item_id""", "sev"))
def trending_sliding(spark, d):
    """S3 (batch twin): event counts per item in 7-day windows sliding by a day."""
    c = Context(spark, d)
    out = TR.trending_batch(c.stream_events)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "item_id",
                      F.col("n").cast("long"))


@query("trending_sliding_stream", with_views("""
    SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(ws + INTERVAL 7 DAYS, '%Y-%m-%d %H:%M:%S') AS window_end, item_id, count(*)::BIGINT AS n
    FROM (SELECT item_id, date_trunc('day', ts) - INTERVAL (g.i) DAY AS ws
          FROM sev CROSS JOIN range(0, 7) g(i) WHERE event IN ('save', 'cart', 'order'))
    WHERE ws + INTERVAL 7 DAYS <= (SELECT max(ts) FROM sev) - INTERVAL 1 HOUR
    GROUP BY ws, item_id""", "sev"))
def trending_sliding_stream(spark, d):
    """S3 as a stream: closed windows only (append mode, 1 hour watermark)."""
    c = Context(spark, d)
    root, schema = replay_files(c.stream_events, "ts", REPLAY_CHUNKS, "replay-trend")
    out = _run_to_table(TR.trending_stream(read_replay(spark, root, schema)), "s3")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "item_id",
                      F.col("n").cast("long"))


@query("user_vector_stream", with_views("""
    SELECT m.user_id, n.n_items, round(sqrt(list_dot_product(m.mv, m.mv)), 6) AS norm
    FROM (SELECT user_id, list(x ORDER BY pos) AS mv FROM (
            SELECT user_id, pos, avg(x) AS x FROM (
              SELECT u.user_id, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS pos
              FROM ui u JOIN vec v ON v.item_id = u.item_id)
            GROUP BY user_id, pos)
          GROUP BY user_id) m
    JOIN (SELECT user_id, count(*)::BIGINT AS n_items FROM ui GROUP BY user_id) n ON n.user_id = m.user_id""",
    "sv", "vec", extra={"ui": "SELECT DISTINCT user_id, item_id FROM sv"}))
def user_vector_stream(spark, d):
    """Per micro-batch, recompute the vectors of the users seen (mean over
    their whole history) and drop their stored lists; returns the final user
    vectors (user_id, n_items, norm)."""
    c = Context(spark, d)
    ev = _valid_stream_events(c)
    history, sums, _ = _run_user_vectors(c, ev)
    n = history.rows().groupBy("user_id").agg(F.countDistinct("item_id").cast("long").alias("n_items"))
    return UP.user_vectors(sums).join(n, "user_id").select("user_id", "n_items", r6(V.norm("v")).alias("norm"))


def _run_user_vectors(c: Context, ev):
    spark = c.spark
    history = UP.BatchLog(spark, scratch_path(spark, "hist"), "user_id long, item_id long")
    sums = UP.BatchLog(spark, scratch_path(spark, "usum"), "user_id long, s array<double>, n long")
    stale = UP.BatchLog(spark, scratch_path(spark, "stale"), "user_id long")
    root, schema = replay_files(ev, "ts", REPLAY_CHUNKS, "replay-uvec")
    q = (read_replay(spark, root, schema).writeStream
         .foreachBatch(UP.user_vector_updater(history, sums, stale, c.vectors))
         .option("checkpointLocation", scratch_path(spark, "s4-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    return history, sums, stale


@query("remaining_lists_stream", with_views("""
    SELECT user_id FROM train_users t
    WHERE NOT EXISTS (SELECT 1 FROM sev s WHERE s.user_id = t.user_id AND s.event IN ('save', 'cart', 'order'))""",
    "train_users", "sev"))
def remaining_lists_stream(spark, d):
    """Users whose stored list is still valid after the stream (those no event has touched)."""
    c = Context(spark, d)
    _, _, stale = _run_user_vectors(c, _valid_stream_events(c))
    lists = L.rec_lists(c.pop_recs, "recs", c.as_of).select("user_id", "list_type", "item_ids")
    return UP.remaining_lists(lists, stale).select("user_id").distinct()


@query("index_append_stream")
def index_append_stream(spark, d):
    """The IVF index built on the visual vectors; items that lack one get a
    text vector (E7 stand-in, same dimension) that streams in and is appended to
    the nearest existing cell.  Returns the index items (item_id, cell)."""
    c = Context(spark, d)
    idx = ann.build_ivf(c.vectors)
    items0 = UP.BatchLog(spark, scratch_path(spark, "ivf-items"), "item_id long, cell long, v array<double>")
    items0.write(idx.items, -1)
    text = _part_text(c)
    new = TX.vectors_incremental(c.items, text, c.vectors, 64).filter(F.col("source") == "new") \
        .select("item_id", "v", F.lit(dt.datetime(2024, 1, 1)).alias("ts"))
    root, schema = replay_files(new.withColumn("ts", (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
                                                       + F.make_interval(mins=F.col("item_id")))),
                                "ts", 3, "replay-items")
    ck = scratch_path(spark, "s5-ck")
    q = (read_replay(spark, root, schema).writeStream.foreachBatch(UP.index_appender(items0, idx.centroids))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return items0.rows().select("item_id", "cell")


@query("index_maintained", with_views("""
    SELECT (SELECT count(*) FROM uvec)::BIGINT AS n_items, (SELECT count(*) FROM uvec)::BIGINT AS newest""", "uvec"))
def index_maintained(spark, d):
    """An index of a third of the vectors takes the others, and newer vectors of the first third, from a stream in six
    batches and is maintained; items, and items with their newest vector."""
    c = Context(spark, d)
    at = lambda h: (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp") + F.make_interval(hours=h))
    first = F.col("item_id") % 3 == 0
    # the first third starts with vectors turned round, which later ones replace
    start = c.vectors.filter(first).select("item_id", F.transform("v", lambda x: -x).alias("v"), at(F.lit(0)).alias("ts"))
    later = c.vectors.select("item_id", "v", at(1 + F.col("item_id") % 48).alias("ts"))
    store = IS.IndexStore(spark, scratch_path(spark, "index-store"))
    store.create(start)
    root, schema = replay_files(later, "ts", REPLAY_CHUNKS, "replay-index")
    q = (read_replay(spark, root, schema).writeStream.foreachBatch(lambda rows, n: store.append(rows, f"stream-{n}"))
         .option("checkpointLocation", scratch_path(spark, "index-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    store.maintain()
    items = materialize(store.items(), "index-items")
    newest = items.join(c.unit_vectors.select("item_id", F.col("v").alias("u")), "item_id").filter(V.dot("v", "u") > 0.999).count()
    return spark.createDataFrame([(items.count(), newest)], "n_items long, newest long")


# ---------------------------------------------------------------- approximate search


def _ivf(c: Context):
    idx = ann.build_ivf(c.vectors)
    q = c.vectors.select(F.col("item_id").alias("qid"), "v")
    idx.nprobe = ann.calibrate_nprobe(q, idx, KNN_K)
    return q, idx


def _pq(c: Context, q):
    index = PQ.build_pq(c.vectors)
    return materialize(PQ.search_pq(q, index, KNN_K, PQ.calibrate(q, index, KNN_K)), "pq-found")


@query("knn_pq")
def knn_pq(spark, d):
    """Cosine top 10 for every item by product-quantised residuals, re-ranked exactly; cells probed as calibrated."""
    c = Context(spark, d)
    return _pq(c, c.vectors.select(F.col("item_id").alias("qid"), "v")).select("qid", "rank", "item_id", r6("score").alias("score"))


@query("knn_ivf")
def knn_ivf(spark, d):
    """IVF cosine top 10 for every item; cells probed as calibrated."""
    q, idx = _ivf(Context(spark, d))
    return ann.search_ivf(q, idx, KNN_K).select("qid", "rank", "item_id", r6("score").alias("score"))


@query("knn_lsh")
def knn_lsh(spark, d):
    """Random-projection LSH cosine top 10 for every item; bits as calibrated."""
    c = Context(spark, d)
    q = c.vectors.select(F.col("item_id").alias("qid"), "v")
    return ann.search_lsh(q, c.vectors, KNN_K).select("qid", "rank", "item_id", r6("score").alias("score"))


@query("knn_graph", with_views("""
    SELECT (SELECT count(*) FROM uvec)::BIGINT AS queries, (SELECT count(*) * 10 FROM uvec)::BIGINT AS n_rows, true AS recall_at_10_is_090,
           true AS distances_below_all""", "uvec"))
def knn_graph(spark, d):
    """The neighbour graph of all vectors, walked by every item for its cosine top 10, beside the exact search;
    ``ef`` as calibrated."""
    c = Context(spark, d)
    graph = GR.build_graph(c.vectors)
    q = c.vectors.select(F.col("item_id").alias("qid"), "v")
    found, work = GR.search_graph(q, graph, KNN_K, GR.calibrate_ef(q, graph, KNN_K))
    found = materialize(found, "graph-found")
    exact = R.knn(q, c.vectors, KNN_K, "cosine")
    one = F.lit(1).alias("k")
    n = found.agg(F.countDistinct("qid").alias("queries"), F.count(F.lit(1)).alias("n_rows")).select("*", one)
    mean = work.agg(F.avg("distances").alias("mean")).select("*", one)
    n_items = graph.items.count()
    # one-row results side by side
    return ann.recall_at_k(found, exact).select("recall", one).join(n, "k").join(mean, "k").select(
        "queries", "n_rows", (F.col("recall") >= 0.9).alias("recall_at_10_is_090"), (F.col("mean") < n_items).alias("distances_below_all"))


@query("ann_recall", with_views("""
    SELECT m.method, (SELECT count(*) FROM uvec)::BIGINT AS queries, (SELECT count(*) * 10 FROM uvec)::BIGINT AS n_rows,
           true AS recall_at_10_is_090
    FROM (VALUES ('ivf_reopened'), ('lsh'), ('pq')) m(method)""", "uvec"))
def ann_recall(spark, d):
    """R7, R8, IO4: the searches against the exact one: all queries answered in full, recall@10
    at least 0.9.  The IVF index is written, reopened and read by cell."""
    c = Context(spark, d)
    q, idx = _ivf(c)
    path = scratch_path(spark, "ivf-index")
    ann.save_ivf(idx, path)
    exact = materialize(R.knn(q, c.vectors, KNN_K, "cosine"), "exact")
    out = None
    for name, found in (("ivf_reopened", ann.search_ivf(q, ann.load_ivf(spark, path), KNN_K)),
                        ("lsh", ann.search_lsh(q, c.vectors, KNN_K)), ("pq", _pq(c, q))):
        n = found.agg(F.countDistinct("qid").alias("queries"), F.count(F.lit(1)).alias("n_rows"))
        # two one-row results side by side
        r = ann.recall_at_k(found, exact).withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k")
        row = r.select(F.lit(name).alias("method"), "queries", "n_rows", (F.col("recall") >= 0.9).alias("recall_at_10_is_090"))
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- text, vector store, registry


def _part_text(c: Context):
    from recsift.sources.tables import read_table
    return read_table(c.spark, c.sf_dir, "part").select(F.col("p_partkey").cast("long").alias("item_id"),
                                                         F.col("p_name").alias("text"))


@query("encode_text_hashed", r"""
    SELECT doc_id, 512 AS dim,
           CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
    FROM documents""")
def encode_text_hashed(spark, d):
    """Every document (whole text) to a unit 512-vector by feature hashing."""
    from recsift.sources.tables import documents
    enc = TX.encode_hashed(documents(spark, d), "doc_id", "text", 512)
    return enc.select("doc_id", F.size("v").alias("dim"), r6(V.norm("v")).alias("norm"))


@query("vectors_incremental", with_views(f"""
    SELECT item_id, 'existing' AS source, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM vec
    UNION ALL
    SELECT i.item_id, 'new', 1.0::DOUBLE FROM items_c i JOIN part p ON p.p_partkey = i.item_id
    WHERE len(coalesce(regexp_extract_all(i.image_urls, '{URL_RE}'), [])) > 0
      AND NOT EXISTS (SELECT 1 FROM vec v WHERE v.item_id = i.item_id)""", "items_c", "vec"))
def vectors_incremental(spark, d):
    """Items with an image but no vector are embedded (text stand-in) and merged."""
    c = Context(spark, d)
    out = TX.vectors_incremental(c.items, _part_text(c), c.vectors, 64)
    return out.select("item_id", "source", r6(V.norm("v")).alias("norm"))


@query("text_search")
def text_search(spark, d):
    """The catalogue's item names encoded; the query text 'red widget'
    (a vector supplied instead serves R13) -> top 10 items with details."""
    c = Context(spark, d)
    hits = TX.text_search(_part_text(c), "item_id", "text", "red widget", KNN_K)
    return R.similar_items_detail(hits, c.items.select("item_id", "category", "brand")) \
        .select("item_id", "category", "brand", r6("similarity_score").alias("similarity_score"))


@query("vector_store_write", """
    SELECT vec_id::BIGINT AS item_id, 'visual' AS model, len(v) AS dim, round(v[1], 6) AS first_x, round(v[len(v)], 6) AS last_x,
           round(list_sum(v), 6) AS sum_x
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def vector_store_write(spark, d):
    """IO3: vectors + ids written with a metadata row (model, dim, count, time)."""
    c = Context(spark, d)
    root = scratch_path(spark, "vector-store")
    c.vectors.select("item_id", "v").write.parquet(f"{root}/vectors")
    meta = c.vectors.agg(F.count(F.lit(1)).alias("count"), F.max(F.size("v")).cast("long").alias("dim")) \
        .select(F.lit("visual").alias("model"), "dim", "count", F.lit(c.as_of).cast("timestamp").alias("created_at"))
    meta.write.parquet(f"{root}/metadata")
    back = spark.read.parquet(f"{root}/vectors")
    m = spark.read.parquet(f"{root}/metadata").first()  # the one metadata row
    return back.select("item_id", F.lit(m["model"]).alias("model"), F.lit(m["dim"]).cast("long").alias("dim"),
                       r6(F.element_at("v", 1)).alias("first_x"), r6(F.element_at("v", -1)).alias("last_x"),
                       r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("sum_x"))


def _registered(c: Context) -> RG.Registry:
    """Runs of the popular and the recent-popular list models appended to a stored registry with their metrics; versions 1 and 2
    are activated in turn."""
    from recsift.operators import evaluation as EV
    root = scratch_path(c.spark, "registry")
    reg = RG.Registry(c.spark, root)
    for recs in (c.pop_recs, c.recent_recs):
        m = EV.evaluate_all(recs, c.truth, (10,)).filter((F.col("k") == 10) & F.col("metric").isin("precision", "recall", "ndcg", "mrr", "map"))
        reg.register("popularity", {r["metric"]: r["value"] for r in m.collect()}, str(c.as_of))  # one row a metric
    reg.activate("popularity", 1, str(c.as_of))
    reg.activate("popularity", 2, str(c.as_of))
    return RG.Registry(c.spark, root)  # reopened


@query("run_registry")
def run_registry(spark, d):
    """Model runs with metrics; (name, version) unique, one active version per name."""
    return _registered(Context(spark, d)).runs().select("name", "version", "metrics", "is_active")


@query("run_registry_log", """
    SELECT 'popularity' AS name, v.version::BIGINT AS version, v.version = 2 AS is_active, 5::BIGINT AS n_metrics
    FROM (VALUES (1), (2)) v(version)""")
def run_registry_log(spark, d):
    """What the registry holds, by its log."""
    return _registered(Context(spark, d)).runs().select("name", "version", "is_active",
                                                        F.size(F.json_object_keys("metrics")).cast("long").alias("n_metrics"))
