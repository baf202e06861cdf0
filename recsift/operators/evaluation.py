"""Ranking and beyond-accuracy metrics over long-form lists.

Inputs
  recs   (user_id, rank from 1, item_id)      -- may hold duplicates
  truth  (user_id, item_id[, rel])             -- distinct ground truth
  users  (user_id)                             -- the users to score (also those
                                                  with an empty list); default:
                                                  users with a recs row
Per-user work is bounded by the largest k (lists are cut before any grouping), so
no per-user group can grow with the data; truth sizes are plain aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.operators.features import SEGMENTS, segment_of
from recsift.operators.ordering import bounded_broadcast
from recsift.session import materialize

METRICS = ("precision", "recall", "ndcg", "mrr", "hit_rate", "map")
DEFAULT_KS = (5, 10, 20)


def _check_ks(ks) -> list[int]:
    ks = [int(k) for k in ([ks] if isinstance(ks, int) else ks)]
    if not ks or any(k <= 0 for k in ks):
        raise ValueError(f"k must be positive, got {ks}")
    return sorted(set(ks))


def _ks_col(ks: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in ks]))


def _idcg_binary(k_col: Column, n_col: Column, kmax: int) -> Column:
    """sum_{i=1..min(k, n)} 1/log2(i+1), from a literal table of prefix sums."""
    prefix, acc = [0.0], 0.0
    for i in range(1, kmax + 1):
        acc += 1.0 / math.log2(i + 1)
        prefix.append(acc)
    arr = F.array(*[F.lit(x) for x in prefix])
    return F.element_at(arr, F.least(k_col, n_col).cast("int") + 1)


def per_user(recs: DataFrame, truth: DataFrame, ks=DEFAULT_KS, users: DataFrame | None = None,
             graded: bool = False) -> DataFrame:
    """M1-M7: one row per (user_id, k) with precision, recall, ndcg, mrr, hit_rate, map."""
    ks = _check_ks(ks)
    kmax = max(ks)
    rel = F.col("rel") if graded and "rel" in truth.columns else F.lit(1.0)
    t = truth.select("user_id", "item_id", rel.cast("double").alias("rel"))
    tsize = t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_truth"))
    r = (recs.filter(F.col("rank") <= kmax).select("user_id", "rank", "item_id")
             .join(t, ["user_id", "item_id"], "left")
             .withColumn("hit", F.col("rel").isNotNull())
             .withColumn("k", _ks_col(ks)).filter(F.col("rank") <= F.col("k")))
    # running hit count (duplicates count at each position, as in the reference)
    w = (Window.partitionBy("user_id", "k").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = r.withColumn("run_hits", F.sum(F.col("hit").cast("long")).over(w))
    agg = r.groupBy("user_id", "k").agg(
        F.countDistinct(F.when(F.col("hit"), F.col("item_id"))).alias("hits"),
        F.sum(F.when(F.col("hit"), F.col("rel") / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("hit"), F.col("run_hits") / F.col("rank"))).alias("ap_sum"))
    if users is None:
        users = recs.select("user_id").distinct()
    base = users.select("user_id").distinct().withColumn("k", _ks_col(ks))
    j = (base.join(agg, ["user_id", "k"], "left").join(tsize, "user_id", "left")
             .fillna({"hits": 0, "n_truth": 0}))
    if graded:
        wi = Window.partitionBy("user_id").orderBy(F.col("rel").desc())
        ideal = (t.withColumn("_i", F.row_number().over(wi)).filter(F.col("_i") <= kmax)
                  .withColumn("k", _ks_col(ks)).filter(F.col("_i") <= F.col("k"))
                  .groupBy("user_id", "k").agg(F.sum(F.col("rel") / F.log2(F.col("_i") + 1)).alias("idcg")))
        j = j.join(ideal, ["user_id", "k"], "left").fillna({"idcg": 0.0})
    else:
        j = j.withColumn("idcg", F.when(F.col("n_truth") > 0,
                                        _idcg_binary(F.col("k"), F.col("n_truth"), kmax))
                         .otherwise(F.lit(0.0)))
    nt = F.col("n_truth")
    return j.select(
        "user_id", F.col("k").cast("int").alias("k"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.when(nt > 0, F.col("hits") / nt).otherwise(0.0).alias("recall"),
        F.when((nt > 0) & (F.col("idcg") > 0), F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg"))
         .otherwise(0.0).alias("ndcg"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.when(nt > 0, F.coalesce(F.col("ap_sum"), F.lit(0.0)) / F.least(F.col("k"), nt))
         .otherwise(0.0).alias("map"),
    )


def single_metric(recs: DataFrame, truth: DataFrame, metric: str, k: int,
                  users: DataFrame | None = None, graded: bool = False) -> DataFrame:
    """One metric at one k per user: (user_id, <metric>)."""
    if metric not in METRICS:
        raise KeyError(metric)
    return per_user(recs, truth, [k], users, graded).select("user_id", metric)


def _long(per: DataFrame, metrics=METRICS, keys: list[str] | None = None) -> DataFrame:
    stack = ", ".join(f"'{m}', {m}" for m in metrics)
    return per.selectExpr(*(keys or []), "user_id", "k",
                          f"stack({len(metrics)}, {stack}) AS (metric, value)")


def evaluate_all(recs: DataFrame, truth: DataFrame, ks=DEFAULT_KS, users: DataFrame | None = None,
                 metrics=METRICS, graded: bool = False, extra_keys: list[str] | None = None) -> DataFrame:
    """M8: mean per (metric, k) over users that have a list and a non-empty truth,
    plus ``num_evaluated_users`` (k null).  Output: [extra keys,] metric, k, value."""
    keys = list(extra_keys or [])
    if users is None:
        users = recs.select("user_id", *keys).distinct()
    users = users.join(truth.select("user_id").distinct(), "user_id", "left_semi")
    per = per_user(recs, truth, ks, users.select("user_id"), graded)
    if keys:
        per = per.join(users.select("user_id", *keys), "user_id")
    long = _long(per, metrics, keys)
    means = long.groupBy(*keys, "metric", "k").agg(F.avg("value").alias("value"))
    n = users.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("value"))
    n = n.select(*keys, F.lit("num_evaluated_users").alias("metric"),
                 F.lit(None).cast("int").alias("k"), "value")
    return means.select(*keys, "metric", "k", "value").unionByName(n)


def coverage(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """M9: distinct recommended items (all users' lists) over catalogue size."""
    n_cat = catalog.count()  # one number to the driver
    n_rec = recs.agg(F.countDistinct("item_id").alias("n_rec"))
    return n_rec.select((F.col("n_rec") / F.lit(n_cat) if n_cat > 0 else F.lit(0.0)).cast("double")
                        .alias("coverage"))


def diversity_per_user(recs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean pairwise cosine distance inside each list, without forming pairs.

    For unit vectors the sum of pairwise dot products is (|sum v|^2 - n) / 2, so a
    list needs one vector sum (``Summarizer.sum``, partial aggregation on the map
    side) -- linear in list length.  Vectors are renormalised in double first;
    items without a valid vector are skipped; fewer than two usable items give 0.

    Only the vectors of recommended items meet the lists, broadcast where their bytes are
    known to be few: files of lists compress so well that Spark would take millions of rows
    for a table small enough to broadcast."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    named = materialize(recs.select("item_id").distinct(), "rec-items")
    unit = (vectors.filter(V.is_valid("v")).join(bounded_broadcast(named), "item_id", "left_semi")
                   .select("item_id", V.l2_normalize("v").alias("u")))
    unit = bounded_broadcast(materialize(unit, "rec-vectors"))
    j = recs.select("user_id", "item_id").join(unit, "item_id")
    sums = (j.select("user_id", array_to_vector("u").alias("_u"))
             .groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("_u")).alias("_s"))
             .select("user_id", "n", V.sq_norm(vector_to_array("_s")).alias("ss")))
    users = recs.select("user_id").distinct()
    d = users.join(sums, "user_id", "left").fillna({"n": 0, "ss": 0.0})
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    mean_dot = ((F.col("ss") - F.col("n")) / 2.0) / pairs
    return d.select("user_id", F.when(F.col("n") >= 2, 1.0 - mean_dot).otherwise(0.0).alias("diversity"))


def novelty_per_user(recs: DataFrame, item_pop: DataFrame, num_users) -> DataFrame:
    """Mean of -log2(max(pop / num_users, 1e-10)); an item without a count
    has popularity 1.  ``num_users`` is an int or a one-row DataFrame (num_users)."""
    if isinstance(num_users, DataFrame):
        num_users = num_users.first()["num_users"]  # one number to the driver
    nu = float(num_users or 0)
    j = recs.select("user_id", "item_id").join(item_pop.select("item_id", "popularity"), "item_id", "left")
    if nu <= 0:
        return j.groupBy("user_id").agg(F.lit(0.0).alias("novelty"))
    p = F.coalesce(F.col("popularity"), F.lit(1)).cast("double") / F.lit(nu)
    info = -F.log2(F.greatest(p, F.lit(1e-10)))
    return j.groupBy("user_id").agg(F.avg(info).alias("novelty"))


def evaluate_full(recs: DataFrame, truth: DataFrame, catalog: DataFrame, vectors: DataFrame,
                  item_pop: DataFrame, num_users, ks=DEFAULT_KS) -> DataFrame:
    """M8 rows plus coverage, diversity and novelty (k null); diversity and
    novelty are means over users with a non-empty list."""
    acc = evaluate_all(recs, truth, ks)
    cov = coverage(recs, catalog).select(F.lit("coverage").alias("metric"),
                                         F.lit(None).cast("int").alias("k"),
                                         F.col("coverage").alias("value"))
    div = diversity_per_user(recs, vectors).agg(F.avg("diversity").alias("value")).select(
        F.lit("diversity").alias("metric"), F.lit(None).cast("int").alias("k"),
        F.coalesce("value", F.lit(0.0)).alias("value"))
    nov = novelty_per_user(recs, item_pop, num_users).agg(F.avg("novelty").alias("value")).select(
        F.lit("novelty").alias("metric"), F.lit(None).cast("int").alias("k"),
        F.coalesce("value", F.lit(0.0)).alias("value"))
    return acc.unionByName(cov).unionByName(div).unionByName(nov)


def metrics_pivot(results: DataFrame, ks=DEFAULT_KS) -> DataFrame:
    """One row per metric, one column ``at_<k>`` per k (M8/M13 long input)."""
    ks = _check_ks(ks)
    acc = results.filter(F.col("k").isNotNull())
    return (acc.groupBy("metric").pivot("k", ks).agg(F.first("value"))
               .select("metric", *[F.col(str(k)).alias(f"at_{k}") for k in ks]))


def evaluate_segments(recs: DataFrame, truth: DataFrame, train: DataFrame, ks=DEFAULT_KS,
                      cold: int = 5, warm: int = 20) -> DataFrame:
    """M8 per segment (cold / warm / hot by training interaction count; an
    unknown user counts 0).  A segment with no user yields only its zero count."""
    spark = recs.sparkSession
    cnt = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    users = (recs.select("user_id").distinct().join(cnt, "user_id", "left")
                 .select("user_id", segment_of(F.col("_n"), cold, warm).alias("segment")))
    res = evaluate_all(recs, truth, ks, users=users, extra_keys=["segment"])
    segs = spark.createDataFrame([(s,) for s in SEGMENTS], "segment string")
    zero = (segs.join(res.filter(F.col("metric") == "num_evaluated_users").select("segment"),
                      "segment", "left_anti")
                .select("segment", F.lit("num_evaluated_users").alias("metric"),
                        F.lit(None).cast("int").alias("k"), F.lit(0.0).alias("value")))
    return res.unionByName(zero)


def offline_ab_test(a: DataFrame, b: DataFrame, primary: str = "ndcg@10") -> DataFrame:
    """Compare two M8 result tables by ``metric@k`` name.

    Per metric: model_a, model_b (missing is 0), diff, pct_change (inf when a <= 0).
    Every row also carries the primary comparison: winner ('A' only if a > b) and
    lift % ((b - a) / a * 100, inf when a <= 0).  The user count is left out."""
    def named(df):
        nm = F.when(F.col("k").isNull(), F.col("metric")).otherwise(
            F.concat(F.col("metric"), F.lit("@"), F.col("k").cast("string")))
        return df.filter(F.col("metric") != "num_evaluated_users").select(nm.alias("metric"), "value")
    j = (named(a).withColumnRenamed("value", "model_a")
         .join(named(b).withColumnRenamed("value", "model_b"), "metric", "full")
         .fillna({"model_a": 0.0, "model_b": 0.0}))
    inf = F.lit(float("inf"))
    j = j.select("metric", "model_a", "model_b",
                 (F.col("model_b") - F.col("model_a")).alias("diff"),
                 F.when(F.col("model_a") > 0,
                        (F.col("model_b") - F.col("model_a")) / F.col("model_a") * 100).otherwise(inf)
                 .alias("pct_change"))
    # the comparison has one row per metric name (bounded by metrics x k values),
    # so the primary values are spread to every row by a window over all rows
    everything = Window.partitionBy()
    a_ = F.coalesce(F.max(F.when(F.col("metric") == primary, F.col("model_a"))).over(everything), F.lit(0.0))
    b_ = F.coalesce(F.max(F.when(F.col("metric") == primary, F.col("model_b"))).over(everything), F.lit(0.0))
    return j.select("*", F.when(a_ > b_, "A").otherwise("B").alias("winner"),
                    F.when(a_ > 0, (b_ - a_) / a_ * 100).otherwise(inf).alias("lift"),
                    F.lit(primary).alias("primary_metric"))


def ab_results_summary(results: DataFrame) -> DataFrame:
    """Count, mean and sample stddev per (experiment, variant, metric)."""
    return (results.groupBy("experiment_name", "variant", "metric_name")
                   .agg(F.count(F.lit(1)).alias("n"), F.avg("metric_value").alias("mean"),
                        F.stddev_samp("metric_value").alias("stddev")))
