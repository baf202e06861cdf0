"""Losses, validation metrics, implicit-feedback factorisation and tower inference
(L1-L5, V1, C1-C4).

Loss inputs are long tables of training triples:
    triples (user_v array<double>, pos_v array<double>, neg_v array<array<double>>, weight double)
or of their scores and distances (_pos, _negs, _d_pos, _d_negs, weight).
Every loss is a per-row array expression followed by one ``avg`` -- Spark's
partial aggregation makes the mean a map-side reduction, nothing is collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.session import materialize, release, sweep

# Fixed values (model configuration)
INFONCE_TEMPERATURE = 0.1
SOFTMAX_TEMPERATURE = 1.0
BPR_MARGIN = 0.0
TRIPLET_MARGIN = 1.0


def scores(t: DataFrame) -> DataFrame:
    """_pos = <u, p>; _negs = [<u, n_j>]; rows that have them already stay as they are."""
    return t if "_pos" in t.columns else t.withColumn("_pos", V.dot("user_v", "pos_v")).withColumn(
        "_negs", F.transform("neg_v", lambda n: V.dot("user_v", n)))


def _logsumexp(arr: Column) -> Column:
    m = F.array_max(arr)
    return m + F.log(F.aggregate(F.transform(arr, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x))


def _weighted_mean(per_row: Column, weighted: bool) -> Column:
    """The mean divides by rows, not by weight (as the reference does)."""
    return F.avg(per_row * F.col("weight")) if weighted else F.avg(per_row)


def loss_infonce(t: DataFrame, temperature: float = INFONCE_TEMPERATURE, weighted: bool = True) -> DataFrame:
    """L1: mean of w * (logsumexp([pos, negs] / T) - pos / T)."""
    s = scores(t)
    logits = F.transform(F.concat(F.array("_pos"), F.col("_negs")), lambda x: x / temperature)
    per = _logsumexp(logits) - F.col("_pos") / temperature
    return s.agg(_weighted_mean(per, weighted).alias("loss"))


def _neg_log_sigmoid(x: Column) -> Column:
    """-log(sigmoid(x)) = log(1 + exp(-x)), in the overflow-free form."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))


def loss_bpr(t: DataFrame, margin: float = BPR_MARGIN, weighted: bool = True) -> DataFrame:
    """L2: mean over negatives of -log sigmoid(pos - neg - margin), then weighted mean."""
    s = scores(t)
    terms = F.transform("_negs", lambda n: _neg_log_sigmoid(F.col("_pos") - n - F.lit(margin)))
    per = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.size(terms)
    return s.agg(_weighted_mean(per, weighted).alias("loss"))


def loss_sampled_softmax(t: DataFrame, temperature: float = SOFTMAX_TEMPERATURE,
                         weighted: bool = True) -> DataFrame:
    """L3: -pos/T + logsumexp([pos, negs] / T)."""
    s = scores(t)
    logits = F.transform(F.concat(F.array("_pos"), F.col("_negs")), lambda x: x / temperature)
    per = _logsumexp(logits) - F.col("_pos") / temperature
    return s.agg(_weighted_mean(per, weighted).alias("loss"))


def loss_triplet(t: DataFrame, margin: float = TRIPLET_MARGIN, weighted: bool = True) -> DataFrame:
    """L4: relu(d(a, p) - min_j d(a, n_j) + margin) with Euclidean distances."""
    if "_d_pos" in t.columns:  # measured already
        d_pos, d_neg = F.col("_d_pos"), F.array_min("_d_negs")
    else:
        d_pos = V.l2_dist("user_v", "pos_v")
        d_neg = F.array_min(F.transform("neg_v", lambda n: V.l2_dist("user_v", n)))
    per = F.greatest(d_pos - d_neg + F.lit(margin), F.lit(0.0))
    return t.agg(_weighted_mean(per, weighted).alias("loss"))


def loss_multitask(losses: DataFrame, weights: DataFrame | None = None,
                   log_vars: DataFrame | None = None) -> DataFrame:
    """``total_fixed`` = sum of w * loss (missing weight 1.0);
    ``total_uncertainty`` uses exp(-s) * loss + s for tasks with a log variance s
    in ``log_vars`` (task, s), the fixed term otherwise.  losses: (task, loss);
    weight and log-variance tables have one row per task (broadcast, bounded)."""
    j = losses
    if weights is not None:
        j = j.join(F.broadcast(weights), "task", "left")
    else:
        j = j.withColumn("w", F.lit(None).cast("double"))
    if log_vars is not None:
        j = j.join(F.broadcast(log_vars), "task", "left")
    else:
        j = j.withColumn("s", F.lit(None).cast("double"))
    fixed = F.coalesce("w", F.lit(1.0)) * F.col("loss")
    unc = F.when(F.col("s").isNotNull(), F.exp(-F.col("s")) * F.col("loss") + F.col("s")).otherwise(fixed)
    return j.agg(F.sum(fixed).alias("total_fixed"), F.sum(unc).alias("total_uncertainty"))


def validation_metrics(t: DataFrame) -> DataFrame:
    """V1: accuracy (pos > mean of its negatives), mrr (rank = 1 + #neg >= pos),
    mean positive score, mean negative score (over all negatives), margin."""
    s = scores(t)
    k = F.size("_negs")
    mean_neg_row = F.aggregate("_negs", F.lit(0.0), lambda a, x: a + x) / k
    rank = 1 + F.size(F.filter("_negs", lambda n: n >= F.col("_pos")))
    agg = s.agg(F.avg((F.col("_pos") > mean_neg_row).cast("double")).alias("accuracy"),
                F.avg(1.0 / rank).alias("mrr"), F.avg("_pos").alias("mean_pos_score"),
                (F.sum(F.aggregate("_negs", F.lit(0.0), lambda a, x: a + x)) / F.sum(k)).alias("mean_neg_score"))
    return agg.withColumn("margin", F.col("mean_pos_score") - F.col("mean_neg_score"))


# ---------------------------------------------------------------- C1, C2: factorisation


#: ratings of one block: a task holds a block's ratings and the factors they name, whatever the table's size
ALS_BLOCK, ALS_BLOCKS = 2_500_000, 10


def als_blocks(ratings: int) -> int:
    """Blocks of users and of items: MLlib's own number for small tables, then one per ``ALS_BLOCK`` ratings."""
    return max(ALS_BLOCKS, -(-ratings // ALS_BLOCK))


def fit_als(train: DataFrame, user_codes: DataFrame, item_codes: DataFrame, rank: int = 16,
            max_iter: int = 5, reg: float = 0.1, alpha: float = 1.0, seed: int = 42):
    """C1 (re-aimed): implicit ALS on (user, item, weight); ALS needs int ids, so
    dense codes from P7 replace the raw ids.  Returns (user_factors, item_factors)
    as (user_id, v) and (item_id, v) in double, written once; the ratings are deleted then, and the
    shuffles of the fit go as far as the driver has let go of them.

    The item factors are checkpointed in every iteration: ALS then drops the shuffles of the iteration before, which
    otherwise stay until the fit has ended (two of the factors' size, times their blocks, per iteration)."""
    from pyspark.ml.recommendation import ALS
    data = materialize(train.join(user_codes, "user_id").join(item_codes, "item_id")
                 .select(F.col("user_code").cast("int"), F.col("item_code").cast("int"),
                         F.col("weight").cast("float")), "als-ratings")
    blocks = als_blocks(data.count())
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True,
              userCol="user_code", itemCol="item_code", ratingCol="weight", seed=seed,
              coldStartStrategy="drop", nonnegative=False, checkpointInterval=1,
              numUserBlocks=blocks, numItemBlocks=blocks)
    model = als.fit(data)
    uf = (model.userFactors.withColumnRenamed("id", "user_code")
          .join(user_codes, "user_code").select("user_id", F.col("features").cast("array<double>").alias("v")))
    itf = (model.itemFactors.withColumnRenamed("id", "item_code")
           .join(item_codes, "item_code").select("item_id", F.col("features").cast("array<double>").alias("v")))
    out = materialize(uf, "als-users"), materialize(itf, "als-items")
    release(data)
    del als, model, uf, itf, data  # what still holds the fit's shuffles
    sweep(train.sparkSession)
    return out


def factor_triples(rows: DataFrame, user_f: DataFrame, item_f: DataFrame, negatives: DataFrame) -> DataFrame:
    """Triples for validation losses from factor vectors: rows (user_id, item_id,
    weight), negatives (user_id, item_id, slot, neg_item_id)."""
    uf = user_f.select("user_id", V.l2_normalize("v").alias("user_v"))
    itf = item_f.select("item_id", V.l2_normalize("v").alias("pos_v"))
    negs = (negatives.join(item_f.select(F.col("item_id").alias("neg_item_id"), V.l2_normalize("v").alias("nv")),
                           "neg_item_id")
            .groupBy("user_id", "item_id").agg(F.sort_array(F.collect_list(F.struct("slot", "nv"))).alias("_n"))
            .select("user_id", "item_id", F.transform("_n", lambda e: e["nv"]).alias("neg_v")))
    return (rows.select("user_id", "item_id", "weight").join(uf, "user_id").join(itf, "item_id")
                .join(negs, ["user_id", "item_id"]).filter(F.col("user_v").isNotNull() & F.col("pos_v").isNotNull()))


# ---------------------------------------------------------------- C3, C4: tower inference

ITEM_EMB = {"item": 64, "category": 32, "brand": 32, "condition": 16, "size": 16}
USER_EMB = {"user": 64, "pref": 16}
ITEM_HIDDEN = (256, 128, 64)
USER_HIDDEN = (128, 64)
OUTPUT_DIM = 32


def id_embedding_table(codes: DataFrame, code_col: str, dim: int, name: str, seed: int = 42,
                       std: float = 0.01) -> DataFrame:
    """A stand-in embedding table (code, e): uniform with deviation ``std``, hashed from
    (seed, table, code, slot), so any partitioning gives the same table."""
    lim = std * math.sqrt(3.0)
    code = F.col(code_col).cast("long")
    e = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.xxhash64(
        F.lit(seed), F.lit(name), code, j) / F.lit(float(2 ** 63)) * F.lit(lim))
    return codes.select(code.alias(code_col), e.alias("e"))


def _dense(rng, n_in, n_out):
    lim = math.sqrt(6.0 / (n_in + n_out))  # xavier uniform
    return rng.uniform(-lim, lim, (n_in, n_out)), np.zeros(n_out)


def mlp_weights(n_in: int, hidden, out: int, seed: int) -> list:
    rng = np.random.default_rng(seed)
    layers, prev = [], n_in
    for h in hidden:
        layers.append(_dense(rng, prev, h))
        prev = h
    layers.append(_dense(rng, prev, out))
    return layers


def mlp_forward(x: np.ndarray, layers) -> np.ndarray:
    """Linear -> LayerNorm -> ReLU per hidden layer, then Linear, then L2 normalise
    (dropout is off at inference)."""
    for w, b in layers[:-1]:
        x = x @ w + b
        mu, var = x.mean(axis=1, keepdims=True), x.var(axis=1, keepdims=True)
        x = np.maximum((x - mu) / np.sqrt(var + 1e-5), 0.0)
    w, b = layers[-1]
    x = x @ w + b
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def tower_inference(features: DataFrame, key: str, parts: list[str], scalars: list[str],
                    layers, visual: str | None = None, visual_layers=None) -> DataFrame:
    """Run an MLP tower over Arrow batches.  ``parts`` are array columns that are
    concatenated, ``scalars`` are double columns; ``visual`` is projected by
    ``visual_layers`` (Linear, ReLU, Linear) first.  Output: key, v (unit vector)."""
    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            cols = [np.vstack(pdf[p].to_numpy()) for p in parts]
            cols += [pdf[s].to_numpy(np.float64)[:, None] for s in scalars]
            if visual is not None:
                x = np.vstack(pdf[visual].to_numpy())
                (w1, b1), (w2, b2) = visual_layers
                cols.append(np.maximum(x @ w1 + b1, 0.0) @ w2 + b2)
            out = mlp_forward(np.hstack(cols), layers)
            yield pd.DataFrame({key: pdf[key].astype("int64"), "v": list(out)})
    return features.mapInPandas(run, f"{key} long, v array<double>")
