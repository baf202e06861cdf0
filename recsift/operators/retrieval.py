"""Nearest-item retrieval, exclusions and fallbacks.

Exact k-NN between a query table and an item table is a blocked matrix product:
queries are hashed into query blocks and items into item blocks; every (query
block, item block) pair is one cogroup handed to numpy, which scores the block
pair in matrix products and keeps only the local top k per query.  Exclusions
travel to the block of their item beside the query rows and are applied *before* the
local top k, so no widening is needed.  Rows per query after the local step are
``k * item_blocks``; the final top k per query is a ``row_number`` filter, which
Spark plans as a WindowGroupLimit (partial top-k before the shuffle).

Memory per task is bounded by the block sizes, never by the data; at most about
``SCORE_CELLS`` scores of a block pair are held at once.  What grows with the data is the
replication of each query row to every item block, the unavoidable cost of an
exact search; ``recsift.operators.ann`` holds the approximate (IVF, LSH) forms
that probe only a few cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.operators.ordering import bounded_broadcast, with_positions
from recsift.session import materialize

KNN_SCHEMA = "qid long, item_id long, score double"
METRICS = ("cosine", "dot", "l2")


def _blocks(n: int, size: int) -> int:
    return max(1, int(math.ceil(n / float(size))))


SCORE_CHUNK = 1024  # most queries scored per matrix product inside a block pair
#: rows of a query and of an item block.  Every query row is copied to each item block and every item row to each query
#: block, so few large blocks keep the copies few; a task holds one pair of blocks
Q_BLOCK, I_BLOCK = 131_072, 65_536
#: scores held at once: with a large item block fewer queries are scored together
SCORE_CELLS = 1 << 21


def _best(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` largest keys of each row, rounded to RANK_DIGITS, ties by column; -inf never.

    A partition finds the k-th largest key; only what reaches it after rounding is sorted."""
    n = key.shape[1]
    if k < n:
        least = np.partition(key, n - k, axis=1)[:, n - k]
        # rounding moves a key by half a unit of the last digit at most
        least = np.where(np.isfinite(least), least - 2.0 * 10.0 ** -V.RANK_DIGITS - 1e-12 * np.abs(least), least)
        rows, cols = np.nonzero((key >= least[:, None]) & (key > -np.inf))
    else:
        rows, cols = np.nonzero(key > -np.inf)
    order = np.lexsort((cols, -np.round(key[rows, cols], V.RANK_DIGITS), rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(key)))[rows]
    return rows[place < k], cols[place < k]


#: items whose largest rough score stands for them; blocks below this many groups per place are scored in full at once
GROUP, LEAST_GROUPS = 32, 4


class Rough:
    """Items in single precision, in which a product finds the few pairs that can be among the best; only they are scored
    in double.  ``of`` is None for rows that single precision cannot hold (not finite, or very large or small)."""

    def __init__(self, I: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((I * I).sum(axis=1))
            self.most, self.least = norm.max(), norm[norm > 0].min(initial=1.0)
        self.fits = bool(np.isfinite(self.most) and self.most < 1e15)
        self.items = I.astype(np.float32).T if self.fits else None

    def of(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(scores, per query how far one may lie from that in double)."""
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.sqrt((Q * Q).sum(axis=1))
        if not (self.fits and np.isfinite(q).all() and q.max() < 1e15 and q[q > 0].min(initial=1.0) * self.least > 1e-12):
            return None
        return Q.astype(np.float32) @ self.items, (Q.shape[1] + 8) * 2.0 ** -23 * q * self.most + 1e-30


def _reaching(rough: np.ndarray, margin: np.ndarray, k: int, floor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of ``rough`` (single precision, -inf: left out) that can be among the ``k`` best of their row
    and reach its ``floor``.

    The k-th largest of the largest scores of groups of items is no larger than the k-th largest score."""
    n, wide = rough.shape[1], rough.shape[1] // GROUP
    # a group is every wide-th item: rows of maxima, not sums over short stretches
    tops = rough[:, :GROUP * wide].reshape(len(rough), GROUP, wide).max(axis=1)
    if GROUP * wide < n:  # a few more items for the first groups
        np.maximum(tops[:, :n - GROUP * wide], rough[:, GROUP * wide:], out=tops[:, :n - GROUP * wide])
    g = tops.shape[1]
    least = np.partition(tops, g - k, axis=1)[:, g - k].astype(np.float64) - 2.0 * margin
    if floor is not None:
        least = np.maximum(least, floor - margin)
    # rounding moves a score by half a unit of the last digit at most
    least = np.where(np.isfinite(least), least - 2.0 * 10.0 ** -V.RANK_DIGITS - 1e-6 * np.abs(least), least)
    rows, groups = np.nonzero(tops >= np.maximum(least, np.finfo(np.float32).min).astype(np.float32)[:, None])
    cols = groups[:, None] + wide * np.arange(GROUP + 1)
    rows = np.repeat(rows, GROUP + 1)[(there := (cols < n).ravel())]
    cols = cols.ravel()[there]
    score = rough[rows, cols]
    keep = (score >= least[rows]) & (score > -np.inf)
    return rows[keep], cols[keep]


def _ranked_pairs(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each row, by score rounded to RANK_DIGITS, ties by column."""
    order = np.lexsort((cols, -np.round(score, V.RANK_DIGITS), rows))
    rows, cols, score = rows[order], cols[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n_rows))[rows]
    return rows[place < k], cols[place < k], score[place < k]


class Kept:
    """The best ``k`` of every row among pairs that come in turns; ``floor``, which a new pair has to reach, rises with them."""

    def __init__(self, rows: int, k: int, floor: np.ndarray):
        self.rows, self.k, self.floor, self.pending = rows, k, floor.copy(), 0
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, scores), best first in each row."""
        self.found, self.pending = [_ranked_pairs(*map(np.concatenate, zip(*self.found)), self.rows, self.k)], 0
        return self.found[0]

    def least(self, rows: np.ndarray, margin=0.0) -> np.ndarray:
        """What a score that may be off by ``margin`` must reach, with room for rounding to RANK_DIGITS."""
        least = self.floor[rows] - margin
        return np.where(np.isfinite(least), least - 2.0 * 10.0 ** -V.RANK_DIGITS - 1e-6 * np.abs(least), np.finfo(np.float32).min)

    def add(self, rows: np.ndarray, cols: np.ndarray, score: np.ndarray) -> None:
        self.found.append((rows, cols, score))
        self.pending += len(rows)
        if self.pending > 2 * self.rows * self.k + 4096:
            rows, _, score = self.best()
            last = np.flatnonzero(np.diff(rows, append=-1))  # each row's worst that is kept
            last = last[np.bincount(rows, minlength=self.rows)[rows[last]] == self.k]
            self.floor[rows[last]] = np.maximum(self.floor[rows[last]], score[last])


#: numbers gathered at once for exact scores
GATHERED = 1 << 21


def _exact(Q: np.ndarray, I: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    step = max(1, GATHERED // Q.shape[1])
    parts = [np.einsum("ij,ij->i", Q[rows[a:a + step]], I[cols[a:a + step]]) for a in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _local_topk(metric: str, k: int, score_chunk: int = SCORE_CHUNK):
    """Return the cogroup function that scores one (query block, item block) pair.

    The query side holds query rows (qid, v) and, marked by ``is_ex``, the pairs (qid, ex) of items
    that must not be returned.  The score matrix in memory has at most ``score_chunk`` rows and about
    ``SCORE_CELLS`` numbers whatever the blocks are."""
    def excluded(qids, exq, exi):
        lo, hi = np.searchsorted(exq, qids), np.searchsorted(exq, qids, "right")
        rows = np.repeat(np.arange(len(qids)), hi - lo)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        return rows, exi[at]

    def chunk(Q, qids, exq, exi, I, ids, small):
        first = small.of(Q) if small is not None else None
        if first is not None:
            rough, margin = first
            if len(exq):
                rough[excluded(qids, exq, exi)] = -np.inf
            rows, cols = _reaching(rough, margin, k, None)
            rows, cols, score = _ranked_pairs(rows, cols, _exact(Q, I, rows, cols), len(Q), k)
            return pd.DataFrame({"qid": qids[rows], "item_id": ids[cols], "score": score})
        if metric == "l2":
            s = (np.sum(Q * Q, axis=1)[:, None] + np.sum(I * I, axis=1)[None, :] - 2.0 * (Q @ I.T))
            key = -np.maximum(s, 0.0)
        else:
            key = Q @ I.T
        key[np.isnan(key)] = -np.inf
        if len(exq):
            key[excluded(qids, exq, exi)] = -np.inf
        rows, cols = _best(key, min(k, len(ids)))
        score = key[rows, cols]
        keep = np.isfinite(score)
        rows, cols, score = rows[keep], cols[keep], score[keep]
        return pd.DataFrame({"qid": qids[rows], "item_id": ids[cols], "score": -score if metric == "l2" else score})

    def fn(q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        is_ex = q["is_ex"].to_numpy(bool)
        ex, q = q[is_ex], q[~is_ex]
        if q.empty or it.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"),
                                 "item_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        # sorted by id: equal scores are taken in item_id order
        it = it.sort_values("iid", kind="stable")
        ids = it["iid"].to_numpy(np.int64)
        I = np.vstack(it["iv"].to_numpy()).astype(np.float64)
        qids, vs = q["qid"].to_numpy(np.int64), q["v"].to_numpy()
        exq, exi = ex["qid"].to_numpy(np.int64), ex["ex"].to_numpy(np.int64)
        at = np.searchsorted(ids, exi, "right") - 1
        here = (at >= 0) & (ids[at] == exi)
        exq, at = exq[here], at[here]
        order = np.argsort(exq, kind="stable")
        exq, at = exq[order], at[order]
        c = max(1, min(score_chunk, SCORE_CELLS // len(ids)))
        small = Rough(I) if metric != "l2" and len(ids) >= GROUP * max(LEAST_GROUPS * k, 64) else None
        parts = [chunk(np.vstack(vs[a:a + c]).astype(np.float64), qids[a:a + c], exq, at, I, ids, small)
                 for a in range(0, len(vs), c)]
        parts = [p for p in parts if len(p)] or parts[:1]
        return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
    return fn


def query_side(queries: DataFrame, exclusions: DataFrame | None, keys: list[str]) -> DataFrame:
    """Query rows (keys, qid, v) and excluded pairs (keys, qid, item_id) as one side of the cogroup: each pair goes
    to the block of its item as a row of its own, so vectors are never joined with exclusions."""
    out = queries.select(*keys, "qid", "v", F.lit(0).cast("long").alias("ex"), F.lit(False).alias("is_ex"))
    if exclusions is None:
        return out
    return out.unionByName(exclusions.select(*keys, "qid", F.lit(None).cast("array<double>").alias("v"),
                                             F.col("item_id").alias("ex"), F.lit(True).alias("is_ex")))


def knn(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine",
        exclusions: DataFrame | None = None, q_block: int = Q_BLOCK, i_block: int = I_BLOCK,
        n_queries: int | None = None, n_items: int | None = None,
        score_chunk: int = SCORE_CHUNK) -> DataFrame:
    """Exact top-k items per query.

    queries: (qid, v); items: (item_id, v); exclusions: (qid, item_id) pairs that
    must not be returned.  ``cosine`` normalises both sides (zero vectors are
    dropped), ``dot`` uses raw vectors, ``l2`` returns squared distances (smaller
    first).  Output: qid, rank (1..k), item_id, score.  Ties: score rounded to 9
    places, then item_id ascending.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k <= 0:
        raise ValueError("k must be positive")
    if metric == "cosine":
        queries = queries.filter(V.is_valid("v")).withColumn("v", V.l2_normalize("v"))
        items = items.filter(V.is_valid("v")).withColumn("v", V.l2_normalize("v"))
    if n_queries is None:
        # the query side is read twice (sizing, scoring): write it once instead
        # of computing its whole lineage twice
        queries = materialize(queries.select("qid", "v"), "knn-queries")
    n_q = n_queries if n_queries is not None else queries.count()
    n_i = n_items if n_items is not None else items.count()
    n_qb, n_ib = _blocks(n_q, q_block), _blocks(n_i, i_block)
    # enough block pairs to keep every core busy (small inputs), never blocks of
    # fewer than 64 queries
    target = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n_qb = max(n_qb, min(_blocks(target, n_ib), _blocks(n_q, 64)))
    qb = F.pmod(F.xxhash64("qid"), F.lit(n_qb))
    ib_of = lambda c: F.pmod(F.xxhash64(c), F.lit(n_ib))
    # block keys are LongType on both sides: the cogroup hashes them, and an int
    # and a long of equal value land in different partitions
    q_rep = (queries.select("qid", F.col("v").cast("array<double>").alias("v")).withColumn("qb", qb.cast("long"))
                    .withColumn("ib", F.explode(F.sequence(F.lit(0).cast("long"),
                                                           F.lit(n_ib - 1).cast("long")))))
    if exclusions is not None:
        # only ids that the item table holds: a long history becomes no more rows than its block has items
        exclusions = (exclusions.select("qid", F.col("item_id").cast("long").alias("item_id")).filter(F.col("qid").isNotNull())
                      .join(items.select("item_id").distinct(), "item_id", "left_semi")
                      .select("qid", "item_id", qb.cast("long").alias("qb"), ib_of(F.col("item_id")).cast("long").alias("ib")))
    q_rep = query_side(q_rep, exclusions, ["qb", "ib"])
    # fresh column names on the item side: both sides often come from one table,
    # and a cogroup of identical attributes would lose one of them
    i_rep = (items.select(F.col("item_id").alias("iid"), F.col("v").alias("iv"))
                  .withColumn("ib", ib_of(F.col("iid")).cast("long"))
                  .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"),
                                                         F.lit(n_qb - 1).cast("long")))))
    local = (q_rep.groupBy("qb", "ib")
                  .cogroup(i_rep.groupBy("qb", "ib"))
                  .applyInPandas(_local_topk(metric, k, score_chunk), KNN_SCHEMA))
    rk = V.rank_score("score")
    w = Window.partitionBy("qid").orderBy(rk.asc() if metric == "l2" else rk.desc(), F.col("item_id"))
    return (local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                 .select("qid", F.col("rank").cast("long"), "item_id", "score"))


def top_k_one(items: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """Exact top k for one literal query vector.  A single global top-k is a
    TakeOrderedAndProject: each partition keeps its k best, the driver merges them."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        score = V.cosine("v", q)
        items = items.filter(V.is_valid("v"))
    elif metric == "dot":
        score = V.dot("v", q)
    else:
        score = V.l2_sq("v", q)
    s = items.select("item_id", score.alias("score"))
    o = V.rank_score("score")
    return (s.orderBy(o.asc() if metric == "l2" else o.desc(), F.col("item_id")).limit(k))


def rank_items(scores: DataFrame, score_col: str) -> tuple[DataFrame, int]:
    """Dense 1-based rank of items by (score desc, item_id asc), via range partitions."""
    ranked, n = with_positions(scores.select("item_id", score_col),
                               [F.col(score_col).desc(), F.col("item_id")], name="prank")
    return ranked, n


def top_k_unseen(ranked: DataFrame, n_ranked: int, seen: DataFrame, users: DataFrame, k: int,
                 chunk: int = 1024) -> DataFrame:
    """Top k of a global ranked list per user, skipping the user's own items.

    Exact without scanning the whole list per user: if the longest history has s items, only seen items among the
    first k + s places matter, and a user who has c_u of these finds the answer in places 1..k+c_u.  The head of the list
    is broadcast where it is small, so the long list of what was seen is not shuffled by item, and users
    without a seen item in the head have its first k.  A user with a huge history is split into chunks of
    positions that are spread by a repartition before they are expanded, so no task expands one user alone.
    ranked: (item_id, prank, score...), seen: (user_id, item_id), users: (user_id).
    Output: user_id, rank, item_id, score (the ranked list's ``score`` column)."""
    size = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("_s"))
    longest = size.agg(F.max("_s")).first()[0] or 0

    def head(places: int) -> DataFrame:
        rows = ranked.select("item_id", "prank", "score").filter(F.col("prank") <= places)
        return bounded_broadcast(rows, known_rows=min(n_ranked, places))
    met = materialize(seen.select("user_id", "item_id").join(head(k + longest), "item_id").select("user_id", "prank"), "seen-head")
    count = met.groupBy("user_id").agg(F.count(F.lit(1)).alias("_s"))
    most = count.agg(F.max("_s")).first()[0] or 0
    u = (users.select("user_id").distinct().join(count, "user_id", "left")
              .withColumn("_need", F.least(F.lit(k) + F.coalesce(F.col("_s"), F.lit(0)), F.lit(n_ranked))).filter(F.col("_need") > 0))
    first = (u.filter(F.col("_s").isNull()).select("user_id", F.explode(F.sequence(F.lit(1), F.col("_need").cast("int"))).alias("prank"))
              .select("user_id", F.col("prank").cast("long").alias("prank"), F.col("prank").cast("long").alias("rank")))
    # an explicit partition count: adaptive execution would otherwise merge the
    # (small) chunk rows into one partition and expand them all in one task
    n_parts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chunks = (u.filter(F.col("_s").isNotNull()).withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_need") - 1) / chunk))))
               .repartition(n_parts, "user_id", "_c"))
    lo = F.col("_c") * chunk + 1
    hi = F.least((F.col("_c") + 1) * chunk, F.col("_need"))
    cand = chunks.select("user_id", F.explode(F.sequence(lo, hi)).alias("prank")).join(met, ["user_id", "prank"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("prank")
    rest = cand.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return (first.unionByName(rest.select("user_id", F.col("prank").cast("long").alias("prank"), "rank")).join(head(k + most), "prank")
                 .select("user_id", "rank", "item_id", F.col("score").cast("double")))


def popularity_fallback(ranked: DataFrame, exclusions: DataFrame, users: DataFrame, k: int,
                        n_ranked: int) -> DataFrame:
    """The popular list minus each user's exclusions, score 1/rank."""
    out = top_k_unseen(ranked, n_ranked, exclusions, users, k)
    return out.withColumn("score", 1.0 / F.col("rank"))


def mean_vector(rows: DataFrame, key: str, vec: str = "v") -> DataFrame:
    """Per-key mean vector with ``Summarizer.mean``: a JVM aggregate with a
    partial (map-side) step, so a key with a third of all rows is summed in
    every input partition and only the partial sums meet in one task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    agg = (rows.select(key, array_to_vector(vec).alias("_f"))
               .groupBy(key).agg(Summarizer.mean(F.col("_f")).alias("_m")))
    return agg.select(key, vector_to_array("_m").alias(vec))


#: (user, place) rows of one block pair, and the pairs of one product inside it
PAIRS_PER_BLOCK, PAIR_CHUNK = 2_000_000, 32_768
#: vectors of one block: whole blocks of vectors meet whole blocks of pairs
VECTOR_BLOCK = 131_072


#: copies of vectors that are shuffled at once; larger jobs run block by block of users, and each pass is written before the next
PASS_VECTORS = 2_000_000


def _pair_blocks(n_pairs: int, n_left: int, n_right: int, spark) -> tuple[int, int]:
    """Numbers of left and right blocks: bounded vectors and pairs per block, and enough of them for the cores as long as that
    costs few copies of the vectors."""
    n_r = _blocks(n_right, VECTOR_BLOCK)
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 64, 2 * spark.sparkContext.defaultParallelism)
    spread = min(_blocks(tasks, n_r), _blocks(n_left, 64), max(1, PASS_VECTORS // 2 // max(n_right, 1)))
    return max(_blocks(n_left, VECTOR_BLOCK), _blocks(n_pairs, PAIRS_PER_BLOCK * n_r), spread), n_r


def _passes(n_l: int, n_left: int, n_r: int, n_right: int) -> list[tuple[int, int]]:
    """Ranges of left blocks: as many at once as make ``PASS_VECTORS`` copies of vectors at most, or one."""
    step = max(1, int(PASS_VECTORS // max(1, n_right + n_left * n_r / n_l)))
    return [(a, min(a + step, n_l)) for a in range(0, n_l, step)]


def _block_of(c: str, n: int):
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("long")


def _copies(n: int, first: int = 0):
    return F.explode(F.sequence(F.lit(first).cast("long"), F.lit(n - 1).cast("long")))


def _right_side(vecs: DataFrame, part: tuple[int, int], n_r: int) -> DataFrame:
    return vecs.select(F.col("idx").alias("iidx"), F.col("v").alias("iv")).withColumn("ib", _block_of("iidx", n_r)) \
        .withColumn("ub", _copies(part[1], part[0]))


def _written(parts: list[DataFrame], name: str) -> DataFrame:
    """The parts, written one after the other, so that only one part's shuffles exist at a time."""
    out = None
    for p in parts:
        p = materialize(p, name)
        out = p if out is None else out.unionByName(p)
    return out


def _matches(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``wanted``, place in ``keys``) of all equal values, as an inner join; a key may repeat."""
    order = np.argsort(keys, kind="stable")
    lo, hi = np.searchsorted(keys, wanted, "left", order), np.searchsorted(keys, wanted, "right", order)
    n = hi - lo
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.repeat(np.arange(len(wanted)), n), order[at]


def pair_scores(pairs: DataFrame, users: DataFrame, vecs: DataFrame, each=None) -> DataFrame:
    """``pairs`` (user_id, item_id, slot, weight, idx) with ``s`` and ``d``: dot product and distance of the user's vector
    (users: user_id, v) and the place's (vecs: idx, v).  Pairs without one of the two are left out.

    A pair moves as a few numbers; vectors move once per block of the other side, not once per pair.  ``each`` is applied to
    the rows of a pass, which hold all pairs of their users."""
    n_pairs, n_users, n_vecs = pairs.count(), users.count(), vecs.count()
    n_l, n_r = _pair_blocks(n_pairs, n_users, n_vecs, pairs.sparkSession)
    keys = ("user_id", "item_id", "slot", "weight", "idx")
    none = F.lit(None).cast("array<double>")
    left = pairs.select(*keys, none.alias("v"), F.lit(False).alias("is_v"), _block_of("user_id", n_l).alias("ub"), _block_of("idx", n_r).alias("ib")) \
        .unionByName(users.select("user_id", *[F.lit(0).cast(t).alias(c) for c, t in (("item_id", "long"), ("slot", "long"), ("weight", "double"), ("idx", "long"))],
                                  "v", F.lit(True).alias("is_v"), _block_of("user_id", n_l).alias("ub")).withColumn("ib", _copies(n_r)))
    out = "user_id long, item_id long, slot long, weight double, s double, d double"

    def score(q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        is_v = q["is_v"].to_numpy(bool)
        u, p = q[is_v], q[~is_v]
        if u.empty or p.empty or it.empty:
            return pd.DataFrame({c: [] for c in ("user_id", "item_id", "slot", "weight", "s", "d")}).astype(
                {"user_id": "int64", "item_id": "int64", "slot": "int64"})
        U, I = np.vstack(u["v"].to_numpy()), np.vstack(it["iv"].to_numpy())
        row, ui = _matches(u["user_id"].to_numpy(), p["user_id"].to_numpy())
        p = p.iloc[row]
        row, ii = _matches(it["iidx"].to_numpy(), p["idx"].to_numpy())
        p, ui = p.iloc[row], ui[row]
        s, d = np.empty(len(p)), np.empty(len(p))
        for a in range(0, len(p), PAIR_CHUNK):
            x, y = U[ui[a:a + PAIR_CHUNK]], I[ii[a:a + PAIR_CHUNK]]
            s[a:a + PAIR_CHUNK] = np.einsum("ij,ij->i", x, y)
            d[a:a + PAIR_CHUNK] = np.sqrt(((x - y) ** 2).sum(axis=1))
        return pd.DataFrame({"user_id": p["user_id"], "item_id": p["item_id"], "slot": p["slot"], "weight": p["weight"], "s": s, "d": d})
    parts = [left.filter((F.col("ub") >= a) & (F.col("ub") < b)).groupBy("ub", "ib").cogroup(_right_side(vecs, (a, b), n_r).groupBy("ub", "ib"))
             .applyInPandas(score, out) for a, b in _passes(n_l, n_users, n_r, n_vecs)]
    return _written([each(p) for p in parts] if each else parts, "pair-scores")


def mean_vectors_by_block(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """(user_id, v): mean over a user's ``pairs`` (user_id, idx) of the places' vectors (vecs: idx, v).  Vectors are added up per
    user inside a block of places, so what is shuffled is a sum per user and block, not a vector per pair."""
    n_users, n_vecs = pairs.select("user_id").distinct().count(), vecs.count()
    n_l, n_r = _pair_blocks(pairs.count(), n_users, n_vecs, pairs.sparkSession)
    left = pairs.select("user_id", "idx", _block_of("user_id", n_l).alias("ub"), _block_of("idx", n_r).alias("ib"))

    def add(p: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        if p.empty or it.empty:
            return pd.DataFrame({"user_id": [], "v": [], "n": []}).astype({"user_id": "int64", "n": "int64"})
        I = np.vstack(it["iv"].to_numpy())
        row, at = _matches(it["iidx"].to_numpy(), p["idx"].to_numpy())
        ids = p["user_id"].to_numpy()[row]
        order = np.argsort(ids, kind="stable")
        ids, at = ids[order], at[order]
        users, start, n = np.unique(ids, return_index=True, return_counts=True)
        total = np.zeros((len(users), I.shape[1]))
        place = np.repeat(np.arange(len(users)), n)
        for a in range(0, len(ids), PAIR_CHUNK):
            np.add.at(total, place[a:a + PAIR_CHUNK], I[at[a:a + PAIR_CHUNK]])
        return pd.DataFrame({"user_id": users, "v": list(total), "n": n})
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def means(a: int, b: int) -> DataFrame:
        parts = left.filter((F.col("ub") >= a) & (F.col("ub") < b)).groupBy("ub", "ib") \
            .cogroup(_right_side(vecs, (a, b), n_r).groupBy("ub", "ib")).applyInPandas(add, "user_id long, v array<double>, n long")
        sums = parts.groupBy("user_id").agg(Summarizer.sum(array_to_vector("v")).alias("_s"), F.sum("n").alias("_n"))
        return sums.select("user_id", F.transform(vector_to_array("_s"), lambda x: x / F.col("_n")).alias("v"))
    return _written([means(a, b) for a, b in _passes(n_l, n_users, n_r, n_vecs)], "mean-vectors")


def similar_items_detail(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Top-k rows back to item details with ``similarity_score``."""
    return (hits.join(items, "item_id")
                .withColumnRenamed("score", "similarity_score"))
