"""Approximate nearest neighbours by cross-polytope hashing.

1. Classes: rows with equal vectors are one class, which keeps its ``k + 1`` smallest ids (all that
   a top k can show); only classes are indexed, so a vector that a third of all rows share is
   one row of the index.
2. Hashing: a pseudo-rotation is three rounds of random signs and a fast Hadamard transform
   (vectors padded to a power of two).  A rotated vector belongs to the signed axis nearest to it.
   ``TABLES`` tables of ``functions`` rotations each; functions follow from the number of
   classes, so that a bucket holds about ``ROWS_PER_BUCKET`` of them.
3. Probes: a query's buckets over all tables are ranked by its coordinates on their axes, and the
   best ``probes`` are read.  The number of probes is fitted: ``SAMPLE`` queries are searched
   exactly, and the least number that meets ``TARGET`` of their neighbours is taken.  Where no
   number does, tables of one rotation less are taken; with one rotation, all buckets are all rows.
4. Buckets of more than ``PART`` classes are split.  A (bucket, part) is one cogroup: one
   matrix product, then the best ``k + 1`` classes of each query by their score in full precision.

The score is the cosine in double precision, summed in the same order for every pair, so equal
vectors have equal scores; vectors are scaled by powers of two first, which changes no bit of it.

Defined cases: null ids take no part; neither do vectors that are null, empty, zero or hold a null
or non-finite component.  Vectors of different lengths are never compared.  A query never meets its
own id.  Repeated rows count once.  A query id that stands on different vectors is searched with
each of them, and keeps the best of all found.  Queries without any candidate have no row; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsift.session import materialize
from recsift.sources.tables import read_table

NEAREST, EVERY = 5, 50
TABLES, ROUNDS, SEED = 8, 3, 20240611
#: classes that a bucket should hold; axes of each rotation that a query tries where tables have several
ROWS_PER_BUCKET, AXES = 1024, 16
#: classes of a bucket that one task scores
PART = 2048
#: the bounded sample that sets the number of probes, and the share of its neighbours to meet
SAMPLE, TARGET = 128, 0.95
#: distance of a matrix product from the score in full precision, at most
SLACK = 1e-9
FOUND = "query_key binary, vec_id long, score double"


# ---- vectors and hashes ------------------------------------------------------------

def usable(v: Column) -> Column:
    """Whether all components are finite and one is not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


@F.pandas_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("x", T.BinaryType())]))
def packed(vectors: pd.Series) -> pd.DataFrame:
    """The components as bytes, and their digest; both zeros are one."""
    out = [(np.asarray(v) + 0.0).tobytes() for v in vectors]
    return pd.DataFrame({"key": [hashlib.blake2b(x, digest_size=16).digest() for x in out], "x": out})


def matrix(values: pd.Series, dtype: str) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two to components of at most 1."""
    a = np.frombuffer(b"".join(values), dtype).astype(np.float64).reshape(len(values), -1)
    return np.ldexp(a, -np.frexp(np.abs(a).max(axis=1))[1][:, None])


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt((a * a).sum(axis=1))[:, None]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Each row times the normalised Hadamard matrix, by butterflies."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Hashes:
    """The tables for vectors of length ``dim``."""

    def __init__(self, dim: int, functions: int):
        self.dim, self.functions, self.axes = dim, functions, 1 << max(dim - 1, 0).bit_length()
        self.codes = 2 * self.axes  # signed axes: 2 i is axis i, 2 i + 1 its opposite
        self.signs = np.random.default_rng([SEED, dim]).choice((-1.0, 1.0), (TABLES, functions, ROUNDS, self.axes))

    def coordinates(self, x: np.ndarray, table: int, function: int) -> np.ndarray:
        """Coordinates on all signed axes after one rotation."""
        r = np.zeros((len(x), self.axes))
        r[:, :self.dim] = x
        for signs in self.signs[table, function]:
            r = hadamard(r * signs)
        return np.stack((r, -r), axis=2).reshape(len(x), self.codes)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, TABLES): the bucket of each row in each table."""
        out = np.empty((len(x), TABLES), np.int64)
        for t in range(TABLES):
            at = np.full(len(x), t, np.int64)
            for f in range(self.functions):
                at = at * self.codes + self.coordinates(x, t, f).argmax(axis=1)
            out[:, t] = at
        return out

    def probes(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """(rows, probes): buckets of all tables, the best first."""
        gains, buckets = [], []
        for t in range(TABLES):
            gain, at = np.zeros((len(x), 1)), np.full((len(x), 1), t, np.int64)
            for f in range(self.functions):
                c = self.coordinates(x, t, f)
                code = np.argsort(-c, axis=1, kind="stable")[:, :self.codes if self.functions == 1 else AXES]
                gain = (gain[:, :, None] + np.take_along_axis(c, code, 1)[:, None, :]).reshape(len(x), -1)
                at = (at[:, :, None] * self.codes + code[:, None, :]).reshape(len(x), -1)
            gains.append(gain), buckets.append(at)
        order = np.argsort(-np.hstack(gains), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(np.hstack(buckets), order, 1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in one fixed order of summation."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_pairs(q: np.ndarray, c: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): each query's ``k`` best candidates, equal scores by ``first``."""
    rough = unit(q) @ unit(c).T
    if len(c) > k:
        floor = np.partition(rough, len(c) - k, axis=1)[:, len(c) - k]
        qi, ci = np.nonzero(rough >= floor[:, None] - SLACK)
    else:
        qi, ci = np.divmod(np.arange(rough.size), len(c))
    score = cosines(q[qi], c[ci])
    order = np.lexsort((first[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[place < k], ci[place < k], score[place < k]


# ---- index and search --------------------------------------------------------------

def _classes(rows: DataFrame, k: int) -> DataFrame:
    """key, dim, x, ids (the k + 1 smallest, ascending), first (the smallest)."""
    w = Window.partitionBy("dim", "key").orderBy("vec_id")
    few = rows.dropDuplicates(["dim", "key", "vec_id"]).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1)
    return few.groupBy("dim", "key").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("vec_id")).alias("ids")) \
        .withColumn("first", F.element_at("ids", 1))


def _fitted_probes(classes: DataFrame, sample: pd.DataFrame, hashes: Hashes, dtype: str, k: int) -> int | None:
    """Least number of probes that meets TARGET of the sample's nearest classes; None if none does."""
    q, keys = matrix(sample["x"], dtype), np.array(sample["key"].map(bytes), object)

    def scan(batches):
        top = None  # the best of all batches of this task
        for pdf in batches:
            if len(pdf):
                qi, ci, score = best_pairs(q, matrix(pdf["x"], dtype), pdf["first"].to_numpy(), k + 1)
                part = pd.DataFrame({"q": qi, "key": pdf["key"].to_numpy()[ci], "x": pdf["x"].to_numpy()[ci], "score": score})
                part = part[np.array([keys[i] != bytes(b) for i, b in zip(part["q"], part["key"], strict=True)], bool)]
                top = part if top is None else pd.concat([top, part])
                top = top.sort_values(["q", "score"], ascending=[True, False], kind="stable").groupby("q").head(k)
        if top is not None:
            yield top[["q", "x", "score"]]

    near = classes.select("key", "x", "first").mapInPandas(scan, "q long, x binary, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"))
    near = near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).select("q", "x").toPandas()  # SAMPLE * k rows
    if near.empty:
        return 1
    order = hashes.probes(q)
    at = hashes.buckets(matrix(near["x"], dtype))
    places = []
    for i, mine in zip(near["q"], at, strict=True):
        hit = np.flatnonzero(np.isin(order[i], mine))
        places.append(hit[0] + 1 if len(hit) else np.inf)
    need = np.sort(places)[int(np.ceil(TARGET * len(places))) - 1]
    return int(need) if np.isfinite(need) else None


def _search(rows: DataFrame, classes: DataFrame, dim: int, n: int, dtype: str, k: int) -> DataFrame:
    """query_key, vec_id, score: the nearest k + 1 ids found for each query class of length ``dim``."""
    rows, classes = rows.filter(F.col("dim") == dim), classes.filter(F.col("dim") == dim)
    asked = rows.filter("asks").groupBy("key").agg(F.first("x").alias("x"))
    sample = asked.orderBy("key").limit(SAMPLE).toPandas()  # SAMPLE rows
    if sample.empty:
        return rows.sparkSession.createDataFrame([], FOUND)
    functions = max(1, round(np.log(max(n / ROWS_PER_BUCKET, 1)) / np.log(Hashes(dim, 1).codes)))
    for f in range(functions, 0, -1):
        hashes = Hashes(dim, f)
        probes = _fitted_probes(classes, sample, hashes, dtype, k)
        if probes:
            break

    @F.pandas_udf("array<long>")
    def buckets(x: pd.Series) -> pd.Series:
        return pd.Series(list(hashes.buckets(matrix(x, dtype))))

    @F.pandas_udf("array<long>")
    def probed(x: pd.Series) -> pd.Series:
        return pd.Series(list(hashes.probes(matrix(x, dtype), probes)))

    # written before the joins: adaptive execution splits a hot bucket only between plain shuffles
    index = materialize(classes.select("key", "x", "ids", "first", F.explode(buckets("x")).alias("bucket")), "polytope-index")
    parts = materialize(index.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "polytope-parts")
    stored = index.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).drop("parts")
    asks = asked.select(F.col("key").alias("query_key"), F.col("x").alias("q"), F.explode(probed("x")).alias("bucket")).join(parts, "bucket") \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def scored(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_key": pd.Series([], dtype=object), "vec_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        qi, ci, score = best_pairs(matrix(q["q"], dtype), matrix(c["x"], dtype), c["first"].to_numpy(), k + 1)
        ids = c["ids"].to_numpy()[ci]
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        return pd.DataFrame({"query_key": q["query_key"].to_numpy()[np.repeat(qi, n_ids)], "vec_id": np.concatenate(ids),
                             "score": np.repeat(score, n_ids)})

    found = asks.groupBy("bucket", "part").cogroup(stored.groupBy("bucket", "part")).applyInPandas(scored, FOUND)
    once = found.groupBy("query_key", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1).drop("_n")


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each row of ``vectors`` (vec_id, embedding) for
    which ``is_query`` holds."""
    kind = vectors.schema["embedding"].dataType
    if not isinstance(kind.elementType, T.FloatType):
        kind = T.ArrayType(T.DoubleType())
    dtype = "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"), is_query.alias("asks")) \
        .filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = materialize(rows.select("vec_id", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("v").alias("dim"),
                                   packed("v").alias("p")).select("vec_id", "asks", "dim", "p.*"), "polytope-rows")
    classes = materialize(_classes(rows, k), "polytope-classes")
    found = rows.sparkSession.createDataFrame([], "dim int, " + FOUND)
    for r in classes.groupBy("dim").count().orderBy("dim").collect():  # one row per length of vectors
        found = found.union(_search(rows, classes, r["dim"], r["count"], dtype, k).select(F.lit(r["dim"]).alias("dim"), "*"))
    found = materialize(found, "polytope-found")
    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "dim", F.col("key").alias("query_key")).distinct()
    others = asked.join(found, ["dim", "query_key"]).filter("vec_id <> query_id") \
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_vectors(spark, sf_dir):
    """The five nearest other vectors of every row whose vec_id is divisible by 50."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op11_nearest_vectors": op11_nearest_vectors}
