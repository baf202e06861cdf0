"""Learned text vectors: truncated SVD of a TF-IDF matrix by subspace iteration.

The matrix is a table of postings (id, term, w), as ``tfidf`` makes them.  A product with a thin
matrix is a join and a sum of vectors: rows meet the terms' vectors, terms the rows' vectors.
Neither side is ever whole in one place; what reaches the driver is the Gram matrix of the thin
side (``k + OVERSAMPLE`` squared), from which its columns are made orthonormal.  Frequent terms
add up map-side; terms' vectors are broadcast only where their bytes are below the limit of
``bounded_broadcast``, else the join is a shuffle that adaptive execution splits.

Defined cases: null and empty texts have no postings and get zero vectors; a matrix of lower rank
than ``k`` gives zeros in the columns beyond its rank; an empty table gives no vectors.  The signs of
vectors are those of the seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.operators.ordering import bounded_broadcast
from recsift.session import materialize

#: columns carried beyond the k asked for
OVERSAMPLE = 8
#: eigenvalues of a Gram matrix below this share of the largest count as zero
RANK_SHARE = 1e-10
TOKENS = r"[^\p{L}\p{N}]+"


@dataclass
class TextModel:
    """idf: (term, idf); terms: (term, v), the right singular vectors; singular: the values, largest first."""

    idf: DataFrame
    terms: DataFrame
    singular: list[float]


def counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) of lower-cased words."""
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), TOKENS), lambda t: t != "")
    return df.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term") \
        .agg(F.count(F.lit(1)).alias("tf"))


def idf_table(tf: DataFrame, n_rows: int) -> DataFrame:
    """(term, idf = ln((n + 1) / (df + 1)) + 1)."""
    return tf.groupBy("term").agg((F.log((F.lit(n_rows) + 1.0) / (F.count(F.lit(1)) + 1.0)) + 1.0).alias("idf"))


def weigh(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """Postings (id, term, w) whose rows have length one; terms without idf take no part."""
    w = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("_n")).alias("w"))


def product(postings: DataFrame, side: DataFrame, on: str, key: str) -> DataFrame:
    """(key, v): per key the sum of w times the vector of the posting's ``on``."""
    scaled = postings.join(bounded_broadcast(side), on).select(
        key, array_to_vector(F.transform("v", lambda x: x * F.col("w"))).alias("_x"))
    return scaled.groupBy(key).agg(Summarizer.sum(F.col("_x")).alias("_s")).select(key, vector_to_array("_s").alias("v"))


def gram(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of v v' over all rows, added per task and then over tasks (``size`` squared numbers)."""
    def partial(frames):
        total = np.zeros((size, size))
        for f in frames:
            if len(f):
                x = np.array(f["v"].tolist())
                total += x.T @ x
        yield pd.DataFrame({"g": [total.ravel().tolist()]})
    parts = rows.select("v").mapInPandas(partial, "g array<double>").select(F.posexplode("g").alias("at", "x"))
    cells = parts.groupBy("at").agg(F.sum("x").alias("x")).collect()  # size squared numbers
    out = np.zeros(size * size)
    for c in cells:
        out[c["at"]] = c["x"]
    return out.reshape(size, size)


def _times(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """(key, v): each row's vector times a small matrix."""
    @F.pandas_udf("array<double>")
    def multiply(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(v.tolist()) @ matrix)) if len(v) else pd.Series([], dtype=object)
    return rows.select(key, multiply("v").alias("v"))


def _eigen(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first (those of no weight as zero), and vectors."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    return np.where(values > RANK_SHARE * max(values[0], 0.0), values, 0.0), vectors


def _inverse(x: np.ndarray) -> np.ndarray:
    return np.divide(1.0, x, out=np.zeros_like(x), where=x > 0)


def fit(df: DataFrame, id_col: str, text_col: str, k: int, rounds: int = 4, seed: int = 7) -> TextModel:
    """The ``k`` largest singular values of the rows' TF-IDF matrix and their term vectors."""
    tf = materialize(counts(df, id_col, text_col), "svd-counts")
    idf = materialize(idf_table(tf, df.count()), "svd-idf")
    postings = materialize(weigh(tf, idf), "svd-postings")
    size = k + OVERSAMPLE
    # hashed normal deviates: the same for a term whatever the partitions are
    even = lambda j, s: (F.pmod(F.xxhash64("term", j, F.lit(s)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    deviate = lambda j: F.sqrt(-2.0 * F.log(even(j, seed))) * F.cos(2.0 * np.pi * even(j, seed + 1))
    terms = idf.select("term", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), deviate).alias("v"))
    for step in range(rounds):
        y = materialize(product(postings, terms, "term", "id"), "svd-rows")
        values, vectors = _eigen(gram(y, size))
        q = _times(y, "id", vectors * _inverse(np.sqrt(values)))
        terms = materialize(product(postings, q, "id", "term"), "svd-terms")
    values, vectors = _eigen(gram(terms, size))
    singular = np.sqrt(values)
    right = materialize(_times(terms, "term", (vectors * _inverse(singular))[:, :k]), "svd-right")
    return TextModel(idf, right, [float(x) for x in singular[:k]])


def encode(model: TextModel, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, v): every row's text as a unit vector of the model's dimension; texts without known words are zero."""
    k = len(model.singular)
    found = product(weigh(counts(df, id_col, text_col), model.idf), model.terms, "term", "id")
    zero = F.array_repeat(F.lit(0.0), k)
    out = df.select(F.col(id_col)).join(found.select(F.col("id").alias(id_col), "v"), id_col, "left")
    return out.select(id_col, F.when(V.is_valid("v"), V.l2_normalize("v")).otherwise(zero).alias("v"))


def tfidf_search(df: DataFrame, id_col: str, text_col: str, query_text: str, k: int) -> DataFrame:
    """R12 without learning: the ``k`` rows of largest TF-IDF cosine with a text, (id, score), ties to the smaller
    id; rows that share no word are not returned."""
    spark = df.sparkSession
    tf = materialize(counts(df, id_col, text_col), "search-counts")
    idf = idf_table(tf, df.count())
    asked = counts(spark.createDataFrame([(0, query_text)], "id long, text string"), "id", "text")
    q = weigh(asked, idf).select("term", F.col("w").alias("_q"))
    hits = weigh(tf, idf).join(q, "term").groupBy("id").agg(F.sum(F.col("w") * F.col("_q")).alias("score"))
    return hits.select(F.col("id").alias(id_col), "score").orderBy(F.round("score", 9).desc(), id_col).limit(k)
