"""Quality scores by a regularised quadratic discriminant.

Each text is described by document statistics, computed in one pass on
the JVM and transformed to be nearly normal: logarithms of counts, logits of shares.

Per class the fit keeps the number of labelled rows, the sums and the sums of products
of the statistics; Spark adds them up over all labelled rows, so the driver sees one row
per class, whatever the table's size.  The class covariance is shrunk towards its own
diagonal and the pooled covariance, and factored once (Cholesky).  A score is the
difference of the two log densities, from the Mahalanobis distances by a triangular
solve with the cached factors; its slope and offset are fitted on the same rows' score
moments, and a logistic turns it into a probability.

Rows with crc32(doc_id as text) mod 3 = 1 are held out: they are never learned from.
Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have the statistics of an empty text and are scored
like any other; repeated rows are scored each on their own, and a label counts once for
every row of its id; a null doc_id has no label and is not held out; several labels of
one id: the largest counts; extra columns are ignored by ``score`` and pass through
``keep_good``; without rows of both labels every text scores 0.5; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsift.llm.textcols import let
from recsift.session import materialize
from recsift.sources.tables import read_table

#: weights of the diagonal and of the pooled covariance, and the least variance
TO_DIAGONAL, TO_POOLED, FLOOR = 0.1, 0.1, 1e-3
FOLDS, HELD_OUT = 3, 1


def _share(part: Column, whole: Column) -> Column:
    """Logit of a share, with half a case added to both sides."""
    return F.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: Column) -> Column:
    """Transformed statistics of a text, as array<double>."""
    t = F.coalesce(text, F.lit(""))
    gone = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))

    def of(c):
        n, w, lines = c["chars"].cast("double"), F.size(c["words"]).cast("double"), F.size(c["lines"]).cast("double")
        per = lambda k: _share(c[k].cast("double"), n)
        return F.array(
            F.log1p(n), F.log1p(w), F.log1p(n) - F.log1p(w),
            _share(w - F.size(F.array_distinct(c["words"])), w),
            _share(lines - F.size(F.array_distinct(c["lines"])), lines), F.log1p(w) - F.log1p(lines),
            _share(F.size(F.filter(c["words"], lambda x: F.length(x) <= 3)).cast("double"), w),
            _share(F.size(F.filter(c["words"], lambda x: F.length(x) >= 12)).cast("double"), w),
            per("upper"), per("digits"), per("symbols"), per("stops"), per("commas"), per("spaces"), per("marked"))

    return let(F.struct(
        F.length(t).alias("chars"), F.array_remove(F.split(F.lower(t), r"\s+"), "").alias("words"),
        F.array_remove(F.split(t, "\n"), "").alias("lines"),
        gone("[A-Z]+").alias("upper"), gone("[0-9]+").alias("digits"),
        gone(r"[^\s\p{L}\p{N}.,;:'\"!?()-]+").alias("symbols"), gone(r"[.!?]+").alias("stops"),
        gone(r"[,;:]+").alias("commas"), gone(r"\s+").alias("spaces"), gone(r"[!#$%&*|]{2,}").alias("marked")), of)


N_STATISTICS = 15


@dataclass
class Discriminant:
    """Means, Cholesky factors and log-determinants per class; slope and offset of the score."""
    means: np.ndarray
    factors: np.ndarray
    offset: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        out = []
        for c in (0, 1):
            z = np.linalg.solve(self.factors[c], (x - self.means[c]).T)
            out.append(self.offset[c] - 0.5 * (z * z).sum(axis=0))
        return out[1] - out[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -500, 500)))


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sums and sums of products."""
    d = N_STATISTICS
    cols = [F.count(F.lit(1)).alias("n")] + [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    cols += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for r in rows.groupBy("quality").agg(*cols).collect():
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r["quality"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), p)
    return out


def shrunk(cov: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    mixed = (1 - TO_POOLED) * cov + TO_POOLED * pooled
    return (1 - TO_DIAGONAL) * mixed + TO_DIAGONAL * np.diag(np.diag(mixed)) + FLOOR * np.eye(len(cov))


def fit(rows: DataFrame) -> Discriminant | None:
    """Fit on ``quality`` (0/1) and ``x`` (array of statistics); None without both classes."""
    m = _moments(rows.filter("quality IN (0, 1)"))
    if set(m) != {0, 1}:
        return None
    total = m[0][0] + m[1][0]
    means = np.stack([m[c][1] / m[c][0] for c in (0, 1)])
    covs = np.stack([m[c][2] / m[c][0] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (m[0][0] * covs[0] + m[1][0] * covs[1]) / total
    factors = np.stack([np.linalg.cholesky(shrunk(covs[c], pooled)) for c in (0, 1)])
    offset = np.array([np.log(m[c][0] / total) - np.log(np.diag(factors[c])).sum() for c in (0, 1)])
    model = Discriminant(means, factors, offset)
    return _calibrated(model, rows.filter("quality IN (0, 1)"))


def _calibrated(model: Discriminant, rows: DataFrame) -> Discriminant:
    """Slope and shift of a logistic through the differences, by Newton steps over binned counts."""
    bins = rows.select("quality", F.round(difference_column(model)(F.col("x")), 1).alias("d")) \
        .select("quality", F.greatest(F.least("d", F.lit(60.0)), F.lit(-60.0)).alias("d")) \
        .groupBy("quality", "d").count().collect()
    d, y, n = (np.array([b[k] for b in bins], float) for k in ("d", "quality", "count"))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        g = np.array([(n * (y - p) * d).sum() - 1e-3 * (a - 1), (n * (y - p)).sum() - 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a + step[0], 1e-3), b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def difference_column(model: Discriminant):
    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(model.difference(np.stack(x.to_numpy())) if len(x) else np.empty(0))
    return of


def probability_column(model: Discriminant | None):
    if model is None:
        return lambda x: F.lit(0.5)

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(x.to_numpy())) if len(x) else np.empty(0))
    return of


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant | None]:
    """(doc_id, x, held_out of every row, the model fitted on the labelled rows that are not held out)."""
    rows = materialize(docs.select(F.col("doc_id").cast("long"), statistics(F.col("text")).alias("x"))
                       .withColumn("held_out", held_out(F.col("doc_id"))), "quality-statistics")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.max("quality").cast("int").alias("quality"))
    return rows, fit(rows.filter("NOT held_out").join(known, "doc_id").select("quality", "x"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows, model = learn(docs, labels)
    scored = rows.select("doc_id", "held_out", probability_column(model)(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as good, with all their columns."""
    _, model = learn(docs, labels)
    return docs.withColumn("_score", probability_column(model)(statistics(F.col("text")))).filter("_score >= 0.5").drop("_score")


def op4_quality_scores(spark, sf_dir):
    """Quality score of every document."""
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_scores": op4_quality_scores}
