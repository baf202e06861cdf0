"""Vector column expressions built from Spark's higher-order array functions.

All arithmetic is in double and stays on the JVM (no Python); Spark evaluates higher-order
functions outside generated code, so searches score blocks in Arrow batches instead.
Zero vectors are never divided by: normalisation of a zero vector yields null and
:func:`is_valid` marks it invalid (they are left out of every index).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are rounded to this many places before ranking so that the summation
# order of a dot product cannot change a rank (ties then break on item_id).
RANK_DIGITS = 9


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def is_valid(a) -> Column:
    """True when any element is non-zero (a failed embedding is all zeros)."""
    return F.coalesce(F.exists(_c(a), lambda x: x != 0), F.lit(False))


def l2_normalize(a) -> Column:
    """v / ||v||; null for a zero or null vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x / n))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_sq(a, b) -> Column:
    """Squared Euclidean distance (what an L2 index reports; smaller is closer)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def l2_dist(a, b) -> Column:
    return F.sqrt(l2_sq(a, b))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def rank_score(score) -> Column:
    return F.round(_c(score), RANK_DIGITS)
