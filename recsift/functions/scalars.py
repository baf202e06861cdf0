"""Scalar column functions: image URL parsing, event weights, cache keys, recency."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's configuration).
EVENT_WEIGHTS = {"save": 1.0, "cart": 3.0, "order": 5.0}
# All http(s) runs up to a space, a quote or a closing bracket.
URL_PATTERN = r"""https?://[^\s"'\]]+"""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_urls(c) -> Column:
    """Bracketed URL string -> array<string>; null or empty gives []."""
    return F.coalesce(F.regexp_extract_all(_c(c), F.lit(URL_PATTERN), 0),
                      F.array().cast("array<string>"))


def first_url(c) -> Column:
    """First element or null (never raises on an empty list)."""
    return F.try_element_at(_c(c), F.lit(1))


def event_weight(c, weights: dict[str, float] | None = None) -> Column:
    """Map an event type to its weight; unknown types give null."""
    w = weights or EVENT_WEIGHTS
    out = None
    for name, val in w.items():
        out = (F.when(_c(c) == name, F.lit(float(val))) if out is None
               else out.when(_c(c) == name, F.lit(float(val))))
    return out


def recency_score(days_since, half_life_days: float = 30.0) -> Column:
    """exp(-ln 2 * days / half_life): 1 for today, 0.5 after one half-life."""
    return F.exp(F.lit(-math.log(2.0) / half_life_days) * _c(days_since))


def query_key(user_id, page, filters_json=None) -> Column:
    """md5 of 'user:page[:sorted-json filters]' (a deterministic cache key)."""
    parts = [_c(user_id).cast("string"), _c(page).cast("string")]
    base = F.concat_ws(":", *parts)
    if filters_json is None:
        return F.md5(base)
    fj = _c(filters_json)
    return F.md5(F.when(fj.isNull(), base).otherwise(F.concat_ws(":", base, fj)))
