"""Connected components of a link table: local forests, then alternating star contraction.

Tasks of at most ``LINKS_PER_TASK`` links first reduce their links to a forest (each vertex
below the smallest vertex that the task knows to be connected to it).  A table that fits
one such task is done.  Larger ones are contracted in rounds; each round is two aggregates and two joins on the link table; a vertex with very many
links is combined in each input task, so no list of neighbours is ever gathered.  The
links of a round are written to the shared folder, which also cuts lineage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsift.session import materialize

MAX_ROUNDS = 60
#: links (two 64-bit ids each) that one task reduces by itself
LINKS_PER_TASK = 1_000_000


def _forest(batches):
    """Union-find over the links of one task; emits (vertex, smallest vertex of its tree)."""
    above: dict[int, int] = {}

    def root(x):
        top = x
        while above.get(top, top) != top:
            top = above[top]
        while x != top:
            above[x], x = top, above.get(x, x)
        return top

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    below = [x for x in above if root(x) != x]
    yield pd.DataFrame({"u": np.array(below, np.int64), "v": np.array([root(x) for x in below], np.int64)})


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written before the join: adaptive execution splits a hot vertex only between plain shuffles
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "links-least")
    near = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``u, root`` for every vertex that ``links`` (u, v: long) hangs below a smaller root;
    roots themselves have no row.  Self-links and repeated links are ignored."""
    e = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "links")
    tasks = max(1, -(-e.count() // LINKS_PER_TASK))
    e = materialize(e.repartition(tasks).mapInPandas(_forest, "u long, v long"), "links")
    if tasks == 1:
        return e.select("u", F.col("v").alias("root"))
    e = e.distinct()
    state = None
    for _ in range(MAX_ROUNDS):
        e = materialize(_small_star(_large_star(e)), "links")
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == state:
            return e.select("u", F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
