"""Hard-negative mining with rotated one-bit codes and exact intervals.

Every row becomes integers (floor of ``SCALE`` times each component); scores are integer inner
products.  An anchor's positives are its best rows of the same label; its negatives are, per
positive, the best rows of other labels whose scores lie in a window below the positive's.

1. Codes: ``ROTATIONS`` pseudo-rotations of a vector a (random signs and Hadamard butterflies, an
   isometry on vectors padded to a power of two) give one sign each coordinate.  The signs,
   turned back, are a code vector; with y its direction, the row stores its alignment <y, a> and
   the residual sqrt(|a|^2 - <y, a>^2).
2. Estimates: an anchor's rotated coordinates are rounded to levels of ``PLANES`` bits.  <signs, anchor>
   is a sum of levels where the sign is up, one product of small matrices for a block; the l1 norm of
   the rounding bounds its error.
3. Intervals: <a, q> = <y, a> <y, q> + rest, and by Cauchy-Schwarz |rest| is at most the row's
   residual times sqrt(|q|^2 - <y, q>^2).  That holds always, not only with high probability.
4. Filter: the most promising rows by estimate are scored exactly; the k-th best of them is a
   floor.  Rows whose interval cannot reach the floor (or lies outside the window) leave;
   all others are scored with integers.  So the result is exact; the codes only save work.

Anchors and rows are hashed into blocks; each (anchor block, row block) is one cogroup, which returns
at most ``k`` rows for an anchor (or an anchor's positive).  A group of equal vectors is spread
over the row blocks.  Scores of integers below 2^53 in all sums are exact in double precision;
larger ones use 64-bit integers, which wrap as SQL's would overflow.

Defined cases: rows with a null id or label, or a vector that is null or holds a null or non-finite
component, take no part; empty vectors score 0.  Vectors of different lengths are never compared.
Rows repeated with equal label and vector count once; one id on different vectors or labels
is several rows, none of which is a partner of an anchor with that id.  Anchors without a positive,
or positives without a negative, have no row.  Extra columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsift.session import materialize
from recsift.sources.tables import read_table

SCALE, LABELS, MOVED, EVERY = 256, 10, 7, 50
POSITIVES, NEGATIVES = 5, 3
#: the window of a negative's score, in hundredths of the positive's
LOW, HIGH = 50, 95
ROTATIONS, ROUNDS, PLANES, SEED = 8, 3, 6, 20240612
#: anchors and rows of one task; anchors whose estimates are in memory at a time
ANCHOR_BLOCK, ROW_BLOCK, ANCHORS = 2048, 4096, 64
#: rows scored first, to set the floor
TRIED = 32
EXACT = 2.0 ** 53
CODE = T.StructType([T.StructField("bits", T.BinaryType()), T.StructField("size", T.DoubleType()),
                     T.StructField("along", T.DoubleType()), T.StructField("rest", T.DoubleType())])


# ---- codes -------------------------------------------------------------------------

def integers(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i8").reshape(len(values), -1) if len(values) else np.empty((0, 0), np.int64)


def butterflies(x: np.ndarray) -> np.ndarray:
    """Each row times the normalised Hadamard matrix."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, -1, 2, step)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def _signs(dim: int) -> np.ndarray:
    width = 1 << max(dim - 1, 0).bit_length()
    return np.random.default_rng([SEED, dim]).choice((-1.0, 1.0), (ROTATIONS, ROUNDS, max(width, 8)))


def rotated(a: np.ndarray) -> np.ndarray:
    """(rows, ROTATIONS * width): the coordinates after each rotation."""
    signs = _signs(a.shape[1])
    padded = np.zeros((len(a), signs.shape[2]))
    padded[:, :a.shape[1]] = a
    out = []
    for rounds in signs:
        r = padded
        for s in rounds:
            r = butterflies(r * s)
        out.append(r)
    return np.hstack(out)


def turned_back(b: np.ndarray, dim: int) -> np.ndarray:
    """The sum over rotations of the inverse rotation of each part of ``b``."""
    signs = _signs(dim)
    total = 0.0
    for part, rounds in zip(np.split(b, ROTATIONS, axis=1), signs, strict=True):
        for s in rounds[::-1]:
            part = butterflies(part) * s
        total = total + part
    return total


def codes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits, length of the code vector, alignment and residual of each row."""
    r = rotated(a)
    up = r >= 0
    size = np.sqrt((turned_back(np.where(up, 1.0, -1.0), a.shape[1]) ** 2).sum(axis=1))
    size = np.where(size > 0, size, 1.0)
    along = np.abs(r).sum(axis=1) / size  # <code vector, a> is the l1 norm of the coordinates
    rest = np.sqrt(np.maximum((a.astype(np.float64) ** 2).sum(axis=1) - along ** 2, 0.0))
    return np.packbits(up, axis=1), size, along, rest


@F.pandas_udf(CODE)
def coded(vectors: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(index=range(len(vectors)), columns=["bits", "size", "along", "rest"])
    lengths = vectors.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        bits, size, along, rest = codes(integers(vectors.iloc[at]))
        out.iloc[at, 0] = pd.Series([b.tobytes() for b in bits], dtype=object).to_numpy()
        out.iloc[at, 1], out.iloc[at, 2], out.iloc[at, 3] = size, along, rest
    return out.astype({"size": float, "along": float, "rest": float})


@F.pandas_udf(T.BinaryType())
def scaled(vectors: pd.Series) -> pd.Series:
    """floor(SCALE * x) of each component, x in double precision, as 64-bit integers; empty vectors as one zero."""
    def one(v):
        f = np.floor(np.asarray(v, np.float64) * SCALE) if len(v) else np.zeros(1)
        return np.clip(f, -2.0 ** 62, 2.0 ** 62).astype("<i8").tobytes()
    return vectors.map(one)


class Rows:
    """The rows of one block with their codes."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids, self.labels = pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
        self.a = integers(pdf["a"])
        bits = np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(pdf), -1)
        # sums of levels stay below 2^24 for vectors of up to 2^15 dimensions
        self.up = np.unpackbits(bits, axis=1).astype(np.float32 if bits.shape[1] * 8 << PLANES <= 1 << 24 else np.float64)
        self.ups = self.up.sum(axis=1, dtype=np.float64)
        self.size, self.along, self.rest = (pdf[c].to_numpy() for c in ("size", "along", "rest"))
        self.norm = np.sqrt(self.along ** 2 + self.rest ** 2)
        self.real, self.largest = self.a.astype(np.float64), float(np.abs(self.a).max(initial=0))

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(q).max(initial=0)) * self.a.shape[1] < EXACT:
            return (self.real[at] @ q.astype(np.float64)).astype(np.int64)
        return (self.a[at] * q).sum(axis=1)

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(estimate, low, high) of the scores of all rows with each anchor."""
        r = rotated(q)
        step = np.maximum(np.abs(r).max(axis=1), 1.0)[:, None] * 2 / ((1 << PLANES) - 1)
        least = -step * ((1 << PLANES) - 1) / 2
        level = np.clip(np.rint((r - least) / step), 0, (1 << PLANES) - 1).astype(np.uint8)
        slip = np.abs(r - (least + step * level)).sum(axis=1)[:, None]
        ones = (level.astype(self.up.dtype) @ self.up.T).astype(np.float64)  # sum of the levels where the row's sign is up
        ups = self.ups[None, :]
        # <signs, levels * step + least>: what is up counts twice, less the whole
        dot = step * (2 * ones - level.sum(axis=1, dtype=np.float64)[:, None]) + least * (2 * ups - r.shape[1])
        low, high = (dot - slip) / self.size, (dot + slip) / self.size  # of <y, q>
        smallest = np.where((low <= 0) & (high >= 0), 0.0, np.minimum(np.abs(low), np.abs(high)))
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))[:, None]
        away = self.rest * np.sqrt(np.maximum(length ** 2 - smallest ** 2, 0.0))
        away = away + 0.5 + 1e-6 * length * self.norm  # rounding of the sums above
        return dot / self.size * self.along, low * self.along - away, high * self.along + away


def best(rows: Rows, q: np.ndarray, estimate, low, high, able: np.ndarray, floor, ceiling, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the ``k`` best of the rows ``able`` with floor <= score <= ceiling; None: no limit.
    ``estimate``, ``low`` and ``high`` are those of the rows ``able``."""
    if ceiling is not None:
        near = np.flatnonzero((low <= ceiling) & (high >= floor))
        able, estimate, high = able[near], estimate[near], high[near]
    if len(able) > TRIED:
        guess = estimate if ceiling is None else np.where(estimate <= ceiling, estimate, -np.inf)
        known = rows.scores(q, able[np.argpartition(-guess, TRIED)[:TRIED]])
        known = np.sort(known if ceiling is None else known[(known >= floor) & (known <= ceiling)])[::-1]
        if len(known) >= k:
            able = able[high >= known[k - 1]]
    score = rows.scores(q, able)
    if ceiling is not None:
        fits = (score >= floor) & (score <= ceiling)
        able, score = able[fits], score[fits]
    order = np.lexsort((rows.ids[able], -score))[:k]
    return able[order], score[order]


# ---- blocks ------------------------------------------------------------------------

def prepared(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """vec_id, label, anchor, dim, a (integers as bytes) and the code of each row that takes part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine) \
        .select(F.col("vec_id").cast("long"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.size(v).alias("dim"),
                F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label).alias("label"), scaled(v).alias("a"))
    rows = rows.dropDuplicates(["vec_id", "label", "a"])
    return rows.select("*", coded("a").alias("c")).select("vec_id", "label", "anchor", "dim", "a", "c.*")


def _blocked(anchors: DataFrame, rows: DataFrame, n_rows: int, n_anchors: int, fn, schema: str) -> DataFrame:
    """``fn`` over every pair of an anchor block and a row block."""
    a_blocks, r_blocks = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = anchors.withColumn("ab", F.pmod(F.xxhash64("anchor_id"), F.lit(a_blocks))).withColumn("rb", every(r_blocks))
    # fresh column names: both sides come from one table, and a cogroup tells columns by their origin
    own = [F.col(c).alias(c) for c in ("vec_id", "label", "a", "bits", "size", "along", "rest")]
    r = rows.select(*own, F.col("dim").alias("row_dim"), F.pmod(F.xxhash64("vec_id", "a"), F.lit(r_blocks)).alias("row_rb"),
                    every(a_blocks).alias("row_ab"))
    return q.groupBy("dim", "ab", "rb").cogroup(r.groupBy("row_dim", "row_ab", "row_rb")).applyInPandas(fn, schema)


def _positives(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(q) and len(r):
        rows = Rows(r)
        for i in range(0, len(q), ANCHORS):
            part = q.iloc[i:i + ANCHORS]
            a = integers(part["q"])
            bounds = rows.intervals(a)
            for j, (anchor, label, key) in enumerate(zip(part["anchor_id"], part["anchor_label"], part["anchor_row"], strict=True)):
                able = np.flatnonzero((rows.labels == label) & (rows.ids != anchor))
                at, score = best(rows, a[j], *(b[j, able] for b in bounds), able, None, None, POSITIVES)
                out += [(key, anchor, rows.ids[x], s) for x, s in zip(at, score, strict=True)]
    return pd.DataFrame(out, columns=["anchor_row", "anchor_id", "positive_id", "positive_score"])


def _negatives(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(q) and len(r):
        rows = Rows(r)
        for i in range(0, len(q), ANCHORS):
            part = q.iloc[i:i + ANCHORS]
            a = integers(part["q"])
            bounds = rows.intervals(a)
            for j, (anchor, label, key, ps) in enumerate(zip(part["anchor_id"], part["anchor_label"], part["anchor_row"], part["positives"],
                                                             strict=True)):
                able = np.flatnonzero((rows.labels != label) & (rows.ids != anchor))
                own = [b[j, able] for b in bounds]
                seen = {}
                for p in ps:
                    pid, score = int(p["positive_id"]), int(p["positive_score"])
                    if score not in seen:
                        # 100 s within LOW and HIGH times the positive's
                        seen[score] = best(rows, a[j], *own, able, -(-LOW * score // 100), HIGH * score // 100, NEGATIVES)
                    out += [(key, anchor, pid, score, rows.ids[x], s) for x, s in zip(*seen[score], strict=True)]
    return pd.DataFrame(out, columns=["anchor_row", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def mine(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over all rows of ``vectors``
    (vec_id, label, embedding); ``is_anchor`` names the anchors."""
    rows = materialize(prepared(vectors, is_anchor), "mining-rows")
    key = F.xxhash64("vec_id", "label", "a")  # tells rows of one id apart
    anchors = rows.filter("anchor").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), key.alias("anchor_row"),
                                           "dim", F.col("a").alias("q"))
    n_rows, n_anchors = rows.count(), anchors.count()
    found = _blocked(anchors, rows, n_rows, n_anchors, _positives, "anchor_row long, anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_row", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= POSITIVES)
    pairs = materialize(first.groupBy("anchor_row", "anchor_id")
                        .agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "mining-positives")
    found = _blocked(anchors.join(pairs, ["anchor_row", "anchor_id"]), rows, n_rows, n_anchors, _negatives,
                     "anchor_row long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    w = Window.partitionBy("anchor_row", "anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= NEGATIVES) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    """The three hardest negatives below each of the five best positives of every anchor."""
    return mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLE = {"op12_hard_negatives": f"""
    WITH r AS (
      SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % {MOVED} = 0 THEN (label::BIGINT + 1) % {LABELS} ELSE label::BIGINT END AS label,
             list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS a
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.id AS anchor, r.id, r.label = q.label AS same, list_dot_product(q.a, r.a)::BIGINT AS score
      FROM r q JOIN r ON q.id % {EVERY} = 0 AND r.id <> q.id AND len(q.a) = len(r.a)),
    p AS (
      SELECT anchor, id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS n FROM s WHERE same),
    n AS (
      SELECT p.anchor, p.id AS positive, p.score AS ps, s.id, s.score,
             row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
      WHERE p.n <= {POSITIVES})
    SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, id AS negative_id, ps AS positive_score,
           score AS negative_score
    FROM n WHERE rank <= {NEGATIVES}"""}
