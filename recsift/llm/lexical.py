"""Ranked lexical search by presence masks.

Terms are runs of ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased.  For
every item the documents are ranked by a sum over the item's terms (repeats included) of

    w(term) * ((1000000000 * tf) div (1000 * tf + 8 * m(document)))

with w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and m = 25 + (75 * n * N) div L, all counted over
the whole table.

1. One pass over the texts keeps, per document, the number of its terms and its counts of the
   items' terms.  N, L and df are sums over those rows.
2. Documents are dealt into blocks, items into slices; each (block, slice) is one cogroup.
3. In a block, each term of the slice has a bitmap of the documents that hold it.  An item's
   bitmaps, transposed, give each document's mask of matched terms; equal masks are one group.
   A mask's maximum is the sum of its terms' weights times the largest share that a document of the
   block has of each.  Masks are evaluated in descending order of that maximum until it is below
   the tenth best score found: no later mask can hold a better document.  Documents that
   match the item in the same groups of terms are scored together.
4. The ten best of all blocks per item, ranked in Spark.

The items' terms travel with the tasks where they are few (``VOCABULARY_BYTES``, counted first);
otherwise the documents' term counts meet them in a join.  Both ways give the same rows.

Defined cases: null and empty texts have no terms; documents without terms count neither in N nor in
L.  Items with a null id or without terms have no rows.  Items repeated with the same text are
one; one id on several texts is ranked for each text on its own.  Documents of equal score come by
doc_id, null ids last; repeated documents rank each on their own.  Extra columns are ignored; an
empty table of items or documents gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsift.operators.ordering import with_positions
from recsift.session import materialize
from recsift.sources.tables import read_table

BEST = 10
#: documents of one block, distinct terms of one slice of items (one item may have more)
BLOCK, SLICE = 4096, 16_384
#: bytes of the items' terms up to which they travel with the tasks
VOCABULARY_BYTES = 16 << 20
#: documents scored at a time
STEP = 256
#: letters and digits and everything beyond ASCII are kept, A-Z lower-cased; all other bytes part terms
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("counts", T.MapType(T.StringType(), T.LongType()))])
SCORED = "slot long, doc_id long, score long"


def term_counts(text: str | None) -> tuple[int, Counter]:
    found = Counter((text or "").encode("utf-8", "replace").translate(_LETTERS).split(b" "))
    found.pop(b"", None)
    return sum(found.values()), found


# ---- counts ------------------------------------------------------------------------

def _items(benchmark: DataFrame) -> DataFrame:
    """slot, item_id, terms (distinct), times (how often each stands in the item)."""
    @F.pandas_udf("struct<terms: array<string>, times: array<long>>")
    def split(texts: pd.Series) -> pd.DataFrame:
        both = [sorted((t.decode(), c) for t, c in term_counts(x)[1].items()) for x in texts]
        return pd.DataFrame({"terms": [[t for t, _ in b] for b in both], "times": [[c for _, c in b] for b in both]})

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL AND text IS NOT NULL") \
        .distinct().select("item_id", split("text").alias("s")).select("item_id", "s.*").filter(F.size("terms") > 0)
    return materialize(rows.withColumn("slot", F.monotonically_increasing_id()), "lexical-items")


def _counted(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, doc_id, n, terms (numbers), tfs: the documents that hold any term, with their counts of the vocabulary's."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("b")).first()["b"]
    known = {r["term"].encode(): r["t"] for r in vocabulary.collect()} if size <= VOCABULARY_BYTES else None
    kept = "doc_id long, n long, " + ("terms array<int>, tfs array<long>" if known is not None else "counts map<string, long>")

    def count(batches):
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                n, found = term_counts(text if isinstance(text, str) else None)
                if not n:
                    continue
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if known is None:
                    out.append((doc_id, n, {t.decode(): c for t, c in found.items()}))
                else:
                    hits = sorted((known[t], c) for t, c in found.items() if t in known)
                    out.append((doc_id, n, [t for t, _ in hits], [c for _, c in hits]))
            out = pd.DataFrame(out, columns=["doc_id", "n", *(["counts"] if known is None else ["terms", "tfs"])])
            yield out.astype({"doc_id": "Int64"})

    counted = materialize(rows.mapInPandas(count, kept).withColumn("row", F.monotonically_increasing_id()), "lexical-counts")
    if known is None:
        pairs = counted.select("row", F.explode("counts").alias("term", "tf"))
        met = pairs.join(vocabulary, "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("t", "tf"))).alias("l"))
        counted = materialize(counted.drop("counts").join(met, "row", "left").select(
            "doc_id", "n", F.coalesce(F.transform("l", lambda x: x["t"]), F.array().cast("array<int>")).alias("terms"),
            F.coalesce(F.transform("l", lambda x: x["tf"]), F.array().cast("array<bigint>")).alias("tfs"), "row"), "lexical-met")
    return counted


# ---- one block ---------------------------------------------------------------------

class Block:
    """Documents of one block: bitmaps of the slice's terms and the shares that count in scores."""

    def __init__(self, docs: pd.DataFrame, numbers: np.ndarray):
        """``numbers``: the slice's terms, ascending."""
        self.n, self.numbers = len(docs), numbers
        self.ids = docs["doc_id"].astype("Int64")
        # equal scores by doc_id, null ids last
        self.place = np.empty(self.n, np.int64)
        self.place[np.lexsort((self.ids.fillna(0).to_numpy(np.int64), self.ids.isna().to_numpy()))] = np.arange(self.n)
        size = docs["terms"].map(len).to_numpy(np.int64)
        term, tf = (np.concatenate([np.empty(0, np.int64), *docs[c]]).astype(np.int64) for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(self.n), size)
        at = np.searchsorted(numbers, term)
        here = (at < len(numbers)) & (numbers[np.minimum(at, len(numbers) - 1)] == term)
        at, doc, tf = at[here], doc[here], tf[here]
        m = docs["m"].to_numpy(np.int64)[doc]
        share = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        order = np.lexsort((doc, at))
        self.doc, self.share = doc[order], share[order]
        self.first = np.searchsorted(at[order], np.arange(len(numbers) + 1))
        self.most = np.array([self.share[a:b].max(initial=0) for a, b in zip(self.first, self.first[1:], strict=False)], np.int64)
        self.maps: dict[int, np.ndarray] = {}

    def bitmap(self, t: int) -> np.ndarray:
        """The documents that hold term ``t`` of the slice, one bit each."""
        if t not in self.maps:
            has = np.zeros(self.n, bool)
            has[self.doc[self.first[t]:self.first[t + 1]]] = True
            self.maps[t] = np.packbits(has)
        return self.maps[t]

    def shares(self, t: int, docs: np.ndarray) -> np.ndarray:
        """Each document's share of term ``t``, 0 where it lacks it."""
        held, share = self.doc[self.first[t]:self.first[t + 1]], self.share[self.first[t]:self.first[t + 1]]
        at = np.minimum(np.searchsorted(held, docs), max(len(held) - 1, 0))
        return np.where(held[at] == docs, share[at], 0) if len(held) else np.zeros(len(docs), np.int64)

    def best(self, item_terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best documents of an item; ``weights`` with repeats counted."""
        at = np.searchsorted(self.numbers, item_terms)
        here = weights > 0
        here &= self.most[at] > 0
        at, weights = at[here], weights[here]
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(at):
            return docs, scores
        # terms of the largest possible gain first, so that one byte more or less of a mask tells much
        order = np.argsort(-weights * self.most[at], kind="stable")
        at, weights = at[order], weights[order]
        matched = np.unpackbits(np.stack([self.bitmap(t) for t in at]), axis=1, count=self.n)
        words = -(-len(at) // 64)
        masks = np.zeros((self.n, 8 * words), np.uint8)
        masks[:, :-(-len(at) // 8)] = np.packbits(matched, axis=0).T
        groups, group = np.unique(masks.view(np.uint64 if words == 1 else f"V{8 * words}").ravel(), return_inverse=True)
        held = np.unpackbits(groups.view(np.uint8).reshape(len(groups), -1), axis=1, count=len(at))
        top = held @ (weights * self.most[at])  # the most that a document with this mask can score
        by_group = np.argsort(group, kind="stable")
        first = np.searchsorted(group[by_group], np.arange(len(groups) + 1))
        floor, waiting, n = 1, [], 0
        ranked = np.argsort(-top, kind="stable")
        for k, g in enumerate(ranked):
            if top[g] < floor:
                break
            waiting.append(by_group[first[g]:first[g + 1]])
            n += len(waiting[-1])
            if n < STEP and k + 1 < len(ranked) and top[ranked[k + 1]] >= floor:
                continue
            for part in np.array_split(np.concatenate(waiting), max(1, n // (4 * STEP))):
                new = np.zeros(len(part), np.int64)
                for t, w in zip(at, weights, strict=True):
                    new += w * self.shares(t, part)
                docs, scores = np.concatenate([docs, part[new > 0]]), np.concatenate([scores, new[new > 0]])
                keep = np.lexsort((self.place[docs], -scores))[:BEST]
                docs, scores = docs[keep], scores[keep]
            waiting, n = [], 0
            if len(scores) == BEST:
                floor = max(1, scores[-1])
        return docs, scores


def _ranked_block(docs: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(docs) and len(items):
        docs = docs.reset_index(drop=True)
        block = Block(docs, np.unique(np.concatenate(items["terms"].to_list())).astype(np.int64))
        for slot, ts, ws in zip(items["slot"], items["terms"], items["weights"], strict=True):
            found, scores = block.best(np.asarray(ts, np.int64), np.asarray(ws, np.int64))
            out.append(pd.DataFrame({"slot": slot, "doc_id": block.ids.iloc[found].reset_index(drop=True), "score": scores}))
    return pd.concat(out) if out else pd.DataFrame({"slot": [], "doc_id": [], "score": []}).astype("int64")


# ---- search ------------------------------------------------------------------------

def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ``BEST`` documents of every item."""
    items = _items(benchmark)
    vocabulary, _ = with_positions(items.select(F.explode("terms").alias("term")).distinct(), [F.col("term")], name="t")
    vocabulary = materialize(vocabulary.select("term", F.col("t").cast("int").alias("t")), "lexical-terms")
    counted = _counted(docs, vocabulary)
    total = counted.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, n_terms = total["N"], total["L"]
    df = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    @F.pandas_udf("long")
    def weight(df: pd.Series) -> pd.Series:
        return pd.Series([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype="int64")

    # terms that no document holds add nothing
    weights = materialize(vocabulary.join(df, "t").select("t", "term", weight("df").alias("w")), "lexical-weights")
    pairs = items.select("slot", F.explode(F.arrays_zip("terms", "times")).alias("p")).select("slot", F.col("p.terms").alias("term"), "p.times")
    met = pairs.join(weights, "term").groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("t", (F.col("w") * F.col("times")).alias("w")))).alias("l"))
    n_pairs = pairs.count()
    slices, blocks = max(1, -(-n_pairs // SLICE)), max(1, -(-n_docs // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = met.select("slot", F.transform("l", lambda x: x["t"]).alias("terms"), F.transform("l", lambda x: x["w"]).alias("weights"),
                     F.pmod(F.xxhash64("slot"), F.lit(slices)).alias("s")).withColumn("b", every(blocks))
    m = 25 + F.expr(f"(75 * n * {n_docs}L) div {max(n_terms, 1)}L")
    dealt = counted.filter(F.size("terms") > 0).select("doc_id", "terms", "tfs", m.alias("m"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("b")) \
        .withColumn("s", every(slices))
    found = dealt.groupBy("b", "s").cogroup(own.groupBy("b", "s")).applyInPandas(_ranked_block, SCORED)
    w = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= BEST)
    return top.join(items.select("slot", "item_id"), "slot").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_ranked_search": op13_ranked_search}

_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = {"op13_ranked_search": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
    n AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
    tot AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
    tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
    it AS (SELECT item_id, text, term, count(*)::BIGINT AS times
           FROM (SELECT item_id, text, unnest({_SQL_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
           GROUP BY item_id, text, term),
    w AS (SELECT term, floor(1000 * ln((2 * (SELECT nn FROM tot) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
          FROM tf WHERE term IN (SELECT term FROM it) GROUP BY term),
    s AS (SELECT it.item_id, it.text, n.doc_id, n.r,
                 sum(it.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * tot.nn) // tot.ll))))::BIGINT AS score
          FROM it JOIN w ON w.term = it.term JOIN tf ON tf.term = it.term JOIN n ON n.r = tf.r CROSS JOIN tot
          GROUP BY it.item_id, it.text, n.doc_id, n.r),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {BEST}"""}
