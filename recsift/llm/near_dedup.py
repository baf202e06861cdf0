"""Near-duplicate detection with circulant MinHash and exact verification.

Words are runs of characters other than ASCII white space, A-Z lower-cased; a text's set
holds its distinct 5-word shingles (the whole text where it has fewer words).  Texts with
a Jaccard similarity of at least 75/100 are linked; components of links are groups.

1. Classes: texts with the same words are one class; only classes go on.
2. Circulant MinHash: shingle hashes index a domain of ``DOMAIN`` places.  The first
   permutation (sigma) spreads them; the second (pi) gives all signature coordinates:
   coordinate k reads pi shifted circularly by k.  The coordinates of one shingle are
   therefore consecutive entries of pi, so a signature is a minimum over slices.
   ``BANDS`` bands of ``ROWS`` coordinates: a pair at 0.75 shares no band with
   probability (1 - 0.75^4)^32, about 5 in a million.
3. Stars: in every band bucket each class is paired with the bucket's smallest class,
   never with all others.  Pairs whose signatures agree too little for 0.75 (four
   standard deviations) leave; the others are verified on their full sets.
4. Rest: links that the stars cannot see join two classes of one bucket that are in
   different components so far.  Buckets with the same classes are one bucket; those of one component
   are settled.  The sets of the classes of all others are brought to them once, the classes outside
   a bucket's largest component against all others, in blocks of bounded size.  Inside a block
   no pair is a row: a pair that the block's own links have not joined, that no earlier band
   shares and whose signatures agree enough is verified on the full sets at once, and each link
   found joins two components of the block, so a block reports fewer links than it has classes.
5. Components of the verified links.  A group's id is its smallest doc_id.

Stars are verified in a stream sorted by star centre: a task holds the centre's set and
one batch.  Stars with many members are split over tasks, each with its own copy of the
centre.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing,
not even each other; texts with equal words are linked; repeated rows are copies of each
other; a null doc_id never names a group unless all its rows have none; extra columns pass
through ``deduplicate``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsift.llm import release_memory
from recsift.llm.components import components
from recsift.session import materialize
from recsift.sources.tables import read_table

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
DOMAIN_BITS = 20
DOMAIN = 1 << DOMAIN_BITS
#: agreeing coordinates of a pair at the threshold, less four standard deviations
LEAST_AGREEING = int(COORDINATES * 0.75 - 4 * (COORDINATES * 0.75 * 0.25) ** 0.5)
#: members of one star in one verification group; classes and shingles in one block of the rest
STAR_PART, BLOCK, BLOCK_SHINGLES = 256, 1024, 1 << 20
#: sets verified at a time against one set
CHUNK = 64
CACHE = 400_000
SKETCH = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("n", T.LongType()),
                       T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---- sets and signatures ---------------------------------------------------------

class _WordHashes(dict):
    """Hash of each word, kept for the words of recent texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _forget() -> None:
    _HASHES.clear()
    release_memory()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(w) - WIDTH + 1
    h = np.zeros(n, np.uint64)
    for j in range(WIDTH):
        h = _mix(h + w[j:j + n])
    return np.unique(h)


@lru_cache(1)
def _permutations():
    rng = np.random.default_rng(20240229)
    sigma, pi = rng.permutation(DOMAIN).astype(np.uint32), rng.permutation(DOMAIN).astype(np.uint32)
    ring = np.concatenate([pi, pi[:COORDINATES]])
    return sigma, np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates: coordinate k is the least pi[(sigma(x) + k) mod DOMAIN] over the set."""
    sigma, slices = _permutations()
    at = sigma[(shingles >> np.uint64(64 - DOMAIN_BITS)).astype(np.int64)]
    best = np.full(COORDINATES, DOMAIN, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(best, slices[at[i:i + 2048]].min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return h.astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the threshold."""
    if not len(a) or not len(b) or min(len(a), len(b)) * DENOMINATOR < max(len(a), len(b)) * NUMERATOR:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both)


@F.pandas_udf(SKETCH)
def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Digest of the word sequence, set size, band keys and one byte per coordinate."""
    for texts in batches:
        out = []
        for t in texts:
            words = words_of(t)
            s = shingle_set(words)
            if not len(s):
                out.append((b"", 0, None, None))
                continue
            sig = signature(s)
            out.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), len(s), band_keys(sig),
                        sig.astype(np.uint8).tobytes()))
        yield pd.DataFrame(out, columns=["words", "n", "bands", "sig"])
    _forget()


@F.pandas_udf(T.BinaryType())
def word_digest(texts: pd.Series) -> pd.Series:
    return pd.Series([hashlib.blake2b(b" ".join(words_of(t)), digest_size=16).digest() for t in texts], dtype=object)


@F.pandas_udf(T.IntegerType())
def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), COORDINATES)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), COORDINATES)
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


# ---- candidate pairs -------------------------------------------------------------

def _stars(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of shared buckets: bucket, band, cid, n, center, size; distinct pairs cid, center)."""
    rows = classes.select("cid", "n", F.posexplode("bands").alias("band", "bucket"))
    # written before the join: adaptive execution splits a hot key only between plain shuffles
    shared = materialize(rows.groupBy("bucket").agg(F.min("cid").alias("center"), F.count(F.lit(1)).alias("size"))
                         .filter("size > 1"), "near-buckets")
    members = materialize(rows.join(shared, "bucket"), "near-members")
    return members, members.filter("cid <> center").select("cid", "center").distinct()


def _similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough."""
    sig = classes.select("cid", "sig")
    other = sig.select(F.col("cid").alias("center"), F.col("sig").alias("center_sig"))
    return pairs.join(sig, "cid").join(other, "center").filter(agreeing("sig", "center_sig") >= LEAST_AGREEING) \
        .select("cid", "center")


def _open_buckets(named: DataFrame) -> DataFrame:
    """bucket, major (the largest component), a, b (blocks of it and of the others): buckets whose classes are in several
    components, one of each set of equal buckets (the one of the first band)."""
    of = named.groupBy("bucket").agg(F.first("band").alias("band"), F.count(F.lit(1)).alias("all_n"), F.sum("n").alias("all_s"),
                                     F.bit_xor(F.xxhash64("cid")).alias("h1"), F.sum(F.hash("cid").cast("long")).alias("h2"))
    first = of.groupBy("all_n", "h1", "h2").agg(F.min(F.struct("band", "bucket")).alias("k")).select(F.col("k.bucket").alias("bucket"))
    counts = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    comps = counts.groupBy("bucket").agg(F.max(F.struct("c", "s", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    j = comps.join(first, "bucket").join(of.select("bucket", "all_n", "all_s"), "bucket")
    one = blocks(F.col("all_n"), F.col("all_s")) == 1
    return j.select("bucket", "m.comp", F.when(one, 0).otherwise(blocks(F.col("m.c"), F.col("m.s"))).alias("a"),
                    F.when(one, 1).otherwise(blocks(F.col("all_n") - F.col("m.c"), F.col("all_s") - F.col("m.s"))).alias("b")) \
        .withColumnRenamed("comp", "major")


def _rest(members: DataFrame, classes: DataFrame, docs: DataFrame, roots: DataFrame) -> DataFrame:
    """Links u, v between classes of one bucket and different components that no star has paired."""
    named = materialize(members.filter("size > 2").join(roots.withColumnRenamed("u", "cid"), "cid", "left").select(
        "bucket", "band", "cid", "n", "center", F.coalesce("root", "cid").alias("comp")), "near-named")
    # written before the joins: adaptive execution splits a hot key only between plain shuffles
    parts = materialize(_open_buckets(named), "near-parts")
    mine = F.when((F.col("comp") == F.col("major")) & (F.col("a") > 0), F.pmod(F.xxhash64("cid"), F.col("a"))) \
        .otherwise(F.col("a") + F.pmod(F.xxhash64("cid"), F.col("b"))).cast("int")
    here = materialize(named.join(parts, "bucket").withColumn("mine", mine), "near-open")
    sets = materialize(_sets(here.select("cid").distinct().join(classes, "cid"), docs), "near-sets")
    # blocks 0..a-1 hold the largest component, a..a+b-1 the others; a pair of blocks has one of the others
    every = F.sequence(F.lit(0), F.col("a") + F.col("b") - 1)
    outer = F.sequence(F.col("a"), F.col("a") + F.col("b") - 1)
    j = here.withColumn("with", F.explode(F.when(F.col("mine") < F.col("a"), outer).otherwise(every)))
    j = j.select("bucket", F.least("mine", "with").alias("x"), F.greatest("mine", "with").alias("y"), "mine", "cid", "comp", "center", "band") \
        .join(sets, "cid")
    return j.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "mine", "cid").mapInPandas(_linked_blocks, "u long, v long")


def _linked_blocks(batches):
    """Rows come by pair of blocks; each is held until it is whole."""
    held, key = [], None
    for pdf in batches:
        for k, g in pdf.groupby(["bucket", "x", "y"], sort=False):
            if k != key and held:
                yield _block_links(held)
                held = []
            key = k
            held.append(g)
    if held:
        yield _block_links(held)
    release_memory()


def _block_links(rows: list[pd.DataFrame]) -> pd.DataFrame:
    pdf = (pd.concat(rows) if len(rows) > 1 else rows[0]).drop_duplicates("cid")
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), COORDINATES)
    cid, comp, mine, center = (pdf[c].to_numpy().copy() for c in ("cid", "comp", "mine", "center"))
    x, y, band = pdf["x"].iloc[0], pdf["y"].iloc[0], pdf["band"].iloc[0]
    bands = np.stack(pdf["bands"].to_list())
    sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    right, u, v = np.flatnonzero(mine == y), [], []
    for i in np.flatnonzero(mine == x):
        ok = right[right > i] if x == y else right
        # the star has tested the pairs with the bucket's smallest class
        ok = ok[(comp[ok] != comp[i]) & (cid[ok] != center[ok]) & (cid[i] != center[i])]
        # sets of too different sizes cannot reach the threshold
        ok = ok[np.minimum(n[ok], n[i]) * DENOMINATOR >= np.maximum(n[ok], n[i]) * NUMERATOR]
        ok = ok[(sig[ok] == sig[i]).sum(axis=1) >= LEAST_AGREEING]
        # a pair that shares several buckets is verified in the first of them
        ok = ok[(bands[ok] == bands[i]).argmax(axis=1) == band]
        for k in range(0, len(ok), CHUNK):
            part = ok[k:k + CHUNK]
            part = part[comp[part] != comp[i]]
            if not len(part):
                continue
            flat = np.concatenate([sets[j] for j in part])
            at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(n[part]) - n[part])
            for j in part[both * DENOMINATOR >= NUMERATOR * (n[part] + n[i] - both)]:
                if comp[j] != comp[i]:
                    u.append(max(cid[i], cid[j])), v.append(min(cid[i], cid[j]))
                    comp[comp == comp[j]] = comp[i]
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


# ---- verification ----------------------------------------------------------------

def _with_text(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (first_id, words, ...) with the text of each class; rows of other texts under the same id come along."""
    text = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text"))
    # null ids do not join; rows without an id are found by their words
    rows = wanted.filter("first_id IS NOT NULL").join(text.filter("first_id IS NOT NULL"), "first_id")
    if not docs.filter("doc_id IS NULL").isEmpty():
        nameless = text.filter("first_id IS NULL").withColumn("words", word_digest("text"))
        rows = rows.unionByName(wanted.filter("first_id IS NULL").drop("first_id").join(nameless, "words").select(*rows.columns))
    return rows


@F.pandas_udf(T.StructType([T.StructField("own", T.BooleanType()), T.StructField("shingles", T.BinaryType())]))
def own_shingles(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Whether the text is the class's own, and its shingle hashes."""
    for texts, digests in batches:
        out = []
        for t, d in zip(texts, digests, strict=True):
            words = words_of(t)
            own = hashlib.blake2b(b" ".join(words), digest_size=16).digest() == d
            out.append((own, shingle_set(words).tobytes() if own else b""))
        yield pd.DataFrame(out, columns=["own", "shingles"])
    _forget()


def _sets(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cid, sig, bands, shingles: the full sets of ``classes``."""
    rows = _with_text(classes.select("cid", "first_id", "words", "sig", "bands"), docs)
    return rows.select("cid", "sig", "bands", own_shingles("text", "words").alias("s")).filter("s.own") \
        .select("cid", "sig", "bands", "s.shingles").dropDuplicates(["cid"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold, as links u, v."""
    sizes = materialize(pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / STAR_PART).cast("int").alias("parts")), "near-stars")
    split = pairs.join(sizes, "center").select("cid", "center", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"))
    own = sizes.select(F.col("center").alias("cid"), "center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = split.union(own).join(classes.select("cid", "first_id", "words"), "cid")
    rows = _with_text(wanted, docs).select("center", "part", "cid", "words", "text")
    order = ["center", "part", F.col("cid") != F.col("center"), "cid"]
    return rows.repartition("center", "part").sortWithinPartitions(*order).mapInPandas(_verify, "u long, v long")


def _verify(batches):
    """Rows come by star, its centre first."""
    key, mine, last = None, None, None
    for pdf in batches:
        u, v = [], []
        for center, part, cid, digest, text in zip(pdf["center"], pdf["part"], pdf["cid"], pdf["words"], pdf["text"], strict=True):
            if (center, part, cid) == last:
                continue  # the text of a row that is there twice
            words = words_of(text)
            if hashlib.blake2b(b" ".join(words), digest_size=16).digest() != digest:
                continue  # another text under the same id
            last = (center, part, cid)
            if cid == center:
                key, mine = (center, part), shingle_set(words)
            elif key == (center, part) and linked(mine, shingle_set(words)):
                u.append(cid), v.append(center)
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})
    _forget()


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, words (digest), root (group)."""
    rows = materialize(docs.select(F.col("doc_id").cast("long"), sketch(F.col("text")).alias("s"))
                       .select("doc_id", "s.*"), "near-sketch")
    some = rows.filter("n > 0")
    classes = materialize(some.groupBy("words").agg(
        F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    members, pairs = _stars(classes)
    links = materialize(_verified(materialize(_similar(pairs, classes), "near-pairs"), classes, docs), "near-links")
    roots = components(links)
    links = links.union(materialize(_rest(members, classes, docs, roots), "near-links"))
    roots = components(links)
    named = classes.select("words", "cid", "first_id").join(roots.withColumnRenamed("u", "cid"), "cid", "left") \
        .select("words", "first_id", F.coalesce("root", "cid").alias("root"))
    least = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "near-least")
    of_words = named.join(least, "root").select("words", "root", "component_id")
    grouped = some.select("doc_id", "n", "words").join(of_words, "words")
    alone = rows.filter("n = 0").select("words", "doc_id", "n", F.lit(None).cast("long").alias("root"),
                                        F.col("doc_id").alias("component_id"))
    return grouped.select(*alone.columns).union(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "words", "root")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per group, the one with the smallest doc_id, with all columns.  Rows
    without words are in no group and stay."""
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("words").alias("words")))
    kept = materialize(groups(docs).filter("root IS NOT NULL").groupBy("root").agg(first.alias("k"))
                       .select(F.col("k.id").alias("_id"), F.col("k.words").alias("_words")), "near-kept")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.filter(has_words).withColumn("_words", word_digest("text"))
    some = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["_words"] == kept["_words"]), "left_semi") \
        .dropDuplicates(["doc_id", "_words"])
    return some.select(*docs.columns).union(docs.filter(~has_words))


def op6_near_dedup(spark, sf_dir):
    """Every document with its set size and the smallest id of its near-duplicate group."""
    return groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op6_near_dedup": op6_near_dedup}
