"""Temporal split and negative sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsift.operators.ordering import bounded_broadcast, with_positions
from recsift.session import materialize, release

SPLIT_ORDER = ("ts", "user_id", "item_id")


def split_bounds(n: int, test: float = 0.2, val: float = 0.1) -> tuple[int, int]:
    """Cut positions exactly as the reference computes them (Python floats)."""
    return int(n * (1 - test - val)), int(n * (1 - test))


def temporal_split(interactions: DataFrame, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """Order by (ts, user_id, item_id); rows 1..train_end are 'train', up to
    val_end 'val', the rest 'test'.  Adds ``pos`` (1-based) and ``split``.

    Positions come from a range partition (``with_positions``): no single-partition
    sort, and only one count per partition reaches the driver.  The numbered rows
    are written once, so later reads of the three parts do not recompute the sort.
    """
    positioned, n = with_positions(interactions, [F.col(c) for c in SPLIT_ORDER])
    train_end, val_end = split_bounds(n, test, val)
    part = (F.when(F.col("pos") <= train_end, "train")
             .when(F.col("pos") <= val_end, "val").otherwise("test"))
    return positioned.withColumn("split", part)


#: ranks of unseen items that share a join key in the exact draw
RANK_BUCKET = 64


def _universe(items: DataFrame, group: str | None) -> tuple[DataFrame, DataFrame]:
    """(grp, item_id, idx) with a dense 0-based index per group, and (grp, size).

    The index is a global range-partition numbering over (group, item) minus the
    group's first position, so a large group is not numbered inside one task."""
    it = items.select((F.col(group) if group else F.lit("")).alias("grp"), "item_id").distinct()
    numbered, _ = with_positions(it, [F.col("grp"), F.col("item_id")], name="_p")
    sizes = numbered.groupBy("grp").agg(F.min("_p").alias("_p0"), F.count(F.lit(1)).alias("size"))
    first = bounded_broadcast(sizes)  # one row per group
    idx = numbered.join(first, "grp").select("grp", "item_id", (F.col("_p") - F.col("_p0")).alias("idx"))
    return idx, sizes.select("grp", "size")


def _seen_index(train: DataFrame, idx: DataFrame) -> DataFrame:
    return train.select("user_id", "item_id").distinct().join(idx, "item_id").select("user_id", "grp", "idx")


#: seen places of a user and group that travel as an array beside the user's rows; longer histories are met by a join of places
SEEN_LIST = 512


def unseen_draws(pos: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """``pos`` (user_id, item_id, grp, draws, ...) with ``places``, the first ``n`` of the candidate places ``draws`` that the
    user has not seen.

    A positive and its draws stay one row: they meet the user's seen places as an array, so a draw is no row of its own
    in any shuffle.  Users with more than ``SEEN_LIST`` seen places in a group are spread by (user, group, place)."""
    size = seen.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("_s"))
    heavy = materialize(size.filter(F.col("_s") > SEEN_LIST).select("user_id", "grp"), "heavy-users")
    arrays = seen.join(heavy, ["user_id", "grp"], "left_anti").groupBy("user_id", "grp").agg(F.collect_list("idx").alias("_seen"))
    none = F.array().cast("array<bigint>")
    light = (pos.join(heavy, ["user_id", "grp"], "left_anti").join(arrays, ["user_id", "grp"], "left")
             .withColumn("places", F.slice(F.filter("draws", lambda x: ~F.array_contains(F.coalesce("_seen", none), x)), 1, n)))
    out = light.select(*pos.columns, "places")
    if heavy.isEmpty():
        return out
    many = pos.join(heavy, ["user_id", "grp"], "left_semi")
    free = (many.select("user_id", "item_id", "grp", F.posexplode("draws").alias("j", "idx"))
            .join(seen.join(heavy, ["user_id", "grp"], "left_semi"), ["user_id", "grp", "idx"], "left_anti")
            .groupBy("user_id", "item_id", "grp").agg(F.sort_array(F.collect_list(F.struct("j", "idx"))).alias("_f")))
    places = F.slice(F.transform(F.coalesce("_f", F.array().cast("array<struct<j:int,idx:bigint>>")), lambda x: x["idx"]), 1, n)
    return out.unionByName(many.join(free, ["user_id", "item_id", "grp"], "left").withColumn("places", places)
                           .select(*pos.columns, "places"))


def _hashed_draws(pos: DataFrame, n: int, seed: int) -> DataFrame:
    """``draws``: ``2n`` places by hash, each once, in the order drawn."""
    h = lambda slot: F.pmod(F.xxhash64("user_id", "item_id", slot, F.lit(seed)), F.col("size"))
    return pos.withColumn("draws", F.array_distinct(F.array(*[h(F.lit(i)) for i in range(1, 2 * n + 1)])))


def _by_rank(pos: DataFrame, seen: DataFrame, sizes: DataFrame, n: int, seed: int) -> DataFrame:
    """Exact draw without rejection: ``n`` consecutive ranks (from a hashed start, around the end)
    among the user's unseen items of the group; fewer only where fewer exist.

    The rank of an unseen item follows from the gaps between the user's seen places: a
    gap knows how many unseen items stand before it.  A rank meets its gap by an equi-join
    on blocks of ``RANK_BUCKET`` ranks."""
    return _ranked_places(pos, seen, sizes, n, F.xxhash64("user_id", "item_id", F.lit("rank"), F.lit(seed)))


def _ranked_places(pos: DataFrame, seen: DataFrame, sizes: DataFrame, n: int, start) -> DataFrame:
    """``n`` consecutive ranks from ``start`` (a column, taken modulo the supply) among each user's unseen places."""
    users = pos.select("user_id", "grp").distinct().join(sizes, "grp")
    ends = users.select("user_id", "grp", F.col("size").alias("idx"))
    marks = seen.join(users.select("user_id", "grp"), ["user_id", "grp"], "left_semi").unionByName(ends)
    w = Window.partitionBy("user_id", "grp").orderBy("idx")
    gaps = (marks.withColumn("first", F.coalesce(F.lag("idx").over(w), F.lit(-1)) + 1)
                 .withColumn("before", F.col("first") - (F.row_number().over(w) - 1))
                 .withColumn("len", F.col("idx") - F.col("first")))
    supply = gaps.groupBy("user_id", "grp").agg(F.sum("len").alias("supply"))
    gaps = (gaps.filter("len > 0")
                .withColumn("bucket", F.explode(F.sequence(F.floor(F.col("before") / RANK_BUCKET),
                                                           F.floor((F.col("before") + F.col("len") - 1) / RANK_BUCKET))))
                .select("user_id", "grp", "bucket", "first", "before", "len"))
    draws = (pos.drop("size").join(supply, ["user_id", "grp"]).filter("supply > 0")
                .withColumn("slot", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.col("supply")).cast("int"))))
                .withColumn("rank", F.pmod(F.pmod(start, F.col("supply")) + F.col("slot") - 1, F.col("supply")))
                .withColumn("bucket", F.floor(F.col("rank") / RANK_BUCKET)))
    return (draws.join(gaps, ["user_id", "grp", "bucket"])
                 .filter("rank >= before AND rank < before + len")
                 .select("user_id", "item_id", "grp", "slot", (F.col("first") + F.col("rank") - F.col("before")).alias("idx")))


def unseen_after(rows: DataFrame, seen: DataFrame, size: int, n: int) -> DataFrame:
    """user_id, item_id, slot, idx: the user's first ``n`` unseen places after each row's own place, around the
    end and without that place itself; fewer only where the user has left fewer unseen.

    rows: user_id, item_id, idx; seen: user_id, idx (distinct); places run from 0 to ``size`` - 1.  A place's number of
    unseen places before it follows from a running count of the user's seen ones; the next ranks are
    met by :func:`_by_rank`'s equi-join on blocks of gaps, so no candidate list is ever formed."""
    users = rows.select("user_id").distinct()
    mine = seen.join(users, "user_id", "left_semi")
    points = mine.select("user_id", "idx", F.lit(1).alias("s"), F.lit(None).cast("long").alias("item_id")) \
        .unionByName(rows.select("user_id", "idx", F.lit(0).alias("s"), "item_id"))
    w = Window.partitionBy("user_id").orderBy("idx", F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    start = points.withColumn("rank", F.col("idx") + 1 - F.sum("s").over(w)).filter("s = 0")
    pos = start.select("user_id", "item_id", F.lit("").alias("grp"), F.col("idx").alias("own"), F.col("rank").alias("start"))
    sizes = rows.sparkSession.createDataFrame([("", size)], "grp string, size long")
    found = _ranked_places(pos, mine.select("user_id", F.lit("").alias("grp"), "idx"), sizes, n + 1, F.col("start"))
    w = Window.partitionBy("user_id", "item_id").orderBy("slot")
    return found.join(pos.select("user_id", "item_id", "own"), ["user_id", "item_id"]).filter("idx <> own") \
        .withColumn("slot", F.row_number().over(w).cast("long")).filter(F.col("slot") <= n).select("user_id", "item_id", "slot", "idx")


def _negatives(train: DataFrame, items: DataFrame, n: int, seed: int, group: str | None) -> DataFrame:
    idx, sizes = _universe(items, group)
    positives = train.select("user_id", "item_id").distinct()
    pos = positives.join(idx.select("item_id", "grp"), "item_id") if group else positives.withColumn("grp", F.lit(""))
    pos = materialize(pos.join(bounded_broadcast(sizes), "grp"), "positives")
    seen = materialize(_seen_index(train, idx), "seen-places")
    # written once: what is short is decided on the rows that are kept
    first = materialize(unseen_draws(_hashed_draws(pos, n, seed), seen, n).drop("draws"), "negatives")
    release(pos)
    done = first.filter(F.size("places") == n).select("user_id", "item_id", "grp", F.posexplode("places").alias("slot", "idx")) \
        .withColumn("slot", F.col("slot") + 1)
    short = first.filter(F.size("places") < n).drop("places")
    drawn = done.unionByName(_by_rank(short, seen, sizes, n, seed))
    return drawn.join(idx.withColumnRenamed("item_id", "neg_item_id"), ["grp", "idx"]) \
        .select("user_id", "item_id", F.col("slot").cast("long"), "neg_item_id", "grp")


def negatives_random(train: DataFrame, items: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """``n`` negatives per positive over the catalogue, the user's own training items
    excluded.  A hashed draw serves nearly all positives; the others draw exactly among the
    user's unseen items.  A positive has fewer than ``n`` rows only where its user has left
    fewer items unseen (see :func:`shortfall`).
    Output: user_id, item_id, slot (1..n), neg_item_id."""
    return _negatives(train, items, n, seed, None).drop("grp")


def negatives_hard(train: DataFrame, items: DataFrame, n: int = 4, ratio: float = 0.3,
                   seed: int = 42) -> DataFrame:
    """N2 (our definition of 'hard'): ``round(n * ratio)`` negatives from the positive's own
    category, drawn like N1; fewer only where the category has fewer unseen items."""
    m = int(round(n * ratio))
    if m == 0:
        return _negatives(train.limit(0), items, 1, seed, "category").withColumnRenamed("grp", "category")
    return _negatives(train, items, m, seed, "category").withColumnRenamed("grp", "category")


def negatives_mixed(train: DataFrame, items: DataFrame, n: int = 4, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """N3's negatives: ``round(n * ratio)`` hard ones in the first slots, random ones in the rest.
    One more random negative is drawn per hard one, so that a random draw equal to a hard one
    can be left out."""
    m = int(round(n * ratio))
    rand = negatives_random(train, items, n + m, seed)
    if m == 0:
        return rand.withColumn("hard", F.lit(False))
    hard = negatives_hard(train, items, n, ratio, seed).drop("category").withColumn("hard", F.lit(True))
    # both kinds meet per positive as short arrays (n + 2m rows at most): one shuffle
    pick = lambda h: F.transform(F.sort_array(F.collect_list(F.when(F.col("hard") == h, F.struct("slot", "neg_item_id")))),
                                 lambda x: x["neg_item_id"])
    both = hard.unionByName(rand.withColumn("hard", F.lit(False)).select(*hard.columns)) \
        .groupBy("user_id", "item_id").agg(pick(True).alias("_h"), pick(False).alias("_r"))
    rest = F.filter("_r", lambda x: ~F.array_contains("_h", x))
    all_ = F.concat(F.transform("_h", lambda x: F.struct(x.alias("neg_item_id"), F.lit(True).alias("hard"))),
                    F.transform(rest, lambda x: F.struct(x.alias("neg_item_id"), F.lit(False).alias("hard"))))
    return both.select("user_id", "item_id", F.posexplode(F.slice(all_, 1, n)).alias("slot", "_x")) \
        .select("user_id", "item_id", (F.col("slot") + 1).cast("long").alias("slot"), "_x.neg_item_id", "_x.hard")


def shortfall(train: DataFrame, negatives: DataFrame, n: int) -> DataFrame:
    """user_id, item_id, missing: positives with fewer than ``n`` negatives."""
    have = negatives.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_h"))
    return (train.select("user_id", "item_id").distinct().join(have, ["user_id", "item_id"], "left")
            .withColumn("missing", F.lit(n) - F.coalesce("_h", F.lit(0))).filter("missing > 0").drop("_h"))


def training_examples(train: DataFrame, negatives: DataFrame, item_feats: DataFrame) -> DataFrame:
    """One row per positive: user, positive features, negatives (array of structs
    ordered by slot; at most n per row, so the collect is bounded) and the weight."""
    feat_cols = [c for c in item_feats.columns if c != "item_id"]
    f_struct = F.struct(*[F.col(c) for c in feat_cols])
    pos_f = item_feats.select(F.col("item_id"), f_struct.alias("pos_features"))
    neg_f = item_feats.select(F.col("item_id").alias("neg_item_id"), f_struct.alias("f"))
    negs = (negatives.join(neg_f, "neg_item_id")
            .groupBy("user_id", "item_id")
            .agg(F.sort_array(F.collect_list(F.struct("slot", "neg_item_id", "f"))).alias("negatives")))
    return (train.select("user_id", "item_id", "weight").join(pos_f, "item_id")
                 .join(negs, ["user_id", "item_id"], "left"))
