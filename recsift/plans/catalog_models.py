"""Registered loss, validation, factorisation, tower and sampling queries
(L1-L5, V1, C1-C4, N1-N3)."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from recsift.functions import vectors as V
from recsift.operators import bounded as B
from recsift.operators import features as FT
from recsift.operators import models as M
from recsift.operators import prep
from recsift.operators import retrieval as R
from recsift.operators import split as SP
from recsift.operators import towers as TW
from recsift.operators import training as TR
from recsift.operators.ordering import bounded_broadcast, with_positions
from recsift.plans.catalog import query, r6
from recsift.plans.context import KS, REC_K, Context
from recsift.plans.oracle_views import VIEWS, with_views
from recsift.session import ensure_checkpoint_dir, materialize, release, shuffles_dropped

N_NEG = 4
NEG_STEP = 37

N_DRAWS = 12  # places tried for the N_NEG unseen negatives before a row walks on place by place


def _standin_sql(key: str) -> str:
    """A unit 64-vector made of an id by arithmetic, the same in SQL and in Spark."""
    raw = f"list_transform(range(64), lambda j: (({key} * 7919 + (j + 1) * 104729) % 2003) / 1001.5::DOUBLE - 1.0)"
    return f"(SELECT list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT {raw} AS w))"


def _triples_sql(rows: str) -> str:
    return f"""
        SELECT t.user_id, t.item_id, any_value(t.weight) AS weight, any_value(t.user_v) AS user_v,
               any_value(t.pos_v) AS pos_v, list(n.v ORDER BY d.k) AS neg_v
        FROM {rows}_negs d JOIN {rows} t ON t.user_id = d.user_id AND t.item_id = d.item_id JOIN ivec n ON n.idx = d.idx
        GROUP BY t.user_id, t.item_id"""


def _negs_sql(rows: str) -> str:
    """user_id, item_id, k, idx: the first unseen of the draws; rows short of them walk on place by place."""
    return f"""
        WITH u AS (
          SELECT r.user_id, r.item_id, n.idx, row_number() OVER (PARTITION BY r.user_id, r.item_id ORDER BY g.j) AS k
          FROM {rows} r CROSS JOIN range(1, {N_DRAWS + 1}) g(j)
          JOIN ivec n ON n.idx = (r.idx + {NEG_STEP} * g.j) % (SELECT count(*) FROM ivec)
          WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user_id = r.user_id AND s.item_id = n.item_id)),
        full_rows AS (SELECT user_id, item_id FROM u WHERE k = {N_NEG}),
        walk AS (
          SELECT r.user_id, r.item_id, n.idx, row_number() OVER (PARTITION BY r.user_id, r.item_id
                 ORDER BY (n.idx - r.idx + (SELECT count(*) FROM ivec)) % (SELECT count(*) FROM ivec)) AS k
          FROM (SELECT * FROM {rows} x WHERE NOT EXISTS
                 (SELECT 1 FROM full_rows f WHERE f.user_id = x.user_id AND f.item_id = x.item_id)) r
          JOIN ivec n ON n.idx <> r.idx
          WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user_id = r.user_id AND s.item_id = n.item_id))
        SELECT u.* FROM u JOIN full_rows f ON f.user_id = u.user_id AND f.item_id = u.item_id WHERE k <= {N_NEG}
        UNION ALL SELECT * FROM walk WHERE k <= {N_NEG}"""


def _scores_sql(triples: str) -> str:
    return f"""
        SELECT weight, user_v, pos_v, neg_v, list_dot_product(user_v, pos_v) AS pos,
               list_transform(neg_v, lambda n: list_dot_product(user_v, n)) AS negs
        FROM {triples}"""


VIEWS.update({
    # every catalogue item: its visual vector, else the stand-in of its id; places in id order
    "ivec": (("items_c", "uvec"), f"""
        SELECT i.item_id, coalesce(u.v, {_standin_sql('i.item_id')}) AS v,
               row_number() OVER (ORDER BY i.item_id) - 1 AS idx
        FROM items_c i LEFT JOIN uvec u ON u.item_id = i.item_id"""),
    "uprof": (("train", "ivec"), """
        SELECT user_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v
        FROM (SELECT user_id, list(x ORDER BY pos) AS v FROM (
                SELECT user_id, pos, avg(x) AS x FROM (
                  SELECT t.user_id, unnest(i.v) AS x, generate_subscripts(i.v, 1) AS pos
                  FROM train t JOIN ivec i ON t.item_id = i.item_id)
                GROUP BY user_id, pos)
              GROUP BY user_id)"""),
    "tri_rows": (("train", "ivec", "uprof"), """
        SELECT t.user_id, t.item_id, t.weight, u.v AS user_v, p.v AS pos_v, p.idx
        FROM train t JOIN ivec p ON p.item_id = t.item_id JOIN uprof u ON u.user_id = t.user_id"""),
    "val_rows": (("split", "ivec", "uprof"), f"""
        SELECT t.user_id, t.item_id, t.weight, coalesce(u.v, {_standin_sql('t.user_id')}) AS user_v, p.v AS pos_v, p.idx
        FROM split t JOIN ivec p ON p.item_id = t.item_id LEFT JOIN uprof u ON u.user_id = t.user_id
        WHERE t.split = 'val'"""),
    "tri_rows_negs": (("tri_rows", "ivec", "train"), _negs_sql("tri_rows")),
    "val_rows_negs": (("val_rows", "ivec", "train"), _negs_sql("val_rows")),
    "triples": (("tri_rows_negs",), _triples_sql("tri_rows")),
    "val_triples": (("val_rows_negs",), _triples_sql("val_rows")),
    "tri_s": (("triples",), _scores_sql("triples")),
    "val_s": (("val_triples",), _scores_sql("val_triples")),
})


def _standin(key):
    raw = F.transform(F.sequence(F.lit(0), F.lit(63)),
                      lambda j: F.pmod(key * 7919 + (j + 1) * 104729, F.lit(2003)) / F.lit(1001.5) - F.lit(1.0))
    return V.l2_normalize(raw)


SCORES, DISTANCES = ("_pos", "_negs"), ("_d_pos", "_d_negs")


def triples(c: Context, part: str = "train", columns: tuple[str, ...] = SCORES + DISTANCES):
    """``columns`` and weights: scores and distances of every row of ``part`` whose user has an unseen item: between the user's
    vector (unit mean of the vectors of its training items, else the stand-in of its id) and the item's
    (visual where it has one, else the stand-in of its id), and between the user's and those of four items
    the user has not touched in training.  These are the first four at 37 j places after the item, j =
    1..12; a row that finds fewer there takes the user's next unseen items in order of place (fewer than
    four only where the user has left fewer)."""
    numbered, n = with_positions(c.items.select("item_id"), [F.col("item_id")], name="_p")
    vec = materialize(numbered.join(c.unit_vectors.select("item_id", "v"), "item_id", "left")
                      .select("item_id", (F.col("_p") - 1).alias("idx"),
                              F.coalesce("v", _standin(F.col("item_id"))).alias("v")), "item-vectors")
    own = materialize(c.train.select("user_id", "item_id").join(vec.select("item_id", "idx").distinct(), "item_id").select("user_id", "idx"), "own-places")
    trained = R.mean_vectors_by_block(own, vec.select("idx", "v")).select("user_id", V.l2_normalize("v").alias("user_v"))
    rows = materialize(c.part(part).select("user_id", "item_id", "weight").join(vec.select("item_id", "idx"), "item_id"), "triple-rows")
    users = materialize(rows.select("user_id").distinct().join(trained, "user_id", "left")
                        .select("user_id", F.coalesce("user_v", _standin(F.col("user_id"))).alias("v")), "user-vectors")
    seen = materialize(own.distinct(), "seen-places")
    # the draws serve nearly all rows; those that are still short walk on
    draws = F.array(*[F.pmod(F.col("idx") + NEG_STEP * j, F.lit(n)) for j in range(1, N_DRAWS + 1)])
    # an item with more than one vector has its rows, and so its draws, as often
    once = rows.groupBy("user_id", "item_id", "idx").agg(F.count(F.lit(1)).cast("int").alias("m"))
    draws = F.flatten(F.transform(draws, lambda x: F.array_repeat(x, F.col("m"))))
    drawn = materialize(SP.unseen_draws(once.select("user_id", "item_id", "idx", "m", F.lit("").alias("grp"), draws.alias("draws")),
                                        seen.withColumn("grp", F.lit("")), N_NEG).drop("draws", "grp"), "draws")
    short = drawn.filter(F.size("places") < N_NEG).select("user_id", "item_id", "idx", F.explode(F.array_repeat(F.lit(0), F.col("m")))).drop("col")
    places = drawn.filter(F.size("places") == N_NEG).select("user_id", "item_id", F.posexplode("places").alias("slot", "idx")) \
        .select("user_id", "item_id", (F.col("slot") + 1).cast("long").alias("slot"), "idx") \
        .unionByName(SP.unseen_after(short, seen, n, N_NEG))
    # slot 0 is the row's own item
    pairs = materialize(rows.select("user_id", "item_id", F.lit(0).cast("long").alias("slot"), F.col("weight").cast("double").alias("weight"), "idx")
                        .unionByName(places.select("user_id", "item_id", "slot", F.lit(0.0).alias("weight"), "idx")), "triple-pairs")
    release(rows, drawn, own, seen)

    def lists(scored):
        met = scored.groupBy("user_id", "item_id").agg(
            F.collect_list(F.when(F.col("slot") == 0, F.struct("weight", "s", "d"))).alias("_p"),
            F.sort_array(F.collect_list(F.when(F.col("slot") > 0, F.struct("slot", "s", "d")))).alias("_l"))
        return met.filter(F.size("_l") > 0).select("user_id", "item_id", F.explode("_p").alias("_o"), "_l").select(
            "user_id", "item_id", "_o.weight", F.col("_o.s").alias("_pos"), F.col("_o.d").alias("_d_pos"),
            F.transform("_l", lambda e: e["s"]).alias("_negs"), F.transform("_l", lambda e: e["d"]).alias("_d_negs")) \
            .select("user_id", "item_id", "weight", *columns)
    out = R.pair_scores(pairs, users, vec.select("idx", "v"), lists)
    release(pairs, users, vec)
    return out


LSE = "list_max({a}) + ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a})))))"


def _lse(a: str) -> str:
    return LSE.format(a=a)


INFONCE_SQL = with_views(f"""
    SELECT round(avg(weight * ({_lse('lg')} - pos / 0.1)), 6) AS loss FROM (
      SELECT weight, pos, list_prepend(pos / 0.1, list_transform(negs, lambda x: x / 0.1)) AS lg FROM tri_s)""",
    "tri_s")


@query("loss_infonce", INFONCE_SQL)
def loss_infonce(spark, d):
    """L1 over all training triples, T = 0.1, weighted by interaction weight."""
    return M.loss_infonce(triples(Context(spark, d), columns=SCORES)).select(r6("loss").alias("loss"))


BPR_SQL = with_views("""
    SELECT round(avg(weight * list_avg(list_transform(negs, lambda n:
             ln(1 + exp(-abs(pos - n))) + greatest(-(pos - n), 0.0)))), 6) AS loss FROM tri_s""", "tri_s")


@query("loss_bpr", BPR_SQL)
def loss_bpr(spark, d):
    """L2: BPR, margin 0."""
    return M.loss_bpr(triples(Context(spark, d), columns=SCORES)).select(r6("loss").alias("loss"))


SOFTMAX_SQL = with_views(f"""
    SELECT round(avg(weight * ({_lse('lg')} - pos)), 6) AS loss FROM (
      SELECT weight, pos, list_prepend(pos, negs) AS lg FROM tri_s)""", "tri_s")


@query("loss_sampled_softmax", SOFTMAX_SQL)
def loss_sampled_softmax(spark, d):
    """L3: sampled softmax, T = 1."""
    return M.loss_sampled_softmax(triples(Context(spark, d), columns=SCORES)).select(r6("loss").alias("loss"))


DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"

TRIPLET_SQL = with_views(f"""
    SELECT round(avg(weight * greatest({DIST.format(a='user_v', b='pos_v')}
                     - list_min(list_transform(neg_v, lambda n: {DIST.format(a='user_v', b='n')})) + 1.0, 0.0)), 6)
           AS loss FROM triples""", "triples")


@query("loss_triplet", TRIPLET_SQL)
def loss_triplet(spark, d):
    """L4: triplet margin 1.0 against the closest negative."""
    return M.loss_triplet(triples(Context(spark, d), columns=DISTANCES)).select(r6("loss").alias("loss"))


MT_WEIGHTS = {"infonce": 1.0, "bpr": 0.5, "triplet": 0.25}  # sampled_softmax keeps the default 1.0
MT_LOGVARS = {"infonce": 0.0, "bpr": 0.5}


def _mt_sql() -> str:
    losses = {
        "infonce": f"(SELECT avg(weight * ({_lse('lg')} - pos / 0.1)) FROM (SELECT weight, pos, "
                   "list_prepend(pos / 0.1, list_transform(negs, lambda x: x / 0.1)) AS lg FROM tri_s))",
        "bpr": "(SELECT avg(weight * list_avg(list_transform(negs, lambda n: ln(1 + exp(-abs(pos - n))) "
               "+ greatest(-(pos - n), 0.0)))) FROM tri_s)",
        "sampled_softmax": f"(SELECT avg(weight * ({_lse('lg')} - pos)) FROM (SELECT weight, pos, "
                           "list_prepend(pos, negs) AS lg FROM tri_s))",
        "triplet": f"(SELECT avg(weight * greatest({DIST.format(a='user_v', b='pos_v')} - list_min("
                   f"list_transform(neg_v, lambda n: {DIST.format(a='user_v', b='n')})) + 1.0, 0.0)) FROM tri_s)",
    }
    fixed = " + ".join(f"{MT_WEIGHTS.get(t, 1.0)} * {q}" for t, q in losses.items())
    unc = " + ".join((f"exp(-{MT_LOGVARS[t]}) * {q} + {MT_LOGVARS[t]}" if t in MT_LOGVARS
                      else f"{MT_WEIGHTS.get(t, 1.0)} * {q}") for t, q in losses.items())
    return with_views(f"SELECT round({fixed}, 6) AS total_fixed, round({unc}, 6) AS total_uncertainty", "tri_s")


@query("loss_multitask", _mt_sql())
def loss_multitask(spark, d):
    """Weighted sum of the four losses, and the uncertainty-weighted form."""
    t = triples(Context(spark, d))
    parts = [M.loss_infonce(t).select(F.lit("infonce").alias("task"), "loss"),
             M.loss_bpr(t).select(F.lit("bpr").alias("task"), "loss"),
             M.loss_sampled_softmax(t).select(F.lit("sampled_softmax").alias("task"), "loss"),
             M.loss_triplet(t).select(F.lit("triplet").alias("task"), "loss")]
    losses = parts[0]
    for p in parts[1:]:
        losses = losses.unionByName(p)
    w = spark.createDataFrame(list(MT_WEIGHTS.items()), "task string, w double")
    s = spark.createDataFrame(list(MT_LOGVARS.items()), "task string, s double")
    out = M.loss_multitask(losses, w, s)
    return out.select(r6("total_fixed").alias("total_fixed"), r6("total_uncertainty").alias("total_uncertainty"))


VAL_SQL = with_views("""
    SELECT round(avg(CASE WHEN pos > list_avg(negs) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
           round(avg(1.0 / (1 + len(list_filter(negs, lambda n: n >= pos)))), 6) AS mrr,
           round(avg(pos), 6) AS mean_pos_score,
           round(sum(list_sum(negs)) / sum(len(negs)), 6) AS mean_neg_score,
           round(avg(pos) - sum(list_sum(negs)) / sum(len(negs)), 6) AS margin
    FROM val_s""", "val_s")


@query("validation_metrics", VAL_SQL)
def validation_metrics(spark, d):
    """V1 over the validation rows."""
    out = M.validation_metrics(triples(Context(spark, d), "val", SCORES))
    return out.select(*[r6(c).alias(c) for c in ("accuracy", "mrr", "mean_pos_score", "mean_neg_score",
                                                  "margin")])


# ---------------------------------------------------------------- C1-C4 (rows-only checks)


def _codes(c: Context):
    users = prep.vocabulary(c.interactions, "user_id", code="user_code")
    items = prep.vocabulary(c.items, "item_id", code="item_code")
    return users, items


@query("als_factors")
def als_factors(spark, d):
    """Implicit ALS (rank 16, 5 iterations) on the training interactions;
    user and item factors in one long table (kind, id, v)."""
    c = Context(spark, d)
    users, items = _codes(c)
    uf, itf = M.fit_als(c.train, users, items, rank=16, max_iter=5)
    return (uf.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "v")
              .unionByName(itf.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "v")))


PATIENCE = 2


@query("model_select")
def model_select(spark, d):
    """Fit ALS for settings of growing size, score each on validation triples (InfoNCE,
    random negatives), keep the lowest; stop after ``PATIENCE`` settings without a better
    one.  The loop runs on the driver and moves one number per setting; a setting's written tables are deleted."""
    c = Context(spark, d)
    users, items = _codes(c)
    val = c.part("val")
    negs = materialize(SP.negatives_random(val, c.items, n=N_NEG, seed=7), "val-negatives")
    rows, since = [], 0
    for rank in (4, 8, 16, 32):
        for reg in (0.1, 0.01):
            uf, itf = M.fit_als(c.train, users, items, rank=rank, max_iter=5, reg=reg)
            with shuffles_dropped(spark):
                loss = M.loss_infonce(M.factor_triples(val, uf, itf, negs)).first()["loss"]
            release(uf, itf)
            loss = float(loss) if loss is not None else float("inf")
            since = 0 if all(loss < r[2] for r in rows) else since + 1
            rows.append((rank, reg, loss))
            if since == PATIENCE:
                break
        if since == PATIENCE:
            break
    best = min(rows, key=lambda r: r[2])
    return spark.createDataFrame([(r, g, x, (r, g, x) == best) for r, g, x in rows],
                                 "rank int, reg double, val_loss double, chosen boolean")


def _item_tower(c: Context):
    codes = {}
    for col, name in (("item_id", "item"), ("category", "category"), ("brand", "brand"),
                      ("condition_id", "condition"), ("size_id", "size")):
        voc = prep.vocabulary(c.items, col, start=1, code=f"{name}_code", bounded=(name != "item"))
        codes[name] = voc
    feats = c.items.select("item_id", "category", "brand", "condition_id", "size_id", "price")
    feats = prep.price_normalized(feats)
    for col, name in (("item_id", "item"), ("category", "category"), ("brand", "brand"),
                      ("condition_id", "condition"), ("size_id", "size")):
        tab = M.id_embedding_table(codes[name], f"{name}_code", M.ITEM_EMB[name], name)
        feats = (feats.join(codes[name], col).join(tab, f"{name}_code").withColumnRenamed("e", f"{name}_e"))
    feats = prep.vector_left_fill(feats, c.vectors, 64).withColumnRenamed("v", "visual")
    n_in = sum(M.ITEM_EMB.values()) + 1 + 64
    layers = M.mlp_weights(n_in, M.ITEM_HIDDEN, M.OUTPUT_DIM, seed=1)
    vis = M.mlp_weights(64, (128,), 64, seed=2)
    vis_layers = [(vis[0][0], vis[0][1]), (vis[1][0], vis[1][1])]
    return M.tower_inference(feats, "item_id", [f"{n}_e" for n in M.ITEM_EMB], ["price_normalized"],
                             layers, visual="visual", visual_layers=vis_layers)


@query("item_tower_embed", with_views("SELECT item_id, 32 AS dim, 1.0::DOUBLE AS norm FROM items_c", "items_c"))
def item_tower_embed(spark, d):
    """Item tower over the whole catalogue (stand-in weights, seeded): id,
    category, brand, condition and size embeddings (joined tables), scaled price
    and the projected visual vector through Linear/LayerNorm/ReLU to a unit
    32-vector.  Output: item_id, dim, norm."""
    out = _item_tower(Context(spark, d))
    return out.select("item_id", F.size("v").alias("dim"), r6(V.norm("v")).alias("norm"))


@query("user_tower_embed", with_views("SELECT DISTINCT user_id, 32 AS dim, 1.0::DOUBLE AS norm FROM inter", "inter"))
def user_tower_embed(spark, d):
    """C4: user tower: user id embedding + 3 category and 2 brand preference
    embeddings (padding code 0) -> unit 32-vector.  Output: user_id, dim, norm."""
    c = Context(spark, d)
    ucodes = prep.vocabulary(c.interactions, "user_id", start=1, code="user_code")
    feats = FT.user_top_attribute(c.interactions, c.items, "category", 3).join(
        FT.user_top_attribute(c.interactions, c.items, "brand", 2), "user_id", "left").fillna(0)
    feats = feats.join(ucodes, "user_id")
    tab = M.id_embedding_table(ucodes, "user_code", M.USER_EMB["user"], "user")
    feats = feats.join(tab, "user_code").withColumnRenamed("e", "user_e")
    n_cat = c.items.select("category").distinct().count()
    n_brand = c.items.select("brand").distinct().count()
    cat_codes = spark.range(0, n_cat + 1).withColumnRenamed("id", "code")
    br_codes = spark.range(0, n_brand + 1).withColumnRenamed("id", "code")
    cat_t = M.id_embedding_table(cat_codes, "code", M.USER_EMB["pref"], "ucat")
    br_t = M.id_embedding_table(br_codes, "code", M.USER_EMB["pref"], "ubrand")
    parts = ["user_e"]
    for col, t, n in (("category_1", cat_t, n_cat), ("category_2", cat_t, n_cat), ("category_3", cat_t, n_cat),
                      ("brand_1", br_t, n_brand), ("brand_2", br_t, n_brand)):
        # vocabulary-sized tables whose row count is known
        tab_c = bounded_broadcast(t.select(F.col("code").alias(col), F.col("e").alias(f"{col}_e")),
                                  known_rows=n + 1)
        feats = feats.join(tab_c, col)
        parts.append(f"{col}_e")
    n_in = M.USER_EMB["user"] + 5 * M.USER_EMB["pref"]
    layers = M.mlp_weights(n_in, M.USER_HIDDEN, M.OUTPUT_DIM, seed=3)
    out = M.tower_inference(feats, "user_id", parts, [], layers)
    return out.select("user_id", F.size("v").alias("dim"), r6(V.norm("v")).alias("norm"))


# ---------------------------------------------------------------- trained towers

TOWER_EPOCHS, TOWER_STEPS, TOWER_RATE = 3, 2, 0.01


def _trained(c: Context) -> TR.State:
    """Towers trained on the training part.  The run is kept under a folder of the application, so a
    second query over the same tables goes on from its last epoch, that is, reads it."""
    root = (f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/two-tower-{c.spark.sparkContext.applicationId}-"
            f"{zlib.crc32(c.sf_dir.encode())}")
    towers = {"user": TW.user_tower(), "item": TW.item_tower(64)}
    state = TR.finished(c.spark, root, towers, TOWER_EPOCHS)
    if state:
        return state
    users, items, sizes = TR.feature_tables(c.train, c.interactions, c.items, c.vectors, c.as_of, 64)
    state = TR.new_state(users, items, sizes, towers, TOWER_RATE)
    val = c.part("val")
    ex = materialize(TR.examples(c.train, SP.negatives_mixed(c.train, c.items, n=N_NEG, ratio=0.3, seed=42)), "tower-examples")
    negs = materialize(SP.negatives_random(val, c.items, n=N_NEG, seed=7), "tower-negatives")
    return TR.fit(state, ex, val, negs, root, TOWER_EPOCHS, TOWER_STEPS)


@query("two_tower_train")
def two_tower_train(spark, d):
    """Both towers trained by weighted InfoNCE; one row an epoch."""
    state = _trained(Context(spark, d))
    cols = ("epoch", "train_loss", "val_loss", "accuracy", "mrr", "rate", "is_best")
    return spark.createDataFrame([tuple(h[x] for x in cols) for h in state.history],
                                 "epoch int, train_loss double, val_loss double, accuracy double, mrr double, rate double, is_best boolean")


@query("two_tower_vectors", with_views("""
    SELECT 'user' AS kind, count(DISTINCT user_id)::BIGINT AS n, 32 AS dim, 1.0::DOUBLE AS least_norm, true AS loss_falls FROM inter
    UNION ALL SELECT 'item', count(*)::BIGINT, 32, 1.0::DOUBLE, true FROM items_c""", "inter", "items_c"))
def two_tower_vectors(spark, d):
    """Trained vectors of all users and items; whether each epoch's training loss is below the one before."""
    state = _trained(Context(spark, d))
    losses = [h["train_loss"] for h in state.history]
    falls = all(a > b for a, b in zip(losses, losses[1:]))
    rows = [v.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("dim"), r6(F.min(V.norm("vec"))).alias("least_norm"))
            .select(F.lit(k).alias("kind"), "n", "dim", "least_norm", F.lit(falls).alias("loss_falls")) for k, v in state.output().items()]
    return rows[0].unionByName(rows[1])


@query("evaluate_two_tower")
def evaluate_two_tower(spark, d):
    """R5 and M1-M8 on trained vectors: the top 20 unseen items of every training user, beside the popular list."""
    from recsift.operators import evaluation as EV
    c = Context(spark, d)
    out = _trained(c).output()
    users = out["user"].select(F.col("id").alias("qid"), F.col("vec").alias("v")).join(c.train_users.withColumnRenamed("user_id", "qid"), "qid")
    items = materialize(out["item"].select(F.col("id").alias("item_id"), F.col("vec").alias("v")), "tower-items")
    ex = c.train.select(F.col("user_id").alias("qid"), "item_id")
    recs = R.knn(users, items, REC_K, "dot", exclusions=ex).select(F.col("qid").alias("user_id"), "rank", "item_id", "score")
    rows = [EV.evaluate_all(r, c.truth, KS).withColumn("model", F.lit(n)) for n, r in (("two_tower", materialize(recs, "tower-recs")),
                                                                                      ("popular", c.pop_recs))]
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------- N1-N3 (rows-only checks)


@query("negatives_random")
def negatives_random(spark, d):
    """4 hash-drawn negatives per training positive, the user's items excluded."""
    c = Context(spark, d)
    return SP.negatives_random(c.train, c.items, n=N_NEG, seed=42)


@query("negatives_hard")
def negatives_hard(spark, d):
    """round(4 * 0.3) = 1 negative per positive from the positive's category."""
    c = Context(spark, d)
    return SP.negatives_hard(c.train, c.items, n=N_NEG, ratio=0.3, seed=42)


@query("negatives_violations", """
    SELECT kind, 0::BIGINT AS seen, 0::BIGINT AS repeated, 0::BIGINT AS short, 0::BIGINT AS other_category
    FROM (VALUES ('random'), ('hard'), ('mixed')) v(kind)""")
def negatives_violations(spark, d):
    """Rows that break a rule: a negative the user has seen, one drawn twice for a positive,
    a positive with fewer than are due and could be drawn, a hard negative of another category."""
    c = Context(spark, d)
    it = c.items.select("item_id", "category")
    seen = c.train.select("user_id", F.col("item_id").alias("neg_item_id")).distinct()
    # unseen items of the user, in all and per category of the positive
    n_items = it.count()
    per_user = seen.join(it.withColumnRenamed("item_id", "neg_item_id"), "neg_item_id")
    all_left = per_user.groupBy("user_id").agg((F.lit(n_items) - F.count(F.lit(1))).alias("left"))
    cat_left = per_user.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("_s")) \
        .join(it.groupBy("category").agg(F.count(F.lit(1)).alias("_n")), "category") \
        .select("user_id", "category", (F.col("_n") - F.col("_s")).alias("left"))
    pos = c.train.select("user_id", "item_id").distinct().join(it, "item_id")
    out = None
    for kind, due, negs in (("random", N_NEG, SP.negatives_random(c.train, c.items, n=N_NEG, seed=42)),
                            ("hard", 1, SP.negatives_hard(c.train, c.items, n=N_NEG, ratio=0.3, seed=42)),
                            ("mixed", N_NEG, SP.negatives_mixed(c.train, c.items, n=N_NEG, ratio=0.3, seed=42))):
        negs = materialize(negs.select("user_id", "item_id", "neg_item_id"), f"negatives-{kind}")
        have = negs.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("neg_item_id").alias("u"))
        left = pos.join(cat_left, ["user_id", "category"]) if kind == "hard" else pos.join(all_left, "user_id")
        due_rows = left.select("user_id", "item_id", F.least(F.lit(due), F.col("left")).alias("due"))
        counts = due_rows.join(have, ["user_id", "item_id"], "left").agg(
            F.sum(F.coalesce(F.col("n") - F.col("u"), F.lit(0))).cast("long").alias("repeated"),
            F.sum(F.greatest(F.col("due") - F.coalesce("n", F.lit(0)), F.lit(0))).cast("long").alias("short"))
        bad = negs.join(seen, ["user_id", "neg_item_id"], "left_semi").agg(F.count(F.lit(1)).alias("seen"))
        wrong = (negs.join(it, "item_id").join(it.select(F.col("item_id").alias("neg_item_id"), F.col("category").alias("_c")),
                                               "neg_item_id").filter("category <> _c") if kind == "hard" else negs.limit(0))
        wrong = wrong.agg(F.count(F.lit(1)).alias("other_category"))
        one = F.lit(1).alias("_k")
        row = counts.select("*", one).join(bad.select("*", one), "_k").join(wrong.select("*", one), "_k") \
            .select(F.lit(kind).alias("kind"), "seen", "repeated", "short", "other_category")
        out = row if out is None else out.unionByName(row)
    return out


def _als(c: Context):
    """Learned vectors of rank 32 of all users and items of the training part, written once."""
    users, items = _codes(c)
    return M.fit_als(c.train, users, items, rank=32, max_iter=5)


@query("als_shape", with_views("""
    SELECT 'user' AS kind, count(DISTINCT user_id)::BIGINT AS n, 32 AS dim FROM train
    UNION ALL SELECT 'item', count(DISTINCT item_id)::BIGINT, 32 FROM train""", "train"))
def als_shape(spark, d):
    """Every user and item of the training part has a learned vector of rank 32."""
    uf, itf = _als(Context(spark, d))
    out = [f.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("dim")).select(F.lit(k).alias("kind"), "n", "dim")
           for k, f in (("user", uf), ("item", itf))]
    return out[0].unionByName(out[1])


def _als_recs(c: Context, k: int):
    uf, itf = _als(c)
    ex = c.train.select(F.col("user_id").alias("qid"), "item_id")
    # learned vectors differ in norm: most blocks are out of reach
    return B.search(uf.select(F.col("user_id").alias("qid"), "v"), B.build_blocks(itf), k, ex)[0]


@query("recommend_als")
def recommend_als(spark, d):
    """R5 on learned vectors: top 20 unseen items of every user by user and item factors."""
    return _als_recs(Context(spark, d), 20).select(F.col("qid").alias("user_id"), "rank", "item_id", r6("score").alias("score"))


@query("evaluate_als")
def evaluate_als(spark, d):
    """M1-M8 of the learned recommendations (k = 100) on the test part."""
    from recsift.operators import evaluation as EV
    c = Context(spark, d)
    recs = materialize(_als_recs(c, 100).select(F.col("qid").alias("user_id"), "rank", "item_id", "score"), "als-recs")
    return EV.evaluate_all(recs, c.truth, (10, 50, 100))


@query("similar_items_learned")
def similar_items_learned(spark, d):
    """R6 on learned vectors: every trained item's 10 nearest other items by cosine."""
    _, itf = _als(Context(spark, d))
    q = itf.select(F.col("item_id").alias("qid"), "v")
    return R.knn(q, itf, 10, "cosine", exclusions=q.select("qid", F.col("qid").alias("item_id"))) \
        .select("qid", "rank", "item_id", r6("score").alias("score"))


@query("training_examples")
def training_examples(spark, d):
    """Positive with its item features, the features of its negatives (0.3 of them hard), the weight."""
    c = Context(spark, d)
    negs = SP.negatives_mixed(c.train, c.items, n=N_NEG, ratio=0.3, seed=42)
    feats = FT.item_features(c.items, None, c.as_of)
    out = SP.training_examples(c.train, negs, feats)
    return out.select("user_id", "item_id", "weight", F.to_json("pos_features").alias("pos_features"),
                      F.size("negatives").alias("n_negatives"), F.to_json("negatives").alias("negatives"))
