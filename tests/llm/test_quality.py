"""Quality classifier: held-out accuracy, moments and densities against numpy."""

import zlib

import numpy as np

from recsift.llm import quality as Q


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = Q.op4_quality_scores(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    test = out[out["held_out"]].merge(labels, on="doc_id")
    print("AUC", auc(test["score"].to_numpy(), test["quality"].to_numpy()), "accuracy", (test["predicted"] == test["quality"]).mean())
    assert auc(test["score"].to_numpy(), test["quality"].to_numpy()) > 0.9
    assert (test["predicted"] == test["quality"]).mean() > 0.9


def test_scores_do_not_depend_on_held_out_labels_or_other_columns(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet").toPandas()
    first = Q.score(docs, spark.createDataFrame(labels)).toPandas().sort_values("doc_id")
    hidden = [zlib.crc32(str(i).encode()) % 3 == 1 for i in labels["doc_id"]]
    labels.loc[hidden, "quality"] = 1 - labels.loc[hidden, "quality"]
    again = Q.score(docs.selectExpr("doc_id", "text", "'x' AS lang", "7 AS source", "1 AS quality", "'y' AS x"),
                    spark.createDataFrame(labels)).toPandas().sort_values("doc_id")
    assert np.allclose(first["score"], again["score"], atol=1e-12)


def test_moments_and_density(spark):
    rng = np.random.default_rng(3)
    d = Q.N_STATISTICS
    x = rng.normal(size=(400, d)) @ rng.normal(size=(d, d))
    y = (rng.random(400) < 0.4).astype(int)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "quality int, x array<double>")
    model = Q.fit(rows)
    pooled = sum((y == c).sum() * np.cov(x[y == c].T, bias=True) for c in (0, 1)) / 400
    want = []
    for c in (0, 1):
        cov = Q.shrunk(np.cov(x[y == c].T, bias=True), pooled)
        z = x - x[y == c].mean(axis=0)
        want.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert np.allclose(model.difference(x), want[1] - want[0], atol=1e-6)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "a " * 100_000), (3, "a " * 100_000), (None, "text"), (4, "\n\n"), (5, "!!! ###")]
    docs += [(100 + i, f"A good sentence number {i}, with words." * (i % 5 + 1)) for i in range(60)]
    docs += [(300 + i, "BUY!! NOW!! $$$ " * (i % 7 + 1)) for i in range(60)]
    table = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, _score string")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(300 + i, 0) for i in range(60)] + [(1, None), (None, 1), (300, 0)],
                                   "doc_id long, quality int")
    out = Q.score(table, labels).toPandas()
    assert len(out) == len(docs) and out["score"].between(0, 1).all()
    assert out[out["doc_id"] == 3]["score"].nunique() == 1
    assert out[out["doc_id"].between(100, 200)]["predicted"].mean() > 0.95
    assert out[out["doc_id"] >= 300]["predicted"].mean() < 0.05
    kept = Q.keep_good(table.drop("_score"), labels)
    assert kept.columns == ["doc_id", "text"]
    assert kept.filter("doc_id >= 300").count() <= 3 and kept.filter("doc_id BETWEEN 100 AND 200").count() >= 57
    one_class = Q.score(table, labels.filter("quality = 1")).toPandas()
    assert (one_class["score"] == 0.5).all()
    assert Q.score(table.limit(0), labels).count() == 0
