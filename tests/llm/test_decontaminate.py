"""Contaminated documents against exact edit distances over all stretches; measured recall."""

import random

import numpy as np

from recsift.llm import decontaminate as D


def distance(item, text):
    """Least edit distance of ``item`` to a stretch of ``text``."""
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(cost[j] + 1, cost[j - 1] + (w != x), new[-1] + 1))
        cost = new
    return min(cost)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        how = rng.randrange(3)
        if how == 0:
            w[k] = f"z{rng.randrange(999)}"
        elif how == 1:
            w.insert(k, f"y{rng.randrange(999)}")
        else:
            del w[k]
    return w


def corpus(seed, items=40, docs=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = ["the", "of", "and", "in", "on"]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    bench = [words(rng.randrange(12, 60)) for _ in range(items)]
    out = []
    for k in range(docs):
        filler = words(rng.randrange(0, 300))
        if k % 2:
            w = bench[rng.randrange(items)]
            at = rng.randrange(len(filler) + 1)
            filler[at:at] = edited(rng, w, rng.randrange(0, D.allowed(len(w)) + 3))
        out.append(filler)
    return bench, out


def test_pairs_and_recall(spark):
    found = wanted = 0
    for seed in range(3):
        bench, docs = corpus(seed)
        table = spark.createDataFrame([(i, " ".join(w).title(), "x") for i, w in enumerate(docs)], "doc_id long, text string, item_id string")
        items = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(bench)], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.findings(table, items).collect()}
        want = {(i, k): d for i, w in enumerate(docs) for k, b in enumerate(bench)
                if (d := distance(b, w)) <= D.allowed(len(b))}
        assert all(want.get(p) is not None for p in got)  # nothing that is not within the distance
        assert sum(got[p] != want[p] for p in got) <= 1
        found, wanted = found + len(got), wanted + len(want)
    print("recall", found, wanted)
    assert wanted > 150 and found >= 0.95 * wanted


def test_documents(spark, small_dir):
    """Every verbatim passage of the test tables is found, and what is found is verified."""
    docs = {r["doc_id"]: D.words_of(r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    bench = {r["item_id"]: D.words_of(r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in D.op8_contaminated_documents(spark, small_dir).collect()}
    verbatim = {(i, k) for i, w in docs.items() for k, b in bench.items()
                if f" {' '.join(b)} " in f" {' '.join(w)} "}
    assert verbatim and verbatim <= got
    assert all(distance(bench[k], docs[i]) <= D.allowed(len(bench[k])) for i, k in got)


def test_best_stretch():
    rng = random.Random(2)
    for _ in range(100):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        edits, start = D.best_stretch(np.array(item), np.array(text))
        assert edits == distance(item, text)
        assert 0 <= start <= len(text)


def test_edge_rows(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, item.upper(), 1), (3, item.upper(), 1), (None, f"x {item} y", 1),
                                  (4, "pad " * 50_000 + item, 1), (5, item.replace("gamma", ""), 1), (6, "alpha beta gamma", 1)],
                                 "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "too short"), (None, item)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["edits"]) for r in D.findings(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted([(i, k, e) for i, e in ((3, 0), (3, 0), (None, 0), (4, 0), (5, 1)) for k in (7, None)], key=repr)
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6]
    assert D.findings(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == 8
    assert D.findings(docs.limit(0), bench).count() == 0
    # a benchmark of several slices gives the same
    monkeypatch.setattr(D, "SLICE_WORDS", 12)
    again = [(r["doc_id"], r["item_id"], r["edits"]) for r in D.findings(docs, bench).collect()]
    assert sorted(again, key=repr) == sorted(got, key=repr)


def test_short_items_are_found_whole_and_marked(spark):
    bench = spark.createDataFrame([(1, "What now?"), (2, "Paris"), (3, "日本の首都は東京です"), (4, "one two three four"), (5, ""), (6, "what NOW")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(10, "so what now then, what now"), (11, "what is now"), (12, "what now"), (13, "PARIS!"), (14, "in paris we met"),
                                  (15, "問題: 日本の首都は東京です。"), (16, "日本の首都は大阪"), (17, "one two three"), (18, "two one two three four"),
                                  (19, None), (20, "what"), (21, "now")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["short"]) for r in D.findings(docs, bench).collect()}
    assert got == {(10, 1): (1, True), (10, 6): (1, True), (12, 1): (0, True), (12, 6): (0, True), (13, 2): (0, True), (14, 2): (1, True),
                   (15, 3): (2, False), (18, 4): (1, True)}
    assert {r["doc_id"] for r in D.clean(docs, bench).collect()} == {10, 11, 14, 16, 17, 18, 19, 20, 21}
