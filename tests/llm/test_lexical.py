"""Ranked search against a plain scan of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from recsift.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if i is not None}:
        scored = []
        for d, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    return sorted(out, key=repr)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, n long, row string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, slot int")
    out = X.search(d, b)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, n_docs=300, n_items=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["thé", "Ünd", "der"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: " ".join(rng.choices(words, weights, k=k))
    return [(i, text(rng.randrange(1, 80))) for i in range(n_docs)], [(i, text(rng.randrange(1, 40))) for i in range(n_items)]


@pytest.mark.parametrize("joined", [False, True])
def test_ranks(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(X, "VOCABULARY_BYTES", 0)
        monkeypatch.setattr(X, "BLOCK", 50)
        monkeypatch.setattr(X, "SLICE", 30)
    monkeypatch.setattr(X, "STEP", 4)
    docs, items = corpus(1)
    assert found(spark, docs, items) == brute(docs, items)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "STEP", 1)
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Alpha beta"), (5, "ALPHA, beta!"), (None, "alpha beta"), (6, "alpha " * 60_000),
            (7, "Éa éa é"), (8, "x1 x1 x2_x3"), (9, "Kelvin K k")] + [(100 + i, "copy of alpha text") for i in range(40)] + [(4, "Alpha beta")] * 2
    items = [(1, "alpha BETA beta"), (1, "alpha BETA beta"), (1, "copy"), (2, None), (3, ""), (4, "nowhere"), (None, "alpha"), (5, "Éa é x3 x2"),
             (6, "k K"), (7, " ".join(f"t{i}" for i in range(200)) + " alpha copy x1")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, " ")], [(1, "a")]) == []


def test_long_items_have_masks_of_several_words(spark):
    docs, _ = corpus(2)
    items = [(1, " ".join(f"W{i}" for i in range(60)) + " thé der " + " ".join(f"z{i}" for i in range(100)))]
    docs += [(1000 + i, f"z{i} z{i + 1} w{i % 60}") for i in range(100)]
    assert found(spark, docs, items) == brute(docs, items)
