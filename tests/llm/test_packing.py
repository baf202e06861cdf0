"""Pieces against plain tokenization; cuts against all ways to cut; little padding."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recsift.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.default_tokenizer())


def check(rows, docs, tokenizer):
    """Every id of every document lies in one piece, and sequences have no holes; returns padding and tokens."""
    want = {}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [P.END]
        want.setdefault(i, []).append(np.array(ids, "<u4"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for i, texts in want.items():
        if len(texts) > 1:
            assert len(by_doc[i]) % len(texts) == 0
            continue
        ids, at = texts[0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = tokens = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= P.WINDOW
        tokens += at
        padding += 0 if at & (at - 1) == 0 else P.WINDOW - at
    return padding, tokens


def test_documents(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    padding, tokens = check(P.op3_pack_documents(spark, sf).collect(), docs, tokenizer)
    print("padding", padding / tokens)
    assert padding < 0.01 * tokens


def test_edge_rows(spark, tokenizer):
    rng = random.Random(1)
    texts = [None, "", "one. two! three?", "word " * 30_000, "a. " * 9000, "É é <|endoftext|>x y\tz\r\n b it's", "x" * 5000]
    texts += [" ".join(rng.choice("alpha beta. gamma, İstanbul ΣΑΣ 1234".split()) for _ in range(rng.randrange(1500))) for _ in range(50)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "no id. none")]
    table = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, start int, offset string").repartition(3)
    rows = P.pack(table, with_ids=True).collect()
    check(rows, docs, tokenizer)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_are_the_best(monkeypatch):
    monkeypatch.setattr(P, "WINDOW", 12)
    rng = random.Random(4)
    for _ in range(200):
        places = sorted(rng.sample(range(1, 60), rng.randrange(1, 20)))
        full = []
        for p in places:  # no gap larger than a window
            while p - (full[-1] if full else 0) > 12:
                full.append((full[-1] if full else 0) + rng.randrange(1, 13))
            full.append(p)
        kinds = [rng.randrange(3) for _ in full]
        cuts = P.best_cuts(full, kinds, True)

        def cost(ends):
            total, at = 0, 0
            for e in ends:
                if e - at > 12:
                    return 1 << 30
                total += 12 - (e - at) + P.PENALTY[kinds[full.index(e)]]
                at = e
            return total

        best = [0] + [1 << 30] * len(full)
        pos = [0, *full]
        for j in range(1, len(pos)):
            best[j] = min(best[i] + 12 - (pos[j] - pos[i]) + P.PENALTY[kinds[j - 1]] for i in range(j) if pos[j] - pos[i] <= 12)
        assert cuts[-1] == full[-1] and cost(cuts) == best[-1]


def test_tail_parts():
    for n in (1, 2, 3, 1000, 2048, 3072, 4095, 4096):
        parts = P.tail_parts(n)
        assert sum(parts) == n and (len(parts) == 1 or all(x & (x - 1) == 0 for x in parts))
    assert P.tail_parts(2049) == [2048, 1] and P.tail_parts(4095) == [4095]


def test_chunks_are_numbered_and_learned_in_one_pass(tokenizer, monkeypatch):
    """Known chunks cost one lookup: only new ones reach ``_learn``, once each, in the order in which they come."""
    enc, asked = P.Encoder(P.default_tokenizer()), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new, base: (asked.append((list(new), base)), learn(new, base)))
    texts = ["alpha beta. alpha 12-x", None, "beta. İx gamma"]
    for _ in range(2):
        got = [x.tolist() for x in enc.encode(texts)]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [P.END] for t in texts]
    assert asked == [(["alpha", "beta.", "12-x", "İx", "gamma"], 2)]


def test_a_failed_call_leaves_no_numbers_without_ids(tokenizer, monkeypatch):
    enc = P.Encoder(P.default_tokenizer())
    with monkeypatch.context() as m:
        m.setattr(enc, "_learn", lambda new, base: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            enc.encode(["some words"])
    assert enc.encode(["some words"])[0].tolist() == tokenizer.encode("some words", add_special_tokens=False).ids + [P.END]


def test_a_distinct_chunk_is_looked_up_once_a_batch(tokenizer):
    enc = P.Encoder(P.default_tokenizer())
    asked = []

    class Counted(type(enc.index)):
        def __getitem__(self, chunk):
            asked.append(chunk)
            return super().__getitem__(chunk)

        def get(self, chunk, *default):
            asked.append(chunk)
            return super().get(chunk, *default)

    enc.index = Counted(enc.index)
    texts = ["alpha beta. " * 300, "beta. gamma " * 300]
    got = [x.tolist() for x in enc.encode(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [P.END] for t in texts]
    assert sorted(c for c in asked if c is not None) == ["", "alpha", "beta.", "gamma"]


def test_cut_places_of_many_documents_are_those_of_each(tokenizer):
    enc = P.Encoder(P.default_tokenizer())
    texts = ["one. two! three?!", None, "...", "a", "word " * 200 + ". " * 3, "x. y"]
    own = enc.encode(texts)
    stops = np.cumsum([len(x) for x in own])
    places, kinds = P.cut_places(np.concatenate(own), stops, enc.ends)
    want = [P.cut_places(x, np.array([len(x)]), enc.ends) for x in own]
    assert places.tolist() == [p + at for (ps, _), at in zip(want, stops - [len(x) for x in own]) for p in ps.tolist()]
    assert kinds.tolist() == [k for _, ks in want for k in ks.tolist()]
