"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from recsift.llm import near_dedup as N
from recsift.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by_shingle.values() for k, a in enumerate(ids) for b in ids[k + 1:]} if len(rows) < 400 else \
        {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
         if sets[a] and 0.74 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.74}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            r = find(i)
            least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, words string")


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_documents(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert got(N.op6_near_dedup(spark, small_dir)) == want
    assert any(d != c for d, _, c in want)


def test_edge_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    other = [f"v{i}" for i in range(90)]
    texts = [None, "", " \n\t", "one two", "One  TWO", "one two three", " ".join(base), " ".join(base).upper(), "é É ß b c d",
             "x " * 60_000, " ".join(other), " ".join(other + ["tail"] * 4)]
    # chains: each near the next, the ends far apart; ids against the order of the chain
    chain, w = [], list(base)
    for k in range(8):
        w = w[6:] + [f"c{k}_{j}" for j in range(6)]
        chain.append(" ".join(w))
    texts += chain + variants(rng, [f"u{i}" for i in range(150)], 60, 2) + variants(rng, [f"t{i}" for i in range(100)], 40, 3)
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(3, texts[-3]), (None, texts[6]), (None, "all alone here without an id"),
                                                                  (None, "all alone here without an id")]
    assert got(N.groups(table(spark, rows))) == brute(rows)


def test_links_that_stars_cannot_see(spark, monkeypatch):
    """Borderline variants of one text: many pairs of one bucket are not linked to its smallest class."""
    rng = random.Random(11)
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "STAR_PART", 4)
    rows = []
    for g in range(6):
        base = [f"g{g}_{i}" for i in range(120)]
        rows += [(len(rows) + i, t) for i, t in enumerate(variants(rng, base, 14, 3))]
    assert got(N.groups(table(spark, rows))) == brute(rows)


def block(band, sigs, bands, sets, comps, x=0, y=0, mine=None):
    return pd.DataFrame({"bucket": 1, "x": x, "y": y, "mine": mine or [0] * len(sigs), "cid": range(10, 10 + len(sigs)), "comp": comps,
                         "center": 0, "band": band, "sig": sigs, "bands": bands,
                         "shingles": [np.array(sorted(s), np.uint64).tobytes() for s in sets]})


def test_a_pair_is_verified_in_the_first_band_it_really_shares():
    """Two classes agree in every byte of their signatures but share the bands 5 and 9 only."""
    own = [[100 * k + b for b in range(N.BANDS)] for k in range(2)]
    for b in (5, 9):
        for keys in own:
            keys[b] = -b
    sets = [set(range(100)), set(range(5, 105))]
    links = {b: N._block_links([block(b, [bytes(128)] * 2, own, sets, [1, 2])]).values.tolist() for b in (5, 9)}
    assert links == {5: [[11, 10]], 9: []}


def test_a_block_reports_fewer_links_than_classes():
    n = 50
    links = N._block_links([block(0, [bytes(128)] * n, [[7] * N.BANDS] * n, [set(range(100))] * n, list(range(n)))])
    assert len(links) == n - 1
    # two components that are joined already, and one apart
    links = N._block_links([block(0, [bytes(128)] * 6, [[7] * N.BANDS] * 6, [set(range(100))] * 4 + [set(range(60, 160))] * 2, [1, 1, 2, 2, 3, 3])])
    assert len(links) == 1


def test_many_near_copies_below_the_threshold(spark, monkeypatch):
    """Copies of one text, most of whose pairs share a band but are no links: the links stay fewer than the classes."""
    monkeypatch.setattr(N, "BLOCK", 64)
    counts, write = {}, N.materialize

    def counted(df, name):
        out = write(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(N, "materialize", counted)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(260)]
    rows = [(i, t) for i, t in enumerate(variants(rng, base, 250, 9))]
    assert got(N.groups(table(spark, rows))) == brute(rows)
    assert counts["near-links"] <= 32 * 250 and counts["near-open"] <= 32 * 250


def test_deduplicate(spark):
    rng = random.Random(3)
    same = variants(rng, [f"u{i}" for i in range(150)], 10, 1)
    rows = [(i, t) for i, t in enumerate(same)] + [(50, ""), (51, None), (52, "a b"), (53, "A  b"), (53, "A  b"), (None, "a b"),
                                                   (None, "nameless text"), (None, "nameless text")]
    docs = table(spark, rows)
    out = N.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(
        [(0, same[0]), (50, ""), (51, None), (52, "a b"), (None, "nameless text")], key=repr)


def test_empty_table(spark):
    assert N.groups(table(spark, [])).count() == 0
    assert N.deduplicate(table(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.75, 0.9):
        both, n = round(1000 * j), 1000
        x = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2))
        rest = (n - both) // 2
        a, b = x[:both + rest], np.concatenate([x[:both], x[both + rest:both + 2 * rest]])
        est = (N.signature(N._mix(a)) == N.signature(N._mix(b))).mean()
        assert est == pytest.approx(j, abs=0.15)


@pytest.mark.parametrize("per_task", [1_000_000, 7])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr("recsift.llm.components.LINKS_PER_TASK", per_task)
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (12, 10), (7, 7)] + [(100, 100 + i) for i in range(1, 50)]
    rows = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert rows == {**{i: 1 for i in range(2, 6)}, 11: 10, 12: 10, **{100 + i: 100 for i in range(1, 50)}}
