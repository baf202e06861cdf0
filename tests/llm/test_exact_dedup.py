"""Exact deduplication against a plain dictionary; state over several streams; a weak digest."""

import hashlib

import pyarrow as pa

from recsift.llm import exact_dedup as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for norm, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        h = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, h) for i in ids]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=repr)


ROWS = [(1, "A b"), (2, "a B"), (3, "a  b"), (4, None), (5, ""), (6, "É"), (7, "é"), (7, "é"), (None, "a b"), (None, "only"),
        (8, "long " * 100_000), (9, "LONG " * 100_000), (10, "K"), (11, "k")] + [(20 + i, "hot") for i in range(60)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, locator int")


def test_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got(D.op7_exact_dedup(spark, small_dir)) == brute([tuple(r) for r in docs])


def test_edge_rows(spark):
    assert got(D.groups(table(spark, ROWS))) == brute(ROWS)


def test_deduplicate_keeps_one_row_of_each_text(spark):
    docs = table(spark, ROWS)
    out = D.deduplicate(docs)
    assert out.columns == docs.columns
    texts = [(r["text"] or "").translate(LOWER) for r in out.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t in ROWS})
    ids = {r["doc_id"] for r in out.collect()}
    assert {2, 5, 7, 9, 79, None} <= ids and 1 not in ids


def test_weak_digest_is_caught_by_the_bytes(spark):
    rows = [(1, "ab"), (2, "cd"), (3, "AB"), (4, "xyz"), (5, "cd"), (6, "ab")]
    out = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in
           D.groups(table(spark, rows), digest=lambda b: str(len(b))).collect()}
    assert out == {1: (6, 3), 2: (5, 2), 3: (6, 3), 4: (4, 1), 5: (5, 2), 6: (6, 3)}


def test_calls_on_one_state_compare_bytes(spark, tmp_path):
    """Texts of one length share the weak digest; over two calls each keeps to its own bytes."""
    state, weak = str(tmp_path / "state"), lambda b: str(len(b))
    calls = [[(1, "ab"), (2, "CD"), (3, "xyz")], [(9, "cd"), (4, "ef"), (5, "AB"), (None, "ef"), (8, "XYZ"), (10, "q")]]
    seen = []
    for rows in calls:
        seen += rows
        out = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in D.groups(table(spark, rows), weak, state).collect()}
        want = {(i, k, n) for i, k, n, _, _ in brute(seen) if any(i == j for j, _ in rows)}
        assert out == want


def test_state_names_the_content(spark, tmp_path):
    """The locator of a key leads to its bytes, and hits of later calls go to the first content."""
    state = str(tmp_path / "state")
    D.groups(table(spark, ROWS), state_path=state).count()
    D.groups(table(spark, [(500, "HOT"), (501, "new")]), state_path=state).count()
    content = {r["locator"]: r for r in D._read(spark, f"{state}/content", D.CONTENT).collect()}
    found = D._read(spark, f"{state}/members", "key string, keep_id long, locator string, group_size long, batch long").collect()
    assert all(content[r["locator"]]["digest"] == r["key"] for r in found)
    hot = hashlib.sha256(b"hot").hexdigest()
    last = max((r for r in found if r["key"] == hot), key=lambda r: r["batch"])
    assert (last["keep_id"], last["group_size"]) == (500, 61) and last["locator"].startswith("00000000:")


def test_hits_are_read_by_their_locators(spark):
    texts = spark.createDataFrame([("k", "a", b"x"), ("k", "b", b"x"), ("k", "c", b"y"), ("k", "d", b"z"), ("m", "e", b"q"), ("m", "f", b"q")],
                                  "key string, locator string, norm binary")
    hits = spark.createDataFrame([("k", "b", "a"), ("k", "c", "a"), ("m", "f", "e")], "key string, locator string, holder string")
    assert [r["locator"] for r in D.differing(texts, hits).collect()] == ["c"]
    assert D.differing(texts, hits.filter("locator <> 'c'")) is None


def test_buffer_of_a_task_may_overflow(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD_BYTES", 300)
    assert got(D.groups(table(spark, ROWS))) == brute(ROWS)


def test_empty_table(spark):
    assert D.groups(table(spark, [])).count() == 0
    assert D.deduplicate(table(spark, [])).count() == 0


def test_a_worker_hands_its_buffer_on_in_small_batches():
    texts = [f"{k} " * (100_000 + k) for k in range(60)] + ["Copy", "copy"]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], names=["doc_id", "text"]) for k, t in enumerate(texts)]
    out = list(D._combined(D.sha256)(iter(batches)))
    assert max(b.nbytes for b in out) < D.ARROW_BYTES + max(map(len, texts)) + 10_000
    found = [r for b in out for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["n"]) for r in found) == [(k, 1) for k in range(60)] + [(61, 2)]
    assert all(r["norm"] == texts[r["doc_id"]].encode().lower() and r["digest"] == D.sha256(r["norm"]) for r in found)
