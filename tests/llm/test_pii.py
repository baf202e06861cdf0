"""Base spans against Python's own matcher; the fitted trees against the model they come from."""

import hashlib
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from recsift.llm import pii as P


def luhn(d):
    return sum(y - 9 if (y := int(x) * (1 + i % 2)) > 9 else y for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))],
        [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]]
    base = [f"{k}:{m.start()}:{m.end()}" for k, ms in zip(("email", "ip", "card", "phone"), kinds, strict=True) for m in ms]
    return (*map(len, kinds), hashlib.sha256(",".join(base).encode()).hexdigest()), base


def check(rows, texts):
    assert len(rows) == len(texts)
    want = sorted(((i, *brute(t)[0]) for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows), key=repr) == want
    base = {i: set(brute(t)[1]) for i, t in texts}
    for r in rows:
        assert base[r["doc_id"]] <= set(r["spans"].split(","))


def test_documents(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(P.op10_personal_data(spark, small_dir).collect(), docs)


def test_edge_rows(spark, tmp_path):
    texts = [None, "", "a@b.c@d.e x@y.z_q@r.st é😀mail me@host.example.org.", "1.2.3.4.5.6.7.8 300.1.2.3 0001.02.3.255 1.2.3 9.9.9.256.1.1.1",
             "4111 1111 1111 1111 4111-1111-1111-1112 " + "0" * 16 + " 12  34", "+1 (017) 555-7713. +1 +1 23 +999999999999999999999 +1-2",
             "9" * 30_000 + "." + "1" * 400 + ".1.1", "a" * 60_000 + "@ b@c.d", "x@" + "y." * 20_000 + "z", "+1" + " " * 50_000 + "2",
             "😀 +44 20 7946 0958 😀 1.1.1.1", "1-" * 20_000, "user [at] host [dot] org"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(4, texts[4], 6), (None, "z@y.xx", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    out = P.op10_personal_data(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    check(out, [(i, t) for i, t, _ in rows])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op10_personal_data(spark, str(tmp_path)).count() == 0


def test_boosting_adds_spans_like_the_ones_it_learned(spark):
    """Local phone numbers with sound area codes are added, those without are not; clean text stays clean."""
    rows = [(i, f"call {200 + i % 700:03d}-{200 + i % 800:03d}-{i % 10000:04d} now, mail u{i}@example.org, at {i % 300}.1.2.{i % 256}")
            for i in range(400)]
    rows += [(1000 + i, f"part 0{i % 100:02d}-0{i % 90:02d}-{i % 10000:04d} in stock 12{i % 10}.4") for i in range(400)] + [(5000, "no data here")]
    out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in
           P.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    good = sum("local_phone" in out[i] for i in range(400))
    bad = sum("local_phone" in out[1000 + i] for i in range(400))
    assert good > 350 and bad <= 8 and out[5000] == []


def test_rare_kinds_and_copies(spark, monkeypatch):
    """A few identity numbers among very many digits and copies are reported where their strict check holds."""
    monkeypatch.setattr(P, "SAMPLE", 200)
    rows = [(i, f"page {i} of {i * 7919} parts, mail u{i}@example.org") for i in range(600)]
    rows += [(1000 + i, "the same 4111 1111 1111 1112 in all copies") for i in range(600)]
    rows += [(2000 + i, f"ssn {100 + i}-45-{6000 + i}") for i in range(6)] + [(2100, "ssn 000-45-6789")]
    out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in
           P.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(out) == len(rows)
    assert all("ssn" in out[2000 + i] for i in range(6)) and "ssn" not in out[2100]


def planted(rng, i):
    """(text, kinds of personal data that it holds beyond the base ones)."""
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    country = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=2))
    account = number(18)
    rest = int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
    iban = f"{country}{98 - rest:02d}{account}"
    good = [(f"call {rng.randrange(200, 1000)}-{rng.randrange(200, 1000)}-{number(4)} today", "local_phone"),
            (f"ssn {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "ssn"), (f"pay to {iban} please", "iban"),
            (f"write to user{i} [at] host [dot] org", "spelled_email"), (f"device {':'.join(f'{rng.randrange(256):02x}' for _ in range(6))} seen", "mac")]
    bad = [f"part 0{number(2)}-0{number(2)}-{number(4)}", f"code 000-{number(2)}-{number(4)}", f"lot {country}{(rest + 50) % 97:02d}{account}",
           f"id {number(12)} and {number(9)}", f"time 00:00:00:00:00:00 {number(3)}", f"version {number(2)}.{number(3)}"]
    return (*good[i // 2 % len(good)],) if i % 2 else (bad[i // 2 % len(bad)], None)


def test_added_spans_on_planted_texts(spark):
    """Precision and recall of the kinds beyond the base ones, on texts whose truth is known."""
    import random
    rng = random.Random(2)
    rows = {i: planted(rng, i) for i in range(2000)}
    df = spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")
    hit = false = 0
    for r in P.detect(df).collect():
        kinds = {s["kind"] for s in r["spans"]} - {"email", "ip", "card", "phone"}
        truth = {rows[r["doc_id"]][1]} - {None}
        hit, false = hit + len(kinds & truth), false + len(kinds - truth)
    assert hit / 1000 >= 0.98 and hit / (hit + false) >= 0.95


def test_a_span_stays_when_other_rows_join(spark):
    one = [(1, "ssn 123-45-6789"), (2, "account 371449635398431 open"), (3, "order 371449635398431 shipped")]
    others = [(100 + i, f"block {i % 900 + 100:03d}-{i % 90 + 10:02d}-0000 and 000-{i % 90 + 10:02d}-{i % 9000 + 1000}") for i in range(300)]
    schema = "doc_id long, text string"
    for rows in (one, one + others):
        out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in P.detect(spark.createDataFrame(rows, schema)).collect()}
        assert out[1] == ["ssn"] and out[2] == ["number"] and out[3] == []


def test_quotas():
    assert P._quotas({0: 30_000, 1: 5, 2: 9_000}) == {1: 5, 2: 9_000, 0: 10_995}
    assert sum(P._quotas({n: 10**6 for n in range(10)}).values()) == P.SAMPLE


def test_tree_expression_equals_the_model(spark):
    df = spark.range(300).select(*[(F.xxhash64("id", F.lit(i)) % 100 / 10.0).alias(f"f{i}") for i in range(4)])
    df = df.withColumn("label", ((F.col("f0") > 1) & (F.col("f1") + F.col("f2") < 3)).cast("double"))
    data = VectorAssembler(inputCols=[f"f{i}" for i in range(4)], outputCol="features").transform(df)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(data)
    score = P.score_expression(model)
    rows = model.transform(data).withColumn("p", score(F.array("f0", "f1", "f2", "f3"))).select("p", "probability").collect()
    assert all(abs(r["p"] - r["probability"][1]) < 1e-9 for r in rows)
