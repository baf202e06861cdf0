"""Licence scan against a plain scan of every block and template."""

import math
import re

from recsift.llm import licenses as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORDS.findall((text or "").translate(LOWER))
    labels, base, places, score = set(), set(), [], 0.0
    for t in L.PHRASES:
        k = len(t.words)
        for p in range(len(w) - k + 1):
            if w[p:p + k] == t.words:
                places.append(p), base.add(t.label), labels.add(t.label)
                score = 1.0
    for t in L.NOTICES + L.BODIES:
        k = 32 if len(t.words) <= 32 else 64
        for b in range(0, max(1, math.ceil(len(w) / k) - 1) * k, k):
            own = set(w[b:b + 2 * k])
            c = len(own & set(t.words)) / len(set(t.words))
            if c >= t.threshold - 1e-12:
                labels.add(t.label)
                score = max(score, c)
    return (len(w), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def rows(df):
    return sorted(((r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"],
                                  r["labels"], round(r["score"], 9))) for r in df.collect()), key=repr)


def test_documents(spark, small_dir):
    got = dict(rows(L.op1_license_scan(spark, small_dir)))
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs}
    assert sum(v[1] for v in got.values()) > 0


def test_edge_rows(spark, tmp_path):
    filler = "alpha beta gamma delta "
    texts = [None, "", "...", "MIT", "the MIT\nLicense, mit-license", "x" * 200_000 + " apache license",
             filler * 5000 + "GNU General Public License" + filler * 3,
             # a notice with a word missing, one cut by the block border, one scattered too far
             "Redistribution and use in source and binary forms, with modification, are permitted",
             filler * 7 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
             " ".join(f"{w} " + filler * 20 for w in "permission is hereby granted free of charge".split()),
             "MİT license", "mit license " * 400]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(4, texts[4], "x"), (None, "mit license", None)]
    spark.createDataFrame(data, "doc_id long, text string, words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(L.op1_license_scan(spark, str(tmp_path)))
    assert got == sorted(((i, brute(t)) for i, t, _ in data), key=repr)
    labels = {i: v[5] for i, v in got}
    assert labels[7] == "bsd" and labels[8] == "mit" and labels[9] == ""


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert L.op1_license_scan(spark, str(tmp_path)).count() == 0


def test_long_templates_are_found_wherever_they_stand(spark):
    body = " ".join(f"t{i}" for i in range(60))
    longer = " ".join(f"u{i}" for i in range(300))
    templates = (L.Template("sixty", body), L.Template("long", longer), L.Template("short", "one two three", 1.0))
    texts = [" ".join(["x"] * k + t.split() + ["y"] * 100) for k in (0, 1, 31, 33, 64, 100, 500) for t in (body, longer, "one two three")]
    texts.append(" ".join(longer.split()[:200]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in L.scan(df, templates=templates).collect()}
    assert got == {i: {("sixty", "long", "short")[i % 3]} if i < 21 else set() for i in range(22)}
