"""Licence scans: an exact set-similarity join of text blocks against licence templates.

A text is cut into blocks, windows of two strides of words that start every
stride, so that each run of up to a stride of words stands whole in one
block.  A template's stride is the least power of two, ``STRIDE`` or more, that holds its words.  A block meets a template when it holds at least ``threshold`` of the
template's distinct words.  All such pairs are found, none is guessed:

- the words of all templates are ordered by document frequency over the whole
  table, rarest first (one counting pass; the result has one row per template word);
- prefix filter: a block can meet a template only if one of the template's first
  ``size - need + 1`` words is among the first ``words - need + 1`` of the block,
  both in that order.  Texts with none of the prefix words leave at once;
- length filter: the block must hold ``need`` template words;
- positional filter: from the place of the first common word on, both sides must
  still have ``need`` words;
- the pairs that are left are counted in full.

The templates are a parameter of bounded size (``MAX_TEMPLATES``) and travel as a
literal; texts are never shuffled.  Main path: DataFrame functions only.

Defined cases: null and empty texts have no words, no labels and score 0; repeated
rows are scored each on their own; a null doc_id stays null; extra columns are
dropped by ``scan`` unless named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsift.llm.textcols import let, lower_words
from recsift.sources.tables import read_table

#: what stands between words, after lower-casing
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE = 32
MAX_TEMPLATES = 500


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    #: the words must stand one after the other; their places are then reported
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def stride(self) -> int:
        return max(STRIDE, 1 << (len(self.words) - 1).bit_length())


PHRASES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
)
#: opening sentences and notices of common licences, in lower-case words
NOTICES = (
    Template("apache", "licensed under the apache license version 2 0", 0.85),
    Template("apache", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by", "licensed under cc by 4 0", 1.0),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 1.0),
    Template("gpl", "this work is licensed under the gnu general public license version 3", 0.85),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Template("lgpl", "gnu lesser general public license", 1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mit", "released under the mit license", 1.0),
    Template("mpl", "subject to the terms of the mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.9),
)
#: sentences from the bodies of common licences
BODIES = (
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
             "basis without warranties or conditions of any kind either express or implied"),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
             "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
             "merchantability or fitness for a particular purpose see the gnu general public license for more details"),
)
TEMPLATES = PHRASES + NOTICES + BODIES


def document_frequency(texts: DataFrame, words: Column, vocabulary: list[str]) -> dict[str, int]:
    """How many texts hold each word of ``vocabulary``; at most one row per such word comes back."""
    found = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words)
    rows = texts.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def _template_column(templates, order: list[str]) -> Column:
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t in templates:
        tokens = sorted(set(t.words), key=rank.__getitem__)
        need = math.ceil(t.threshold * len(tokens) - 1e-9)
        rows.append(F.struct(
            F.lit(t.label).alias("label"), F.lit(need).alias("need"),
            F.array(*map(F.lit, tokens)).alias("tokens"),
            F.array(*map(F.lit, tokens[: len(tokens) - need + 1])).alias("prefix"),
            F.array(*map(F.lit, t.words if t.phrase else [])).cast("array<string>").alias("phrase")))
    return F.array(*rows)


def _blocks(words: Column, order: Column, stride: int) -> Column:
    """array<struct<first, stop, words, tokens>>: ``tokens`` are the block's template words,
    rarest first; ``first`` to ``stop`` are the places that this block reports."""
    n = F.size(words)
    last = F.greatest(F.ceil(n / F.lit(stride)).cast("int") - 2, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: let(
        F.slice(words, b * stride + 1, 2 * stride), lambda own: F.struct(
            (b * stride).alias("first"), F.when(b == last, n).otherwise((b + 1) * stride).alias("stop"),
            F.array_intersect(order, own).alias("tokens"))))


def _candidate(t: Column, b: Column) -> Column:
    """Length, prefix and positional filter, cheapest first."""
    left = F.size(b["tokens"]) - t["need"]
    head = F.slice(b["tokens"], 1, F.greatest(left + 1, F.lit(1)))

    def positional(common):
        first = F.element_at(common, 1)
        rest = F.least(F.size(t["tokens"]) - F.array_position(t["tokens"], first),
                       F.size(b["tokens"]) - F.array_position(b["tokens"], first))
        return (F.size(common) > 0) & (rest + 1 >= t["need"])

    return F.when(left >= 0, let(F.array_intersect(t["prefix"], head), lambda c: F.when(
        F.size(c) > 0, positional(c)).otherwise(False))).otherwise(False)


def _phrase_places(words: Column, t: Column, b: Column) -> Column:
    n = F.size(t["phrase"])
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.filter(
        F.sequence(b["first"], F.greatest(b["stop"] - 1, b["first"])),
        lambda p: F.slice(words, p + 1, F.greatest(n, F.lit(1))) == t["phrase"]))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns, ``words`` (count) and ``matches``, an
    array<struct<label, first, stop, containment, places>> with every block (its word
    range) that meets a template; ``places`` has the starts of a phrase."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; scan them {MAX_TEMPLATES} at a time")
    words = lower_words(F.col(text), SEPARATORS)
    vocabulary = sorted({w for t in templates for w in t.words})
    df = document_frequency(docs, words, vocabulary)
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    tables = {k: _template_column([t for t in templates if t.stride == k], order) for k in sorted({t.stride for t in templates})}
    rank = {w: i for i, w in enumerate(order)}
    prefixes = set()
    for t in templates:
        tokens = sorted(set(t.words), key=rank.__getitem__)
        prefixes.update(tokens[: len(tokens) - math.ceil(t.threshold * len(tokens) - 1e-9) + 1])

    def matches(w):
        def of_block(b, table):
            pairs = F.transform(F.filter(table, lambda t: _candidate(t, b)), lambda t: F.struct(
                t["label"].alias("label"), b["first"].alias("first"), b["stop"].alias("stop"),
                F.size(F.array_intersect(t["tokens"], b["tokens"])).alias("overlap"), t["need"].alias("need"),
                F.size(t["tokens"]).alias("size"), F.size(t["phrase"]).alias("phrase_words"),
                _phrase_places(w, t, b).alias("places")))
            return F.filter(pairs, lambda m: (m["overlap"] >= m["need"]) & (
                (m["phrase_words"] == 0) | (F.size(m["places"]) > 0)))
        def of_stride(stride, table):
            blocks = let(F.array(*map(F.lit, order)), lambda o: _blocks(w, o, stride))
            return F.flatten(F.transform(blocks, lambda b: of_block(b, table)))

        found = F.concat(*[of_stride(k, t) for k, t in tables.items()])
        hit = F.arrays_overlap(w, F.array(*map(F.lit, sorted(prefixes))))
        return F.struct(F.size(w).cast("long").alias("words"),
                        F.when(hit, found).otherwise(F.array().cast(MATCHES)).alias("matches"))

    out = docs.select(*keep, let(words, matches).alias("_m"))
    return out.select(*keep, "_m.words", F.transform("_m.matches", lambda m: F.struct(
        m["label"].alias("label"), m["first"].alias("first"), m["stop"].alias("stop"),
        (m["overlap"] / m["size"]).alias("containment"), m["phrase_words"].alias("phrase_words"),
        m["places"].alias("places"))).alias("matches"))


MATCHES = ("array<struct<label:string,first:int,stop:int,overlap:int,need:int,size:int,"
           "phrase_words:int,places:array<int>>>")


def op1_license_scan(spark, sf_dir):
    """Licence labels of every document: phrases with their places, and the templates met by any block."""
    s = scan(read_table(spark, sf_dir, "documents"))
    phrases = F.filter("matches", lambda m: m["phrase_words"] > 0)
    places = F.flatten(F.transform(phrases, lambda m: m["places"]))

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    return s.select(
        "doc_id", F.col("words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        labels(phrases).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
        F.size("matches").cast("long").alias("n_matches"))


QUERIES = {"op1_license_scan": op1_license_scan}


def _oracle() -> str:
    """Every block against every template, without the filters."""
    values = ",\n".join(f"('{t.label}', {t.words!r}, {t.threshold}, {t.phrase}, {t.stride})" for t in TEMPLATES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT *, len(w) AS n FROM t),
tpl(label, words, threshold, phrase, stride) AS (VALUES {values}),
cuts AS (SELECT *, greatest(1, ceil(n / stride::DOUBLE)::BIGINT - 1) AS nb FROM d, (SELECT DISTINCT stride FROM tpl)),
pairs AS (SELECT rid, label, phrase, words, w, threshold, b.stride, list_distinct(words) AS tokens, b * b.stride AS first,
                 CASE WHEN b = nb - 1 THEN n ELSE (b + 1) * b.stride END AS stop
          FROM (SELECT *, unnest(range(0, nb)) AS b FROM cuts) b JOIN tpl ON tpl.stride = b.stride),
m AS (SELECT rid, label, phrase, len(tokens) AS size, len(list_intersect(tokens, list_slice(w, first + 1, first + 2 * stride))) AS overlap,
             CASE WHEN phrase THEN list_filter(range(first, stop), lambda p: list_slice(w, p + 1, p + len(words)) = words)
                  ELSE []::BIGINT[] END AS places, threshold
      FROM pairs),
hits AS (SELECT * FROM m WHERE overlap >= ceil(threshold * size - 1e-9) AND (NOT phrase OR len(places) > 0)),
g AS (SELECT rid, coalesce(sum(len(places)), 0)::BIGINT AS n_base, min(list_min(places))::BIGINT AS first_word,
             max(list_max(places))::BIGINT AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(overlap / size) AS score, count(*) AS n_matches
      FROM hits GROUP BY rid)
SELECT d.doc_id, d.n::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_matches, 0) AS n_matches
FROM d LEFT JOIN g USING (rid)"""


ORACLE = {"op1_license_scan": _oracle()}
