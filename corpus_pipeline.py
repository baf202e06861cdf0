"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` are (name, function) pairs in order; a function takes (spark, docs, sf_dir) and
returns a DataFrame.  Each stage reads all rows that its predecessor kept; all but the last
return the columns of ``documents``.  ``run`` writes every stage's rows as Parquet to the
shared folder and reads them back, so a lost executor repeats one stage at most.

No SQL gives these rows (a fitted classifier, MinHash groups, edit distances, token ids), so
``ORACLE_SQL`` is None and ``tests/llm/test_pipeline.py`` holds every stage against a plain
version of it.
"""

from __future__ import annotations

from recsift.llm import bounded_batches, decontaminate, exact_dedup, near_dedup, packing, quality
from recsift.session import materialize
from recsift.sources.tables import read_table


def quality_classifier(spark, docs, sf_dir):
    """Rows that the quality classifier does not reject."""
    bounded_batches(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_deduplication(spark, docs, sf_dir):
    """One row of each text, the one with the largest id."""
    bounded_batches(spark)
    return exact_dedup.deduplicate(docs)


def near_deduplication(spark, docs, sf_dir):
    """One row of each near-duplicate group, the one with the smallest id."""
    bounded_batches(spark)
    return near_dedup.deduplicate(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Rows without a passage of the benchmark."""
    bounded_batches(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of the training sequences."""
    bounded_batches(spark)
    return packing.pack(docs, keep_cache=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the whole ``documents`` table."""
    bounded_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
