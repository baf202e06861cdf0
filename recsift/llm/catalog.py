"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from recsift.llm import (
    bounded_batches, cross_polytope, decontaminate, exact_dedup, hard_negatives, html_wrappers, lexical, licenses, near_dedup, packing, pii,
    quality, secrets, sharding)

MODULES = [licenses, sharding, packing, quality, secrets, near_dedup, exact_dedup, decontaminate, html_wrappers, pii, cross_polytope,
           hard_negatives, lexical]


def _wrap(fn):
    def run(spark, sf_dir):
        bounded_batches(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries():
    out = {}
    for m in MODULES:
        out.update({k: _wrap(f) for k, f in m.QUERIES.items()})
    import corpus_pipeline
    out["pipeline"] = _wrap(corpus_pipeline.run)
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out.update(getattr(m, "ORACLE", {}))
    return out
