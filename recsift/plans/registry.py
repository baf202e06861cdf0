"""Collects the query catalogue modules into the driver's three functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recsift.plans import catalog
from recsift.session import ensure_checkpoint_dir

_MODULES_LOADED = False


def _load():
    global _MODULES_LOADED
    if _MODULES_LOADED:
        return
    import importlib
    for mod in ("recsift.plans.catalog_vectors", "recsift.plans.catalog_lists",
                "recsift.plans.catalog_models", "recsift.plans.catalog_streams",
                "recsift.plans.catalog_io", "recsift.plans.catalog_stored"):
        importlib.import_module(mod)
    _MODULES_LOADED = True


def _wrap(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        # the tables hold zone-less timestamps; windows and day arithmetic are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries():
    _load()
    return {k: _wrap(v) for k, v in catalog.QUERIES.items()}


def oracle_sql():
    _load()
    return dict(catalog.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrap(catalog.flagship)(spark, sf_dir)
