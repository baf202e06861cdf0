"""File sources and sinks: item/event CSV with explicit schemas (IO1, IO2), the
vector cache by name (IO5) and metric results as JSON (IO6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ITEMS_CSV_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("brand_id", T.StringType()),
    T.StructField("condition_id", T.LongType()),
    T.StructField("size_id", T.LongType()),
    T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("image_urls", T.StringType()),
])
EVENTS_CSV_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """Read a headed CSV with a fixed schema (no inference), failing on malformed
    rows; a missing file or a missing required column raises before any job."""
    from pyspark.errors import AnalysisException
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise
    missing = [c for c in (required or [f.name for f in schema.fields]) if c not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    # quotes inside fields are doubled (RFC 4180, as pandas writes them)
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
                 .option("escape", '"').option("enforceSchema", False).csv(path))


def load_data(spark: SparkSession, items_path: str, events_path: str) -> tuple[DataFrame, DataFrame]:
    """IO1: items and events; both files must exist."""
    return (read_csv(spark, items_path, ITEMS_CSV_SCHEMA),
            read_csv(spark, events_path, EVENTS_CSV_SCHEMA))


def load_items(spark: SparkSession, path: str, id_column: str = "item_id",
               url_column: str = "image_urls") -> DataFrame:
    """IO2: item CSV that must carry an id and a URL column."""
    return read_csv(spark, path, ITEMS_CSV_SCHEMA, required=[id_column, url_column])


def save_vector_cache(vectors: DataFrame, root: str, name: str) -> str:
    """IO5: store (item_id, v) under ``root/name``."""
    path = f"{root.rstrip('/')}/{name}"
    vectors.select("item_id", "v").write.mode("overwrite").parquet(path)
    return path


def load_vector_cache(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def write_metrics_json(results: DataFrame, path: str) -> None:
    """IO6: the long metric table (metric, k, value) as JSON lines."""
    results.coalesce(1).write.mode("overwrite").json(path)
