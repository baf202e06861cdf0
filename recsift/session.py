"""Spark session helpers: session construction, shared checkpoint folder, materialisation.

Everything that cuts lineage goes through :func:`materialize`, which writes parquet
into the folder named by ``spark.checkpoint.dir``.  On a cluster that folder is the
shared one the cluster names; only when it is unset (tests, local runs) do we pick
one ourselves.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Broadcasts are requested explicitly, behind a size check (operators.ordering);
    # the automatic threshold stays at Spark's default.
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "recsift", extra: dict | None = None) -> SparkSession:
    """Create (or return) a session with the settings this library relies on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: rows and shuffled bytes that one task is meant to hold
ROWS_PER_TASK = 500_000
TASK_BYTES = 8 << 20


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Let a task's share stay the same as ``rows`` grow: at least a shuffle partition per ``ROWS_PER_TASK`` rows, and adaptive
    execution merges them up to ``TASK_BYTES`` at most (by default up to 64 MB, compressed: millions of rows that a
    task sorts and hashes).  A session that has more partitions or smaller ones keeps them."""
    need = -(-rows // ROWS_PER_TASK)
    if need > int(spark.conf.get("spark.sql.shuffle.partitions", "200")):
        spark.conf.set("spark.sql.shuffle.partitions", str(need))
    now = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m").strip().lower())
    if now and int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] > TASK_BYTES:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``recsift`` importable in Python workers (pandas UDFs, cogroups):
    zip the package once per application and ``addPyFile`` it, the standard way
    to send driver-side code to executors (``addArtifacts`` on Spark Connect)."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001  (Spark Connect has no SparkContext)
        sc, app = None, f"connect-{id(spark)}"
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="recsift-code-"), "recsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder: ``spark.checkpoint.dir``, else the context's
    checkpoint folder.  One is made up only in local mode; on a cluster without either
    setting intermediates have no shared place, so that raises.  Also ships the package to the Python workers (once per application)."""
    ship_package(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: DataFrame.checkpoint uses the conf)
        pass
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="recsift-ckpt-", dir=os.environ.get("RECSIFT_SCRATCH", "/tmp"))
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark drops the shuffle files of an execution when it ends, not when the driver happens to collect its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Executions inside leave no shuffle files.  Only for frames that are executed once: a second execution of the same
    plan would have to repeat its stages."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    This cuts lineage (a lost executor re-reads the files instead of recomputing the
    whole plan) and turns a result that is read several times into a scan.  The shuffle files of the
    write are dropped with it, so what a query holds on disk is its written tables and one step's shuffles.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of frames of :func:`materialize` that nothing will read again: neither they nor
    a frame derived from them may be executed later."""
    for df in frames:
        spark = df.sparkSession
        if not hasattr(spark, "_jvm"):  # Spark Connect: the files stay
            continue
        base = ensure_checkpoint_dir(spark).rstrip("/").removeprefix("file://").removeprefix("file:")
        for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"{base}/" in at:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let go of the shuffles and kept blocks of finished RDD work (ALS, k-means), which Spark drops only once the driver's
    objects for them are collected."""
    gc.collect()
    if hasattr(spark, "_jvm"):  # not on Spark Connect
        spark._jvm.System.gc()
