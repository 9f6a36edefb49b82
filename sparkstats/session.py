"""Session helpers: defaults for local runs, checkpoint folder discovery."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale; every one is a plain Spark config key.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

def prepare(spark: SparkSession) -> SparkSession:
    """Make sure a checkpoint folder is known; no setting of the session changes."""
    ensure_checkpoint_dir(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sparkstats") -> SparkSession:
    """Session for tests and the bench (local mode)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "16g")
    for k, v in SCALE_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's ``spark.checkpoint.dir`` wins; a folder of our own is only
    chosen under a local master with nothing configured (tests). Elsewhere each
    executor would write to its own disk, so a missing setting raises.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local") or "cluster" in sc.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="sparkstats-ckpt-")
    sc.setCheckpointDir(path)
    return path


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df, tag: str = "stage", **options: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it
    back. Multi-pass operators (quantile fits, Gram passes, k-means, LDA) then
    scan a columnar table with pruning and pushdown instead of re-running the
    upstream joins; the written table also cuts lineage, so a lost executor
    re-reads files rather than recomputing the whole plan. ``options`` go to the writer."""
    import uuid
    spark = df.sparkSession
    path = checkpoint_path(spark, f"tables/{tag}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)
