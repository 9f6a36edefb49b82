"""Helpers that the corpus operators share: table access, row identity, shared
intermediate tables, ASCII lower-casing and positions in a total order."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
LEAST_LONG = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without that setting (tests); elsewhere a folder
    of the driver's machine would lose rows, so this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sparkstats-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage
    ends there, so that a lost executor costs a file read and no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that broadcasts neither side. Spark sizes a table by its files and
    takes a row to stay one row in an ``explode``: a side that is many times as large counts as
    small then, and would pass through the driver."""
    return df.hint("merge")


def text_of(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the engine's fast path."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def identity(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two non-null longs that name a row: its id (null: the least long) and a
    hash of its text. Repeated rows (same id, same text) share them, and every
    operator gives such rows the same result."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_LONG)).alias("_id"),
            F.xxhash64(text_of(text_col), F.col(id_col).isNull()).alias("_th")]


def positions(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``_pos``, the 1-based place of a row in its group by ``order``.

    Rows are range-partitioned by group and order, so that a group of any size
    spreads over many tasks; only one count per (group, partition) is summed.
    Rows that tie in all of ``order`` must be interchangeable.
    """
    keys = [group, *order]
    ordered = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn("_at", F.monotonically_increasing_id())
                     .withColumn("_part", F.shiftright("_at", 33)), name)
    counts = ordered.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_in"), "_first",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (ordered.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")))
            .withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first") + 1)
            .drop("_at", "_part", "_group", "_in", "_first", "_before"))


def carrying(*inputs: str) -> Callable:
    """Decorator for an operator ``f(table, ...)`` that reads the columns ``inputs`` and passes the
    others through: those travel under fresh names, so that no name of the caller's can meet one
    of the operator's own. A column that the operator adds replaces a caller's of that name."""
    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(table: DataFrame, *args, **options) -> DataFrame:
            mark = uuid.uuid4().hex[:8]
            away = {c: f"_carried{i}_{mark}" for i, c in enumerate(table.columns) if c not in inputs}
            out = f(table.withColumnsRenamed(away), *args, **options)
            added = set(out.columns) - set(away.values())
            back = {fresh: c for c, fresh in away.items() if fresh in out.columns and c not in added}
            return out.drop(*[fresh for c, fresh in away.items() if c in added]).withColumnsRenamed(back)
        return run
    return wrap
