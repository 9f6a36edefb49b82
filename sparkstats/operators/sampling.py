"""Exact-size reproducible sampling and stratified splitting (SA*).

Order of a row = md5('<seed>:<key>'), then key, then all other columns, so rows
of a repeated (or null) key are cut one by one. The n smallest rows form the sample. A
global ``orderBy().limit(n)`` would merge partitions x n rows in one task, so
instead: a uniform 60-bit prefix of the hash pre-filters to about n + 6 standard
deviations candidates (one count), and ``ordered.row_positions`` numbers those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import join_by, row_positions

_SPAN = float(2 ** 60)


def hash_order(key, seed: int = 42) -> Column:
    """md5 of '<seed>:<key>' (hex string): the sampling order. A null key is hashed as
    '<seed>?', which no key spells."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), k.cast("string")), F.lit(f"{seed}?")))


def hash_unit(key, seed: int = 42) -> Column:
    """First 15 hex digits of the md5 as a number in [0, 2^60)."""
    return F.conv(F.substring(hash_order(key, seed), 1, 15), 16, 10).cast("double")


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """SA1: exactly min(n, rows) rows, reproducible for a given seed and key."""
    total = df.count()
    if n >= total:
        return df
    p = n / total
    frac = min(1.0, p + 6 * math.sqrt(p * (1 - p) / total) + 10.0 / total)
    while True:
        cand = (df.withColumn("_u", hash_unit(key, seed))
                  .where(F.col("_u") < F.lit(frac * _SPAN))
                  .withColumn("_h", hash_order(key, seed)))
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 2)
    placed = row_positions(cand.drop("_u"), [], ["_h", key], "sample")
    return placed.where(F.col("_pos") <= n).drop("_h", "_pos", "_total")


#: Hash prefixes (hex digits) by which a split counts rows before it orders any.
PREFIX = 4


def stratified_split(df: DataFrame, label: str, key: str, train_frac: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """SA2: adds ``is_train``: per class, the first round(frac * n_class) rows in
    hash order are train (floor(x + 0.5)), so every class keeps its ratio.

    One count by class and hash prefix tells in which prefix a class is cut: rows of lower prefixes are
    train, of higher ones test, and only the rows of that prefix are put in order."""
    h = materialize(df.withColumn("_b", F.substring(hash_order(key, seed), 1, PREFIX)), "split_input")
    counts = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    grp = Window.partitionBy(label)
    counts = counts.withColumns({"_upto": F.sum("_n").over(grp.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)),
                                 "_train": F.least(F.floor(F.sum("_n").over(grp) * train_frac + 0.5), F.sum("_n").over(grp))})
    # a row a class: the prefix that holds its last train row, and how many of that prefix are train
    cut = (counts.where(F.col("_upto") >= F.col("_train")).groupBy(label)
           .agg(F.min(F.struct("_b", (F.col("_train") - F.col("_upto") + F.col("_n")).alias("_kept"))).alias("_c"))
           .select(label, F.col("_c._b").alias("_cut"), F.col("_c._kept").alias("_kept")))
    placed = join_by(h, materialize(cut, "split_cuts"), [label])
    clear = placed.where(F.col("_b") != F.col("_cut")).withColumn("is_train", (F.col("_b") < F.col("_cut")).cast("int"))
    at = placed.where(F.col("_b") == F.col("_cut")).withColumn("_h", hash_order(key, seed))
    at = row_positions(at, [label], ["_h", key], "split")
    at = at.withColumn("is_train", (F.col("_pos") <= F.col("_kept")).cast("int")).drop("_h", "_pos", "_total")
    return materialize(clear.unionByName(at).select(*df.columns, "is_train"), "split")


def hash_split(df: DataFrame, key: str, train_frac: float = 0.8, seed: int = 42) -> DataFrame:
    """SA2 by threshold: adds ``is_train`` from the row's hash alone. No count, no
    order and no shuffle; class ratios hold on average instead of exactly."""
    cut = F.lit(train_frac * _SPAN)
    return df.withColumn("is_train", (hash_unit(key, seed) < cut).cast("int"))
