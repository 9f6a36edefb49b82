"""Nearest-neighbour local regression (LOESS of degree one).

At every distinct x the ``k`` rows nearest along x have tricube weights by their distance
in units of the k-th row's, and a weighted straight line through them gives the
trend. Rows of equal x are one point with their count and sum of y, so a value that a
third of all rows share is work for one. A row at the k-th distance has weight zero, so
ties there change nothing.

The points are range-partitioned by x and stored; a table of the partitions' first and
last ranks (one row each) tells which partitions need a point: its own, and those
whose ranks are within ``k`` rows (the halo). Each partition then moves a window of ``k``
rows over its sorted points. A partition holds its points and 2 k rows at most beside
them, and the result is the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_order

#: Weights held at a time in a task.
PIECE = 1 << 21


def kth_distance(x: np.ndarray, n: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Distance from each point ``at`` to the k-th nearest row (itself included); x ascending, n rows each.

    A window of k rows from point l reaches to point r(l). As l moves right, the distance to
    l falls and that to r(l) grows, so the best window is where they cross."""
    upto = np.concatenate([[0], np.cumsum(n)])
    k = min(k, int(upto[-1]))
    reach = np.searchsorted(upto, upto[:-1] + k, "left") - 1
    right = np.append(x, np.inf)[np.minimum(reach, len(x))]
    low, high = np.zeros(len(at), np.int64), at.copy()
    while (low < high).any():
        mid = (low + high) // 2
        crossed = x[at] - x[mid] <= right[mid] - x[at]
        high = np.where(crossed, mid, high)
        low = np.where(crossed, low, mid + 1)
    before = np.where(low > 0, x[at] - x[np.maximum(low - 1, 0)], np.inf)
    return np.minimum(right[low] - x[at], before)


def smoothed(x: np.ndarray, n: np.ndarray, sy: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(trend, k-th distance) at the points ``at``; sy: sums of y."""
    h = kth_distance(x, n, at, k)
    first, stop = np.searchsorted(x, x[at] - h, "left"), np.searchsorted(x, x[at] + h, "right")
    out = np.empty(len(at))
    ends = np.cumsum(stop - first)
    start = 0
    while start < len(at):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        width = (stop - first)[start:end]
        offset = np.concatenate([[0], np.cumsum(width)[:-1]])
        idx = np.arange(width.sum()) - np.repeat(offset - first[start:end], width)
        d = x[idx] - np.repeat(x[at[start:end]], width)
        reach = np.repeat(h[start:end], width)
        u = np.minimum(np.abs(d) / np.where(reach > 0, reach, 1), 1)
        w = np.where(reach > 0, (1 - u ** 3) ** 3, d == 0)
        s0, s1, s2, t0, t1 = (np.add.reduceat(w * v, offset) for v in (n[idx], n[idx] * d, n[idx] * d * d, sy[idx], sy[idx] * d))
        det = s0 * s2 - s1 * s1
        line = det > 1e-10 * s0 * s2
        out[start:end] = np.where(line, (s2 * t0 - s1 * t1) / np.where(line, det, 1), t0 / s0)
        start = end
    return out, h


def nearest_trend(df: DataFrame, x: str, y: str, k: int, partitions: int | None = None) -> DataFrame:
    """T16 at every distinct x of the complete rows: ``x, n`` (rows of that x), ``y_hat`` and
    ``reach`` (distance of the k-th nearest row). NaN counts as null; fewer than ``k`` rows: all are neighbours."""
    if k < 1:
        raise ValueError("k is at least 1")
    xv, yv = F.col(x).cast("double"), F.col(y).cast("double")
    points = (df.select(xv.alias("x"), yv.alias("y")).where(~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull())
              .groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")))
    points = in_order(points, ["x"], "trend", partitions)
    inside = Window.partitionBy("_part").orderBy("_seq")
    parts = points.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect()  # one row a partition
    schema = "x double, n long, y_hat double, reach double"
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    last = np.cumsum([r["n"] for r in parts])
    before = last - [r["n"] for r in parts]
    place = {r["_part"]: i for i, r in enumerate(parts)}

    @F.pandas_udf("array<int>")
    def needed(part: pd.Series, upto: pd.Series, n: pd.Series) -> pd.Series:
        own = part.map(place).to_numpy()
        last_rank = before[own] + upto.to_numpy()
        low = np.searchsorted(last, last_rank - n.to_numpy() + 1 - k, "left")
        high = np.searchsorted(before, last_rank + k, "left") - 1
        return pd.Series([[2 * j + (j != i) for j in range(a, b + 1)] for i, a, b in zip(own, np.minimum(low, own), np.maximum(high, own))])

    ranked = points.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sent = ranked.select("x", "n", "sy", F.explode(needed("_part", "upto", "n")).alias("to"))
    sent = sent.select("x", "n", "sy", F.floor(F.col("to") / 2).cast("int").alias("to"), (F.col("to") % 2 == 0).alias("own"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in frames if len(b)]
        if held:
            b = pd.concat(held)
            xs, n, sy = b["x"].to_numpy(float), b["n"].to_numpy(float), b["sy"].to_numpy(float)
            at = np.flatnonzero(b["own"].to_numpy(bool))
            trend, reach = smoothed(xs, n, sy, at, k)
            yield pd.DataFrame({"x": xs[at], "n": n[at].astype(np.int64), "y_hat": trend, "reach": reach})

    return (sent.repartitionById(len(parts), F.col("to")).sortWithinPartitions("to", "x").mapInPandas(run, schema))
