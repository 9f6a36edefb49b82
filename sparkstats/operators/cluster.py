"""K-means delay tiers (M1, M2, A19, W2) by Lloyd steps as Spark aggregates.

The distinct points are stored once with their number of rows. Starting centres come
from rounds of oversampling over all of them: each round takes, for every start, a few
points with chances in proportion to weight times squared distance from the candidates
so far (the smallest of ``-ln u / (w d^2)``, with u from a hash of the point, so neither
partitioning nor task order matters); the candidates, weighted by the rows that are
nearest to them, are then clustered on the driver. All starts run in the same
passes: a step reads the points once, assigns each for every running start, and
sums per (start, cluster); only these sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even
from ..session import materialize
from .blocks import packed, unpacked, width
from .encode import scaler_table

# The clustering features.
CLUSTER_FEATURES = ["dep_delay", "arr_delay", "distance", "air_time"]
#: Rounds of oversampling, and candidates of a round for each cluster.
ROUNDS, PER_CLUSTER = 5, 2


@dataclass
class KMeansFit:
    """A fitted clustering: centres of the scaled features and the tier of each."""
    features: list
    mean: np.ndarray
    std: np.ndarray
    centres: np.ndarray
    tiers: list
    cost: float

    def cluster(self) -> Column:
        """Index of a row's nearest centre; null if it lacks a feature."""
        scaled = [(F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.std)]
        whole = F.lit(True)
        for f in self.features:
            whole = whole & F.col(f).isNotNull()
        return F.when(whole, nearest(scaled, self.centres))

    def tier(self) -> Column:
        return F.element_at(F.array(*[F.lit(int(t)) for t in self.tiers]), self.cluster() + 1)


def weighted_points(df: DataFrame, features: list, table: dict) -> DataFrame:
    """Distinct complete points, stored: scaled ``z0, z1, ...``, their rows ``w`` and a hash ``h`` of the raw values."""
    rows = df.dropna(subset=features).groupBy(*features).agg(F.count(F.lit(1)).alias("w"))
    z = [((F.col(c).cast("double") - float(table[c][0])) / float(table[c][1])).alias(f"z{i}") for i, c in enumerate(features)]
    return materialize(rows.select(*z, F.col("w").cast("double").alias("w"), F.xxhash64(*features).alias("h")), "points")


def _blocks(points: DataFrame) -> DataFrame:
    """The points as packed blocks, for the passes below."""
    return points if points.columns == ["block"] else packed(points, "point_blocks")


def _uniform(h: np.ndarray, seed: int, start: int, turn: int) -> np.ndarray:
    """A coin in (0, 1) for every point, start and round."""
    x = h.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + start * 0xBF58476D1CE4E5B9 + turn * 0x94D049BB133111EB) % (1 << 64))
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0 ** -54


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres, one feature at a time: the same bits for a point in any batch."""
    out = np.zeros((len(x), len(centres)))
    for f in range(x.shape[1]):
        out += np.square(x[:, f, None] - centres[None, :, f])
    return out


def _features(points: DataFrame) -> int:
    return width(points) - 2


def _batches(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for x in unpacked(batches, p + 2):
        yield x[:, :p], x[:, p], x[:, p + 1].copy().view(np.int64)


def _as_batch(b: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(b, preserve_index=False)


def _drawn(points: DataFrame, have: list, each: int, seed: int, turn: int) -> list:
    """For every start ``each`` further points, by weight times squared distance from those it has."""
    p = _features(points)
    names = [f"z{i}" for i in range(p)]

    def best(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pd.DataFrame(columns=["start", "key", *names])] * len(have)
        for x, w, h in _batches(frames, p):
            for s, centres in enumerate(have):
                far = _squared(x, centres).min(1) if len(centres) else np.ones(len(x))
                at = np.flatnonzero(far > 0)
                if not len(at):
                    continue
                key = -np.log(_uniform(h[at], seed, s, turn)) / (w[at] * far[at])
                first = np.argpartition(key, each - 1)[:each] if len(key) > each else np.arange(len(key))
                mine = pd.DataFrame(x[at][first], columns=names).assign(start=s, key=key[first])
                both = pd.concat([held[s], mine]) if len(held[s]) else mine
                held[s] = both.sort_values(["key", *names]).head(each)
        for one in held:
            if len(one):
                yield _as_batch(one[["start", "key", *names]].astype({"start": "int32"}))

    schema = "start int, key double, " + ", ".join(f"{c} double" for c in names)
    order = Window.partitionBy("start").orderBy("key", *names)
    rows = points.mapInArrow(best, schema).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).collect()
    return [np.array([[r[c] for c in names] for r in sorted(rows, key=lambda r: r["_n"]) if r["start"] == s], float).reshape(-1, p) for s in range(len(have))]


def _owned(points: DataFrame, candidates: list) -> list:
    """For every start the rows that are nearest to each of its candidates."""
    p, most = _features(points), max(map(len, candidates))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((len(candidates), most))
        for x, w, _ in _batches(frames, p):
            for s, centres in enumerate(candidates):
                got[s] += np.bincount(_squared(x, centres).argmin(1), weights=w, minlength=most)
        at = np.argwhere(got > 0)
        yield _as_batch(pd.DataFrame({"start": at[:, 0].astype(np.int32), "candidate": at[:, 1].astype(np.int32), "n": got[got > 0]}))

    out = [np.zeros(len(c)) for c in candidates]
    for r in points.mapInArrow(count, "start int, candidate int, n double").groupBy("start", "candidate").agg(F.sum("n").alias("n")).collect():
        out[r["start"]][r["candidate"]] = r["n"]
    return out


def _reclustered(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of a few weighted candidates: spread start, then Lloyd steps."""
    order = np.lexsort(x.T[::-1])
    x, w = x[order], w[order]
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    while len(chosen) < k:
        far = w * _squared(x, x[chosen]).min(1)
        if not far.sum() > 0:
            far = np.array([i not in chosen for i in range(len(x))], float)  # candidates without rows of their own
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    centres = x[chosen]
    for _ in range(100):
        own = _squared(x, centres).argmin(1)
        moved = np.array([np.average(x[own == j], axis=0, weights=w[own == j]) if w[own == j].sum() > 0 else centres[j] for j in range(k)])
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return centres


def starting_centres(points: DataFrame, k: int, n_init: int, seed: int) -> np.ndarray:
    """(n_init, k, p) from oversampled candidates of all points; ``points``: see ``weighted_points``."""
    points = _blocks(points)
    candidates = _drawn(points, [np.zeros((0, 0))] * n_init, 1, seed, 0)
    for turn in range(1, ROUNDS + 1):
        more = _drawn(points, candidates, PER_CLUSTER * k, seed, turn)
        candidates = [np.concatenate([a, b]) for a, b in zip(candidates, more)]
    fewest = min(len(np.unique(c, axis=0)) for c in candidates)
    if fewest < k:
        raise ValueError(f"{fewest} distinct points for {k} clusters")
    owned = _owned(points, candidates)
    return np.array([_reclustered(c, w, k, np.random.default_rng([seed, s])) for s, (c, w) in enumerate(zip(candidates, owned))])


def _step(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cost): per start and cluster the rows and the coordinate sums, and per
    start the sum of squared distances to the nearest centre."""
    n, k, p = centres.shape
    flat = centres.reshape(n * k, p)

    def partials(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((p + 2, n * k))
        for x, w, _ in _batches(frames, p):
            far = _squared(x, flat).reshape(len(x), n, k)
            own = far.argmin(2)
            at = (own + np.arange(n) * k).ravel()
            weight = np.repeat(w, n)
            got[0] += np.bincount(at, weights=weight, minlength=n * k)
            for f in range(p):
                got[1 + f] += np.bincount(at, weights=np.repeat(w * x[:, f], n), minlength=n * k)
            got[-1] += np.bincount(at, weights=weight * np.take_along_axis(far, own[:, :, None], 2).ravel(), minlength=n * k)
        yield _as_batch(pd.DataFrame(got.T, columns=[f"s{i}" for i in range(p + 2)]).assign(at=np.arange(n * k, dtype=np.int32)))

    schema = ", ".join(f"s{i} double" for i in range(p + 2)) + ", at int"
    rows = points.mapInArrow(partials, schema).groupBy("at").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(p + 2)]).collect()
    sums = np.zeros((n * k, p + 2))
    for r in rows:  # n_init x k rows
        sums[r["at"]] = [r[f"s{i}"] for i in range(p + 2)]
    sums = sums.reshape(n, k, p + 2)
    return sums[:, :, :-1], sums[:, :, -1].sum(1)


def lloyd(points: DataFrame, centres: np.ndarray, max_iter: int, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cost) of every start after at most ``max_iter`` steps; a start
    stops once no centre moves by more than ``tol``. Empty clusters stay put."""
    points, centres = _blocks(points), centres.copy()
    running = np.arange(len(centres))
    for _ in range(max_iter):
        sums, _ = _step(points, centres[running])
        full = sums[:, :, 0] > 0
        moved = centres[running].copy()
        moved[full] = sums[full][:, 1:] / sums[full][:, :1]
        shift = np.sqrt(((moved - centres[running]) ** 2).sum(2)).max(1)
        centres[running] = moved.round(12)
        running = running[shift > tol]
        if not len(running):
            break
    return centres, _step(points, centres)[1]


def nearest(cols: list, centres: np.ndarray) -> Column:
    """Index of the nearest centre as an expression (the first of equals)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    d = F.array(*[sum(((c - float(v)) ** 2 for c, v in zip(cols, centre)), F.lit(0.0))
                  for centre in centres])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def fit_kmeans(df: DataFrame, features=CLUSTER_FEATURES, k: int = 4, n_init: int = 10, seed: int = 42, max_iter: int = 300,
               ddof: int = 0, rank_by: str = "arr_delay", starts: np.ndarray | None = None, tol: float = 1e-4) -> KMeansFit:
    """M1 / M2: complete cases, standardise, best of ``n_init`` seeded k-means runs (least
    within-cluster cost), tiers 0..k-1 by the mean of ``rank_by`` (0 = lowest). ``starts``
    (runs x k x features, of the raw features) replaces the seeded starts."""
    feats = list(features)
    table = scaler_table(df.dropna(subset=feats), feats, ddof)
    if any(table[c][0] is None for c in feats):
        raise ValueError(f"0 distinct points for {k} clusters")
    mean, std = (np.array([float(table[c][i]) for c in feats]) for i in (0, 1))
    points = _blocks(weighted_points(df, feats, table))
    first = starting_centres(points, k, n_init, seed) if starts is None else (np.asarray(starts, float) - mean) / std
    centres, cost = lloyd(points, first, max_iter, tol)
    best = int(np.argmin(cost.round(9)))
    fit = KMeansFit(feats, mean, std, centres[best], list(range(k)), float(cost[best]))
    means = {r["c"]: r["m"] for r in df.dropna(subset=feats).groupBy(fit.cluster().alias("c")).agg(F.avg(rank_by).alias("m")).collect()}
    order = sorted(range(k), key=lambda c: (means.get(c) is None, means.get(c) or 0.0, c))
    fit.tiers = [order.index(c) for c in range(k)]
    return fit


def with_tiers(df: DataFrame, fit: KMeansFit) -> DataFrame:
    """The complete rows of ``df`` with their tier ``cluster`` and the fit's ``_cost``."""
    return df.dropna(subset=fit.features).withColumn("cluster", fit.tier()).withColumn("_cost", F.lit(fit.cost))


def kmeans_tiers(df: DataFrame, features=CLUSTER_FEATURES, k: int = 4, n_init: int = 10,
                 seed: int = 42, max_iter: int = 300, ddof: int = 0,
                 rank_by: str = "arr_delay") -> DataFrame:
    """M1 / M2 in one call: ``fit_kmeans`` and its tiers on every complete row. The
    input should be a stored table (see ``session.materialize``)."""
    return with_tiers(df, fit_kmeans(df, features, k, n_init, seed, max_iter, ddof, rank_by))


def cluster_summary(clustered: DataFrame, features=CLUSTER_FEATURES) -> DataFrame:
    """Mean of each feature per tier, rounded to 2 (half-even), with sizes."""
    g = clustered.groupBy(F.col("cluster").alias("tier")).agg(
        *[F.avg(c).alias(c) for c in features], F.count(F.lit(1)).alias("n"),
        F.first("_cost").alias("training_cost"))
    return g.withColumns({c: half_even(c, 2) for c in features}).orderBy("tier")
