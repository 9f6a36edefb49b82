"""Embedding whitening by a block Jacobi-Davidson eigensolver on Spark.

Components become integers, ``x = floor(256 * c)``. The fit list holds each distinct
x vector once; it is stored in packed blocks, and every product of its covariance
with a few vectors is one Spark pass over those blocks: rows are centred exactly
(``n * x - S`` in integers), multiplied, and only the product is summed. No
d x d matrix is formed anywhere; the driver holds a few vectors of length d.

The solver keeps a subspace with its products. Each step takes Ritz pairs from it,
locks the leading ones whose residual has reached double precision, and extends
it by corrections of the others: projected equations
``(I - UU')(V - theta I)(I - UU') t = -r`` (U: locked and current Ritz vectors), all
solved in lockstep by MINRES, so that one pass serves every equation. A pair
counts as converged by its residual under a fresh product.

Defined cases: vectors that are null, empty, or hold null or non-finite components
are dropped; vectors of several lengths, or with components beyond 2^53 / 256, raise
ValueError; a null vec_id and repeated ids are rows like any other; equal vectors count
once in the fit and get equal results; components without variance (beyond the rank of
the covariance, as with a single vector) are left out, as whitening is undefined
there; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256.0
BLOCK = 4096            # vectors in one packed row of the fit list
GOAL = 48 * np.finfo(float).eps  # residual of a locked pair, in units of the greatest eigenvalue
GUARDS = 8              # further pairs that are corrected along with the wanted ones
CAPACITY = 8            # subspace vectors for each wanted or guard pair before a restart

Product = Callable[[np.ndarray], np.ndarray]


# --- the solver ---------------------------------------------------------------

def minres(product: Product, shift: np.ndarray, inside: np.ndarray, right: np.ndarray, steps: int, goal: np.ndarray) -> np.ndarray:
    """Approximate solutions t of ``P (V - shift) P t = right`` with P = I - inside inside',
    a column for each shift; one product a step. A column rests once its residual is
    below ``goal`` times its right side."""
    def project(x: np.ndarray) -> np.ndarray:
        x = x - inside @ (inside.T @ x)
        return x - inside @ (inside.T @ x)

    v = project(right)
    size = np.linalg.norm(v, axis=0)
    live = size > 0
    v = v / np.where(live, size, 1)
    before, way, way_before, out = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    rest, first = size.copy(), size.copy()
    cos, cos_before, sin, sin_before = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    off = np.zeros_like(size)
    for _ in range(steps):
        if not live.any():
            break
        at = np.flatnonzero(live)
        image = np.zeros_like(v)
        image[:, at] = project(product(v[:, at]) - v[:, at] * shift[at])
        diagonal = (v * image).sum(0)
        following = project(image - v * diagonal - before * off)
        next_off = np.linalg.norm(following, axis=0)
        d = cos * diagonal - cos_before * sin * off
        top = np.hypot(d, next_off)
        second, third = sin * diagonal + cos_before * cos * off, sin_before * off
        fine = live & (top > 0)
        top = np.where(fine, top, 1)
        step = (v - way_before * third - way * second) / top
        cos_before, sin_before = cos, sin
        cos, sin = d / top, next_off / top
        out = np.where(fine, out + step * (cos * rest), out)
        way_before, way = way, step
        rest = np.where(fine, -sin * rest, rest)
        before, off = v, next_off
        live = fine & (next_off > 1e-12 * np.abs(shift)) & (np.abs(rest) > goal * first)
        v = np.where(live, following / np.where(live, next_off, 1), 0)
    return project(out)


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The directions of ``new`` outside the spans of ``against``, orthonormal."""
    kept: list[np.ndarray] = []
    for x in new.T:
        size = np.linalg.norm(x)
        if not size > 0:
            continue
        x = x / size
        for _ in range(3):
            for basis in against:
                x = x - basis @ (basis.T @ x)
            for y in kept:
                x = x - y * (y @ x)
            size = np.linalg.norm(x)
            if size < 1e-10:
                break
            x = x / size
        else:
            kept.append(x)
    return np.column_stack(kept) if kept else np.zeros((len(new), 0))


def _turned(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values in falling order, vectors and their products."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], basis @ turn[:, ::-1], image @ turn[:, ::-1]


def leading(product: Product, dim: int, wanted: int, inner: int = 6, most: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of a symmetric positive semidefinite operator in
    falling order, their unit vectors and residual norms (in units of the greatest)."""
    wanted = min(wanted, dim)
    block = min(dim, wanted + GUARDS)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dim, block)))
    image = product(basis)
    locked, held = np.zeros((dim, 0)), np.zeros((dim, 0))
    scale, best, stalled = 0.0, np.inf, 0
    for _ in range(most):
        values, vectors, images = _turned(basis, image)
        scale = max(scale, float(values[0]) if len(values) else 0.0, float((locked * held).sum(0).max(initial=0)))
        residual = images - vectors * values
        size = np.linalg.norm(residual, axis=0)
        done = 0
        while done < min(wanted - locked.shape[1], len(size)) and size[done] <= GOAL * scale:
            done += 1
        whole = locked.shape[1] + basis.shape[1] >= dim
        stalled = 0 if done or size[0] < 0.7 * best else stalled + 1
        best = np.inf if done else min(best, size[0])
        if not done and stalled >= 4 and size[0] <= 1e4 * GOAL * scale:
            done = 1  # rounding of the products keeps it here
        if whole or scale == 0:
            done = min(wanted - locked.shape[1], len(size))
        if done:
            # what was rotated many times is taken anew, so that the residual is a fresh product's
            fresh = _orthonormal(vectors[:, :done], locked)
            locked, held = np.column_stack([locked, fresh]), np.column_stack([held, product(fresh)])
            basis, image = vectors[:, done:], images[:, done:]
            if locked.shape[1] >= wanted:
                break
            values, vectors, images, residual, size = values[done:], basis, image, residual[:, done:], size[done:]
        now = min(block - locked.shape[1], basis.shape[1])
        if basis.shape[1] + now > CAPACITY * block:
            keep = 3 * block
            basis, image = vectors[:, :keep], images[:, :keep]
        inside = np.column_stack([locked, vectors[:, :now]])
        goal = np.clip(0.5 * GOAL * scale / np.maximum(size[:now], 1e-300), 1e-3, 0.5)
        correction = minres(product, values[:now], inside, -residual[:, :now], inner, goal)
        more = _orthonormal(correction, locked, basis)
        if not more.shape[1]:
            more = _orthonormal(residual[:, :now], locked, basis)
        if not more.shape[1]:
            more = _orthonormal(np.random.default_rng(seed + basis.shape[1]).standard_normal((dim, 1)), locked, basis)
        basis, image = np.column_stack([basis, more]), np.column_stack([image, product(more)])
    values, vectors, images = _turned(locked, held)
    return values, vectors, np.linalg.norm(images - vectors * values, axis=0) / (scale or 1.0)


# --- the passes -----------------------------------------------------------------

@dataclass
class Fit:
    """The fit list's size, per-dimension sums (exact), trace and leading pairs."""
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    identity_error: float


def _doubles() -> Column:
    return F.col("embedding").cast("array<double>")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that hold a whole finite vector; x: its integers."""
    fine = F.forall(_doubles(), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("embedding") > 0)
    near = F.forall(_doubles(), lambda c: F.abs(c * SCALE) < 2.0 ** 53)
    too_far = F.raise_error(F.lit("an embedding component is beyond 2^53 / 256"))
    x = F.transform(_doubles(), lambda c: F.floor(c * SCALE).cast("long"))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.when(near, x).otherwise(too_far).alias("x"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.column("x").slice(at, BLOCK)
            lengths = part.value_lengths().to_numpy()
            if (lengths != lengths[0]).any():
                raise ValueError("embeddings of several lengths")
            values = part.flatten().to_numpy()
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(part)], pa.int64()), "dim": pa.array([int(lengths[0])], pa.int64()),
                                              "body": pa.array([values.tobytes()], pa.binary())})


def fit_blocks(vectors: DataFrame) -> DataFrame:
    """The fit list, stored: ``n, dim, body`` (int64, row by row)."""
    distinct = usable(vectors).select("x").distinct()
    return stored(distinct.mapInArrow(_packed, "n long, dim long, body binary"), "fit-list")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for dim, body in zip(b.column("dim").to_pylist(), b.column("body")):
            yield np.frombuffer(body.as_buffer(), np.int64).reshape(-1, dim)


def _summed(blocks: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of a block's ``part``: a partial for each task, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _each(batches):
            total += part(x)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size)), "v": pa.array(total.ravel())})

    rows = blocks.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in rows:
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _totals(blocks: DataFrame) -> list[int]:
    """Exact per-dimension sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for x in _each(batches):
            # halves, so that no partial sum leaves the longs: at most 2^27 and 2^26 times BLOCK rows a block
            part = [int(h) * (1 << 26) + int(low) for h, low in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0))]
            total = np.array(part, object) if total is None else total + np.array(part, object)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total))), "v": pa.array([str(v) for v in total])})

    rows = blocks.mapInArrow(run, "at long, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return [int(v) for _, v in sorted((r["at"], r["v"]) for r in rows)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: in longs where they hold it, else in Python's integers."""
    most = max(max(map(abs, sums)), n * int(np.abs(x).max(initial=0)))
    kind = np.int64 if most < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, kind)


def fitted(vectors: DataFrame, wanted: int = 4) -> Fit | None:
    """Whitening of the leading components; None without any vector."""
    blocks = fit_blocks(vectors)
    row = blocks.agg(F.sum("n").alias("n"), F.min("dim").alias("low"), F.max("dim").alias("high")).first()
    if row["n"] is None:
        return None
    n, dim = row["n"], row["low"]
    if dim != row["high"]:
        raise ValueError(f"embeddings of {dim} and of {row['high']} components")
    sums = _totals(blocks)

    def off(x: np.ndarray) -> np.ndarray:
        return _centred(x, n, sums).astype(float) / n

    def times(right: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = off(x)
            return c.T @ (c @ right)
        return _summed(blocks, right.shape, part) / n

    trace = float(_summed(blocks, (1, 1), lambda x: np.array([[np.square(off(x)).sum()]]))[0, 0]) / n
    values, components, residuals = leading(times, dim, min(wanted, dim))
    rank = int((values > dim * np.finfo(float).eps * trace).sum())
    values, components, residuals = values[:rank], components[:, :rank], residuals[:rank]
    way = components / np.sqrt(values)
    mean = _summed(blocks, (1, max(rank, 1)), lambda x: (off(x) @ way).sum(0, keepdims=True))[:, :rank] / n if rank else np.zeros((1, 0))
    spread = _summed(blocks, (rank, rank), lambda x: (off(x) @ way - mean).T @ (off(x) @ way - mean)) / n if rank else np.zeros((0, 0))
    return Fit(n, sums, trace, values, components, residuals, float(np.abs(spread - np.eye(rank)).max(initial=0.0)))


COLUMNS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double, eigenvalue double, residual double")


def whitened(vectors: DataFrame, wanted: int = 4) -> DataFrame:
    """A row for each remaining vector and leading component: the fit list's size, the
    vector's exact squared deviation (times n^2), its whitened coordinate, the component's
    share of the variance, and how far the whitened covariance is from the identity."""
    fit = fitted(vectors, wanted)
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    n, sums, k = fit.n, fit.sums, len(fit.values)
    way, explained = fit.vectors / np.sqrt(fit.values), fit.values / fit.trace
    identity_error, values, residuals = fit.identity_error, fit.values, fit.residuals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            away = _centred(b.column("x").flatten().to_numpy().reshape(rows, -1), n, sums)
            reach = int(np.abs(away).max(initial=0))
            far = away if reach * reach * away.shape[1] < 1 << 63 else away.astype(object)
            deviation = [int(v) for v in (far * far).sum(1)]
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(each),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, n)), "deviation": pa.array(deviation, pa.int64()).take(each),
                "whitened": pa.array((away.astype(float) / n @ way).ravel()), "explained": pa.array(np.tile(explained, rows)),
                "identity_error": pa.array(np.full(rows * k, identity_error)),
                "eigenvalue": pa.array(np.tile(values, rows)), "residual": pa.array(np.tile(residuals, rows))})

    return usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, COLUMNS)
