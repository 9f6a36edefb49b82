"""Logistic regression (M3, M4, M5, V9) by Newton steps as Spark aggregates.

Label and features are stored once more as packed blocks of rows, so that a step moves a few binary
values instead of every number. A step is one pass over the blocks: each task adds up the weighted loss, its
gradient and the information matrix sum(w p (1-p) x x'), and Spark adds the
tasks up; the driver solves a p x p system. The same matrix gives the standard
errors. Class balancing is a weight per class, from one count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..session import materialize
from .blocks import packed, unpacked
from .encode import apply_scaler, scaler_table
from .sampling import stratified_split

# Feature lists of the two cancellation models.
LR_FEATURES = ["dep_delay", "distance", "air_time", "carrier_delay", "weather_delay",
               "nas_delay", "late_aircraft_delay", "month", "day_of_week"]
LR_FEATURES_NO_LEAK = ["dep_delay", "distance", "carrier_delay", "weather_delay",
                       "nas_delay", "late_aircraft_delay", "month", "day_of_week"]


@dataclass
class LogisticFit:
    """Coefficients (intercept first), the information matrix there, the weighted log loss
    (with its penalty) and the greatest entry of its gradient per unit of weight."""
    coef: np.ndarray
    information: np.ndarray
    loss: float
    gradient: float
    steps: int
    converged: bool


def newton(rows: DataFrame, label: str, features, weights: dict, penalty: float = 0.0, max_iter: int = 60,
           tol: float = 1e-10) -> LogisticFit:
    """Minimise sum w loss + penalty / 2 |b|^2 (the intercept is free). weights: per label 0 and 1.

    Every step reads the packed label and feature columns. A step that raises the
    loss is halved; where the classes can be separated there is no minimum without a
    penalty, and the fit stops at ``max_iter`` with ``converged`` false."""
    feats = list(features)
    p = len(feats) + 1
    upper = np.triu_indices(p)
    x = rows.select(F.col(label).cast("double").alias("y"), *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(feats)])
    blocks = packed(x)
    w0, w1 = float(weights[0]), float(weights[1])

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + p + len(upper[0]))
            for block in unpacked(frames, p):
                y, z = block[:, 0].copy(), block.copy()
                z[:, 0] = 1
                eta, w = z @ b, np.where(y == 1, w1, w0)
                prob = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                total[0] += (w * (np.logaddexp(0, eta) - y * eta)).sum()
                total[1:1 + p] += z.T @ (w * (prob - y))
                total[1 + p:] += ((z * (w * prob * (1 - prob))[:, None]).T @ z)[upper]
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total))), "v": pa.array(total)})

        got = np.zeros(1 + p + len(upper[0]))
        for r in blocks.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            got[r["at"]] = r["v"]
        hessian = np.zeros((p, p))
        hessian[upper] = got[1 + p:]
        return got[0], got[1:1 + p], hessian + np.triu(hessian, 1).T

    ridge = np.diag([0.0] + [penalty] * (p - 1))
    counts = {int(r["y"]): r["n"] for r in x.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    mass = w0 * counts.get(0, 0) + w1 * counts.get(1, 0)
    if not counts.get(0) or not counts.get(1) or len(counts) > 2:
        raise ValueError(f"labels 0 and 1 are needed, found {sorted(counts)}")
    b = np.zeros(p)
    b[0] = np.log(w1 * counts[1] / (w0 * counts[0]))
    loss, gradient, information = at(b)
    steps, converged = 0, False
    for steps in range(1, max_iter + 1):
        slope = gradient + ridge @ b
        unit = np.sqrt(np.maximum(np.diag(information + ridge), 1e-300))
        if (np.abs(slope) / unit).max() <= tol * np.sqrt(mass):
            converged = True
            break
        # in units of the curvature, so that features of any scale meet one rank tolerance
        move = -np.linalg.pinv((information + ridge) / np.outer(unit, unit), rcond=1e-12, hermitian=True) @ (slope / unit) / unit
        whole = loss + 0.5 * b @ ridge @ b
        for half in range(30):
            trial = b + move / 2 ** half
            new = at(trial)
            if new[0] + 0.5 * trial @ ridge @ trial <= whole * (1 + 1e-14):
                break
        b, (loss, gradient, information) = trial, new
    return LogisticFit(b, information, loss + 0.5 * b @ ridge @ b, float(np.abs(gradient + ridge @ b).max() / mass), steps, converged)


def covariance(information: np.ndarray) -> np.ndarray:
    """Variances of the coefficients: the diagonal of the inverse information, taken in units of its own
    diagonal so that features of any scale meet one rank tolerance."""
    unit = np.sqrt(np.diag(information))
    unit[unit <= 0] = np.inf
    return np.diag(np.linalg.pinv(information / np.outer(unit, unit), rcond=1e-12, hermitian=True)) / unit ** 2


def class_weights(rows: DataFrame, label: str) -> tuple[dict, int]:
    """Balanced weights of labels 0 and 1, and the number of rows."""
    counts = {int(r[0]): r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).limit(3).collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"labels 0 and 1 are needed, found {sorted(counts)}")
    n = counts[0] + counts[1]
    return {k: n / (2 * c) for k, c in counts.items()}, n


def linear_score(features, coef, intercept) -> Column:
    e = F.lit(float(intercept))
    for f, b in zip(features, coef):
        e = e + F.col(f).cast("double") * float(b)
    return e


def score(df: DataFrame, features, coef, intercept, prob: str = "prob") -> DataFrame:
    """V9: apply stored coefficients: sigmoid of the linear score."""
    return df.withColumn(prob, 1.0 / (1.0 + F.exp(-linear_score(features, coef, intercept))))


def logistic_balanced(df: DataFrame, label: str, key: str, features=LR_FEATURES,
                      train_frac: float = 0.8, seed: int = 42, c: float = 1.0) -> dict:
    """M3: complete cases, stratified split, scaler fitted on train (E7), L2 with
    C, class-balanced weights; returns coefficients and scored test rows."""
    feats = list(features)
    sub = df.select(key, label, *feats).dropna()
    split = stratified_split(sub, label, key, train_frac, seed)
    train = split.where(F.col("is_train") == 1)
    test = split.where(F.col("is_train") == 0)
    st = scaler_table(train, feats, ddof=0)
    train_s = materialize(apply_scaler(train, st, feats).select(label, *feats), "lr_train")
    test_s = apply_scaler(test, st, feats)
    weights, n_train = class_weights(train_s, label)
    fit = newton(train_s, label, feats, weights, 1.0 / c)
    coef, b0 = fit.coef[1:], float(fit.coef[0])
    scored = score(test_s, feats, coef, b0).withColumn(
        "pred", (F.col("prob") >= 0.5).cast("int"))
    return {"features": feats, "coef": coef, "intercept": b0, "test": scored, "raw_test": test,
            "n_train": n_train, "scale": st, "train": train_s, "fit": fit, "weights": weights}


def logistic_unpenalised(df: DataFrame, label: str, features=LR_FEATURES_NO_LEAK,
                         key: str | None = None, train_frac: float = 0.8, seed: int = 42
                         ) -> dict:
    """M4: equal-prior weights, no penalty, raw features; Wald standard errors
    from the weighted information matrix."""
    feats = list(features)
    sub = df.select(*([key] if key else []), label, *feats).dropna()
    holdout = None
    if key:  # the split is stored: the passes below and the hold-out read it
        split = stratified_split(sub, label, key, train_frac, seed)
        sub, holdout = split.where(F.col("is_train") == 1), split.where(F.col("is_train") == 0)
    else:
        sub = materialize(sub, "lr_unpenalised")
    weights, _ = class_weights(sub, label)
    w = sub.withColumn("_w", F.when(F.col(label) == 1, weights[1]).otherwise(weights[0]))
    fit = newton(sub, label, feats, weights)
    coef, b0 = fit.coef[1:], float(fit.coef[0])
    est = np.concatenate([[b0], coef])
    rows = []
    for term, e, var in zip(["Intercept", *feats], est, covariance(fit.information)):
        se = float(np.sqrt(var)) if var > 0 else None  # no information about the term: no test
        wald = (float(e) / se) ** 2 if se else None
        rows.append((term, float(e), se, wald, dist.chi2_sf(wald, 1) if wald is not None else None))
    return {"features": feats, "coef": coef, "intercept": b0, "rows": rows, "train": w,
            "holdout": holdout, "fit": fit, "weights": weights}


def coef_importance(spark, features, coef, pvalues=None, top: int = 15) -> DataFrame:
    """M5: coefficients (no intercept) ordered by |value|, p < .05 flag, top n."""
    rows = []
    for i, (f, b) in enumerate(zip(features, coef)):
        p = None if pvalues is None else float(pvalues[i])
        rows.append((f, float(b), abs(float(b)), p, None if p is None else p < 0.05))
    df = spark.createDataFrame(rows, "feature string, coefficient double, abs_coef double, "
                               "p_value double, significant boolean")
    return df.orderBy(F.desc("abs_coef"), "feature").limit(top)

