"""Linear discriminant analysis.

One grouped aggregate over the rows gives per class n, sums and centred cross
products (p(p+1)/2 expressions); the eigenproblem runs on the driver on p x p and
k x p matrices, so the number of classes is bounded (``MAX_CLASSES``). Projection and prediction are column
expressions with the solved weights as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Classes of a fit; each sends a row of p(p+1)/2 sums to the driver.
MAX_CLASSES = 10_000


@dataclass
class LDAModel:
    features: list
    classes: list            # sorted class labels
    priors: np.ndarray
    means: np.ndarray        # k x p
    xbar: np.ndarray         # p
    scalings: np.ndarray     # p x rank
    coef: np.ndarray         # k x p
    intercept: np.ndarray    # k
    explained_variance_ratio: np.ndarray
    n: int


def class_stats(df: DataFrame, label: str, features) -> tuple:
    """Per class: n, mean vector and within-class centred SSCP, from one grouped
    aggregate (columns are shifted by the global mean first for precision)."""
    feats = list(features)
    cc = df.dropna(subset=[label, *feats])
    gm = cc.agg(*[F.avg(c).alias(c) for c in feats]).first()
    shift = [F.col(c) - F.lit(float(gm[c])) for c in feats]
    pairs = [(i, j) for i in range(len(feats)) for j in range(i, len(feats))]
    rows = cc.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(s).alias(f"_s{i}") for i, s in enumerate(shift)],
        *[F.sum(shift[i] * shift[j]).alias(f"_q{k}") for k, (i, j) in enumerate(pairs)]
    ).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    rows.sort(key=lambda r: r[label])
    p = len(feats)
    classes = [r[label] for r in rows]
    ns = np.array([float(r["_n"]) for r in rows])
    sums = np.array([[float(r[f"_s{i}"]) for i in range(p)] for r in rows])
    sw = np.zeros((p, p))
    means = sums / ns[:, None]
    for r_i, r in enumerate(rows):
        q = np.zeros((p, p))
        for k, (i, j) in enumerate(pairs):
            q[i, j] = q[j, i] = float(r[f"_q{k}"])
        sw += q - ns[r_i] * np.outer(means[r_i], means[r_i])
    shift_v = np.array([float(gm[c]) for c in feats])
    return classes, ns, means + shift_v, sw


def lda_fit(df: DataFrame, label: str, features, tol: float = 1e-4) -> LDAModel:
    """Directions v that solve B v = lambda W v, for the scatter B of the class means
    and the pooled within-class covariance W (divisor n - k), scaled to v'Wv = 1.

    W is taken in units of the features' own spread, so that ``tol`` drops combinations
    of features without spread whatever their scale; W-orthonormal coordinates turn the
    problem into an ordinary symmetric one. A direction's sign is that of its largest weight.
    """
    classes, sizes, means, within = class_stats(df, label, features)
    total, k = float(sizes.sum()), len(classes)
    priors = sizes / total
    centre = priors @ means
    unit = np.sqrt(np.diag(within) / total)
    unit[unit == 0] = 1.0
    roots, axes = np.linalg.eigh(within / np.outer(unit, unit) / (total - k))
    kept = np.flatnonzero(np.sqrt(np.clip(roots, 0, None)) > tol)[::-1]
    to_sphere = axes[:, kept] / unit[:, None] / np.sqrt(roots[kept])
    away = (means - centre) @ to_sphere
    strength, turn = np.linalg.eigh((away * sizes[:, None]).T @ away / max(k - 1, 1))
    strength, turn = np.clip(strength[::-1], 0, None), turn[:, ::-1]
    told = np.sqrt(strength) > tol * np.sqrt(strength[0]) if len(strength) else np.zeros(0, bool)
    directions = to_sphere @ turn[:, told]
    if directions.size:
        largest = np.abs(directions).argmax(0)
        directions = directions * np.sign(directions[largest, np.arange(directions.shape[1])])
    scores = (means - centre) @ directions
    coef = scores @ directions.T
    intercept = np.log(priors) - 0.5 * np.square(scores).sum(1) - coef @ centre
    share = strength[:min(k, len(strength))]
    return LDAModel(list(features), classes, priors, means, centre, directions, coef, intercept,
                    share / share.sum() if share.sum() > 0 else share, int(total))


def lda_transform(df: DataFrame, model: LDAModel, n_components: int = 2) -> DataFrame:
    """LD1..LDn as columns (x - xbar) @ scalings."""
    cols = {}
    for j in range(min(n_components, model.scalings.shape[1])):
        e = F.lit(0.0)
        for i, f in enumerate(model.features):
            e = e + (F.col(f) - float(model.xbar[i])) * float(model.scalings[i, j])
        cols[f"LD{j + 1}"] = e
    return df.withColumns(cols)


def decision_scores(model: LDAModel) -> list[Column]:
    out = []
    for c in range(len(model.classes)):
        e = F.lit(float(model.intercept[c]))
        for i, f in enumerate(model.features):
            e = e + F.col(f) * float(model.coef[c, i])
        out.append(e)
    return out


def lda_predict(df: DataFrame, model: LDAModel, out: str = "predicted") -> DataFrame:
    """Argmax of the linear class scores (all discriminant directions)."""
    scores = F.array(*decision_scores(model))
    labels = F.array(*[F.lit(c) for c in model.classes])
    pos = F.array_position(scores, F.array_max(scores))
    return df.withColumn(out, F.element_at(labels, pos.cast("int")))


def coefficients_table(spark, model: LDAModel) -> DataFrame:
    rows = [(str(model.classes[c]), f, float(model.coef[c, i]))
            for c in range(len(model.classes)) for i, f in enumerate(model.features)]
    rows += [(str(model.classes[c]), "intercept", float(model.intercept[c]))
             for c in range(len(model.classes))]
    return spark.createDataFrame(rows, "class string, term string, coef double")


def model_summary(spark, model: LDAModel) -> DataFrame:
    rows = [("prior", str(c), float(p)) for c, p in zip(model.classes, model.priors)]
    rows += [("explained_variance_ratio", f"LD{i + 1}", float(v))
             for i, v in enumerate(model.explained_variance_ratio)]
    return spark.createDataFrame(rows, "item string, name string, value double")


def importance(coef: DataFrame) -> DataFrame:
    """Mean |coefficient| over the class functions per feature, ranked."""
    g = (coef.where(F.col("term") != "intercept").groupBy(F.col("term").alias("feature"))
             .agg(F.avg(F.abs("coef")).alias("mean_abs_coef")))
    from pyspark.sql import Window
    return g.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("mean_abs_coef"), "feature")))


def _class_type(classes) -> str:
    """Spark type of the stored class labels."""
    for kind, name in ((bool, "boolean"), (int, "long"), (float, "double")):
        if all(isinstance(c, kind) for c in classes):
            return name
    return "string"


def data_fingerprint(df: DataFrame, label: str, features) -> str:
    """Row count and order-free content hash of a fit's input (features rounded,
    so that another order of summation in a scaler does not count as a change)."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(
        F.col(label), *[F.round(F.col(c), 6) for c in features]).cast("decimal(38,0)"))).first()
    return f"{label}|{','.join(features)}|{row[0]}|{row[1]}"
