"""Least squares and its diagnostics, logistic regression.

*Gram pattern*: one pass for the means, one pass for the centred cross
products of [X, y] (p(p+1)/2 aggregate expressions, map-side combined), then
a p x p solve on the driver. Reduced models (Type III sums of squares,
nested F tests) reuse the same matrix by deleting rows and columns, so they
cost no extra pass. Per-row outputs (fitted values, residuals, leverage,
Cook's distance) are column expressions with the solved coefficients as
literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from .ordered import in_order


@dataclass
class Gram:
    names: list          # column names, y last
    n: float             # sum of weights (row count when unweighted)
    rows: int
    mean: np.ndarray     # weighted means
    css: np.ndarray      # centred (weighted) sums of squares and cross products


def gram(df: DataFrame, cols, weight: str | None = None) -> Gram:
    """Centred sums of squares / cross products of ``cols`` over complete rows.

    Pass 1: weighted sums (one aggregate). Pass 2: every partition forms its
    centred X'WX with numpy on Arrow batches (``mapInPandas``) and emits one
    row of p(p+1)/2 partial sums; the partials are summed by a grouped
    aggregate on the cluster, so the driver receives one p x p matrix and the
    per-row work stays vectorised whatever p is (no giant codegen method).
    """
    import pandas as pd

    cols = list(cols)
    cc = df.dropna(subset=cols + ([weight] if weight else []))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    first = cc.agg(F.sum(w).alias("_sw"), F.count(F.lit(1)).alias("_n"),
                   *[F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in enumerate(cols)]).first()
    sw = float(first["_sw"] or 0.0)
    if sw == 0:
        raise ValueError("no complete rows")
    p = len(cols)
    mean = np.array([float(first[f"_s{i}"]) / sw for i in range(p)])
    iu = np.triu_indices(p)
    m = len(iu[0])
    x = cc.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                  w.alias("w"))

    def partials(batches):
        acc = np.zeros(m)
        seen = False
        for b in batches:
            if len(b) == 0:
                continue
            seen = True
            xc = b[[f"x{i}" for i in range(p)]].to_numpy(dtype=float) - mean
            ww = b["w"].to_numpy(dtype=float)
            acc += ((xc * ww[:, None]).T @ xc)[iu]
        if seen:
            yield pd.DataFrame({"k": np.arange(m, dtype=np.int64), "v": acc})

    parts = x.mapInPandas(partials, "k long, v double")
    sums = parts.groupBy("k").agg(F.sum("v").alias("v")).collect()
    css = np.zeros((p, p))
    flat = np.zeros(m)
    for r in sums:
        flat[r["k"]] = r["v"]
    css[iu] = flat
    css = css + css.T - np.diag(np.diag(css))
    return Gram(cols, sw, int(first["_n"]), mean, css)


@dataclass
class OLSResult:
    terms: list
    coef: np.ndarray          # intercept first when fitted with one
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    n: int
    k: int                    # estimated parameters (rank, incl. intercept)
    sse: float
    sst: float
    r2: float
    adj_r2: float
    f_stat: float
    f_p: float
    sigma: float
    xtx_inv: np.ndarray       # of the full design incl. intercept column
    extra: dict = field(default_factory=dict)


#: Share of its own sum of squares that a column must keep after the columns before it.
SWEEP_TOLERANCE = 1e-9
#: Rows up to which the Durbin-Watson p-value is exact.
EXACT_ROWS = 100


def sweep(css: np.ndarray, idx: list, y: int, tol: float = SWEEP_TOLERANCE) -> tuple[np.ndarray, np.ndarray, float, list]:
    """(coefficients, generalised inverse, residual sum of squares, aliased positions) of the columns ``idx``.

    Columns enter in order; one whose rest after those before it is below ``tol`` of its
    own sum of squares is aliased: its coefficient is 0 and its row and column of the inverse
    vanish, so the estimates are those of the model without it."""
    at = [*idx, y]
    a = css[np.ix_(at, at)].astype(float).copy()
    p, own, aliased = len(idx), np.diag(a).copy(), []
    for k in range(p):
        pivot = a[k, k]
        if not pivot > tol * own[k] or own[k] <= 0:
            aliased.append(k)
            a[k, :] = a[:, k] = 0.0
            continue
        row, col = a[k].copy() / pivot, a[:, k].copy()
        a -= np.outer(col, row)
        a[k], a[:, k] = row, -col / pivot
        a[k, k] = 1 / pivot
    inverse = a[:p, :p]
    return a[:p, p].copy(), (inverse + inverse.T) / 2, float(a[p, p]), aliased


def _solve(css: np.ndarray, mean: np.ndarray, n: float, rows: int, idx: list, y: int,
           intercept: bool = True):
    b, inv, sse, aliased = sweep(css, idx, y)
    k = len(idx) - len(aliased) + (1 if intercept else 0)
    return b, inv, max(sse, 0.0), k, aliased


def ols_from_gram(g: Gram, y: str, xs, intercept: bool = True) -> OLSResult:
    """OLS with intercept on the centred Gram matrix; aliased terms get 0 and no standard error."""
    pos = {c: i for i, c in enumerate(g.names)}
    idx = [pos[c] for c in xs]
    yi = pos[y]
    b, inv, sse, k, aliased = _solve(g.css, g.mean, g.n, g.rows, idx, yi, intercept)
    n = g.rows
    sst = float(g.css[yi, yi])
    dfe = n - k
    sigma2 = sse / dfe if dfe > 0 else float("nan")
    xbar = g.mean[idx]
    b0 = float(g.mean[yi] - b @ xbar)
    var_b = sigma2 * np.diag(inv)
    var_b0 = sigma2 * (1.0 / g.n + xbar @ inv @ xbar)
    coef = np.concatenate([[b0], b])
    se = np.sqrt(np.concatenate([[var_b0], var_b]))
    se[[i + 1 for i in aliased]] = np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
    p = np.array([dist.t_sf2(float(tv), dfe) if np.isfinite(tv) else float("nan") for tv in t])
    r2 = 1 - sse / sst if sst > 0 else float("nan")
    adj = 1 - (1 - r2) * (n - 1) / dfe if dfe > 0 else float("nan")
    dfm = k - 1
    f_stat = ((sst - sse) / dfm) / sigma2 if dfm > 0 and sigma2 > 0 else float("nan")
    f_p = dist.f_sf(f_stat, dfm, dfe) if np.isfinite(f_stat) else float("nan")
    # (X'X)^-1 of the uncentred design [1, X]
    p_ = len(idx)
    full = np.zeros((p_ + 1, p_ + 1))
    full[0, 0] = 1.0 / g.n + xbar @ inv @ xbar
    full[0, 1:] = full[1:, 0] = -(inv @ xbar)
    full[1:, 1:] = inv
    return OLSResult(["Intercept", *xs], coef, se, t, p, n, k, sse, sst, r2, adj, f_stat, f_p,
                     math.sqrt(sigma2) if sigma2 == sigma2 else float("nan"), full,
                     {"aliased": [xs[i] for i in aliased]})


def ols(df: DataFrame, y: str, xs, weight: str | None = None) -> tuple[OLSResult, Gram]:
    g = gram(df, [*xs, y], weight)
    return ols_from_gram(g, y, list(xs)), g


def coef_table(spark, res: OLSResult, g: Gram | None = None, y: str | None = None,
               with_beta: bool = False, with_vif: bool = False, with_aliased: bool = False) -> DataFrame:
    """Tidy coefficient table: term, estimate, std_err, t_value, p_value[, std_beta, vif, aliased].
    An aliased term has estimate 0 and nulls."""
    rows = []
    sd = None
    if g is not None and y is not None:
        sd = {c: math.sqrt(g.css[i, i] / (g.rows - 1)) for i, c in enumerate(g.names)}
    vifs = {}
    if with_vif and g is not None:
        xs = res.terms[1:]
        pos = {c: i for i, c in enumerate(g.names)}
        idx = [pos[c] for c in xs]
        c = g.css[np.ix_(idx, idx)]
        d = np.sqrt(np.diag(c))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = c / np.outer(d, d)
        inv = np.linalg.pinv(r)
        vifs = {x: float(inv[i, i]) for i, x in enumerate(xs)}
    for i, term in enumerate(res.terms):
        gone = term in res.extra.get("aliased", [])
        row = {"term": term, "estimate": float(res.coef[i])} | {
            name: None if gone else float(v[i]) for name, v in (("std_err", res.se), ("t_value", res.t), ("p_value", res.p))}
        if with_aliased:
            row["aliased"] = gone
        if with_beta:
            row["std_beta"] = (0.0 if term == "Intercept"
                               else float(res.coef[i] * sd[term] / sd[y]))
        if with_vif:
            row["vif"] = 0.0 if term == "Intercept" else vifs.get(term)
        rows.append(row)
    schema = "term string, estimate double, std_err double, t_value double, p_value double"
    if with_beta:
        schema += ", std_beta double"
    if with_vif:
        schema += ", vif double"
    if with_aliased:
        schema += ", aliased boolean"
    return spark.createDataFrame(rows, schema)


def fit_table(spark, res: OLSResult, model: str = "model") -> DataFrame:
    row = {"model": model, "nobs": res.n, "n_params": res.k, "r2": res.r2,
           "adj_r2": res.adj_r2, "f_stat": res.f_stat, "f_p_value": res.f_p,
           "resid_std_err": res.sigma, "sse": res.sse, "df_resid": res.n - res.k}
    return spark.createDataFrame([row], "model string, nobs long, n_params long, r2 double, "
                                 "adj_r2 double, f_stat double, f_p_value double, "
                                 "resid_std_err double, sse double, df_resid long")


def linear_predictor(res: OLSResult) -> Column:
    expr = F.lit(float(res.coef[0]))
    for term, b in zip(res.terms[1:], res.coef[1:]):
        expr = expr + F.col(term) * float(b)
    return expr


def renamed(res: OLSResult, names: dict) -> OLSResult:
    """``res`` with terms renamed, where a column needs quoting to be referred to."""
    return replace(res, terms=[names.get(t, t) for t in res.terms])


def quad_form(res: OLSResult) -> Column:
    """Leverage h = x' (X'X)^-1 x as a column expression (x includes the 1)."""
    xs = [F.lit(1.0)] + [F.col(t).cast("double") for t in res.terms[1:]]
    m = res.xtx_inv
    expr = None
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            c = m[i, j] * (1.0 if i == j else 2.0)
            if c == 0:
                continue
            term = xs[i] * xs[j] * float(c)
            expr = term if expr is None else expr + term
    return expr if expr is not None else F.lit(0.0)


def diagnostics(df: DataFrame, res: OLSResult, y: str, key: str) -> DataFrame:
    """T19 per row: fitted, residual, leverage, internally studentised residual,
    Cook's distance."""
    cc = df.dropna(subset=[y, *res.terms[1:]])
    yhat = linear_predictor(res)
    h = quad_form(res)
    s2 = res.sigma ** 2
    out = cc.select(key, F.col(y).alias("y"), yhat.alias("yhat"), h.alias("leverage"))
    out = out.withColumn("resid", F.col("y") - F.col("yhat"))
    out = out.withColumn("student_resid",
                         F.col("resid") / F.sqrt(F.lit(s2) * (1 - F.col("leverage"))))
    return out.withColumn("cooks_d", F.col("student_resid") ** 2 / res.k
                          * F.col("leverage") / (1 - F.col("leverage")))


def type3_ss(g: Gram, y: str, effects: dict) -> list[dict]:
    """Type III SS per effect (name -> list of its columns): SSE(without) - SSE(full), which tests what
    of the effect is estimable beside all others; its df are those that the effect adds to the rank,
    and an effect that adds none has no test."""
    pos = {c: i for i, c in enumerate(g.names)}
    all_x = [c for cols in effects.values() for c in cols]
    full_idx = [pos[c] for c in all_x]
    yi = pos[y]
    _, _, sse_full, k_full, _ = _solve(g.css, g.mean, g.n, g.rows, full_idx, yi)
    dfe = g.rows - k_full
    mse = sse_full / dfe
    out = []
    for name, cols in effects.items():
        red = [pos[c] for c in all_x if c not in cols]
        _, _, sse_red, k_red, _ = _solve(g.css, g.mean, g.n, g.rows, red, yi)
        df_ = k_full - k_red
        ss = sse_red - sse_full if df_ > 0 else 0.0
        f = (ss / df_) / mse if df_ > 0 else None
        out.append({"source": name, "df": df_, "ss3": ss, "mean_square": ss / df_ if df_ else None,
                    "f_value": f, "p_value": dist.f_sf(f, df_, dfe) if df_ > 0 else None})
    return out


def nested_f(g: Gram, y: str, full: list, reduced: list) -> dict:
    """F test of a reduced model against the full one (same rows)."""
    a = ols_from_gram(g, y, full)
    b = ols_from_gram(g, y, reduced)
    df1 = a.k - b.k
    df2 = a.n - a.k
    f = ((b.sse - a.sse) / df1) / (a.sse / df2)
    return {"f_stat": f, "df1": df1, "df2": df2, "p_value": dist.f_sf(f, df1, df2),
            "full": a, "reduced": b}


def breusch_pagan(df: DataFrame, res: OLSResult, y: str) -> dict:
    """Studentised (Koenker) LM = n R^2 of e^2 on X; chi-square with p df."""
    xs = res.terms[1:]
    cc = df.dropna(subset=[y, *xs]).withColumn("_e2", (F.col(y) - linear_predictor(res)) ** 2)
    aux = ols_from_gram(gram(cc, [*xs, "_e2"]), "_e2", xs)
    lm = aux.n * aux.r2
    return {"bp_stat": float(lm), "df": len(xs), "p_value": float(dist.chi2_sf(lm, len(xs)))}


def with_neighbors(df: DataFrame, key: str, cols) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>``: the rows before / after in the order of
    ``key`` and then of all other columns, so repeated keys have one order
    whatever the partitioning of the input.

    No single-partition window over rows: lag / lead run inside the partitions
    of a stored range sort; a partition's first and last rows take their outside
    neighbour from the edge table (one row per partition).
    """
    from pyspark.sql import Window
    cols = list(cols)
    b = in_order(df, [key, *[c for c in df.columns if c != key]], "neighbors")
    w = Window.partitionBy("_part").orderBy("_seq")
    edges = b.groupBy("_part").agg(
        F.min("_seq").alias("_lo"), F.max("_seq").alias("_hi"),
        F.min_by(F.struct(*cols), F.col("_seq")).alias("_first"),
        F.max_by(F.struct(*cols), F.col("_seq")).alias("_last"))
    we = Window.orderBy("_part")  # one row per partition
    edges = edges.select("_part", "_lo", "_hi", F.lag("_last").over(we).alias("_pl"),
                         F.lead("_first").over(we).alias("_nf"))
    b = b.withColumns({**{f"_lag_{c}": F.lag(c).over(w) for c in cols},
                       **{f"_lead_{c}": F.lead(c).over(w) for c in cols}})
    out = b.join(edges, "_part").withColumns({
        **{f"prev_{c}": F.when(F.col("_seq") == F.col("_lo"), F.col(f"_pl.{c}")).otherwise(F.col(f"_lag_{c}"))
           for c in cols},
        **{f"next_{c}": F.when(F.col("_seq") == F.col("_hi"), F.col(f"_nf.{c}"))
           .otherwise(F.col(f"_lead_{c}")) for c in cols}})
    return out.drop("_part", "_seq", "_lo", "_hi", "_pl", "_nf", *[f"_lag_{c}" for c in cols],
                    *[f"_lead_{c}" for c in cols])


def quadratic_ratio_cdf(eigenvalues: np.ndarray, d: float) -> float:
    """P(sum v_i z_i^2 / sum z_i^2 <= d) for independent standard normal z_i: the characteristic
    function of sum (v_i - d) z_i^2 inverted along the real line (Imhof's integral)."""
    away = np.asarray(eigenvalues, float) - d
    if not len(away) or not np.abs(away).max() > 0:
        return 1.0
    away = away / np.abs(away).max()
    if (away <= 0).all() or (away >= 0).all():
        return 1.0 if (away <= 0).all() else 0.0
    nodes, weights = np.polynomial.legendre.leggauss(64)
    cuts = np.concatenate([[0], np.geomspace(1e-6, 1 - 1e-6, 40), 1 - np.geomspace(1e-6, 1e-12, 8)[1:], [1]])
    cuts = np.unique(np.concatenate([cuts, 1 - np.geomspace(0.5, 1e-6, 40)]))
    t = ((cuts[1:] - cuts[:-1])[:, None] * (nodes + 1) / 2 + cuts[:-1, None]).ravel()
    w = ((cuts[1:] - cuts[:-1])[:, None] * weights / 2).ravel()
    u = t / (1 - t)
    turn = away[None, :] * u[:, None]
    angle = 0.5 * np.arctan(turn).sum(1)
    log_size = 0.25 * np.log1p(turn * turn).sum(1)
    area = (w * np.sin(angle) * np.exp(-log_size) / (u * (1 - t) ** 2)).sum()
    return float(np.clip(0.5 - area / np.pi, 0, 1))


def durbin_watson_exact(d: float, x: np.ndarray) -> float:
    """P(d' <= d) under independent normal errors for the design x (rows in order, intercept included)."""
    n = len(x)
    q = np.linalg.qr(x)[0]
    q = q[:, np.abs(q).sum(0) > 0]
    outside = np.linalg.svd(np.eye(n) - q @ q.T)[0][:, :n - np.linalg.matrix_rank(x)]
    steps = np.diff(outside, axis=0)
    return quadratic_ratio_cdf(np.linalg.eigvalsh(steps.T @ steps), d)


def durbin_watson(df: DataFrame, res: OLSResult, y: str, key: str) -> dict:
    """d = sum((e_t - e_{t-1})^2) / sum(e_t^2) in key order, with
    P(d <= observed) (alternative: positive autocorrelation): exact for fewer than ``EXACT_ROWS``
    rows (the p-value of a table of that size is computed on the driver), else the
    normal approximation.

    Moments of d under H0 use tr(X'AX G) and tr(X'A^2X G) (A = D'D): the Gram
    matrices of the first differences of X and of A X, in the same pass as
    the numerator.
    """
    xs = ["_one", *res.terms[1:]]
    cc = df.dropna(subset=[y, *res.terms[1:]]).withColumn("_one", F.lit(1.0))
    cc = cc.select(key, *[F.col(c).cast("double").alias(c) for c in xs],
                   (F.col(y) - linear_predictor(res)).alias("_e"))
    nb = with_neighbors(cc, key, [*xs, "_e"])
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    dif = {c: F.col(c) - F.col(f"prev_{c}") for c in xs}
    ax = {c: 2 * F.col(c) - F.coalesce(F.col(f"prev_{c}"), F.col(c))
          - F.coalesce(F.col(f"next_{c}"), F.col(c)) for c in xs}
    de = F.col("_e") - F.col("prev__e")
    agg = nb.agg(F.sum(de * de).alias("num"), F.sum(F.col("_e") ** 2).alias("den"),
                 *[F.sum(dif[xs[i]] * dif[xs[j]]).alias(f"q{k}") for k, (i, j) in enumerate(pairs)],
                 *[F.sum(ax[xs[i]] * ax[xs[j]]).alias(f"r{k}") for k, (i, j) in enumerate(pairs)]
                 ).first()
    d = float(agg["num"] or 0.0) / float(agg["den"])
    xax = np.zeros((p, p))
    xa2x = np.zeros((p, p))
    for k, (i, j) in enumerate(pairs):
        xax[i, j] = xax[j, i] = agg[f"q{k}"] or 0.0
        xa2x[i, j] = xa2x[j, i] = agg[f"r{k}"] or 0.0
    gm = res.xtx_inv
    n, kk = res.n, res.k
    m1 = xax @ gm
    pp = 2 * (n - 1) - np.trace(m1)
    qq = 2 * (3 * n - 4) - 2 * np.trace(xa2x @ gm) + np.trace(m1 @ m1)
    e = pp / (n - kk)
    v = 2.0 / ((n - kk) * (n - kk + 2)) * (qq - pp * e)
    if n < EXACT_ROWS:
        rest = [c for c in cc.columns if c != key]
        rows = cc.orderBy(key, *rest).select(*xs).limit(EXACT_ROWS).collect()
        pval = durbin_watson_exact(d, np.array([list(r) for r in rows], float))
    else:
        pval = dist.norm_cdf((d - e) / math.sqrt(v)) if v > 0 else float("nan")
    return {"dw": float(d), "n": int(n), "k": int(kk), "expected": float(e),
            "p_value": float(pval)}


def hosmer_lemeshow(df: DataFrame, label: str, prob: str, groups: int = 10) -> DataFrame:
    """Groups by probability deciles (cut points = exact quantiles, equal
    probabilities stay together), observed vs expected events, chi-square on
    groups - 2 df."""
    from .ordered import quantiles_wide
    probs = [i / groups for i in range(1, groups)]
    names = [f"_c{i}" for i in range(1, groups)]
    cuts = quantiles_wide(df, prob, probs, names)
    x = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).crossJoin(F.broadcast(cuts))
    grp = sum(F.when(F.col(prob) > F.col(c), 1).otherwise(0) for c in names)
    g = x.groupBy(grp.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("observed"),
        F.sum(prob).alias("expected"))
    term = (F.col("observed") - F.col("expected")) ** 2 / (
        F.col("expected") * (1 - F.col("expected") / F.col("n")))
    return g.withColumn("chi2_term", term)


def hosmer_lemeshow_test(df: DataFrame, label: str, prob: str, groups: int = 10) -> DataFrame:
    """T20 total: chi-square over the groups, its degrees of freedom and p."""
    g = hosmer_lemeshow(df, label, prob, groups).agg(
        F.sum("chi2_term").alias("chi2"), (F.count(F.lit(1)) - 2).cast("int").alias("df")).first()
    chi2, k = g["chi2"], g["df"]
    p = dist.chi2_sf(chi2, k) if chi2 is not None and k > 0 else None
    return df.sparkSession.createDataFrame([(chi2, k, p)], "chi2 double, df int, p_value double")


def standardized_residuals(df: DataFrame, res: OLSResult, y: str) -> DataFrame:
    """``fitted``, ``res`` and ``std_res`` (by its own standard error, which
    the leverage shrinks) of the complete rows."""
    cc = df.dropna(subset=[y, *res.terms[1:]])
    cc = cc.withColumns({"fitted": linear_predictor(res), "_h": quad_form(res)})
    cc = cc.withColumn("res", F.col(y) - F.col("fitted"))
    return cc.withColumn("std_res", F.col("res") / (float(res.sigma) * F.sqrt(1 - F.col("_h")))).drop("_h")


def qq_points(df: DataFrame, col: str, probs) -> DataFrame:
    """Sample quantiles of ``col`` against normal ones at ``probs``."""
    from .ordered import quantiles_long
    q = quantiles_long(df, col, probs)
    theory = F.array(*[F.lit(dist.norm_ppf(float(p))) for p in probs])
    return q.select("prob", F.get(theory, F.col("prob_index")).alias("theoretical"), F.col("value").alias("sample"))


def scale_location(df: DataFrame, bins: int = 40) -> DataFrame:
    """By bins of the fitted value, its mean and the mean root of the
    absolute standardised residual."""
    span = df.agg(F.min("fitted").alias("lo"), F.max("fitted").alias("hi")).first()
    if span["lo"] is None:
        width = 1.0
    else:
        width = (span["hi"] - span["lo"]) / bins or 1.0
    at = F.least(F.floor((F.col("fitted") - F.lit(span["lo"])) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("fitted").alias("fitted"),
                                           F.avg(F.sqrt(F.abs("std_res"))).alias("root_abs_std_res"))
