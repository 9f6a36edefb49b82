"""Statistics: correlation, covariance, VIF, normality, ANOVA, histograms,
densities, box statistics, trends (T*).

Row passes are Spark aggregates (one expression per pair or per group);
only p x p matrices or a handful of scalars reach the driver, where the
distribution tails of ``functions.dist`` turn statistics into p-values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..session import materialize
from .ordered import (join_by, multi_quantiles, quantiles_from_counts, quantiles_wide, row_ranks,
                      value_counts, without_nan)

# ---------------------------------------------------------------------------
# Correlation and covariance
# ---------------------------------------------------------------------------


def corr_long(df: DataFrame, cols, by=()) -> DataFrame:
    """Pearson r for every pair i < j, pairwise complete: (by..., var1, var2, n, r). NaN counts
    as null; r is null where a column has no variance."""
    cols = list(cols)
    df = without_nan(df, *cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        spread = F.sqrt(F.var_pop(F.when(both, F.col(a)))) * F.sqrt(F.var_pop(F.when(both, F.col(b))))
        r = F.try_divide(F.covar_pop(a, b), spread)
        aggs += [r.alias(f"_r{k}"), F.count_if(both).alias(f"_n{k}")]
    one = df.groupBy(*by).agg(*aggs)
    one = one.withColumns({f"_r{k}": F.when(F.abs(f"_r{k}") > 1, F.signum(f"_r{k}")).otherwise(F.col(f"_r{k}")) for k in range(len(pairs))})
    arr = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                             F.col(f"_n{k}").alias("n"), F.col(f"_r{k}").alias("r"))
                    for k, (a, b) in enumerate(pairs)])
    return one.select(*by, F.explode(arr).alias("_p")).select(*by, "_p.*")


def corr_pvalues(corr: DataFrame) -> DataFrame:
    """T1 (batch report form): t = r sqrt((n-2)/(1-r^2)) and two-sided p per pair.

    The input is the p(p-1)/2-row pair table; tails are evaluated on the driver.
    """
    rows = corr.collect()
    out = []
    for r in rows:
        d = r.asDict()
        rv, n = d["r"], d["n"]
        if rv is None or n is None or n < 3 or abs(rv) >= 1:
            t = p = None
        else:
            t = rv * math.sqrt((n - 2) / (1 - rv * rv))
            p = dist.t_sf2(t, n - 2)
        out.append({**d, "t": t, "p_value": p})
    spark = corr.sparkSession
    schema = corr.schema.add("t", "double").add("p_value", "double")
    return spark.createDataFrame(out, schema)


def high_corr_pairs(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with |r| above the threshold."""
    return corr.where(F.abs("r") > threshold)


def group_covariance(df: DataFrame, cols, group: str) -> DataFrame:
    """Sample covariance per group for i <= j: (group, var1, var2, cov)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.groupBy(group).agg(*[F.covar_samp(a, b).alias(f"_c{k}")
                                  for k, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                             F.col(f"_c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])
    return one.select(group, F.explode(arr).alias("_p")).select(group, "_p.*")


def _blocked_pairs(rows: DataFrame, group: str, values: list, block: int) -> DataFrame:
    """Every ordered pair of different groups: ``group_a, group_b`` and ``a_<v>, b_<v>``. Groups fall
    into hash blocks, and each pair of blocks is one key of an equi-join, which deals the
    pairs out over tasks for any number of groups."""
    c = materialize(rows.select(group, *values), "paired")
    blocks = max(1, -(-c.count() // block))
    own = F.pmod(F.xxhash64(group), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = c.select(F.col(group).alias("group_a"), *[F.col(x).alias(f"a_{x}") for x in values], own.alias("_i"), every.alias("_j"))
    b = c.select(F.col(group).alias("group_b"), *[F.col(x).alias(f"b_{x}") for x in values], own.alias("_j"), every.alias("_i"))
    return a.join(b, ["_i", "_j"]).where(F.col("group_a") != F.col("group_b")).drop("_i", "_j")


def cov_frobenius(cov: DataFrame, group: str, block: int = 1024) -> DataFrame:
    """T4: Frobenius distance between every two groups' covariance matrices.

    The input has k * p(p+1)/2 rows (k groups); an off-diagonal cell counts
    twice. A group's cells become one vector, and pairs of groups are dealt out by blocks.
    Output: (group_a, group_b, distance, mean_distance)."""
    weight = F.when(F.col("var1") == F.col("var2"), 1.0).otherwise(math.sqrt(2))
    cell = F.struct("var1", "var2", (weight * F.col("cov")).alias("c"))
    vectors = cov.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    vectors = vectors.select(group, F.transform("_cells", lambda x: x["c"]).alias("cells"))
    pairs = _blocked_pairs(vectors, group, ["cells"], block).where(F.col("group_a") < F.col("group_b"))
    squares = F.zip_with("a_cells", "b_cells", lambda x, y: (x - y) ** 2)
    total = F.aggregate(squares, F.lit(0.0), lambda t, x: t + x)
    d = materialize(pairs.select("group_a", "group_b", F.sqrt(total).alias("distance")), "frobenius")
    return d.crossJoin(F.broadcast(d.agg(F.avg("distance").alias("mean_distance"))))


def corr_matrix_np(df: DataFrame, cols) -> np.ndarray:
    """Complete-case correlation matrix on the driver (p x p)."""
    cc = without_nan(df, *cols).dropna(subset=list(cols))
    long = corr_long(cc, cols).collect()
    p = len(cols)
    m = np.eye(p)
    idx = {c: i for i, c in enumerate(cols)}
    for r in long:
        i, j = idx[r["var1"]], idx[r["var2"]]
        m[i, j] = m[j, i] = r["r"] if r["r"] is not None else float("nan")
    return m


def vif(df: DataFrame, cols) -> DataFrame:
    """T5: variance inflation factors = diagonal of the inverse correlation matrix
    (complete cases; the same as regressing each column on the others with an
    intercept). A column without variance has none (null) and takes no part."""
    cols = list(cols)
    m = corr_matrix_np(df, cols)
    off = m.copy()
    np.fill_diagonal(off, np.nan)
    used = [i for i in range(len(cols)) if len(cols) == 1 or not np.isnan(off[i]).all()]
    inv = np.linalg.pinv(m[np.ix_(used, used)]) if used else np.zeros((0, 0))
    found = {i: float(inv[k, k]) for k, i in enumerate(used)}
    rows = [(c, found.get(i)) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


# ---------------------------------------------------------------------------
# Normality
# ---------------------------------------------------------------------------

#: Ranks at either end, and spans of up to so many ranks, whose normal scores are taken one by one.
END_RANKS, SHORT_SPAN = 64, 16
#: Sizes for which the Shapiro-Wilk p-value approximation is defined.
SW_DOMAIN = (3, 5000)


def _span_sums(rows: DataFrame) -> DataFrame:
    """Adds the sums ``m`` of m_i and ``mm`` of m_i^2 over the ranks from..to, m_i = z((i - 3/8) / (n + 1/4)), without a
    row per rank.

    Euler-Maclaurin at the midpoints: the integral from ``from`` - 1/2 to ``to`` + 1/2, whose
    antiderivatives are -N phi(z) and N (p - z phi(z)) with N = n + 1/4, less the first two
    terms in the odd derivatives at its ends. These fall like powers of 1 / rank, so with
    ``END_RANKS`` ranks between the span and either end the rest is below 1e-10. A single
    rank is taken directly."""
    big = F.col("n") + 0.25
    ends = {"a": F.col("from") - 0.5, "b": F.col("to") + 0.5, "c": (F.col("from") + F.col("to")) / 2}
    # a column each: the quantile function is long and must stand in the plan once per end
    rows = rows.withColumns({f"_p{k}": (t - 0.375) / big for k, t in ends.items()})
    alone = F.col("from") == F.col("to")
    rows = rows.withColumns({f"_z{k}": F.when(alone if k == "c" else ~alone, dist.norm_ppf_col(F.col(f"_p{k}"))) for k in ends})
    rows = rows.withColumns({f"_f{k}": F.exp(-F.col(f"_z{k}") * F.col(f"_z{k}") / 2) / math.sqrt(2 * math.pi) for k in "ab"})
    rows = rows.withColumns({f"_g{k}": 1 / (big * F.col(f"_f{k}")) for k in "ab"})  # dz/dt

    def at(k: str) -> tuple[Column, Column]:
        p, z, phi, g = (F.col(f"_{c}{k}") for c in "pzfg")
        return (-big * phi - g / 24 + 7 * g * g * g * (1 + 2 * z * z) / 5760,
                big * (p - z * phi) - 2 * z * g / 24 + 7 * 2 * g * g * g * z * (4 + 2 * z * z) / 5760)

    (one_a, two_a), (one_b, two_b), z = at("a"), at("b"), F.col("_zc")
    return (rows.withColumns({"m": F.when(alone, z).otherwise(one_b - one_a), "mm": F.when(alone, z * z).otherwise(two_b - two_a)})
            .drop(*[f"_{c}{k}" for c in "pz" for k in "abc"], *[f"_{c}{k}" for c in "fg" for k in "ab"]))


def _normal_scores(spans: DataFrame) -> DataFrame:
    """Per piece of a value's rank span: ``x, n, from, to`` and the sums ``m`` and ``mm`` of the normal scores
    and their squares. A span makes three pieces at most besides the ``END_RANKS`` ranks
    at either end and short spans, which go rank by rank: work per distinct value, not per row."""
    n = F.col("n")
    cut = F.least(F.lit(END_RANKS), F.floor(n / 2))

    def piece(a: Column, b: Column, single: bool) -> Column:
        ranks = F.sequence(a, b) if single else F.array(a)
        return F.when(a <= b, F.transform(ranks, lambda i: F.struct(i.alias("from"), (i if single else b).alias("to")))).otherwise(
            F.array().cast("array<struct<from:bigint,to:bigint>>"))

    a, b = F.col("first_rank"), F.col("last_rank")
    short = b - a < SHORT_SPAN
    low_end, high_start = F.least(b, cut), F.greatest(a, n - cut + 1)
    mid_a, mid_b = F.greatest(a, cut + 1), F.least(b, n - cut)
    pieces = F.when(short, piece(a, b, True)).otherwise(F.concat(
        piece(a, low_end, True), piece(mid_a, mid_b, False), piece(high_start, b, True)))
    rows = spans.select("x", "n", F.explode(pieces).alias("_p")).select("x", "n", "_p.from", "_p.to")
    return _span_sums(rows)


def _sw_coef_ends(n: int):
    m = [dist.norm_ppf((i - 0.375) / (n + 0.25)) for i in (n - 1, n)]
    return m[0], m[1]


def shapiro_wilk(df: DataFrame, col: str) -> dict:
    """Shapiro-Wilk W and p (Royston 1992/1995 approximation).

    One aggregate over the rank spans gives sum(m_i^2), sum(m_i x_(i)) over the middle
    ranks and the four end values; the rest is scalar algebra. W is computed for
    any n; the p-value only inside ``SW_DOMAIN``, and is null beyond it.
    """
    df = without_nan(df, col)
    base = df.where(F.col(col).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp(col).alias("v"))
    b = base.first()
    n = int(b["n"])
    if n < 3:
        return {"column": col, "n": n, "W": None, "p_value": None}
    ss_x = float(b["v"]) * (n - 1)
    ex = _normal_scores(row_ranks(df, col).withColumn("x", F.col(col).cast("double")))
    # the four end ranks are always pieces of their own
    at = F.col("from")
    mid = (at > 2) & (at < F.col("n") - 1)
    agg = ex.agg(
        F.sum("mm").alias("ss"),
        F.sum(F.when(mid, F.col("m") * F.col("x"))).alias("smid"),
        F.max(F.when(at == 1, F.col("x"))).alias("x1"),
        F.max(F.when(at == 2, F.col("x"))).alias("x2"),
        F.max(F.when(at == F.col("n") - 1, F.col("x"))).alias("xn1"),
        F.max(F.when(at == F.col("n"), F.col("x"))).alias("xn")).first()
    if ss_x <= 0:
        return {"column": col, "n": n, "W": None, "p_value": None}
    ss = float(agg["ss"])
    mn1, mn = _sw_coef_ends(n)
    u = 1.0 / math.sqrt(n)
    if n == 3:
        an = math.sqrt(0.5)
        stat = (an * (agg["xn"] - agg["x1"])) ** 2 / ss_x
        w = min(stat, 1.0)
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return {"column": col, "n": n, "W": w, "p_value": p}
    an = (-2.706056 * u ** 5 + 4.434685 * u ** 4 - 2.07119 * u ** 3 - 0.147981 * u ** 2
          + 0.221157 * u + mn / math.sqrt(ss))
    if n > 5:
        an1 = (-3.582633 * u ** 5 + 5.682633 * u ** 4 - 1.752461 * u ** 3
               - 0.293762 * u ** 2 + 0.042981 * u + mn1 / math.sqrt(ss))
        phi = (ss - 2 * mn ** 2 - 2 * mn1 ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
        num = (an * (agg["xn"] - agg["x1"]) + an1 * (agg["xn1"] - agg["x2"])
               + float(agg["smid"] or 0.0) / math.sqrt(phi))
    else:
        phi = (ss - 2 * mn ** 2) / (1 - 2 * an ** 2)
        # middle ranks 2..n-1 all use m_i / sqrt(phi)
        mid_all = float(agg["smid"] or 0.0) + mn1 * agg["xn1"] - mn1 * agg["x2"]
        num = an * (agg["xn"] - agg["x1"]) + mid_all / math.sqrt(phi)
    w = min(num * num / ss_x, 1.0)
    if n > SW_DOMAIN[1]:
        return {"column": col, "n": n, "W": w, "p_value": None}
    if n <= 11:
        gamma = 0.459 * n - 2.273
        mu = 0.544 - 0.39978 * n + 0.025054 * n ** 2 - 0.0006714 * n ** 3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n ** 2 - 0.0020322 * n ** 3)
        arg = gamma - math.log1p(-w) if w < 1 else float("inf")
        z = (-math.log(arg) - mu) / sd if arg > 0 and math.isfinite(arg) else float("-inf")
    else:
        ln = math.log(n)
        mu = 0.0038915 * ln ** 3 - 0.083751 * ln ** 2 - 0.31082 * ln - 1.5861
        sd = math.exp(0.0030302 * ln ** 2 - 0.082676 * ln - 0.4803)
        z = (math.log1p(-w) - mu) / sd if w < 1 else float("-inf")
    p = dist.norm_sf(z)
    return {"column": col, "n": n, "W": w, "p_value": p}


def shapiro_wilk_table(df: DataFrame, cols) -> DataFrame:
    rows = [shapiro_wilk(df, c) for c in cols]
    for r in rows:
        r["in_domain"] = SW_DOMAIN[0] <= r["n"] <= SW_DOMAIN[1]
        r["normal_at_05"] = None if r["p_value"] is None else bool(r["p_value"] > 0.05)
    return df.sparkSession.createDataFrame(
        rows, "column string, n long, W double, p_value double, in_domain boolean, normal_at_05 boolean")


def moments(df: DataFrame, col: str, by=()) -> DataFrame:
    """T7 moments: n, mean, std, and bias-adjusted skewness G1 / kurtosis G2."""
    g = without_nan(df, col).groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"),
                            F.stddev_samp(col).alias("std"),
                            F.skewness(col).alias("_g1"), F.kurtosis(col).alias("_g2"))
    n = F.col("n").cast("double")
    return g.withColumns({
        "skewness": F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2),
        "kurtosis": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6),
    }).drop("_g1", "_g2")


def normality_large_n(df: DataFrame, col: str) -> DataFrame:
    """T7 tests against the fitted normal: Kolmogorov-Smirnov D, Cramer-von Mises
    W^2 and Anderson-Darling A^2, with p-values for estimated parameters.

    Each distinct value stands for its span of ranks: the terms are polynomials
    in the rank, so a span's sum has a closed form and repeated values are never
    expanded. Both tails enter as logarithms of their own (no 1 - F).
    """
    st = df.agg(F.avg(col).alias("mu"), F.stddev_samp(col).alias("sd"))
    v = row_ranks(df, col).crossJoin(F.broadcast(st))
    z = (F.col(col) - F.col("mu")) / F.col("sd")
    v = v.withColumns({"F": dist.norm_cdf_col(z), "ln_f": dist.norm_log_cdf_col(z),
                       "ln_s": dist.norm_log_cdf_col(-z)})
    n, m = F.col("n").cast("double"), F.col("_n").cast("double")
    a, b = F.col("first_rank").cast("double"), F.col("last_rank").cast("double")
    odd = a + b - 1  # the mean of 2i - 1 over the span
    agg = v.agg(
        F.first("n").alias("n"),
        F.max(F.greatest(b / n - F.col("F"), F.col("F") - (a - 1) / n)).alias("ks_d"),
        (F.sum(m * (F.col("F") - odd / (2 * n)) ** 2 + m * (m * m - 1) / (12 * n * n))
         + 1 / (12 * F.first(n))).alias("cvm_w2"),
        (-F.first(n) - F.sum(m * (odd * F.col("ln_f") + (2 * n - odd) * F.col("ln_s")))
         / F.first(n)).alias("ad_a2"))
    return agg.select(F.lit(col).alias("column"), "n", "ks_d", "cvm_w2", "ad_a2",
                      _ks_p(F.col("ks_d"), F.col("n")).alias("ks_p"),
                      _cvm_p(F.col("cvm_w2"), F.col("n")).alias("cvm_p"),
                      _ad_p(F.col("ad_a2"), F.col("n")).alias("ad_p"))


def _quadratic(x: Column, c0: float, c1: float, c2: float) -> Column:
    return F.exp(c0 + c1 * x + c2 * x * x)


# Fixed values below (as those in ``shapiro_wilk``: Royston's polynomials): published approximations of the tests' p-values when mean and
# variance are estimated (Dallal and Wilkinson 1986; D'Agostino and Stephens 1986).

def _ks_p(d: Column, n: Column) -> Column:
    """Defined up to 0.1, null above."""
    d = F.when(n > 100, d * F.pow(n / 100.0, F.lit(0.49))).otherwise(d)
    n = F.least(n, F.lit(100)).cast("double")
    p = F.exp(-7.01256 * d * d * (n + 2.78019) + 2.99587 * d * F.sqrt(n + 2.78019)
              - 0.122119 + 0.974598 / F.sqrt(n) + 1.67997 / n)
    return F.when(p <= 0.1, p)


def _cvm_p(w: Column, n: Column) -> Column:
    w = w * (1 + 0.5 / n)
    return (F.when(w < 0.0275, 1 - _quadratic(w, -13.953, 775.5, -12542.61))
            .when(w < 0.051, 1 - _quadratic(w, -5.903, 179.546, -1515.29))
            .when(w < 0.092, _quadratic(w, 0.886, -31.62, 10.897))
            .when(w < 1.1, _quadratic(w, 1.111, -34.242, 12.832)).otherwise(7.37e-10))


def _ad_p(a: Column, n: Column) -> Column:
    a = a * (1 + 0.75 / n + 2.25 / (n.cast("double") * n))
    return (F.when(a < 0.2, 1 - _quadratic(a, -13.436, 101.14, -223.73))
            .when(a < 0.34, 1 - _quadratic(a, -8.318, 42.796, -59.938))
            .when(a < 0.6, _quadratic(a, 0.9177, -4.279, -1.38))
            .when(a < 10, _quadratic(a, 1.2937, -5.709, 0.0186)).otherwise(3.7e-24))


# ---------------------------------------------------------------------------
# ANOVA
# ---------------------------------------------------------------------------

def anova_table(df: DataFrame, y: str, group: str) -> DataFrame:
    """One-way ANOVA sums of squares from group n / mean / M2, one aggregate
    per group then a k-row combine: (k, n, ss_between, ss_within, df_between,
    df_within, f_stat, r2). F and r2 are null where nothing varies; NaN counts as null."""
    g = without_nan(df, y).where(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("nk"), F.avg(y).alias("mk"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("m2k"))
    tot = g.agg(F.count(F.lit(1)).alias("k"), F.sum("nk").alias("n"),
                (F.sum(F.col("nk") * F.col("mk")) / F.sum("nk")).alias("grand"))
    j = g.crossJoin(F.broadcast(tot))
    out = j.groupBy("k", "n").agg(
        F.sum(F.col("nk") * (F.col("mk") - F.col("grand")) ** 2).alias("ss_between"),
        F.sum("m2k").alias("ss_within"))
    return out.withColumns({
        "df_between": F.col("k") - 1, "df_within": F.col("n") - F.col("k")}).withColumns({
        "f_stat": F.try_divide(F.try_divide(F.col("ss_between"), F.col("df_between")),
                               F.try_divide(F.col("ss_within"), F.col("df_within"))),
        "r2": F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within"))})


def anova_test(df: DataFrame, y: str, group: str) -> DataFrame:
    """T8 with the F-test p-value (tail on the driver from the 1-row table)."""
    table = anova_table(df, y, group)
    t = table.first().asDict()
    t["p_value"] = (dist.f_sf(t["f_stat"], t["df_between"], t["df_within"])
                    if t["f_stat"] is not None else None)
    return df.sparkSession.createDataFrame([t], table.schema.add("p_value", "double"))


# ---------------------------------------------------------------------------
# Histograms, densities, box statistics, trends
# ---------------------------------------------------------------------------

def _range_row(df: DataFrame, col: str, by=()):
    return df.groupBy(*by).agg(F.min(col).cast("double").alias("_lo"),
                               F.max(col).cast("double").alias("_hi"),
                               F.count(col).alias("_n"))


def histogram(df: DataFrame, col: str, bins: int = 60, by=()) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), empty bins kept.

    Rows are binned and counted (map-side combine); the bin axis is generated
    per group from the k-row range table, then left-joined to the counts. NaN counts as
    null; a null group is a group; a group without values has no bins.
    """
    by = list(by)
    df = without_nan(df, col).where(F.col(col).isNotNull())
    rng = _range_row(df, col, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    # the range table has one row per group; with no groups it is one row.
    x = join_by(df, rng, by)
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)))
    counts = x.groupBy(*by, idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    axis = rng.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
                      .alias("bin"))
    out = join_by(axis, counts, [*by, "bin"], "left").na.fill(0, subset=["count"])
    w = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*by, "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_start"),
                      (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_end"), "count")


def histogram_width(df: DataFrame, col: str, width: float, by=()) -> DataFrame:
    """T9 by bin width: bins [k*w, (k+1)*w) aligned at 0, only non-empty bins."""
    k = F.floor(F.col(col) / width)
    return (without_nan(df, col).where(F.col(col).isNotNull()).groupBy(*by, k.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count"))
              .withColumns({"bin_start": F.col("bin") * width,
                            "bin_end": (F.col("bin") + 1) * width}))


#: Moments kept of a bin, bins to a bandwidth, and bandwidths after which the kernel ends.
KDE_MOMENTS, KDE_BINS, KDE_REACH = 14, 2, 9


def kde(df: DataFrame, col: str, grid: int = 200, by=()) -> DataFrame:
    """Gaussian kernel density on a grid of ``grid`` points over [min, max]
    (per group, each with its own bandwidth and normalisation), Scott's rule
    h = n^(-1/5) * sample std. NaN counts as null; a null group is a group; a group of one
    value has density 0.

    Rows are binned first: bins of h / ``KDE_BINS`` keep the sums of the first
    ``KDE_MOMENTS`` powers of the distance from their centre, and a bin's part of the density is
    the kernel's Taylor series about that centre. Distances are at most s = 1/4 bandwidth, so by
    Cramer's bound the rest is below 1.09 s^14 / sqrt(14!) < 2e-14 of the kernel's peak, and the
    cut at ``KDE_REACH`` bandwidths below 3e-18 of it. Work is one aggregate, then bins times
    the grid points in reach: it does not grow with the distinct values."""
    by = list(by)
    rows = without_nan(df, col).where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    st = rows.groupBy(*by).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"))
    st = materialize(st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), -0.2))
                     .withColumn("_step", (F.col("_hi") - F.col("_lo")) / (grid - 1)), "kde_spans")
    x = join_by(rows, st.select(*by, "_lo", "_h"), by).where(F.col("_h") > 0)
    x = x.withColumn("_bin", F.floor((F.col("_x") - F.col("_lo")) / F.col("_h") * KDE_BINS))
    away = (F.col("_x") - F.col("_lo")) / F.col("_h") - (F.col("_bin") + 0.5) / KDE_BINS
    power, powers = F.lit(1.0), []
    for j in range(KDE_MOMENTS):
        powers.append(F.sum(power / math.factorial(j)).alias(f"_m{j}"))
        power = power * away
    bins = join_by(x.groupBy(*by, "_bin").agg(*powers), st, by)
    centre = (F.col("_bin") + 0.5) / KDE_BINS      # in bandwidths from the least value
    step = F.col("_step") / F.col("_h")
    lo_k = F.greatest(F.lit(0), F.ceil((centre - KDE_REACH) / step))
    hi_k = F.least(F.lit(grid - 1), F.floor((centre + KDE_REACH) / step))
    bins = bins.where(lo_k <= hi_k).withColumn("k", F.explode(F.sequence(lo_k.cast("int"), hi_k.cast("int"))))
    bins = bins.withColumn("_z", F.col("k") * step - centre)
    names, z = [f"_e{j}" for j in range(KDE_MOMENTS)], F.col("_z")
    for j in range(KDE_MOMENTS):  # one column each: the recurrence stays linear in size
        term = F.lit(1.0) if j == 0 else z if j == 1 else z * F.col(names[j - 1]) - (j - 1) * F.col(names[j - 2])
        bins = bins.withColumn(names[j], term)
    series = sum((F.col(f"_m{j}") * F.col(names[j]) for j in range(1, KDE_MOMENTS)), F.col("_m0"))
    dens = bins.groupBy(*by, "k").agg(
        (F.sum(F.exp(-z * z / 2.0) * series) / (F.first("_n") * F.first("_h") * math.sqrt(2 * math.pi))).alias("density"))
    axis = st.select(*by, "_lo", "_step", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
                     .alias("k"))
    out = join_by(axis, dens, [*by, "k"], "left").na.fill(0.0, subset=["density"])
    return out.select(*by, F.col("k").alias("point"),
                      (F.col("_lo") + F.col("k") * F.col("_step")).alias("x"), F.greatest("density", F.lit(0.0)).alias("density"))


def normal_fit_curve(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Normal pdf from the sample mean and std on a grid over [min, max]."""
    st = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"),
                F.avg(col).alias("_mu"), F.stddev_samp(col).alias("_sd"))
    pts = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    x = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (grid - 1)
    z = (x - F.col("_mu")) / F.col("_sd")
    return pts.select("point", x.alias("x"),
                      (F.exp(-z * z / 2.0) / (F.col("_sd") * math.sqrt(2 * math.pi))
                       ).alias("density"))


def box_stats(df: DataFrame, col: str, by=()) -> DataFrame:
    """Quartiles, 1.5 IQR whisker ends (most extreme values inside the
    fences), mean, n and outlier count, all from one stored table of value counts
    by group."""
    by = list(by)
    counts = materialize(value_counts(df.select(*by, col), col, by), "box_counts")
    q = quantiles_from_counts(counts, col, [0.25, 0.5, 0.75], by)
    q = q.groupBy(*by).agg(*[F.max(F.when(F.col("prob_index") == i, F.col("value"))).alias(name)
                             for i, name in enumerate(["q1", "median", "q3"])])
    q = q.withColumns({"lower_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                       "upper_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    # one row per group; without groups it is a single row
    j = join_by(counts, q, by)
    inside = (F.col(col) >= F.col("lower_fence")) & (F.col(col) <= F.col("upper_fence"))
    agg = j.groupBy(*by, "q1", "median", "q3", "lower_fence", "upper_fence").agg(
        F.sum("_n").alias("n"), (F.sum(F.col(col) * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min(F.when(inside, F.col(col))).cast("double").alias("whisker_low"),
        F.max(F.when(inside, F.col(col))).cast("double").alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"))
    return agg


def centroid_distances(centroids: DataFrame, group: str, cols, block: int = 1024) -> DataFrame:
    """Euclidean distance between every two group centroids. The table of
    all ordered pairs is the result, so the work is its size, dealt out by pairs of blocks."""
    j = _blocked_pairs(centroids, group, list(cols), block)
    d = F.sqrt(sum((F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 for x in cols))
    return j.select("group_a", "group_b", d.alias("distance"))


def linear_trend(df: DataFrame, x: str, y: str, points: int = 200) -> DataFrame:
    """Least-squares line over complete pairs and ``points`` points on it."""
    st = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                F.min(F.when(F.col(y).isNotNull(), F.col(x))).cast("double").alias("_lo"),
                F.max(F.when(F.col(y).isNotNull(), F.col(x))).cast("double").alias("_hi"))
    pts = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    xv = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    return pts.select("point", xv.alias("x"),
                      (F.col("intercept") + F.col("slope") * xv).alias("y_hat"),
                      "slope", "intercept")


def local_trend(df: DataFrame, x: str, y: str, grid: int = 100, span: float = 0.3,
                bins: int = 1000) -> DataFrame:
    """T16 (re-aimed LOESS): tricube-weighted local straight line at ``grid``
    points over [min, max] of x, with a fixed bandwidth h = span * range.

    Rows are first reduced to sufficient sums per fine x-bin (n, sum x, sum y,
    sum x^2, sum xy); a bin is weighted by the distance of its centre and
    contributes only to grid points within h (a bounded fan-out per bin), so
    the work after the first aggregate is independent of the row count.
    """
    xs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = xs.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None or hi == lo:
        return xs.sparkSession.createDataFrame([], "point int, x double, y_hat double")
    width = (hi - lo) / bins
    h = span * (hi - lo)
    step = (hi - lo) / (grid - 1)
    xv, yv = F.col(x).cast("double"), F.col(y).cast("double")
    b = xs.groupBy(F.least(F.floor((xv - lo) / width), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(xv).alias("sx"), F.sum(yv).alias("sy"),
        F.sum(xv * xv).alias("sxx"), F.sum(xv * yv).alias("sxy"))
    c = F.lit(lo) + (F.col("bin") + 0.5) * width
    k_lo = F.greatest(F.lit(0), F.ceil((c - h - lo) / step)).cast("int")
    k_hi = F.least(F.lit(grid - 1), F.floor((c + h - lo) / step)).cast("int")
    e = b.withColumn("k", F.explode(F.sequence(k_lo, k_hi)))
    g = F.lit(lo) + F.col("k") * step
    u = F.abs(g - c) / h
    t = F.when(u < 1, (1 - u ** 3) ** 3).otherwise(0.0)
    s = e.groupBy("k").agg(*[F.sum(t * F.col(v)).alias(f"w_{v}")
                             for v in ("n", "sx", "sy", "sxx", "sxy")])
    det = F.col("w_n") * F.col("w_sxx") - F.col("w_sx") ** 2
    slope = (F.col("w_n") * F.col("w_sxy") - F.col("w_sx") * F.col("w_sy")) / det
    icpt = (F.col("w_sy") - slope * F.col("w_sx")) / F.col("w_n")
    gx = F.lit(lo) + F.col("k") * step
    return s.where(F.col("w_n") > 0).select(
        F.col("k").cast("int").alias("point"), gx.alias("x"),
        F.when(det != 0, icpt + slope * gx).otherwise(F.col("w_sy") / F.col("w_n")).alias("y_hat"))
