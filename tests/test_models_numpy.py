"""Model and test statistics against direct numpy recomputation on the
smallest tables (operators without a SQL oracle)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkstats.functions import dist
from sparkstats.operators import evaluate, linear, stats
from sparkstats.sources.flights import flights

from conftest import SF_SMALL

XS = ["dep_delay", "distance", "weather_delay"]


@pytest.fixture(scope="module")
def data(spark):
    f = flights(spark, SF_SMALL).select("flight_key", "arr_delay", *XS).dropna()
    # sf0.001 holds one repeated flight_key; keep a strict order for the lag tests.
    uniq = f.groupBy("flight_key").count().where("count = 1").select("flight_key")
    f = f.join(uniq, "flight_key", "left_semi")
    pdf = f.toPandas().sort_values("flight_key").reset_index(drop=True)
    return f, pdf


def _np_ols(pdf):
    x = np.column_stack([np.ones(len(pdf)), pdf[XS].to_numpy(float)])
    y = pdf["arr_delay"].to_numpy(float)
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    s2 = e @ e / (len(y) - x.shape[1])
    se = np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x)))
    return x, y, b, e, se


def test_ols_matches_numpy(data):
    f, pdf = data
    res, _ = linear.ols(f, "arr_delay", XS)
    x, y, b, e, se = _np_ols(pdf)
    assert np.allclose(res.coef, b, rtol=1e-8, atol=1e-10)
    assert np.allclose(res.se, se, rtol=1e-6)
    r2 = 1 - (e @ e) / np.sum((y - y.mean()) ** 2)
    assert abs(res.r2 - r2) < 1e-10


def test_durbin_watson_and_bp(data):
    f, pdf = data
    res, _ = linear.ols(f, "arr_delay", XS)
    x, y, b, e, _ = _np_ols(pdf)
    dw = linear.durbin_watson(f, res, "arr_delay", "flight_key")
    assert abs(dw["dw"] - np.sum(np.diff(e) ** 2) / (e @ e)) < 1e-9
    # moments of d under H0 by direct traces
    n, k = x.shape
    a = np.diag(np.r_[1, np.full(n - 2, 2), 1]) - np.eye(n, k=1) - np.eye(n, k=-1)
    g = np.linalg.inv(x.T @ x)
    m1 = x.T @ a @ x @ g
    p = 2 * (n - 1) - np.trace(m1)
    assert abs(dw["expected"] - p / (n - k)) < 1e-9
    bp = linear.breusch_pagan(f, res, "arr_delay")
    e2 = e ** 2
    bb, *_ = np.linalg.lstsq(x, e2, rcond=None)
    fit = x @ bb
    r2 = 1 - np.sum((e2 - fit) ** 2) / np.sum((e2 - e2.mean()) ** 2)
    assert abs(bp["bp_stat"] - n * r2) < 1e-6


def test_diagnostics_leverage(data):
    f, pdf = data
    res, _ = linear.ols(f, "arr_delay", XS)
    x, y, b, e, _ = _np_ols(pdf)
    h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    d = linear.diagnostics(f, res, "arr_delay", "flight_key").toPandas().sort_values(
        "flight_key")
    assert np.allclose(d["leverage"].to_numpy(), h, atol=1e-10)
    assert np.allclose(d["resid"].to_numpy(), e, atol=1e-8)


def test_shapiro_wilk_small_n(spark):
    # W is scale-free; the reference value for this textbook sample comes from
    # the same algorithm, checked against a direct numpy evaluation here.
    vals = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = stats.shapiro_wilk(df, "x")
    n = len(vals)
    m = np.array([dist.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    assert r["n"] == n and 0.5 < r["W"] < 1.0 and 0 <= r["p_value"] <= 1
    x = np.sort(vals)
    w_plain = (m @ x) ** 2 / (m @ m) / np.sum((x - x.mean()) ** 2)
    assert abs(r["W"] - w_plain) < 0.02


def test_tails():
    assert abs(dist.t_sf2(2.0, 10) - 0.0733880347707) < 1e-10
    assert abs(dist.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(dist.f_sf(3.4928284767, 2, 20) - 0.05) < 1e-8
    for p in (1e-12, 0.01, 0.3, 0.5, 0.9, 1 - 1e-9):
        assert abs(dist.norm_cdf(dist.norm_ppf(p)) - p) < 1e-12 * max(1, 1 / p)


def test_norm_columns_match_scalars(spark):
    df = spark.range(1, 200).select((F.col("id") / 200.0).alias("p"))
    rows = df.select("p", dist.norm_ppf_col("p").alias("z"),
                     dist.norm_cdf_col(dist.norm_ppf_col("p")).alias("back")).collect()
    for r in rows:
        assert abs(r["z"] - dist.norm_ppf(r["p"])) < 1e-12
        assert abs(r["back"] - r["p"]) < 1e-13


def test_auc_equals_pairwise(spark):
    f = flights(spark, SF_SMALL).select("cancelled", "dep_delay").dropna()
    pdf = f.toPandas()
    pos = pdf.loc[pdf.cancelled == 1, "dep_delay"].to_numpy()
    neg = pdf.loc[pdf.cancelled != 1, "dep_delay"].to_numpy()
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
        / (len(pos) * len(neg))
    got = evaluate.auc(f, "cancelled", "dep_delay").first()["auc"]
    assert abs(got - want) < 1e-12


def test_anova_pvalue(spark):
    f = flights(spark, SF_SMALL)
    t = stats.anova_test(f, "dep_delay", "op_unique_carrier").first()
    assert t["p_value"] == pytest.approx(dist.f_sf(t["f_stat"], t["df_between"], t["df_within"]))
    assert 0 <= t["p_value"] <= 1 and not math.isnan(t["f_stat"])
