"""Registered model queries without a SQL twin, against numpy on the smallest tables."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF_SMALL

from sparkstats.functions import dist
from sparkstats.operators import cluster
from sparkstats.plans import model_queries as mq
from sparkstats.plans.catalog import load_all

REG = load_all()


def got(spark, name):
    return REG[name].spark(spark, SF_SMALL).toPandas()


def lstsq(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b, e, float(e @ e), np.linalg.matrix_rank(x)


def test_carrier_effects(spark):
    design, xs = mq._carrier_design(spark, SF_SMALL)
    d = design.select("log_arr_delay", *[f"`{c}`" for c in xs]).toPandas().astype(float)
    b, e, sse, rank = lstsq(d[xs].to_numpy(), d["log_arr_delay"].to_numpy())
    t = got(spark, "ols_carrier_effects").set_index("term")
    assert rank == len(xs) + 1 and np.allclose(t.loc[["Intercept", *xs], "estimate"], b, rtol=1e-6, atol=1e-9)
    x = np.column_stack([np.ones(len(d)), d[xs]])
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sse / (len(d) - rank))
    assert np.allclose(t.loc[["Intercept", *xs], "std_err"], se, rtol=1e-5)
    assert np.allclose(t.loc[xs, "p_value"], [dist.t_sf2(v, len(d) - rank) for v in b[1:] / se[1:]], rtol=1e-4, atol=1e-12)
    fit = got(spark, "ols_carrier_fit").iloc[0]
    y = d["log_arr_delay"].to_numpy()
    assert np.isclose(fit.r2, 1 - sse / ((y - y.mean()) ** 2).sum()) and fit.nobs == len(d) and fit.n_params == rank
    top = got(spark, "ols_coef_importance")
    want = sorted(np.abs(b[1:]), reverse=True)[:15]
    assert np.allclose(top["abs_coef"], want, rtol=1e-6) and (top["abs_coef"].diff().dropna() <= 0).all()


def test_class_effect_model(spark):
    data, dummies, levels = mq._glm_design(spark, SF_SMALL)
    cols = [*mq.REG_FEATURES, *dummies]
    d = data.select("log_arr_delay", *[f"`{c}`" for c in cols]).toPandas().astype(float)
    y = d["log_arr_delay"].to_numpy()
    b, e, sse, rank = lstsq(d[cols].to_numpy(), y)
    est = got(spark, "glm_estimates").set_index("term")
    assert np.allclose(est.loc[["Intercept", *cols], "estimate"], b, rtol=1e-6, atol=1e-9) and est.loc[f"carrier[{levels[-1]}]", "estimate"] == 0
    tests = got(spark, "glm_type3").set_index("source")
    for name, gone in [(f, [f]) for f in mq.REG_FEATURES] + [("op_unique_carrier", dummies)]:
        _, _, less, r = lstsq(d[[c for c in cols if c not in gone]].to_numpy(), y)
        row = tests.loc[name]
        assert row.df == rank - r and np.isclose(row.ss3, less - sse, rtol=1e-6, atol=1e-8 * sse)
        assert np.isclose(row.f_value, (less - sse) / row.df / (sse / (len(d) - rank)), rtol=1e-5, atol=1e-6)
    p = got(spark, "glm_predictions")
    assert np.isclose((p["residual"] ** 2).sum(), sse) and abs(p["residual"].sum()) < 1e-6 and len(p) == len(d)
    reg = got(spark, "reg_numeric").set_index("term")
    b8 = lstsq(d[mq.REG_FEATURES].to_numpy(), y)[0]
    assert np.allclose(reg.loc[mq.REG_FEATURES, "estimate"], b8[1:], rtol=1e-6)
    sd = d[mq.REG_FEATURES].std().to_numpy()
    assert np.allclose(reg.loc[mq.REG_FEATURES, "std_beta"], b8[1:] * sd / y.std(ddof=1), rtol=1e-6)
    inflation = np.diag(np.linalg.inv(np.corrcoef(d[mq.REG_FEATURES].to_numpy().T)))
    assert np.allclose(reg.loc[mq.REG_FEATURES, "vif"], inflation, rtol=1e-6)


def test_diagnostics(spark):
    d = mq._reg_data(spark, SF_SMALL).select("flight_key", "log_arr_delay", *mq.REG_FEATURES).toPandas()
    x = np.column_stack([np.ones(len(d)), d[mq.REG_FEATURES].astype(float)])
    y = d["log_arr_delay"].to_numpy(float)
    inv = np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    e = y - x @ (inv @ x.T @ y)
    s2 = e @ e / (len(y) - x.shape[1])
    want = np.sort(e ** 2 / s2 / x.shape[1] * h / (1 - h) ** 2)
    t = got(spark, "reg_diagnostics")
    assert np.allclose(np.sort(t["leverage"]), np.sort(h), rtol=1e-6) and np.allclose(np.sort(t["cooks_d"]), want, rtol=1e-5, atol=1e-12)
    assert np.isclose(t["leverage"].sum(), x.shape[1])


def test_nested_models(spark):
    d = mq._nested_data(spark, SF_SMALL).toPandas()
    y, full, small = d["arr_delay"].to_numpy(float), d[mq.MODEL_A].to_numpy(float), d[mq.MODEL_B].to_numpy(float)
    (_, e, a, ra), (_, _, b, rb) = lstsq(full, y), lstsq(small, y)
    f = (b - a) / (ra - rb) / (a / (len(y) - ra))
    t = got(spark, "nested_ols").set_index("model")
    assert np.isclose(t.loc["A", "nested_f"], f, rtol=1e-6) and np.isclose(t.loc["A", "nested_p"], dist.f_sf(f, ra - rb, len(y) - ra), rtol=1e-5)
    assert np.isclose(t.loc["B", "resid_std_err"], np.sqrt(b / (len(y) - rb)))
    aux, _, rest, _ = lstsq(full, e ** 2)
    lm = len(y) * (1 - rest / ((e ** 2 - (e ** 2).mean()) ** 2).sum())
    bp = got(spark, "breusch_pagan").iloc[0]
    assert np.isclose(bp.bp_stat, lm, rtol=1e-6) and bp.df == len(mq.MODEL_A) and np.isclose(bp.p_value, dist.chi2_sf(lm, bp.df), rtol=1e-5)
    v = got(spark, "vif_models")
    for m, xs in (("A", full), ("B", small)):
        assert np.allclose(v[v.model == m]["vif"], np.diag(np.linalg.inv(np.corrcoef(xs.T))), rtol=1e-6)
    battery = got(spark, "restricted_battery").set_index("item")["value"]
    assert 0 < battery["shapiro_wilk"] < 1 and 0 < battery["durbin_watson"] < 4


def test_logistic_models(spark):
    r = mq._lr_unpen(spark, SF_SMALL)
    t = r["train"].select("cancelled", "_w", *r["features"]).toPandas().astype(float)
    z, y, w = np.column_stack([np.ones(len(t)), t[r["features"]]]), t["cancelled"].to_numpy(), t["_w"].to_numpy()
    b = np.zeros(z.shape[1])
    unit = np.abs(z).max(0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z / unit) @ b))
        info = (z / unit).T @ ((z / unit) * (w * p * (1 - p))[:, None])
        b = b - np.linalg.pinv(info) @ ((z / unit).T @ (w * (p - y)))
    q = got(spark, "logistic_unpenalised").set_index("term")
    loss = lambda c: (w * (np.logaddexp(0, z @ c) - y * (z @ c))).sum()
    mine = q.loc[["Intercept", *r["features"]], "estimate"].to_numpy()
    assert loss(mine) <= loss(b / unit) * (1 + 1e-9)
    se = np.sqrt(np.abs(np.diag(np.linalg.pinv(info)))) / unit
    known = q.loc[["Intercept", *r["features"]], "std_err"].to_numpy() < 100  # the others have no finite estimate: no cause is ever given to a cancelled flight
    assert known.sum() >= 4
    assert np.allclose(mine[known], (b / unit)[known], rtol=1e-4, atol=1e-6)
    assert np.allclose(q.loc[["Intercept", *r["features"]], "std_err"][known], se[known], rtol=1e-3)
    table = got(spark, "logistic_class_table")
    assert len(table) == 5
    hl = got(spark, "logistic_hosmer_lemeshow")
    assert hl["n"].sum() == len(t) and np.isclose(hl["observed"].sum(), y.sum())
    s = mq._lr_balanced(spark, SF_SMALL)
    tr = s["train"].toPandas()
    z, y = np.column_stack([np.ones(len(tr)), tr[s["features"]]]), tr["cancelled"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    c = np.r_[s["intercept"], s["coef"]]
    assert np.abs(z.T @ (w * (1 / (1 + np.exp(-z @ c)) - y)) + np.r_[0, c[1:]]).max() < 1e-5
    scored = s["test"].select("cancelled", "prob").toPandas()
    pos, neg = (scored[scored.cancelled == k]["prob"].to_numpy() for k in (1, 0))
    area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert np.isclose(got(spark, "logistic_balanced_auc").iloc[0].auc, area)
    report = got(spark, "logistic_balanced_report").set_index("label")
    assert np.isclose(report.loc["1", "recall"], (pos >= 0.5).mean())


def test_discriminant_model(spark):
    data, m = mq._lda(spark, SF_SMALL)
    d = data.select("o_orderpriority", *mq.LDA_FEATURES).toPandas()
    g, x = d["o_orderpriority"].to_numpy(), d[mq.LDA_FEATURES].to_numpy(float)
    names = sorted(set(g))
    means, share = np.array([x[g == k].mean(0) for k in names]), np.array([(g == k).mean() for k in names])
    within = sum((x[g == k] - mu).T @ (x[g == k] - mu) for k, mu in zip(names, means)) / (len(x) - len(names))
    between = sum((g == k).sum() * np.outer(mu - share @ means, mu - share @ means) for k, mu in zip(names, means))
    roots = np.sort(np.linalg.eigvals(np.linalg.solve(within, between)).real)[::-1]
    summary = got(spark, "lda_summary").set_index(["item", "name"])["value"]
    assert np.allclose([summary["prior", k] for k in names], share)
    ratios = summary["explained_variance_ratio"]
    assert np.allclose(ratios.to_numpy(), (roots / roots.sum())[:len(ratios)], atol=1e-9)
    w = got(spark, "lda_coefficients")
    table = {(row["class"], row["term"]): row["coef"] for _, row in w.iterrows()}
    # score differences between classes are those of the pooled normal model, in the kept directions
    scores = np.array([[table[k, "intercept"] + r @ [table[k, f] for f in mq.LDA_FEATURES] for k in names] for r in x[:50]])
    inv = np.linalg.inv(within)
    want = x[:50] @ inv @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inv, means) + np.log(share)
    kept = m.scalings.shape[1] == min(len(names) - 1, x.shape[1])
    if kept:
        assert np.allclose(scores - scores[:, :1], want - want[:, :1], atol=1e-6)
    one = got(spark, "lda_transform")[["LD1", "LD2"]].to_numpy()
    assert np.allclose(one.mean(0), 0, atol=1e-9)
    assert got(spark, "lda_confusion").drop(columns="true_label").to_numpy().sum() == len(x)
    assert got(spark, "lda_stored_model")["n"].sum() == len(x) == got(spark, "stored_lda_predictions")["n"].sum()


def test_delay_tiers(spark):
    rows, fit = mq._delay_tiers(spark, SF_SMALL)
    d = rows.select(*cluster.CLUSTER_FEATURES).toPandas().dropna().to_numpy(float)
    z = (d - d.mean(0)) / d.std(0)
    far = ((z[:, None] - fit.centres) ** 2).sum(2)
    own = far.argmin(1)
    assert np.isclose(far.min(1).sum(), fit.cost, rtol=1e-9)
    assert np.abs(np.array([z[own == j].mean(0) for j in range(4)]) - fit.centres).max() < 1e-3  # a fixed point of the steps
    best = np.inf
    for s in range(10):  # no worse than seeded runs on the rows
        rng = np.random.default_rng(s)
        c = z[[rng.integers(len(z))]]
        while len(c) < 4:
            w = ((z[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack([c, z[rng.choice(len(z), p=w / w.sum())]])
        for _ in range(100):
            o = ((z[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([z[o == j].mean(0) if (o == j).any() else c[j] for j in range(4)])
        best = min(best, ((z[:, None] - c) ** 2).sum(2).min(1).sum())
    assert fit.cost <= best * 1.002
    t = got(spark, "kmeans_tiers").set_index("tier")
    assert t["n"].sum() == len(d) and (t["arr_delay"].diff().dropna() >= 0).all()
    r = got(spark, "kmeans_rows")
    assert r.groupby("cluster").size().to_dict() == t["n"].to_dict()
    assert got(spark, "stored_kmeans_tiers").dropna()["n"].sum() >= 0
    assert got(spark, "kmeans_operated")["n"].sum() > 0


@pytest.mark.parametrize("name,column", [("fitted_residual_loess", "y_hat"), ("glm_residual_trend", "y_hat")])
def test_residual_trends_are_flat(spark, name, column):
    """Least-squares residuals have no straight trend along the fit."""
    t = got(spark, name)
    x = "x"
    slope = np.polyfit(t[x], t[column], 1, w=np.sqrt(t["n"]) if "n" in t else None)[0]
    assert abs(slope) * (t[x].max() - t[x].min()) < 0.2 * max(1.0, t[column].std() * 10)
