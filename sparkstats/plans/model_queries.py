"""Queries of the models and their diagnostics (M*, T17-T20, V9)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import derive, labels
from ..operators import clean, cluster, discrim, encode, evaluate, linear, logistic, model_store, stats
from ..sources.flights import flights
from ..session import checkpoint_path, materialize
from .catalog import query
from .flight_queries import _sql, derived
from .stat_queries import PRIORITIES

OLS_FEATURES = ["dep_delay", "distance", "air_time", "carrier_delay", "weather_delay",
                "nas_delay", "late_aircraft_delay", "month", "day_of_week"]
REG_FEATURES = ["dep_delay", "distance", "carrier_delay", "weather_delay", "nas_delay",
                "late_aircraft_delay", "month", "day_of_week"]


def _carrier_design(spark, sf):
    """M6 design: cleaned flights, complete cases, carrier dummies (first level
    dropped), y = log(arr_delay + table-wide shift)."""
    base = materialize(clean.load_clean(flights(spark, sf)).select("op_unique_carrier", "arr_delay", *OLS_FEATURES)
                       .dropna(subset=[*OLS_FEATURES, "arr_delay"]), "ols_design")
    lv = encode.levels(base, "op_unique_carrier")
    dummies = {f"carrier_{v}": (F.col("op_unique_carrier") == v).cast("double") for v in lv[1:]}
    design = base.withColumns(dummies)
    design = derive.log_delay_global(design, "arr_delay", "log_arr_delay")
    return design, [*OLS_FEATURES, *dummies]


def _ols_carrier(spark, sf):
    design, xs = _carrier_design(spark, sf)
    res, g = linear.ols(design, "log_arr_delay", xs)
    return res, g


@query("ols_carrier_effects")
def q_ols_carrier(spark, sf):
    """M6: OLS of the shifted log arrival delay on nine features and carrier
    dummies: estimate, standard error, t, p."""
    res, _ = _ols_carrier(spark, sf)
    return linear.coef_table(spark, res)


@query("ols_carrier_fit")
def q_ols_carrier_fit(spark, sf):
    """M6 fit statistics: R2, adjusted R2, F, nobs."""
    res, _ = _ols_carrier(spark, sf)
    return linear.fit_table(spark, res, "carrier_effects")


@query("ols_coef_importance")
def q_ols_importance(spark, sf):
    """M5: top 15 coefficients by |estimate| without the intercept, p < .05 flag."""
    res, _ = _ols_carrier(spark, sf)
    return logistic.coef_importance(spark, res.terms[1:], res.coef[1:], res.p[1:], 15)


def _reg_data(spark, sf):
    d = derived(spark, sf).select("flight_key", "op_unique_carrier", "log_arr_delay",
                                  *REG_FEATURES)
    return materialize(d.dropna(subset=["log_arr_delay", *REG_FEATURES]), "reg_data")


@query("reg_numeric")
def q_reg_numeric(spark, sf):
    """M7: OLS of the row-shifted log delay on eight numerics with standardised
    betas and VIF."""
    data = _reg_data(spark, sf)
    res, g = linear.ols(data, "log_arr_delay", REG_FEATURES)
    return linear.coef_table(spark, res, g, "log_arr_delay", with_beta=True, with_vif=True)


@query("reg_diagnostics")
def q_reg_diag(spark, sf):
    """Fitted, residual, leverage, studentised residual, Cook's D per row."""
    data = _reg_data(spark, sf)
    res, _ = linear.ols(data, "log_arr_delay", REG_FEATURES)
    return linear.diagnostics(data, res, "log_arr_delay", "flight_key")


def _glm_design(spark, sf):
    data = _reg_data(spark, sf).withColumn(
        "carrier_name", labels.value_label("op_unique_carrier", labels.CARRIER_NAMES, "Other"))
    lv = encode.levels(data, "carrier_name")
    cols = {f"carrier[{v}]": (F.col("carrier_name") == v).cast("double") for v in lv[:-1]}
    return data.withColumns(cols), list(cols), lv


@query("glm_type3")
def q_glm_type3(spark, sf):
    """M8: Type III sums of squares with the formatted carrier as a class effect
    (last level is the reference), from one Gram matrix."""
    data, dummies, _ = _glm_design(spark, sf)
    g = linear.gram(data, [*REG_FEATURES, *dummies, "log_arr_delay"])
    effects = {**{f: [f] for f in REG_FEATURES}, "op_unique_carrier": dummies}
    rows = linear.type3_ss(g, "log_arr_delay", effects)
    return spark.createDataFrame(rows, "source string, df long, ss3 double, mean_square double, "
                                 "f_value double, p_value double")


@query("glm_estimates")
def q_glm_estimates(spark, sf):
    """M8 parameter estimates; the reference carrier level is reported as 0."""
    data, dummies, lv = _glm_design(spark, sf)
    res, _ = linear.ols(data, "log_arr_delay", [*REG_FEATURES, *dummies])
    t = linear.coef_table(spark, res)
    ref = spark.createDataFrame([(f"carrier[{lv[-1]}]", 0.0, None, None, None)], t.schema)
    return t.unionByName(ref)


@query("glm_predictions")
def q_glm_predictions(spark, sf):
    """M8 per row: fitted value and residual of the class-effect model."""
    data, dummies, _ = _glm_design(spark, sf)
    res, _ = linear.ols(data, "log_arr_delay", [*REG_FEATURES, *dummies])
    fitted = linear.linear_predictor(linear.renamed(res, {c: f"`{c}`" for c in dummies}))
    return data.select("flight_key", "log_arr_delay", fitted.alias("fitted")).withColumn(
        "residual", F.col("log_arr_delay") - F.col("fitted"))


@query("glm_residual_trend")
def q_glm_residual_trend(spark, sf):
    """Local trend of the class-effect model's residuals along the fit."""
    p = materialize(q_glm_predictions(spark, sf).select("fitted", "residual"), "glm_residuals")
    return stats.local_trend(p, "fitted", "residual", 100, 0.3, 1000)


# The predictors of the two nested models.
MODEL_A = ["dep_delay", "distance", "weather_delay", "nas_delay", "is_weekend"]
MODEL_B = MODEL_A[:-1]


def _nested_data(spark, sf):
    return materialize(derived(spark, sf).select("flight_key", "arr_delay", *MODEL_A).dropna(),
                       "nested_data")


@query("nested_ols")
def q_nested(spark, sf):
    """M9: full model (with a 0/1 dummy) against the restricted one, F test."""
    data = _nested_data(spark, sf)
    g = linear.gram(data, [*MODEL_A, "arr_delay"])
    r = linear.nested_f(g, "arr_delay", MODEL_A, MODEL_B)
    rows = []
    for name, m in (("A", r["full"]), ("B", r["reduced"])):
        rows.append((name, m.n, m.k, m.r2, m.adj_r2, m.sigma, m.f_stat, m.f_p,
                     r["f_stat"] if name == "A" else None, r["p_value"] if name == "A" else None))
    return spark.createDataFrame(rows, "model string, nobs long, n_params long, r2 double, "
                                 "adj_r2 double, resid_std_err double, f_stat double, "
                                 "f_p_value double, nested_f double, nested_p double")


@query("breusch_pagan")
def q_bp(spark, sf):
    """T17 on model A."""
    data = _nested_data(spark, sf)
    res, _ = linear.ols(data, "arr_delay", MODEL_A)
    return spark.createDataFrame([linear.breusch_pagan(data, res, "arr_delay")],
                                 "bp_stat double, df long, p_value double")


@query("restricted_battery")
def q_restricted_battery(spark, sf):
    """T5, T17, T18, T6 and T7 of model B: its checks in one table."""
    data = _nested_data(spark, sf)
    res, _ = linear.ols(data, "arr_delay", MODEL_B)
    bp = linear.breusch_pagan(data, res, "arr_delay")
    dw = linear.durbin_watson(data, res, "arr_delay", "flight_key")
    r = materialize(data.select((F.col("arr_delay") - linear.linear_predictor(res)).alias("residual")), "residuals")
    sw, big = stats.shapiro_wilk(r, "residual"), stats.normality_large_n(r, "residual").first()
    rows = [("breusch_pagan", bp["bp_stat"], bp["p_value"]), ("durbin_watson", dw["dw"], dw["p_value"]),
            ("shapiro_wilk", sw["W"], sw["p_value"]), ("kolmogorov_smirnov", big["ks_d"], big["ks_p"]),
            ("cramer_von_mises", big["cvm_w2"], big["cvm_p"]), ("anderson_darling", big["ad_a2"], big["ad_p"])]
    rows += [(f"vif[{v['feature']}]", v["vif"], None) for v in stats.vif(data, MODEL_B).collect()]
    return spark.createDataFrame(rows, "item string, value double, p_value double")


@query("vif_models")
def q_vif_models(spark, sf):
    """T5 + F19 of models A and B: inflation factors with the flag above 10."""
    data = _nested_data(spark, sf).withColumn("is_weekend", F.col("is_weekend").cast("double"))
    both = [stats.vif(data, xs).withColumn("model", F.lit(m)) for m, xs in (("A", MODEL_A), ("B", MODEL_B))]
    return both[0].unionByName(both[1]).withColumn("high", F.col("vif") > 10)


@query("durbin_watson")
def q_dw(spark, sf):
    """T18 on model A, rows in flight_key order."""
    data = _nested_data(spark, sf)
    res, _ = linear.ols(data, "arr_delay", MODEL_A)
    return spark.createDataFrame([linear.durbin_watson(data, res, "arr_delay", "flight_key")],
                                 "dw double, n long, k long, expected double, p_value double")


@query("durbin_watson_simple", _sql("""
  , st AS (SELECT regr_slope(arr_delay, dep_delay) AS b, regr_intercept(arr_delay, dep_delay) AS a
           FROM flights WHERE arr_delay IS NOT NULL AND dep_delay IS NOT NULL),
  e AS (SELECT flight_key, arr_delay - (a + b * dep_delay) AS e FROM flights, st
        WHERE arr_delay IS NOT NULL AND dep_delay IS NOT NULL),
  d AS (SELECT e, e - lag(e) OVER (ORDER BY flight_key) AS de FROM e)
  SELECT sum(de * de) / sum(e * e) AS dw, count(*) AS n FROM d"""), rounded=["dw"], digits=9)
def q_dw_simple(spark, sf):
    """T18 numerator / denominator for arr_delay ~ dep_delay (order: flight_key)."""
    f = flights(spark, sf).select("flight_key", "arr_delay", "dep_delay").dropna()
    res, _ = linear.ols(f, "arr_delay", ["dep_delay"])
    e = f.select("flight_key", (F.col("arr_delay") - linear.linear_predictor(res)).alias("e"))
    nb = linear.with_neighbors(e, "flight_key", ["e"])
    de = F.col("e") - F.col("prev_e")
    return nb.agg((F.sum(de * de) / F.sum(F.col("e") ** 2)).alias("dw"),
                  F.count(F.lit(1)).alias("n"))


@query("residual_normality")
def q_resid_sw(spark, sf):
    """T6 on the residuals of model A."""
    data = _nested_data(spark, sf)
    res, _ = linear.ols(data, "arr_delay", MODEL_A)
    r = data.withColumn("residual", F.col("arr_delay") - linear.linear_predictor(res))
    return stats.shapiro_wilk_table(r, ["residual"])


@query("hosmer_lemeshow_fixed", _sql("""
  , s AS (SELECT cancelled, 1.0 / (1.0 + exp(-(dep_delay - 60.0) / 15.0)) AS prob FROM flights
          WHERE dep_delay IS NOT NULL AND cancelled IS NOT NULL),
  c AS (SELECT """ + ", ".join(f"quantile_cont(prob, {i / 10}) AS c{i}" for i in range(1, 10))
    + """ FROM s),
  g AS (SELECT (""" + " + ".join(f"CAST(prob > c{i} AS INTEGER)" for i in range(1, 10))
    + """) AS decile, count(*) AS n, CAST(sum(cancelled) AS DOUBLE) AS observed,
           sum(prob) AS expected FROM s, c GROUP BY 1)
  SELECT decile, n, observed, expected,
         (observed - expected) * (observed - expected) / (expected * (1 - expected / n)) AS chi2_term
  FROM g"""), rounded=["expected", "chi2_term"], digits=9)
def q_hl_fixed(spark, sf):
    """T20 with a fixed score 1 / (1 + exp(-(dep_delay - 60) / 15)) for cancelled."""
    f = flights(spark, sf).where(F.col("dep_delay").isNotNull())
    s = f.select("cancelled", (1.0 / (1.0 + F.exp(-(F.col("dep_delay") - 60.0) / 15.0)))
                 .alias("prob"))
    return linear.hosmer_lemeshow(s, "cancelled", "prob")


def _lr_balanced(spark, sf):
    sub = clean.load_clean(flights(spark, sf)).select(
        "flight_key", "cancelled", *logistic.LR_FEATURES)
    return logistic.logistic_balanced(materialize(sub, "lr_input"), "cancelled", "flight_key")


@query("logistic_balanced_report")
def q_lr_report(spark, sf):
    """M3 + V5 on the 20 % hold-out."""
    r = _lr_balanced(spark, sf)
    return evaluate.classification_report(r["test"], "cancelled", "pred", [0, 1])


@query("logistic_balanced_auc")
def q_lr_auc(spark, sf):
    """M3 + V7 on the hold-out probabilities."""
    r = _lr_balanced(spark, sf)
    return evaluate.auc(r["test"], "cancelled", "prob")


@query("logistic_balanced_roc")
def q_lr_roc(spark, sf):
    """M3 + V6."""
    r = _lr_balanced(spark, sf)
    return evaluate.roc_curve(r["test"], "cancelled", "prob")


@query("logistic_coef_importance")
def q_lr_coef(spark, sf):
    """M5 for M3: coefficients by |value| (scaled features)."""
    r = _lr_balanced(spark, sf)
    return logistic.coef_importance(spark, r["features"], r["coef"], None, 15)


def _lr_unpen(spark, sf):
    d = derived(spark, sf).select("flight_key", "cancelled", *logistic.LR_FEATURES_NO_LEAK)
    return logistic.logistic_unpenalised(materialize(d, "lr_unpen_input"), "cancelled",
                                         logistic.LR_FEATURES_NO_LEAK, "flight_key")


@query("logistic_unpenalised")
def q_lr_unpen(spark, sf):
    """M4: equal priors, no penalty, Wald chi-square per parameter."""
    r = _lr_unpen(spark, sf)
    return spark.createDataFrame(r["rows"], "term string, estimate double, std_err double, "
                                 "wald_chi2 double, p_value double")


@query("logistic_hosmer_lemeshow")
def q_lr_hl(spark, sf):
    """T20 on the M4 training predictions."""
    r = _lr_unpen(spark, sf)
    s = logistic.score(r["train"], r["features"], r["coef"], r["intercept"])
    return linear.hosmer_lemeshow(s, "cancelled", "prob")


@query("logistic_class_table")
def q_lr_ctable(spark, sf):
    """V8 at p = .5 (and neighbours) on the M4 training predictions."""
    r = _lr_unpen(spark, sf)
    s = logistic.score(r["train"], r["features"], r["coef"], r["intercept"])
    return evaluate.class_table(s, "cancelled", "prob", [0.3, 0.4, 0.5, 0.6, 0.7])


@query("logistic_score_holdout")
def q_lr_score(spark, sf):
    """V9: the stored M4 coefficients applied to the held-out 20 %, then AUC."""
    r = _lr_unpen(spark, sf)
    s = logistic.score(r["holdout"], r["features"], r["coef"], r["intercept"])
    return evaluate.auc(s, "cancelled", "prob")


def _stored_path(spark, sf, name: str) -> str:
    return checkpoint_path(spark, f"models/{name}_{hashlib.md5(sf.encode()).hexdigest()}")


def _delay_tiers(spark, sf):
    """Cleaned flights and their clustering: one stored fit for every query on these data."""
    rows = materialize(clean.load_clean(flights(spark, sf)).select("flight_key", *cluster.CLUSTER_FEATURES), "kmeans_input")
    model = model_store.load_or_fit(spark, _stored_path(spark, sf, "delay_tiers"),
                                    lambda: model_store.of_kmeans(cluster.fit_kmeans(rows)),
                                    model_store.data_fingerprint(rows, cluster.CLUSTER_FEATURES))
    return rows, model_store.kmeans(model)


@query("kmeans_tiers")
def q_kmeans(spark, sf):
    """M1 + A19: best of 10 seeded k-means runs (k = 4) on scaled features,
    tiers ordered by mean arrival delay; per-tier means."""
    return cluster.cluster_summary(cluster.with_tiers(*_delay_tiers(spark, sf)))


@query("kmeans_rows")
def q_kmeans_rows(spark, sf):
    """Every clustered row with its tier, for the scatter plot (the tiers of ``kmeans_tiers``)."""
    return cluster.with_tiers(*_delay_tiers(spark, sf)).select("flight_key", "distance", "arr_delay", "cluster")


@query("kmeans_operated")
def q_kmeans_op(spark, sf):
    """M2: operated flights only, sample-std scaling, one seeded run, 100 iterations."""
    d = derived(spark, sf).where(F.col("cancelled") == 0).select(*cluster.CLUSTER_FEATURES)
    c = cluster.kmeans_tiers(materialize(d, "kmeans_operated_input"), n_init=1, max_iter=100,
                             ddof=1)
    return cluster.cluster_summary(c)


# Starting centres (arr_delay, distance) of the run that SQL repeats.
FIXED_STARTS = [[-20.0, 500.0], [40.0, 1500.0], [100.0, 2500.0]]
FIXED_STEPS = 6


def _fixed_start_sql() -> str:
    """The same Lloyd steps, one CTE a step: features in units of their spread, ties to the first centre."""
    steps = [f"""
  , s AS (SELECT avg(arr_delay) AS ma, stddev_pop(arr_delay) AS sa, avg(distance) AS md, stddev_pop(distance) AS sd FROM flights
          WHERE arr_delay IS NOT NULL AND distance IS NOT NULL),
  p AS (SELECT (arr_delay - ma) / sa AS x, (distance - md) / sd AS y, count(*) AS w FROM flights, s
        WHERE arr_delay IS NOT NULL AND distance IS NOT NULL GROUP BY 1, 2),
  c0 AS (SELECT j, (a - ma) / sa AS x, (d - md) / sd AS y FROM s, (VALUES {', '.join(f'({j}, {a}, {d})' for j, (a, d) in enumerate(FIXED_STARTS))}) AS v(j, a, d))"""]
    near = "SELECT p.x, p.y, p.w, arg_min(c.j, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS j, min((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS far FROM p, c{} AS c GROUP BY 1, 2, 3"
    for t in range(1, FIXED_STEPS + 1):
        steps.append(f"""
  c{t} AS (SELECT c.j, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{t - 1} AS c LEFT JOIN (
    SELECT j, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y FROM ({near.format(t - 1)}) GROUP BY j) AS m USING (j))""")
    return ",".join(steps) + f"""
  , f AS ({near.format(FIXED_STEPS)})
  SELECT (row_number() OVER (ORDER BY sum(w * x) / sum(w)) - 1)::INTEGER AS cluster, sum(w)::BIGINT AS n, sum(w * (x * sa + ma)) / sum(w) AS arr_delay,
         sum(w * (y * sd + md)) / sum(w) AS distance, sum(sum(w * far)) OVER () AS cost
  FROM f, s GROUP BY j"""


@query("kmeans_fixed_start", _sql(_fixed_start_sql()), rounded=["arr_delay", "distance", "cost"], digits=6)
def q_kmeans_fixed(spark, sf):
    """M1 from given starting centres and a fixed number of steps: sizes, means and cost per tier."""
    feats = ["arr_delay", "distance"]
    rows = materialize(flights(spark, sf).select(*feats), "kmeans_fixed_input")
    fit = cluster.fit_kmeans(rows, feats, k=3, max_iter=FIXED_STEPS, starts=[FIXED_STARTS], tol=0.0)
    return cluster.with_tiers(rows, fit).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in feats], F.first("_cost").alias("cost"))


# --- discriminant analysis on the flights (class = order priority) -----------------

LDA_FEATURES = ["dep_delay", "arr_delay", "distance", "air_time"]


def _lda_data(spark, sf):
    d = flights(spark, sf).select("flight_key", "o_orderpriority", *LDA_FEATURES).dropna()
    return encode.standard_scale(materialize(d, "lda_input"), LDA_FEATURES, ddof=0)


def _lda(spark, sf):
    data = _lda_data(spark, sf)
    return data, discrim.lda_fit(data, "o_orderpriority", LDA_FEATURES)


@query("lda_coefficients")
def q_lda_coef(spark, sf):
    """Class-function coefficients and intercepts."""
    _, m = _lda(spark, sf)
    return discrim.coefficients_table(spark, m)


@query("lda_summary")
def q_lda_summary(spark, sf):
    """Priors and explained variance ratio per discriminant."""
    _, m = _lda(spark, sf)
    return discrim.model_summary(spark, m)


@query("lda_transform")
def q_lda_transform(spark, sf):
    """LD1, LD2 per row."""
    data, m = _lda(spark, sf)
    return discrim.lda_transform(data, m, 2).select("flight_key", "o_orderpriority", "LD1", "LD2")


@query("lda_confusion")
def q_lda_conf(spark, sf):
    """M12 + V1: in-sample confusion matrix of the LDA prediction."""
    data, m = _lda(spark, sf)
    return evaluate.confusion_matrix(discrim.lda_predict(data, m), "o_orderpriority",
                                     "predicted", PRIORITIES)


@query("lda_report")
def q_lda_report(spark, sf):
    """M12 + V5."""
    data, m = _lda(spark, sf)
    return evaluate.classification_report(discrim.lda_predict(data, m), "o_orderpriority",
                                          "predicted", PRIORITIES)


@query("lda_importance")
def q_lda_imp(spark, sf):
    """Mean |coefficient| per feature, ranked."""
    _, m = _lda(spark, sf)
    return discrim.importance(discrim.coefficients_table(spark, m))


@query("lda_group_centroids")
def q_lda_cent(spark, sf):
    """A16 + T14 on the discriminant scores: centroid distances."""
    data, m = _lda(spark, sf)
    t = discrim.lda_transform(data, m, 2)
    cent = t.groupBy("o_orderpriority").agg(F.avg("LD1").alias("LD1"), F.avg("LD2").alias("LD2"))
    return stats.centroid_distances(cent, "o_orderpriority", ["LD1", "LD2"])


@query("lda_stored_model")
def q_lda_stored(spark, sf):
    """Store the model (unless one of the same data is there), load it, then
    predict (V9)."""
    data = _lda_data(spark, sf)
    model = model_store.load_or_fit(
        spark, _stored_path(spark, sf, "lda_priority"),
        lambda: model_store.of_lda(discrim.lda_fit(data, "o_orderpriority", LDA_FEATURES), "o_orderpriority"),
        discrim.data_fingerprint(data, "o_orderpriority", LDA_FEATURES))
    return model_store.apply(data, model).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))
