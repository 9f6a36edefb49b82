"""Queries of stored models (S7), nearest-neighbour trends (T16), format tables (X1), sparse
designs (E1, M6), sketches (Q4, V7), aliased terms (M8) and exact small-sample tests (T18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import clean, encode, evaluate, formats, linear, local, logistic, model_store, ordered, sparse
from ..session import materialize
from ..sources.flights import flights
from ..sources.tables import table
from .catalog import query
from .flight_queries import _sql, derived
from .model_queries import _delay_tiers, _lda, _stored_path

SCALED = ["dep_delay", "arr_delay", "distance"]


def _reloaded(spark, sf, name: str, model: model_store.Model) -> model_store.Model:
    """``model`` after a round through the store."""
    path = _stored_path(spark, sf, name)
    return model_store.load(spark, path, kind=model.kind, version=model_store.save(spark, path, model))


@query("stored_scaler_scores", _sql("""
  , s AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED) + """ FROM flights)
  SELECT op_unique_carrier, count(*) AS n, """ + ", ".join(f"avg(({c} - m_{c}) / s_{c}) AS {c}" for c in SCALED) + """
  FROM flights, s GROUP BY 1"""), rounded=SCALED)
def q_stored_scaler(spark, sf):
    """S7 + E4: a scaler stored, loaded and applied: mean scaled features by carrier."""
    f = materialize(flights(spark, sf).select("op_unique_carrier", *SCALED), "scaler_input")
    model = _reloaded(spark, sf, "scaler", model_store.of_scaler(encode.scaler_table(f, SCALED)))
    return model_store.apply(f, model).groupBy("op_unique_carrier").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in SCALED])


@query("stored_encoder_codes", _sql("""
  , o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT origin AS v FROM flights WHERE origin IS NOT NULL)),
  d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT dest AS v FROM flights WHERE dest IS NOT NULL))
  SELECT o.code AS origin, d.code AS dest, count(*) AS n FROM flights AS f LEFT JOIN o ON f.origin = o.v LEFT JOIN d ON f.dest = d.v
  GROUP BY 1, 2"""))
def q_stored_encoder(spark, sf):
    """S7 + E2: a label encoder stored, loaded and applied: rows by pair of codes."""
    f = materialize(flights(spark, sf).select("origin", "dest"), "encoder_input")
    model = _reloaded(spark, sf, "encoder", model_store.of_label_encoder(f, ["origin", "dest"]))
    return model_store.apply(f, model).groupBy("origin", "dest").agg(F.count(F.lit(1)).alias("n"))


@query("stored_ols_scores", _sql("""
  , s AS (SELECT regr_slope(arr_delay, dep_delay) AS b, regr_intercept(arr_delay, dep_delay) AS a FROM flights)
  SELECT op_unique_carrier, count(dep_delay) AS n, avg(a + b * dep_delay) AS predicted FROM flights, s GROUP BY 1"""), rounded=["predicted"])
def q_stored_ols(spark, sf):
    """S7 + M6 + V9: a regression stored, loaded and scored: mean prediction by carrier."""
    f = materialize(flights(spark, sf).select("op_unique_carrier", "dep_delay", "arr_delay"), "ols_store_input")
    res, _ = linear.ols(f, "arr_delay", ["dep_delay"])
    scored = model_store.apply(f, _reloaded(spark, sf, "ols", model_store.of_ols(res, "arr_delay")))
    return scored.groupBy("op_unique_carrier").agg(F.count("dep_delay").alias("n"), F.avg("predicted").alias("predicted"))


@query("stored_models", _sql("""
  , c AS (SELECT count(*) AS n, count(CASE WHEN dep_delay IS NOT NULL AND arr_delay IS NOT NULL AND distance IS NOT NULL THEN 1 END) AS whole
          FROM flights)
  SELECT kind, n AS n_rows, 0::BIGINT AS n_different FROM c, (VALUES ('scaler'), ('label_encoder'), ('one_hot'), ('ols'), ('logistic')) AS v(kind)"""))
def q_stored_models(spark, sf):
    """Models stored and loaded against those in memory: rows scored, rows that differ."""
    f = materialize(flights(spark, sf).select("flight_key", "op_unique_carrier", "origin", "cancelled", *SCALED), "store_input")
    scale = encode.scaler_table(f, SCALED)
    res, _ = linear.ols(f, "arr_delay", ["dep_delay", "distance"])
    whole = materialize(f.dropna(subset=["cancelled", "distance"]), "store_whole")
    weights, _ = logistic.class_weights(whole, "cancelled")
    lr = logistic.newton(whole, "cancelled", ["distance"], weights, 1.0)
    models = [model_store.of_scaler(scale), model_store.of_label_encoder(f, ["origin"]), model_store.of_one_hot(f, ["op_unique_carrier"]),
              model_store.of_ols(res, "arr_delay"), model_store.of_logistic(["distance"], lr.coef[1:], float(lr.coef[0]), "cancelled")]
    parts = []
    for model in models:
        here = model_store.apply(f.withColumn("_k", F.monotonically_increasing_id()), model)
        there = model_store.apply(f.withColumn("_k", F.monotonically_increasing_id()), _reloaded(spark, sf, f"all_{model.kind}", model))
        sums = [F.sum(F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in x.columns if c != "_k"]).cast("decimal(38,0)")).alias("h")
                for x in (here, there)]
        both = here.agg(F.count(F.lit(1)).alias("n_rows"), sums[0].alias("a")).crossJoin(F.broadcast(there.agg(sums[1].alias("b"))))
        parts.append(both.select(F.lit(model.kind).alias("kind"), "n_rows", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("n_rows")).cast("long").alias("n_different")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("stored_kmeans_tiers")
def q_stored_kmeans(spark, sf):
    """S7 + M1: the stored clustering loaded by a later job and applied to all flights: rows by tier (null: incomplete)."""
    _delay_tiers(spark, sf)
    model = model_store.load(spark, _stored_path(spark, sf, "delay_tiers"), kind="kmeans")
    return model_store.apply(flights(spark, sf), model).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("stored_logistic_auc")
def q_stored_logistic(spark, sf):
    """S7 + M3 + V7: the balanced model with its scaler stored, loaded and scored on raw held-out rows."""
    d = derived(spark, sf).select("flight_key", "cancelled", *logistic.LR_FEATURES_NO_LEAK)
    r = logistic.logistic_balanced(materialize(d, "lr_store_input"), "cancelled", "flight_key", logistic.LR_FEATURES_NO_LEAK)
    model = model_store.of_logistic(r["features"], r["coef"], r["intercept"], "cancelled", scale=r["scale"])
    return evaluate.auc(model_store.apply(r["raw_test"], _reloaded(spark, sf, "logistic_balanced", model)), "cancelled", "prob")


@query("stored_lda_predictions")
def q_stored_lda_rows(spark, sf):
    """S7 + M12: predictions of the discriminant model in memory against the loaded one, by predicted class."""
    data, m = _lda(spark, sf)
    loaded = _reloaded(spark, sf, "lda_rows", model_store.of_lda(m, "o_orderpriority"))
    return model_store.apply(data, loaded).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


# --- trends ---------------------------------------------------------------------------

NEIGHBOURS = 500


@query("distance_loess", _sql(f"""
  , d AS (SELECT distance::DOUBLE AS x, count(*) AS n, sum(arr_delay) AS sy FROM flights WHERE distance IS NOT NULL AND arr_delay IS NOT NULL GROUP BY 1),
  r AS (SELECT *, sum(n) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS last, sum(n) OVER () AS total FROM d),
  c AS (SELECT a.x AS g, a.n AS own, least({NEIGHBOURS}, a.total) AS k, b.n, b.sy, b.x - a.x AS away FROM r AS a JOIN r AS b
        ON b.last - b.n + 1 <= a.last + {NEIGHBOURS} AND b.last >= a.last - a.n + 1 - {NEIGHBOURS}),
  f AS (SELECT g, abs(away) AS far, k, sum(sum(n)) OVER (PARTITION BY g ORDER BY abs(away)) AS upto FROM c GROUP BY g, abs(away), k),
  h AS (SELECT g, min(far) AS h FROM f WHERE upto >= k GROUP BY g),
  w AS (SELECT g, own, h, n, sy, away, CASE WHEN h > 0 THEN pow(1 - pow(abs(away) / h, 3), 3) ELSE 1.0 END AS w
        FROM c JOIN h USING (g) WHERE abs(away) < h OR away = 0),
  s AS (SELECT g, own, h, sum(w * n) AS s0, sum(w * n * away) AS s1, sum(w * n * away * away) AS s2, sum(w * sy) AS t0, sum(w * sy * away) AS t1
        FROM w GROUP BY g, own, h)
  SELECT g AS x, own AS n, h AS reach, CASE WHEN s0 * s2 - s1 * s1 > 1e-10 * s0 * s2 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS y_hat
  FROM s"""), rounded=["y_hat", "reach"], digits=6)
def q_distance_loess(spark, sf):
    """Local lines through the 500 nearest flights at every distance."""
    return local.nearest_trend(flights(spark, sf).select("distance", "arr_delay"), "distance", "arr_delay", NEIGHBOURS)


@query("fitted_residual_loess")
def q_residual_loess(spark, sf):
    """T16 + G12: nearest-neighbour trend of the residuals of a three-feature model along its fit."""
    f = materialize(flights(spark, sf).select("arr_delay", "dep_delay", "distance", "weather_delay").dropna(), "loess_fit")
    res, _ = linear.ols(f, "arr_delay", ["dep_delay", "distance", "weather_delay"])
    fitted = linear.linear_predictor(res)
    return local.nearest_trend(f.select(fitted.alias("yhat"), (F.col("arr_delay") - fitted).alias("resid")), "yhat", "resid", 200)


# --- format tables ----------------------------------------------------------------------

@query("price_band_labels", """
WITH p AS (SELECT o_totalprice AS lo, min(o_orderkey) AS k FROM orders GROUP BY 1),
b AS (SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi, 'above order ' || k AS label, k FROM p),
g AS (SELECT lo, hi, label FROM b WHERE k % 10 <> 3),
v AS (SELECT l_extendedprice * 4 AS x FROM lineitem)
SELECT coalesce(g.label, 'no band') AS label, count(*) AS n FROM v LEFT JOIN g ON v.x >= g.lo AND (v.x < g.hi OR g.hi IS NULL) GROUP BY 1""")
def q_price_bands(spark, sf):
    """X1 + F15: line prices labelled from a table of as many bands as there are order prices (every tenth is a gap)."""
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    p = o.groupBy(F.col("o_totalprice").alias("lo")).agg(F.min("o_orderkey").alias("k"))
    b = linear.with_neighbors(p, "lo", ["lo"]).where(F.col("k") % 10 != 3)
    bands = b.select("lo", F.col("next_lo").alias("hi"), F.concat(F.lit("above order "), F.col("k").cast("string")).alias("label"))
    lines = table(spark, sf, "lineitem", "l_extendedprice").select((F.col("l_extendedprice") * 4).alias("x"))
    return formats.range_format(lines, "x", bands, "label", "no band").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("nation_name_format", """
SELECT coalesce(n.n_name, 'elsewhere') AS nation, count(*) AS n FROM customer AS c
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 2) AS n ON c.c_nationkey = n.n_nationkey GROUP BY 1""")
def q_nation_format(spark, sf):
    """X1 + F14: codes labelled from a table of values, unlisted ones by a default."""
    names = table(spark, sf, "nation", "n_nationkey", "n_name").where(F.col("n_nationkey") % 5 != 2)
    c = formats.value_format(table(spark, sf, "customer", "c_nationkey"), "c_nationkey", names, "nation", "elsewhere", "n_nationkey", "n_name")
    return c.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


# --- sparse designs ------------------------------------------------------------------------

@query("one_hot_sparse_parts", """
WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 2 AS c FROM (SELECT DISTINCT l_partkey::VARCHAR AS v FROM lineitem)),
r AS (SELECT v, row_number() OVER (ORDER BY v) - 2 AS c FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)),
w AS (SELECT (SELECT count(*) - 1 FROM l) AS first, (SELECT count(*) - 1 FROM l) + (SELECT count(*) - 1 FROM r) AS size),
e AS (SELECT l.c AS i FROM lineitem JOIN l ON l_partkey::VARCHAR = l.v WHERE l.c >= 0
      UNION ALL SELECT first + r.c FROM lineitem JOIN r ON l_returnflag = r.v, w WHERE r.c >= 0)
SELECT i AS position, size, count(*)::DOUBLE AS total FROM e, w GROUP BY 1, 2""")
def q_one_hot_sparse(spark, sf):
    """Parts and return flags as one sparse 0/1 vector per line: column totals."""
    lines = table(spark, sf, "lineitem", "l_partkey", "l_returnflag")
    coded, _, _ = sparse.sparse_one_hot(lines, ["l_partkey", "l_returnflag"])
    cells = coded.select("one_hot.size", F.explode(F.arrays_zip("one_hot.indices", "one_hot.values")).alias("cell"))
    return cells.groupBy(F.col("cell.indices").cast("long").alias("position"), F.col("size").cast("long").alias("size")).agg(F.sum("cell.values").alias("total"))


@query("ols_sparse_parts", """
WITH g AS (SELECT l_partkey::VARCHAR AS level, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
b AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / sum((l_quantity - mx) * (l_quantity - mx)) AS b
      FROM lineitem JOIN g ON l_partkey::VARCHAR = g.level),
a AS (SELECT level, my - b * mx AS a FROM g, b), z AS (SELECT arg_min(a, level) AS a FROM a)
SELECT 'Intercept' AS term, NULL AS level, a AS estimate FROM z UNION ALL SELECT 'l_quantity', NULL, b FROM b
UNION ALL SELECT 'l_partkey', level, a.a - z.a FROM a, z""", rounded=["estimate"], digits=2)
def q_sparse_ols(spark, sf):
    """M6: price on quantity and one column per part, by conjugate gradients on the normal equations of sparse rows."""
    lines = table(spark, sf, "lineitem", "l_extendedprice", "l_quantity", "l_partkey")
    return sparse.sparse_ols(lines, "l_extendedprice", ["l_quantity"], ["l_partkey"])[0]


# --- sketches -------------------------------------------------------------------------------

SKETCH_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]
SKETCH_ACCURACY = 200


@query("quantile_sketch_delay", _sql("""
  SELECT op_unique_carrier, count(arr_delay) AS n, true AS within_bound FROM flights GROUP BY 1"""))
def q_quantile_sketch(spark, sf):
    """Q4 by sketch: quantiles of the arrival delay by carrier have ranks within the stated error."""
    f = materialize(flights(spark, sf).select("op_unique_carrier", "arr_delay"), "sketch_input")
    names = [f"q{i}" for i in range(len(SKETCH_PROBS))]
    q = ordered.quantiles_wide(f, "arr_delay", SKETCH_PROBS, names, ["op_unique_carrier"], "sketch", SKETCH_ACCURACY)
    rows = ordered.join_by(f, q, ["op_unique_carrier"])
    ranks = rows.groupBy("op_unique_carrier").agg(
        F.count("arr_delay").alias("n"), *[F.count_if(F.col("arr_delay") < F.col(c)).alias(f"below_{c}") for c in names],
        *[F.count_if(F.col("arr_delay") <= F.col(c)).alias(f"upto_{c}") for c in names])
    fine = F.lit(True)
    for p, c in zip(SKETCH_PROBS, names):
        slack = F.col("n") / SKETCH_ACCURACY + 1
        fine = fine & (F.col(f"below_{c}") <= p * F.col("n") + slack) & (F.col(f"upto_{c}") >= p * F.col("n") - slack)
    return ranks.select("op_unique_carrier", "n", fine.alias("within_bound"))


@query("winsorize_sketch_bounds", _sql("""
  SELECT 'dep_delay' AS "column", count(dep_delay) AS n, true AS within_bound FROM flights
  UNION ALL SELECT 'distance', count(distance), true FROM flights UNION ALL SELECT 'air_time', count(air_time), true FROM flights"""))
def q_winsorize_sketch(spark, sf):
    """C6 by sketch: no column has more rows clipped at either end than its share and the stated error allow."""
    cols, accuracy = ["dep_delay", "distance", "air_time"], 500
    f = materialize(flights(spark, sf).select("flight_key", *cols), "winsorize_sketch")
    w = clean.winsorize(f.withColumns({f"_{c}": F.col(c) for c in cols}), cols, method="sketch", accuracy=accuracy)
    sums = [F.struct(F.lit(c).alias("column"), F.count(f"_{c}").alias("n"), F.count_if(F.col(c) > F.col(f"_{c}")).alias("low"),
                     F.count_if(F.col(c) < F.col(f"_{c}")).alias("high")).alias(c) for c in cols]
    rows = w.agg(*sums).select(F.explode(F.array(*cols)).alias("r")).select("r.*")
    most = F.col("n") * (0.01 + 1 / accuracy) + 1
    return rows.select("column", "n", ((F.col("low") <= most) & (F.col("high") <= most)).alias("within_bound"))


@query("auc_sketch_delay", _sql("""
  SELECT sum(CASE WHEN cancelled = 1 THEN 1 ELSE 0 END)::BIGINT AS n_pos, sum(CASE WHEN cancelled <> 1 THEN 1 ELSE 0 END)::BIGINT AS n_neg,
         true AS within_bound FROM flights WHERE cancelled IS NOT NULL AND distance IS NOT NULL"""))
def q_auc_sketch(spark, sf):
    """V7 by sketch: the area from 200 bins of scores is within its stated error of the exact one."""
    f = materialize(flights(spark, sf).select("cancelled", "distance"), "auc_input")
    near, exact = evaluate.auc(f, "cancelled", "distance", "sketch", 200), evaluate.auc(f, "cancelled", "distance").select(F.col("auc").alias("exact"))
    both = near.crossJoin(F.broadcast(exact))  # one row each
    return both.select("n_pos", "n_neg", (F.abs(F.col("auc") - F.col("exact")) <= F.col("error") + 1e-12).alias("within_bound"))


# --- aliased terms, exact tests -----------------------------------------------------------------

@query("ols_aliased_terms", _sql("""
  , s AS (SELECT regr_slope(arr_delay, dep_delay) AS b, regr_intercept(arr_delay, dep_delay) AS a FROM flights)
  SELECT * FROM (SELECT 'Intercept' AS term, a AS estimate, false AS aliased FROM s UNION ALL SELECT 'dep_delay', b, false FROM s
  UNION ALL SELECT 'dep_delay_hours', 0.0, true UNION ALL SELECT 'one', 0.0, true)"""), rounded=["estimate"])
def q_aliased(spark, sf):
    """M8: terms that others determine have estimate 0 and are marked."""
    f = flights(spark, sf).select("arr_delay", "dep_delay", (F.col("dep_delay") / 60).alias("dep_delay_hours"), F.lit(1.0).alias("one"))
    res, _ = linear.ols(materialize(f, "aliased_input"), "arr_delay", ["dep_delay", "dep_delay_hours", "one"])
    return linear.coef_table(spark, res, with_aliased=True).select("term", "estimate", "aliased")


@query("glm_redundant_classes")
def q_redundant_classes(spark, sf):
    """M8: carrier and a coarser class that it determines: estimates with aliased terms marked."""
    d = materialize(flights(spark, sf).select("arr_delay", "dep_delay", "op_unique_carrier").dropna(), "redundant_input")
    lv = encode.levels(d, "op_unique_carrier")
    first = sorted({v[0] for v in lv})
    cols = {f"carrier_{v}": (F.col("op_unique_carrier") == v).cast("double") for v in lv[:-1]}
    cols |= {f"initial_{v}": (F.substring("op_unique_carrier", 1, 1) == v).cast("double") for v in first[:-1]}
    res, _ = linear.ols(d.withColumns(cols), "arr_delay", ["dep_delay", *cols])
    return linear.coef_table(spark, res, with_aliased=True)


@query("durbin_watson_months", _sql("""
  , m AS (SELECT date_trunc('month', fl_date) AS t, avg(arr_delay) AS y, avg(distance) AS x FROM flights GROUP BY 1),
  s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m),
  e AS (SELECT t, y - (a + b * x) AS e FROM m, s), d AS (SELECT e, e - lag(e) OVER (ORDER BY t) AS de FROM e)
  SELECT sum(de * de) / sum(e * e) AS dw, count(*) AS n, true AS exact FROM d"""), rounded=["dw"], digits=6)
def q_dw_months(spark, sf):
    """T18 on monthly means, few enough rows for the exact p-value, which the normal approximation comes near."""
    m = flights(spark, sf).groupBy(F.date_format("fl_date", "yyyy-MM").alias("t")).agg(F.avg("arr_delay").alias("y"), F.avg("distance").alias("x"))
    m = materialize(m, "months")
    res, _ = linear.ols(m, "y", ["x"])
    r = linear.durbin_watson(m, res, "y", "t")
    return spark.createDataFrame([(r["dw"], r["n"], r["n"] < linear.EXACT_ROWS and 0 <= r["p_value"] <= 1)], "dw double, n long, exact boolean")
