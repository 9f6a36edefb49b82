"""Queries of merged sources, fixed-coefficient scoring, batch quartiles and the
diagnostics of a fitted line, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import derive, dist
from ..operators import cluster, discrim, encode, evaluate, linear, logistic, ordered, relate, sampling, stats
from ..session import checkpoint_path, materialize
from ..sources.flights import airports, flights
from ..sources.io import coerce_schema, read_csv_table, register, write_table
from ..sources.tables import table
from .catalog import query
from .flight_queries import HE, _sql

# --- sources and sinks ------------------------------------------------------------

NATION_KEY = ["nation_key"]


@query("merge_nation_indicators", """
  WITH a AS (SELECT c_nationkey AS nation_key, avg(c_acctbal) AS customer_balance FROM customer GROUP BY 1),
  b AS (SELECT s_nationkey AS nation_key, avg(s_acctbal) AS supplier_balance FROM supplier GROUP BY 1),
  c AS (SELECT c_nationkey AS nation_key, count(*) AS orders, max(o_totalprice) AS largest_order
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
  d AS (SELECT s_nationkey AS nation_key, sum(l_quantity) AS quantity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
  e AS (SELECT n_nationkey AS nation_key, n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT * FROM e JOIN a USING (nation_key) JOIN b USING (nation_key) JOIN c USING (nation_key) JOIN d USING (nation_key)""",
       rounded=["customer_balance", "supplier_balance"], digits=6)
def q_merge_nations(spark, sf):
    """Five keyed tables merged by a fold of inner equi-joins."""
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    frames = [
        table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")),
        customer.groupBy(F.col("c_nationkey").alias("nation_key")).agg(F.avg("c_acctbal").alias("customer_balance")),
        supplier.groupBy(F.col("s_nationkey").alias("nation_key")).agg(F.avg("s_acctbal").alias("supplier_balance")),
        table(spark, sf, "orders", "o_custkey", "o_totalprice")
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation_key"))
        .agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest_order")),
        table(spark, sf, "lineitem", "l_suppkey", "l_quantity")
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("nation_key")).agg(F.sum("l_quantity").alias("quantity")),
    ]
    return relate.merge_all(frames, on=NATION_KEY)


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_csv_round_trip(spark, sf):
    """S5 + S1 + S4: the customers written as CSV, read back under a declared
    schema of strings, then typed and renamed by position."""
    path = checkpoint_path(spark, f"tables/customer-csv-{uuid.uuid4().hex}")
    customer = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    write_table(customer, path, "csv")
    text = read_csv_table(spark, path, ", ".join(f"f{i} string" for i in range(5)))
    return coerce_schema(text, ["bigint", "string", "int", "double", "string"], customer.columns)


@query("partitioned_sink", "SELECT n_regionkey, count(*) AS nations, min(n_name) AS first_name FROM nation GROUP BY 1")
def q_partitioned_sink(spark, sf):
    """S5 + S6: the nations written as Parquet partitioned by region, read back as
    a named view."""
    path = checkpoint_path(spark, f"tables/nation-{uuid.uuid4().hex}")
    write_table(table(spark, sf, "nation"), path, partition_by=["n_regionkey"])
    view = "nations_by_region"
    register(spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(path), view)
    return spark.table(view).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.min("n_name").alias("first_name"))


# --- derived columns and scaling ----------------------------------------------------

@query("log_delay_shifted", _sql("""
  SELECT flight_key, ln(arr_delay + (SELECT greatest(0.0, -min(arr_delay)) + 1 FROM flights)) AS log_arr_delay FROM flights"""),
       rounded=["log_arr_delay"], digits=9)
def q_log_delay_shifted(spark, sf):
    """one table-wide shift, then the logarithm."""
    return derive.log_delay_global(flights(spark, sf).select("flight_key", "arr_delay")).select("flight_key", "log_arr_delay")


@query("scaled_by_train", _sql("""
  , s AS (SELECT flight_key, dep_delay, distance, row_number() OVER (PARTITION BY cancelled ORDER BY md5('42:' || flight_key), flight_key)
            <= floor(count(*) OVER (PARTITION BY cancelled) * 0.8 + 0.5) AS t FROM flights),
  m AS (SELECT avg(dep_delay) AS a, stddev_pop(dep_delay) AS b, avg(distance) AS c, stddev_pop(distance) AS d FROM s WHERE t)
  SELECT flight_key, CAST(t AS INTEGER) AS is_train, (dep_delay - a) / b AS dep_delay, (distance - c) / d AS distance FROM s, m"""),
       rounded=["dep_delay", "distance"], digits=9)
def q_scaled_by_train(spark, sf):
    """The scaler is fitted on the training rows and applied to all."""
    f = flights(spark, sf).select("flight_key", "cancelled", "dep_delay", "distance")
    split = sampling.stratified_split(f, "cancelled", "flight_key", 0.8, 42)
    cols = ["dep_delay", "distance"]
    fitted = encode.scaler_table(split.where(F.col("is_train") == 1), cols)
    return encode.apply_scaler(split, fitted, cols).select("flight_key", "is_train", *cols)


@query("hash_split", _sql("""
  SELECT flight_key, CAST(CAST('0x' || substr(md5('42:' || flight_key), 1, 15) AS BIGINT) < 0.8 * 1152921504606846976 AS INTEGER) AS is_train
  FROM flights"""))
def q_hash_split(spark, sf):
    """SA2 by hash threshold."""
    return sampling.hash_split(flights(spark, sf).select("flight_key"), "flight_key", 0.8, 42)


@query("delay_range", _sql("SELECT count(*) AS n, avg(dep_delay) AS mean FROM flights WHERE dep_delay BETWEEN -30 AND 180 AND arr_delay IS NOT NULL"),
       rounded=["mean"], digits=9)
def q_delay_range(spark, sf):
    """Rows complete in both delays with the departure delay in -30..180."""
    f = flights(spark, sf).where(derive.not_missing("dep_delay", "arr_delay") & F.col("dep_delay").between(-30, 180))
    return f.agg(F.count(F.lit(1)).alias("n"), F.avg("dep_delay").alias("mean"))


# --- quartiles by averaged empirical distribution ----------------------------------

@query("quartiles_averaged", _sql("""
  , v AS (SELECT op_unique_carrier AS carrier, dep_delay AS x, row_number() OVER (PARTITION BY op_unique_carrier ORDER BY dep_delay) AS i,
                 count(*) OVER (PARTITION BY op_unique_carrier) AS n FROM flights WHERE dep_delay IS NOT NULL),
  q AS (SELECT carrier, p, avg(x) AS value FROM v, (VALUES (25), (50), (75)) AS t(p)
        WHERE i = CASE WHEN (n * p) % 100 = 0 THEN n * p // 100 ELSE n * p // 100 + 1 END OR ((n * p) % 100 = 0 AND i = n * p // 100 + 1)
        GROUP BY carrier, p)
  SELECT carrier, max(value) FILTER (WHERE p = 25) AS p25, max(value) FILTER (WHERE p = 50) AS median, max(value) FILTER (WHERE p = 75) AS p75
  FROM q GROUP BY carrier"""))
def q_quartiles_averaged(spark, sf):
    """Q4 by definition 5: the j-th value, or the mean of it and the next where
    n * p is the whole number j."""
    f = flights(spark, sf).select(F.col("op_unique_carrier").alias("carrier"), "dep_delay")
    return ordered.quantiles_averaged(f, "dep_delay", [25, 50, 75], ["p25", "median", "p75"], ["carrier"])


# --- fixed labels and coefficients ----------------------------------------------------

_TIER = "CASE WHEN distance < 800 THEN 'c' WHEN distance < 1600 THEN 'a' WHEN distance < 2400 THEN 'd' ELSE 'b' END"


@query("tiers_of_fixed_clusters", _sql(f"""
  , c AS (SELECT *, {_TIER} AS g FROM flights WHERE dep_delay IS NOT NULL AND arr_delay IS NOT NULL AND distance IS NOT NULL AND air_time IS NOT NULL),
  m AS (SELECT g, row_number() OVER (ORDER BY avg(arr_delay), g) - 1 AS tier FROM c GROUP BY g)
  SELECT CAST(tier AS INTEGER) AS tier, {HE('avg(dep_delay)')} AS dep_delay, {HE('avg(arr_delay)')} AS arr_delay,
         {HE('avg(distance)')} AS distance, {HE('avg(air_time)')} AS air_time, count(*) AS n, median(arr_delay) AS median_arr_delay
  FROM c JOIN m USING (g) GROUP BY tier"""))
def q_fixed_tiers(spark, sf):
    """W2 + A19 + A12 for clusters given by distance bands: tiers by mean arrival
    delay, with means, sizes and medians."""
    c = flights(spark, sf).dropna(subset=cluster.CLUSTER_FEATURES).withColumn("_g", F.expr(_TIER))
    tiers = relate.rank_tiers(c.groupBy("_g").agg(F.avg("arr_delay").alias("_m")), "_g", "_m", "cluster").drop("_m")
    c = materialize(c.join(F.broadcast(tiers), "_g").withColumn("_cost", F.lit(0.0)).select("cluster", "_cost", *cluster.CLUSTER_FEATURES), "tiers")
    median = ordered.quantiles_wide(c, "arr_delay", [0.5], ["median_arr_delay"], ["cluster"])
    return (cluster.cluster_summary(c).drop("training_cost").join(median, F.col("tier") == F.col("cluster")).drop("cluster"))


@query("importance_of_slopes", _sql("""
  , t AS (SELECT o_orderpriority AS class, 'dep_delay' AS term, regr_slope(arr_delay, dep_delay) AS coef FROM flights GROUP BY 1
          UNION ALL SELECT o_orderpriority, 'distance', regr_slope(arr_delay, distance) FROM flights GROUP BY 1
          UNION ALL SELECT o_orderpriority, 'air_time', regr_slope(arr_delay, air_time) FROM flights GROUP BY 1)
  SELECT term AS feature, avg(abs(coef)) AS mean_abs_coef, CAST(row_number() OVER (ORDER BY avg(abs(coef)) DESC, term) AS INTEGER) AS rank FROM t GROUP BY term"""),
       rounded=["mean_abs_coef"], digits=9)
def q_importance_of_slopes(spark, sf):
    """M13 on a coefficient table of one slope per class and feature."""
    f = flights(spark, sf)
    names = ["dep_delay", "distance", "air_time"]
    wide = f.groupBy(F.col("o_orderpriority").alias("class")).agg(*[F.regr_slope("arr_delay", c).alias(c) for c in names])
    return discrim.importance(wide.unpivot("class", names, "term", "coef"))


@query("score_fixed_coefficients", _sql("""
  SELECT flight_key, 1.0 / (1.0 + exp(-(-5.0 + dep_delay * 0.02 + distance * 0.001 + month * -0.05))) AS prob FROM flights"""),
       rounded=["prob"], digits=9)
def q_score_fixed(spark, sf):
    """V9: stored coefficients applied to every row."""
    f = flights(spark, sf).select("flight_key", "dep_delay", "distance", "month")
    return logistic.score(f, ["dep_delay", "distance", "month"], [0.02, 0.001, -0.05], -5.0).select("flight_key", "prob")


# --- one fitted line and its diagnostics -----------------------------------------------

_LINE = """
  , xy AS (SELECT flight_key, dep_delay AS x, arr_delay AS y FROM flights WHERE dep_delay IS NOT NULL AND arr_delay IS NOT NULL),
  fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y, x) AS sxx,
                 regr_syy(y, x) AS syy, avg(x) AS mx FROM xy),
  s AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2)) AS sigma FROM fit),
  e AS (SELECT xy.*, a + b * x AS fitted, y - a - b * x AS res, (y - a - b * x) / (sigma * sqrt(1 - 1.0 / n - (x - mx) * (x - mx) / sxx)) AS std_res FROM xy, s)"""


def _line(spark, sf):
    data = materialize(flights(spark, sf).select("flight_key", "dep_delay", "arr_delay").dropna(), "line")
    return data, linear.ols(data, "arr_delay", ["dep_delay"])[0]


@query("ols_line", _sql(_LINE + """
  SELECT 'Intercept' AS term, a AS estimate, sigma * sqrt(1.0 / n + mx * mx / sxx) AS std_err FROM s
  UNION ALL SELECT 'dep_delay', b, sigma / sqrt(sxx) FROM s"""), rounded=["estimate", "std_err"], digits=8)
def q_ols_line(spark, sf):
    """M6 with one feature: estimates and standard errors."""
    _, res = _line(spark, sf)
    out = linear.coef_table(spark, res).select("term", "estimate", "std_err")
    return out.withColumn("term", F.when(F.col("term") == "dep_delay", F.col("term")).otherwise("Intercept"))


@query("breusch_pagan_line", _sql(_LINE + "SELECT count(*) * regr_r2(res * res, x) AS bp_stat FROM e"), rounded=["bp_stat"], digits=6)
def q_breusch_pagan_line(spark, sf):
    """T17 of the line."""
    data, res = _line(spark, sf)
    return spark.createDataFrame([(linear.breusch_pagan(data, res, "arr_delay")["bp_stat"],)], "bp_stat double")


def _std_residuals(spark, sf):
    data, res = _line(spark, sf)
    return linear.standardized_residuals(data, res, "arr_delay")


_QQ = [(i + 0.5) / 50 for i in range(50)]


@query("qq_line", _sql(_LINE + f"""
  , q AS (SELECT unnest([{', '.join(map(str, _QQ))}]) AS prob, unnest(quantile_cont(std_res, [{', '.join(map(str, _QQ))}])) AS sample,
                 unnest([{', '.join(repr(dist.norm_ppf(p)) for p in _QQ)}]) AS theoretical FROM e)
  SELECT prob, theoretical, sample FROM q"""), rounded=["theoretical", "sample"], digits=6)
def q_qq_line(spark, sf):
    """Normal quantile plot of the standardised residuals, 50 points."""
    return linear.qq_points(_std_residuals(spark, sf), "std_res", _QQ)


@query("scale_location_line", _sql(_LINE + """
  , r AS (SELECT min(fitted) AS lo, max(fitted) AS hi FROM e)
  SELECT CAST(least(floor((fitted - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n, avg(fitted) AS fitted,
         avg(sqrt(abs(std_res))) AS root_abs_std_res FROM e, r GROUP BY 1"""), rounded=["fitted", "root_abs_std_res"], digits=6)
def q_scale_location_line(spark, sf):
    """Mean root of the absolute standardised residual along the fit."""
    return linear.scale_location(_std_residuals(spark, sf), 40)


@query("residual_sample_line", _sql(_LINE + """
  SELECT flight_key, fitted, res AS residual FROM e ORDER BY md5('42:' || flight_key), flight_key LIMIT 3000"""),
       rounded=["fitted", "residual"], digits=6)
def q_residual_sample(spark, sf):
    """Rows with fit and residual for the residual plot, 3000 of them."""
    r = _std_residuals(spark, sf).select("flight_key", "fitted", F.col("res").alias("residual"))
    return sampling.sample_exact(r, 3000, "flight_key", 42)


@query("scatter_sample", _sql("""
  SELECT flight_key, distance, arr_delay FROM flights WHERE distance IS NOT NULL AND arr_delay IS NOT NULL
  ORDER BY md5('42:' || flight_key), flight_key LIMIT 2000"""))
def q_scatter_sample(spark, sf):
    """Sampled points of a scatter plot."""
    f = flights(spark, sf).select("flight_key", "distance", "arr_delay").dropna()
    return sampling.sample_exact(f, 2000, "flight_key", 42)


_HL = """
  , p AS (SELECT cancelled AS y, 1.0 / (1.0 + exp(-(dep_delay - 60.0) / 15.0)) AS p FROM flights WHERE dep_delay IS NOT NULL),
  c AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM p),
  g AS (SELECT len(list_filter(cuts, lambda x: p > x)) AS d, count(*) AS n, sum(y) AS o, sum(p) AS e FROM p, c GROUP BY 1),
  t AS (SELECT sum((o - e) * (o - e) / (e * (1 - e / n))) AS chi2, CAST(count(*) - 2 AS INTEGER) AS df FROM g)
  SELECT chi2, df FROM t"""


@query("hosmer_lemeshow_total", _sql(_HL), rounded=["chi2"], digits=4)
def q_hl_total(spark, sf):
    """Chi-square over the groups and its degrees of freedom."""
    f = flights(spark, sf).where(F.col("dep_delay").isNotNull())
    s = f.select("cancelled", (1.0 / (1.0 + F.exp(-(F.col("dep_delay") - 60.0) / 15.0))).alias("prob"))
    return linear.hosmer_lemeshow_test(s, "cancelled", "prob").select("chi2", "df")


# --- reports --------------------------------------------------------------------------

@query("origin_bars", _sql(f"""
  SELECT origin, {HE('avg(arr_delay)')} AS avg_arr_delay, avg(arr_delay) > 0 AS positive FROM flights GROUP BY 1"""))
def q_origin_bars(spark, sf):
    """Bar heights by origin with the sign flag used for the bar colour."""
    a = relate.delay_by_origin_all(flights(spark, sf))
    return a.select("origin", "avg_arr_delay", (F.col("avg_arr_delay") > 0).alias("positive"))


@query("best_worst_f1", _sql("""
  , c AS (SELECT o_orderpriority AS t, CASE WHEN dep_delay >= 60 THEN '1-URGENT' WHEN dep_delay >= 20 THEN '2-HIGH' WHEN dep_delay >= 0 THEN '3-MEDIUM'
                 ELSE '5-LOW' END AS p FROM flights WHERE dep_delay IS NOT NULL),
  k AS (SELECT DISTINCT t FROM c),
  f AS (SELECT k.t AS label, 2.0 * count(*) FILTER (WHERE c.t = k.t AND c.p = k.t)
               / (count(*) FILTER (WHERE c.t = k.t) + count(*) FILTER (WHERE c.p = k.t)) AS f1 FROM k, c GROUP BY k.t)
  SELECT arg_min(label, (f1, label)) AS worst_label, min(f1) AS worst_f1, arg_min(label, (-f1, label)) AS best_label, max(f1) AS best_f1 FROM f"""),
       rounded=["worst_f1", "best_f1"], digits=9)
def q_best_worst_f1(spark, sf):
    """The classes of the best and the worst F1 of a fixed rule."""
    d = F.col("dep_delay")
    c = flights(spark, sf).where(d.isNotNull()).withColumn("pred", F.when(d >= 60, "1-URGENT").when(d >= 20, "2-HIGH")
                                                           .when(d >= 0, "3-MEDIUM").otherwise("5-LOW"))
    levels = encode.levels(table(spark, sf, "orders", "o_orderpriority"), "o_orderpriority")
    rep = evaluate.classification_report(c, "o_orderpriority", "pred", levels)
    bw = relate.best_worst(rep.where(F.col("label").isin(*levels)), "label", "f1")  # its best is the smallest value
    return bw.select(F.col("best_label").alias("worst_label"), F.col("best_value").alias("worst_f1"),
                     F.col("worst_label").alias("best_label"), F.col("worst_value").alias("best_f1"))


@query("vif_flags", _sql("""
  , c AS (SELECT dep_delay AS x, arr_delay AS y FROM flights WHERE dep_delay IS NOT NULL AND arr_delay IS NOT NULL)
  SELECT f AS feature, 1 / (1 - pow(corr(x, y), 2)) AS vif, 1 / (1 - pow(corr(x, y), 2)) > 10 AS high FROM c, (VALUES ('dep_delay'), ('arr_delay')) AS t(f) GROUP BY f"""),
       rounded=["vif"], digits=6)
def q_vif_flags(spark, sf):
    """T5 + F19: inflation factors of two features with the flag above 10."""
    return stats.vif(flights(spark, sf), ["dep_delay", "arr_delay"]).withColumn("high", F.col("vif") > 10)


@query("airport_labels", """
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS IATA, count(*) AS n FROM nation GROUP BY 1""")
def q_airport_labels(spark, sf):
    """C2 on the airport dimension: one row per key that is not null."""
    return relate.dedupe_first(airports(spark, sf), "IATA").groupBy("IATA").agg(F.count(F.lit(1)).alias("n"))
