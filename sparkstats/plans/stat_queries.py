"""Queries of the statistics and evaluation operators (T*, V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import clean, evaluate, relate, stats
from ..sources.flights import flights
from .catalog import query
from .flight_queries import DERIVE_SQL, _sql, derived
from .profile_queries import _CARRIER_LABEL_SQL, _union

CORR_COLS = ["dep_delay", "arr_delay", "carrier_delay", "weather_delay", "nas_delay",
             "late_aircraft_delay", "distance", "air_time"]
PAIRS = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
CORR_SQL = _union([
    f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) FILTER (WHERE {a} IS NOT NULL AND "
    f"{b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM flights" for a, b in PAIRS])


@query("corr_matrix", _sql(CORR_SQL), rounded=["r"], digits=9)
def q_corr_matrix(spark, sf):
    """Pairwise-complete Pearson r, lower triangle in long form."""
    return stats.corr_long(flights(spark, sf), CORR_COLS)


@query("corr_pvalues")
def q_corr_pvalues(spark, sf):
    """T1 with t and two-sided p per pair (tails on the driver, p(p-1)/2 rows)."""
    return stats.corr_pvalues(stats.corr_long(flights(spark, sf), CORR_COLS))


@query("high_corr_pairs", _sql(f"SELECT * FROM ({CORR_SQL}) WHERE abs(r) > 0.7"),
       rounded=["r"], digits=9)
def q_high_corr_pairs(spark, sf):
    """T2."""
    return stats.high_corr_pairs(stats.corr_long(flights(spark, sf), CORR_COLS), 0.7)


COV_COLS = ["dep_delay", "arr_delay", "distance"]
COV_SQL = _union([
    f"SELECT o_orderpriority, '{a}' AS var1, '{b}' AS var2, covar_samp({a}, {b}) AS cov "
    f"FROM flights GROUP BY o_orderpriority"
    for i, a in enumerate(COV_COLS) for b in COV_COLS[i:]])


@query("group_covariance", _sql(COV_SQL), rounded=["cov"], digits=6)
def q_group_covariance(spark, sf):
    """Per-class sample covariance (i <= j)."""
    return stats.group_covariance(flights(spark, sf), COV_COLS, "o_orderpriority")


@query("cov_frobenius", _sql(f"""
  , cv AS ({COV_SQL}),
  d AS (SELECT a.o_orderpriority AS group_a, b.o_orderpriority AS group_b,
               sqrt(sum(CASE WHEN a.var1 = a.var2 THEN 1.0 ELSE 2.0 END
                        * (a.cov - b.cov) * (a.cov - b.cov))) AS distance
        FROM cv a JOIN cv b ON a.var1 = b.var1 AND a.var2 = b.var2
        WHERE a.o_orderpriority < b.o_orderpriority GROUP BY 1, 2)
  SELECT *, avg(distance) OVER () AS mean_distance FROM d"""),
    rounded=["distance", "mean_distance"], digits=6)
def q_cov_frobenius(spark, sf):
    """T4: covariance-matrix distance between every two classes and their mean."""
    return stats.cov_frobenius(stats.group_covariance(flights(spark, sf), COV_COLS,
                                                      "o_orderpriority"), "o_orderpriority")


VIF_COLS = ["dep_delay", "distance", "air_time", "carrier_delay", "weather_delay",
            "nas_delay", "late_aircraft_delay"]


@query("vif_features")
def q_vif(spark, sf):
    """T5 on complete cases of seven predictors (p x p inverse on the driver)."""
    return stats.vif(flights(spark, sf), VIF_COLS)


@query("shapiro_wilk_dep_delay")
def q_shapiro(spark, sf):
    """T6 on dep_delay and arr_delay (whole columns)."""
    return stats.shapiro_wilk_table(flights(spark, sf), ["dep_delay", "arr_delay"])


@query("univariate_moments", _sql("""
  SELECT count(dep_delay) AS n, avg(dep_delay) AS mean, stddev_samp(dep_delay) AS std,
         skewness(dep_delay) AS skewness, kurtosis(dep_delay) AS kurtosis FROM flights"""),
    rounded=["mean", "std", "skewness", "kurtosis"], digits=9)
def q_moments(spark, sf):
    """T7 moments with bias-adjusted skewness and excess kurtosis."""
    return stats.moments(flights(spark, sf), "dep_delay")


@query("normality_tests_dep_delay")
def q_normality(spark, sf):
    """KS, Cramer-von Mises and Anderson-Darling against the fitted normal."""
    return stats.normality_large_n(derived(spark, sf), "dep_delay")


ANOVA_SQL = f"""
  , lab AS (SELECT dep_delay AS y, {_CARRIER_LABEL_SQL} AS g FROM dflights),
  grp AS (SELECT g, count(*) AS nk, avg(y) AS mk, var_pop(y) * count(*) AS m2k
          FROM lab WHERE y IS NOT NULL AND g IS NOT NULL GROUP BY g),
  tot AS (SELECT count(*) AS k, sum(nk) AS n, sum(nk * mk) / sum(nk) AS grand FROM grp),
  a AS (SELECT k, n, sum(nk * (mk - grand) * (mk - grand)) AS ss_between,
               sum(m2k) AS ss_within FROM grp CROSS JOIN tot GROUP BY k, n)
  SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, ss_between, ss_within,
         CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within,
         (ss_between / (k - 1)) / (ss_within / (n - k)) AS f_stat,
         ss_between / (ss_between + ss_within) AS r2 FROM a"""


def _carrier_labelled(spark, sf):
    return derived(spark, sf).withColumn(
        "carrier_name", labels.value_label("op_unique_carrier", labels.CARRIER_NAMES, "Other"))


@query("anova_carrier", _sql(ANOVA_SQL, DERIVE_SQL),
       rounded=["ss_between", "ss_within", "f_stat", "r2"], digits=6)
def q_anova(spark, sf):
    """One-way ANOVA of dep_delay by formatted carrier."""
    return stats.anova_table(_carrier_labelled(spark, sf), "dep_delay", "carrier_name")


@query("anova_carrier_test")
def q_anova_test(spark, sf):
    """T8 with the F-test p-value."""
    return stats.anova_test(_carrier_labelled(spark, sf), "dep_delay", "carrier_name")


def _hist_sql(src, col, bins, by=None):
    g = f"{by}, " if by else ""
    on = f" USING ({by}, bin)" if by else " USING (bin)"
    grp = f" GROUP BY {by}" if by else ""
    return f"""
  , rng AS (SELECT {g}CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi
            FROM {src} WHERE {col} IS NOT NULL{grp}),
  binned AS (SELECT {g.replace(', ', '') + ', ' if by else ''}CAST(CASE WHEN hi = lo THEN 0 ELSE
                 least(floor(({col} - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin
             FROM {src} JOIN rng {'USING (' + by + ')' if by else 'ON true'}
             WHERE {col} IS NOT NULL),
  counts AS (SELECT {g}bin, count(*) AS count FROM binned GROUP BY {g}bin),
  axis AS (SELECT {g}lo, hi, CAST(b AS INTEGER) AS bin FROM rng,
           range(0, {bins}) t(b))
  SELECT {g}bin, lo + bin * ((hi - lo) / {bins}) AS bin_start,
         lo + (bin + 1) * ((hi - lo) / {bins}) AS bin_end, coalesce(count, 0) AS count
  FROM axis LEFT JOIN counts{on}"""


@query("histogram_dep_delay", _sql(_hist_sql("flights", "dep_delay", 60)),
       rounded=["bin_start", "bin_end"], digits=9)
def q_hist(spark, sf):
    """60 equal-width bins."""
    return stats.histogram(flights(spark, sf), "dep_delay", 60)


@query("histogram_width_arr_delay", _sql("""
  SELECT CAST(floor(arr_delay / 5.0) AS BIGINT) AS bin, count(*) AS count,
         floor(arr_delay / 5.0) * 5.0 AS bin_start, (floor(arr_delay / 5.0) + 1) * 5.0 AS bin_end
  FROM flights WHERE arr_delay IS NOT NULL GROUP BY 1, 3, 4"""))
def q_hist_width(spark, sf):
    """T9 by width (5 minutes)."""
    return stats.histogram_width(flights(spark, sf), "arr_delay", 5.0)


TOP5_SQL = """top5 AS (SELECT op_unique_carrier FROM flights GROUP BY 1
                      ORDER BY count(*) DESC, op_unique_carrier LIMIT 5),
   t5f AS (SELECT f.* FROM flights f SEMI JOIN top5 USING (op_unique_carrier))"""


@query("histogram_top_carriers", _sql(_hist_sql("t5f", "arr_delay", 40, "op_unique_carrier"),
                                      TOP5_SQL), rounded=["bin_start", "bin_end"], digits=9)
def q_hist_top(spark, sf):
    """40-bin histogram of arr_delay for each of the five busiest carriers."""
    top = relate.top_groups_semi(flights(spark, sf), "op_unique_carrier", 5)
    return stats.histogram(top, "arr_delay", 40, by=["op_unique_carrier"])


@query("kde_dep_delay_by_priority", _sql("""
  , vals AS (SELECT o_orderpriority, dep_delay AS v FROM flights WHERE dep_delay IS NOT NULL),
  st AS (SELECT o_orderpriority, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi,
                count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM vals GROUP BY 1),
  grid AS (SELECT o_orderpriority, CAST(k AS INTEGER) AS point,
                  lo + k * ((hi - lo) / 99) AS x, n, h FROM st, range(0, 100) t(k))
  SELECT g.o_orderpriority, g.point, g.x,
         sum(exp(-((g.x - v.v) / g.h) * ((g.x - v.v) / g.h) / 2.0))
           / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi())) AS density
  FROM grid g JOIN vals v USING (o_orderpriority) GROUP BY 1, 2, 3"""),
    rounded=["x", "density"], digits=9)
def q_kde(spark, sf):
    """Per-class Gaussian KDE (Scott bandwidth) on 100 grid points."""
    return stats.kde(flights(spark, sf), "dep_delay", 100, by=["o_orderpriority"])


@query("normal_fit_dep_delay", _sql("""
  , st AS (SELECT CAST(min(dep_delay) AS DOUBLE) AS lo, CAST(max(dep_delay) AS DOUBLE) AS hi,
                avg(dep_delay) AS mu, stddev_samp(dep_delay) AS sd FROM flights)
  SELECT CAST(k AS INTEGER) AS point, lo + k * (hi - lo) / 199 AS x,
         exp(-((lo + k * (hi - lo) / 199 - mu) / sd) * ((lo + k * (hi - lo) / 199 - mu) / sd) / 2.0)
           / (sd * sqrt(2 * pi())) AS density
  FROM st, range(0, 200) t(k)"""), rounded=["x", "density"], digits=9)
def q_normal_fit(spark, sf):
    """T12."""
    return stats.normal_fit_curve(flights(spark, sf), "dep_delay", 200)


def _box_sql(src, col, by):
    return f"""
  , q AS (SELECT {by}, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
                quantile_cont({col}, 0.75) AS q3 FROM {src} WHERE {col} IS NOT NULL GROUP BY 1),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
  SELECT {by}, q1, median, q3, lower_fence, upper_fence, count(*) AS n, avg({col}) AS mean,
         CAST(min(CASE WHEN {col} BETWEEN lower_fence AND upper_fence THEN {col} END) AS DOUBLE)
           AS whisker_low,
         CAST(max(CASE WHEN {col} BETWEEN lower_fence AND upper_fence THEN {col} END) AS DOUBLE)
           AS whisker_high,
         count(*) FILTER (WHERE NOT ({col} BETWEEN lower_fence AND upper_fence)) AS n_outliers
  FROM {src} JOIN f USING ({by}) WHERE {col} IS NOT NULL
  GROUP BY {by}, q1, median, q3, lower_fence, upper_fence"""


_BOX_ROUND = ["q1", "median", "q3", "lower_fence", "upper_fence", "mean", "whisker_low",
              "whisker_high"]


@query("box_stats_carrier", _sql(_box_sql("flights", "arr_delay", "op_unique_carrier")),
       rounded=_BOX_ROUND, digits=9)
def q_box(spark, sf):
    """Box statistics of arr_delay per carrier."""
    return stats.box_stats(flights(spark, sf), "arr_delay", by=["op_unique_carrier"])


@query("box_before_after_clip", _sql(
    _box_sql("stages", "dep_delay", "stage"),
    "stages AS (SELECT 'raw' AS stage, dep_delay FROM flights UNION ALL "
    "SELECT 'clipped' AS stage, CASE WHEN dep_delay IS NOT NULL THEN least(greatest(dep_delay, "
    "(SELECT quantile_cont(dep_delay, 0.01) FROM flights)), (SELECT quantile_cont(dep_delay, 0.99) "
    "FROM flights)) END FROM flights)"), rounded=_BOX_ROUND, digits=9)
def q_box_clip(spark, sf):
    """dep_delay box statistics before and after winsorizing."""
    f = flights(spark, sf).select("dep_delay")
    both = (f.withColumn("stage", F.lit("raw"))
            .unionByName(clean.winsorize(f, ["dep_delay"]).withColumn("stage", F.lit("clipped"))))
    return stats.box_stats(both, "dep_delay", by=["stage"])


CENT_COLS = ["dep_delay", "arr_delay", "distance"]


@query("centroid_distances", _sql(
    "  , c AS (SELECT o_orderpriority, " + ", ".join(f"avg({x}) AS {x}" for x in CENT_COLS)
    + " FROM flights GROUP BY 1)\n  SELECT a.o_orderpriority AS group_a, "
    "b.o_orderpriority AS group_b, sqrt("
    + " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in CENT_COLS)
    + ") AS distance FROM c a JOIN c b ON a.o_orderpriority <> b.o_orderpriority"),
    rounded=["distance"], digits=6)
def q_centroid_distances(spark, sf):
    """T14 with A16 centroids."""
    cent = flights(spark, sf).groupBy("o_orderpriority").agg(
        *[F.avg(c).alias(c) for c in CENT_COLS])
    return stats.centroid_distances(cent, "o_orderpriority", CENT_COLS)


@query("group_moments", _sql("""
  SELECT o_orderpriority, avg(dep_delay) AS mean_dep, stddev_samp(dep_delay) AS std_dep,
         avg(arr_delay) AS mean_arr, stddev_samp(arr_delay) AS std_arr, count(*) AS n
  FROM flights GROUP BY 1"""), rounded=["mean_dep", "std_dep", "mean_arr", "std_arr"], digits=9)
def q_group_moments(spark, sf):
    """Per-class mean, std and count."""
    return flights(spark, sf).groupBy("o_orderpriority").agg(
        F.avg("dep_delay").alias("mean_dep"), F.stddev_samp("dep_delay").alias("std_dep"),
        F.avg("arr_delay").alias("mean_arr"), F.stddev_samp("arr_delay").alias("std_arr"),
        F.count(F.lit(1)).alias("n"))


@query("linear_trend", _sql("""
  , st AS (SELECT regr_slope(arr_delay, distance) AS slope,
                regr_intercept(arr_delay, distance) AS intercept,
                CAST(min(CASE WHEN arr_delay IS NOT NULL THEN distance END) AS DOUBLE) AS lo,
                CAST(max(CASE WHEN arr_delay IS NOT NULL THEN distance END) AS DOUBLE) AS hi
         FROM flights)
  SELECT CAST(k AS INTEGER) AS point, lo + k * (hi - lo) / 199 AS x,
         intercept + slope * (lo + k * (hi - lo) / 199) AS y_hat, slope, intercept
  FROM st, range(0, 200) t(k)"""), rounded=["x", "y_hat", "slope", "intercept"], digits=9)
def q_linear_trend(spark, sf):
    """Degree-1 least squares of arr_delay on distance, 200 points."""
    return stats.linear_trend(flights(spark, sf), "distance", "arr_delay", 200)


# --- evaluation with fixed rules on the view -----------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PRI_ARR = "[" + ", ".join(f"'{p}'" for p in PRIORITIES) + "]"
PRED_SQL = f"""scored AS (
  SELECT flight_key, o_orderpriority AS truth, cancelled, dep_delay,
    CASE WHEN dep_delay IS NOT NULL THEN ({_PRI_ARR})[CAST(least(5, greatest(1,
         floor((dep_delay + 60) / 40) + 1)) AS INTEGER)] END AS pred,
    CAST(dep_delay >= 60 AS INTEGER) AS pred_cancel
  FROM flights)"""


def scored(spark, sf):
    """Fixed rule: predicted priority from the departure-delay band; predicted
    cancellation when dep_delay >= 60; score = dep_delay."""
    f = flights(spark, sf)
    band = F.least(F.lit(5), F.greatest(F.lit(1), F.floor((F.col("dep_delay") + 60) / 40) + 1))
    return f.select(
        "flight_key", F.col("o_orderpriority").alias("truth"), "cancelled", "dep_delay",
        F.when(F.col("dep_delay").isNotNull(), F.element_at(
            F.array(*[F.lit(p) for p in PRIORITIES]), band.cast("int"))).alias("pred"),
        (F.col("dep_delay") >= 60).cast("int").alias("pred_cancel"))


def _conf_sql(levels, t="truth", p="pred", quote=True):
    q = (lambda v: f"'{v}'") if quote else str
    lv = "(VALUES " + ", ".join(f"({q(v)})" for v in levels) + ") AS lv(true_label)"
    cells = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE pred_label = {q(v)}), 0) AS BIGINT) "
                      f"AS \"{v}\"" for v in levels)
    return (f", pc AS (SELECT {t} AS true_label, {p} AS pred_label, count(*) AS n FROM scored "
            f"WHERE {t} IS NOT NULL AND {p} IS NOT NULL GROUP BY 1, 2)\n"
            f"SELECT lv.true_label, {cells} FROM {lv} LEFT JOIN pc USING (true_label) "
            f"GROUP BY lv.true_label")


@query("confusion_priority", _sql(_conf_sql(PRIORITIES), PRED_SQL))
def q_confusion(spark, sf):
    """V1 / R2: 5 x 5 confusion matrix (true rows, predicted columns)."""
    return evaluate.confusion_matrix(scored(spark, sf), "truth", "pred", PRIORITIES)


@query("confusion_cancelled", _sql(_conf_sql([0, 1], "cancelled", "pred_cancel", False),
                                   PRED_SQL))
def q_confusion_bin(spark, sf):
    """V1 on the binary cancellation rule."""
    return evaluate.confusion_matrix(scored(spark, sf), "cancelled", "pred_cancel", [0, 1])


@query("confusion_normalized_priority", _sql(
    ", pc AS (SELECT truth AS true_label, pred AS pred_label, count(*) * 100.0 / "
    "sum(count(*)) OVER (PARTITION BY truth) AS pct FROM scored WHERE truth IS NOT NULL AND "
    "pred IS NOT NULL GROUP BY 1, 2)\nSELECT lv.true_label, "
    + ", ".join(f"CAST(coalesce(max(pct) FILTER (WHERE pred_label = '{v}'), 0.0) AS DOUBLE) "
                f"AS \"{v}\"" for v in PRIORITIES)
    + " FROM (VALUES " + ", ".join(f"('{v}')" for v in PRIORITIES)
    + ") AS lv(true_label) LEFT JOIN pc USING (true_label) GROUP BY lv.true_label", PRED_SQL),
    rounded=PRIORITIES, digits=9)
def q_confusion_norm(spark, sf):
    """V2."""
    return evaluate.confusion_normalized(scored(spark, sf), "truth", "pred", PRIORITIES)


_PER_CLASS_SQL = (", pc AS (SELECT truth AS t, pred AS p, count(*) AS n FROM scored "
                  "WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2), "
                  "lv AS (SELECT * FROM (VALUES "
                  + ", ".join(f"({i}, '{v}')" for i, v in enumerate(PRIORITIES))
                  + ") AS lv(pos, label)), cls AS (SELECT CAST(pos AS BIGINT) AS pos, label, "
                  "CAST(coalesce((SELECT sum(n) FROM pc WHERE t = label), 0) AS BIGINT) AS support,"
                  " CAST(coalesce((SELECT sum(n) FROM pc WHERE p = label), 0) AS BIGINT) AS predicted,"
                  " CAST(coalesce((SELECT sum(n) FROM pc WHERE t = label AND p = label), 0) "
                  "AS BIGINT) AS tp FROM lv)")


@query("accuracy_by_class_priority", _sql(
    _PER_CLASS_SQL + f"""
  SELECT pos, label, tp AS correct, support,
         CASE WHEN support <> 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS accuracy,
         support > 0 AND tp = support AS perfect FROM cls
  UNION ALL
  SELECT {len(PRIORITIES)}, 'overall', sum(tp), sum(support),
         CASE WHEN sum(support) <> 0 THEN CAST(sum(tp) AS DOUBLE) / sum(support) ELSE 0.0 END,
         sum(tp) = sum(support) FROM cls""", PRED_SQL), rounded=["accuracy"], digits=9)
def q_accuracy(spark, sf):
    """V3."""
    return evaluate.accuracy_by_class(scored(spark, sf), "truth", "pred", PRIORITIES)


@query("misclassifications_priority", _sql("""
  SELECT truth AS true_label, pred AS pred_label, count(*) AS n,
         count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY truth) AS pct_of_true
  FROM scored WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2
  QUALIFY truth <> pred""", PRED_SQL), rounded=["pct_of_true"], digits=9)
def q_misclass(spark, sf):
    """V4."""
    return evaluate.misclassifications(scored(spark, sf), "truth", "pred")


@query("classification_report_priority", _sql(
    _PER_CLASS_SQL + f""", per AS (
    SELECT pos, label,
           CASE WHEN tp + (predicted - tp) <> 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END
             AS precision,
           CASE WHEN support <> 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
           CAST(support AS DOUBLE) AS support, tp FROM cls),
  per2 AS (SELECT *, CASE WHEN precision + recall <> 0
                          THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
           FROM per),
  tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr,
                 avg(f1) AS mf, sum(precision * support) AS wp, sum(recall * support) AS wr,
                 sum(f1 * support) AS wf FROM per2)
  SELECT pos, label, precision, recall, f1, support FROM per2
  UNION ALL SELECT {len(PRIORITIES)}, 'accuracy', tp / n, tp / n, tp / n, n FROM tot
  UNION ALL SELECT {len(PRIORITIES) + 1}, 'macro avg', mp, mr, mf, n FROM tot
  UNION ALL SELECT {len(PRIORITIES) + 2}, 'weighted avg', wp / n, wr / n, wf / n, n FROM tot""",
    PRED_SQL), rounded=["precision", "recall", "f1"], digits=9)
def q_report(spark, sf):
    """V5."""
    return evaluate.classification_report(scored(spark, sf), "truth", "pred", PRIORITIES)


_SCORE_SQL = ("sc AS (SELECT CAST(dep_delay AS DOUBLE) AS score, "
              "sum(CAST(cancelled = 1 AS BIGINT)) AS pos, sum(CAST(cancelled <> 1 AS BIGINT)) "
              "AS neg FROM flights WHERE cancelled IS NOT NULL AND dep_delay IS NOT NULL "
              "GROUP BY 1)")


@query("roc_dep_delay", _sql("""
  SELECT score AS threshold,
         CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) / sum(neg) OVER () AS fpr,
         CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) / sum(pos) OVER () AS tpr
  FROM sc UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""", _SCORE_SQL),
    rounded=["fpr", "tpr"], digits=9)
def q_roc(spark, sf):
    """V6: ROC points of the score dep_delay against cancelled."""
    return evaluate.roc_curve(flights(spark, sf), "cancelled", "dep_delay")


@query("auc_dep_delay", _sql("""
  , r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED
          PRECEDING AND 1 PRECEDING), 0) AS below FROM sc)
  SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc,
         CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM r""",
    _SCORE_SQL), rounded=["auc"], digits=9)
def q_auc(spark, sf):
    """V7: rank AUC with ties counted half."""
    return evaluate.auc(flights(spark, sf), "cancelled", "dep_delay")


CUTOFFS = [0, 15, 30, 60, 90, 120]


@query("class_table_dep_delay", _sql(
    ", cut AS (SELECT * FROM (VALUES " + ", ".join(f"({float(c)})" for c in CUTOFFS)
    + """) AS c(cutoff)),
  g AS (SELECT cutoff,
          CAST(sum(CASE WHEN score >= cutoff THEN pos ELSE 0 END) AS BIGINT) AS correct_events,
          CAST(sum(CASE WHEN score < cutoff THEN neg ELSE 0 END) AS BIGINT) AS correct_nonevents,
          CAST(sum(CASE WHEN score >= cutoff THEN neg ELSE 0 END) AS BIGINT) AS incorrect_events,
          CAST(sum(CASE WHEN score < cutoff THEN pos ELSE 0 END) AS BIGINT) AS incorrect_nonevents
        FROM sc CROSS JOIN cut GROUP BY cutoff)
  SELECT *, CASE WHEN correct_events + incorrect_nonevents <> 0 THEN correct_events * 100.0 /
              (correct_events + incorrect_nonevents) ELSE 0.0 END AS sensitivity,
            CASE WHEN correct_nonevents + incorrect_events <> 0 THEN correct_nonevents * 100.0 /
              (correct_nonevents + incorrect_events) ELSE 0.0 END AS specificity,
            (correct_events + correct_nonevents) * 100.0 / (correct_events + correct_nonevents
              + incorrect_events + incorrect_nonevents) AS pct_correct FROM g""", _SCORE_SQL),
    rounded=["sensitivity", "specificity", "pct_correct"], digits=9)
def q_class_table(spark, sf):
    """V8 at fixed cut-offs of the score."""
    return evaluate.class_table(flights(spark, sf), "cancelled", "dep_delay", CUTOFFS)


@query("local_trend_distance", _sql("""
  , xs AS (SELECT CAST(distance AS DOUBLE) AS x, CAST(arr_delay AS DOUBLE) AS y FROM flights
           WHERE distance IS NOT NULL AND arr_delay IS NOT NULL),
  r AS (SELECT min(x) AS lo, max(x) AS hi FROM xs),
  p AS (SELECT lo, (hi - lo) / 1000 AS width, 0.3 * (hi - lo) AS h, (hi - lo) / 99 AS step
        FROM r),
  b AS (SELECT least(floor((x - lo) / width), 999) AS bin, count(*) AS n, sum(x) AS sx,
               sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM xs, p GROUP BY 1),
  e AS (SELECT CAST(k AS INTEGER) AS k, b.*, lo + (bin + 0.5) * width AS c, h, lo, step
        FROM b, p, range(0, 100) t(k)
        WHERE abs(lo + k * step - (lo + (bin + 0.5) * width)) < h),
  s AS (SELECT k, any_value(lo + k * step) AS gx,
               sum(pow(1 - pow(abs(lo + k * step - c) / h, 3), 3) * n) AS w_n,
               sum(pow(1 - pow(abs(lo + k * step - c) / h, 3), 3) * sx) AS w_sx,
               sum(pow(1 - pow(abs(lo + k * step - c) / h, 3), 3) * sy) AS w_sy,
               sum(pow(1 - pow(abs(lo + k * step - c) / h, 3), 3) * sxx) AS w_sxx,
               sum(pow(1 - pow(abs(lo + k * step - c) / h, 3), 3) * sxy) AS w_sxy
        FROM e GROUP BY k)
  SELECT k AS point, gx AS x,
         CASE WHEN w_n * w_sxx - w_sx * w_sx <> 0 THEN
           (w_sy - ((w_n * w_sxy - w_sx * w_sy) / (w_n * w_sxx - w_sx * w_sx)) * w_sx) / w_n
           + ((w_n * w_sxy - w_sx * w_sy) / (w_n * w_sxx - w_sx * w_sx)) * gx
         ELSE w_sy / w_n END AS y_hat
  FROM s WHERE w_n > 0"""), rounded=["x", "y_hat"], digits=6)
def q_local_trend(spark, sf):
    """Binned tricube local line of arr_delay on distance, 100 points."""
    return stats.local_trend(flights(spark, sf), "distance", "arr_delay", 100, 0.3, 1000)
