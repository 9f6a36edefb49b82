"""Classifier evaluation (V*): confusion tables, reports, ROC, AUC, cut-off tables.

Everything starts from grouped counts - (truth, prediction) pairs or
(score, positives, negatives) - so the row pass is one partial aggregate and
the rest runs on k x k or distinct-score tables. Cumulative sums over scores
use the bucketed prefix sums of ``ordered`` (no single-task window).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .formats import with_cell
from .ordered import prefix_sums
from .relate import matrix_pivot


def pair_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return (df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
              .groupBy(F.col(truth).alias("true_label"), F.col(pred).alias("pred_label"))
              .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, truth: str, pred: str, levels) -> DataFrame:
    """V1: true labels in rows, predicted in columns, fixed class order, 0 for empty."""
    pc = pair_counts(df, truth, pred)
    return matrix_pivot(pc, "true_label", "pred_label", levels, value="n")


def confusion_normalized(df: DataFrame, truth: str, pred: str, levels) -> DataFrame:
    """V2: row percentages of the confusion matrix."""
    pc = pair_counts(df, truth, pred)
    pc = pc.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(
        Window.partitionBy("true_label")))
    m = pc.groupBy("true_label").pivot("pred_label", list(levels)).agg(F.first("pct"))
    names = [str(v) for v in levels]
    spark = df.sparkSession
    axis = spark.range(len(levels)).select(F.element_at(
        F.array(*[F.lit(v) for v in levels]), (F.col("id") + 1).cast("int")).alias("true_label"))
    return F.broadcast(axis).join(m, "true_label", "left").na.fill(0.0, subset=names)


def per_class_counts(df: DataFrame, truth: str, pred: str, levels) -> DataFrame:
    """tp, fp, fn, support per class (fixed level list), from the pair counts."""
    pc = pair_counts(df, truth, pred)
    spark = df.sparkSession
    axis = spark.range(len(levels)).select(F.element_at(
        F.array(*[F.lit(v) for v in levels]), (F.col("id") + 1).cast("int")).alias("label"),
        F.col("id").alias("pos"))
    t = pc.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"))
    p = pc.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    d = pc.where(F.col("true_label") == F.col("pred_label")).select(
        F.col("true_label").alias("label"), F.col("n").alias("tp"))
    out = (F.broadcast(axis).join(t, "label", "left").join(p, "label", "left")
           .join(d, "label", "left").na.fill(0, subset=["support", "predicted", "tp"]))
    return out.withColumns({"fp": F.col("predicted") - F.col("tp"),
                            "fn": F.col("support") - F.col("tp")})


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def accuracy_by_class(df: DataFrame, truth: str, pred: str, levels) -> DataFrame:
    """V3: per-class correct count, support, accuracy (recall); plus an 'overall' row."""
    c = per_class_counts(df, truth, pred, levels)
    per = c.select("pos", "label", F.col("tp").alias("correct"), "support",
                   _safe_div(F.col("tp").cast("double"), F.col("support")).alias("accuracy"),
                   ((F.col("support") > 0) & (F.col("tp") == F.col("support"))
                    ).alias("perfect"))
    tot = per.agg(F.lit(len(levels)).alias("pos"), F.lit("overall").alias("label"),
                  F.sum("correct").alias("correct"), F.sum("support").alias("support"))
    tot = tot.withColumns({"accuracy": _safe_div(F.col("correct").cast("double"),
                                                 F.col("support")),
                           "perfect": F.col("correct") == F.col("support")})
    return per.unionByName(tot)


def misclassifications(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """V4: off-diagonal (true, predicted) pairs with count and % of the true class."""
    pc = pair_counts(df, truth, pred)
    pc = pc.withColumn("pct_of_true", F.col("n") * 100.0 / F.sum("n").over(
        Window.partitionBy("true_label")))
    return pc.where(F.col("true_label") != F.col("pred_label"))


def classification_report(df: DataFrame, truth: str, pred: str, levels) -> DataFrame:
    """V5: precision, recall, f1, support per class, then accuracy, macro avg and
    weighted avg rows (0 where a denominator is 0)."""
    c = per_class_counts(df, truth, pred, levels)
    tp = F.col("tp").cast("double")
    per = c.select("pos", F.col("label").cast("string").alias("label"),
                   _safe_div(tp, F.col("tp") + F.col("fp")).alias("precision"),
                   _safe_div(tp, F.col("tp") + F.col("fn")).alias("recall"),
                   F.col("support").cast("double").alias("support"), "tp")
    per = per.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall")))
    k = len(levels)
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                  F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = _safe_div(F.col("tp").cast("double"), F.col("n"))
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit(k).alias("pos"), F.lit("accuracy").alias("label"),
                 acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit(k + 1).alias("pos"), F.lit("macro avg").alias("label"),
                 F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit(k + 2).alias("pos"), F.lit("weighted avg").alias("label"),
                 _safe_div(F.col("wp"), F.col("n")).alias("precision"),
                 _safe_div(F.col("wr"), F.col("n")).alias("recall"),
                 _safe_div(F.col("wf"), F.col("n")).alias("f1"),
                 F.col("n").alias("support")))).alias("_r")).select("_r.*")
    return per.select("pos", "label", "precision", "recall", "f1", "support").unionByName(
        summary)


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score; label 1 = positive."""
    return (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
              .groupBy(F.col(score).cast("double").alias("score"))
              .agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"),
                   F.sum((F.col(label) != 1).cast("long")).alias("neg")))


def binned_scores(df: DataFrame, label: str, score: str, bins: int = 1000) -> DataFrame:
    """(score, pos, neg) per bin of scores, ``score`` the bin's least one: bins lie between quantiles
    of a mergeable sketch (one aggregate, no sort), so a bin has about 1 / ``bins`` of the
    rows, or is one heavy score. The table has ``bins`` + 1 rows at most."""
    x = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    x = x.select(F.col(label).alias("label"), F.col(score).cast("double").alias("score"))
    cuts = x.agg(F.percentile_approx("score", [i / bins for i in range(bins)], 20 * bins)).first()[0] or []
    cuts = sorted(set(cuts))  # ``bins`` numbers
    return (with_cell(x, "score", "bin", cuts).groupBy("bin").agg(F.min("score").alias("score"), F.sum((F.col("label") == 1).cast("long")).alias("pos"),
                                           F.sum((F.col("label") != 1).cast("long")).alias("neg")).drop("bin"))


def _score_table(df: DataFrame, label: str, score: str, method: str, bins: int) -> DataFrame:
    if method not in ("exact", "sketch"):
        raise ValueError(f"method is exact or sketch, not {method}")
    return score_counts(df, label, score) if method == "exact" else materialize(binned_scores(df, label, score, bins), "score_bins")


def roc_curve(df: DataFrame, label: str, score: str, method: str = "exact", bins: int = 1000) -> DataFrame:
    """V6: (threshold, fpr, tpr) for each distinct score (``method`` "sketch": for each bin's least
    one, where the point is exact), predicting positive when score >= threshold; plus
    the (inf, 0, 0) start point."""
    sc = _score_table(df, label, score, method, bins)
    r = prefix_sums(sc, [], "score", ["pos", "neg"])
    # positives with score >= threshold = total - those strictly below
    tpr = (F.col("pos_total") - F.col("pos_before")) / F.col("pos_total")
    fpr = (F.col("neg_total") - F.col("neg_before")) / F.col("neg_total")
    pts = r.select(F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    start = pts.limit(1).select(F.lit(float("inf")).alias("threshold"),
                                F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def auc(df: DataFrame, label: str, score: str, method: str = "exact", bins: int = 1000) -> DataFrame:
    """V7: area under the ROC curve = P(score_pos > score_neg) + 0.5 P(tie). ``method`` "sketch" counts
    rows of one bin as ties and adds ``error``, half the share of pairs within a bin, a bound of what
    that can change."""
    sc = _score_table(df, label, score, method, bins)
    r = prefix_sums(sc, [], "score", ["neg"])
    part = F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))
    pairs = F.sum("pos") * F.first("neg_total")
    more = [(F.sum(0.5 * F.col("pos") * F.col("neg")) / pairs).alias("error")] if method == "sketch" else []
    return r.agg((F.sum(part) / pairs).alias("auc"),
                 F.sum("pos").alias("n_pos"), F.first("neg_total").alias("n_neg"), *more)


def class_table(df: DataFrame, label: str, score: str, cutoffs) -> DataFrame:
    """V8: at each cut-off (event predicted when score >= cut-off): correct and
    incorrect events / non-events, sensitivity, specificity, percent correct.

    Distinct scores are counted first; each then carries one flag per cut-off
    (a fixed-length array), so no join with the cut-off list is needed.
    """
    sc = score_counts(df, label, score)
    cut = F.array(*[F.lit(float(c)) for c in cutoffs])
    x = sc.select("score", "pos", "neg", F.posexplode(cut).alias("_i", "cutoff"))
    ev = F.col("score") >= F.col("cutoff")
    g = x.groupBy("_i", "cutoff").agg(
        F.sum(F.when(ev, F.col("pos")).otherwise(0)).alias("correct_events"),
        F.sum(F.when(~ev, F.col("neg")).otherwise(0)).alias("correct_nonevents"),
        F.sum(F.when(ev, F.col("neg")).otherwise(0)).alias("incorrect_events"),
        F.sum(F.when(~ev, F.col("pos")).otherwise(0)).alias("incorrect_nonevents"))
    p = F.col("correct_events") + F.col("incorrect_nonevents")
    n = F.col("correct_nonevents") + F.col("incorrect_events")
    return g.withColumns({
        "sensitivity": _safe_div(F.col("correct_events") * 100.0, p),
        "specificity": _safe_div(F.col("correct_nonevents") * 100.0, n),
        "pct_correct": _safe_div((F.col("correct_events") + F.col("correct_nonevents")) * 100.0,
                                 p + n)}).drop("_i")
