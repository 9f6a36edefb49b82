"""Published numbers of the country-indicator chain, for anyone who has the files:
set COUNTRY_DATA_DIR to their folder (without it these tests are shown as skipped; the
same operators are checked on generated files in test_country_chain.py)."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkstats.operators import discrim, evaluate, stats
from sparkstats.plans import country

DATA = os.environ.get("COUNTRY_DATA_DIR", "")
pytestmark = pytest.mark.skipif(not DATA, reason="COUNTRY_DATA_DIR is not set")


@pytest.fixture(scope="module")
def merged(spark):
    return country.merge_indicators(spark, DATA).cache()


def test_merge_and_clean_counts(merged):
    assert merged.count() == 252
    nulls = merged.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in
                         [*country.INDICATOR_COLS, "Income group"]]).first()
    assert [nulls[c] for c in [*country.INDICATOR_COLS, "Income group"]] == [8, 30, 38, 0, 75, 43]
    assert merged.dropna().count() == 112


def test_group_counts_and_scaling(merged):
    p = country.processed(merged)
    counts = {r[0]: r[1] for r in p.groupBy("Income_group_encoded").count().collect()}
    assert [counts[i] for i in range(4)] == [3, 23, 35, 51]
    sd = p.agg(*[F.stddev_samp(c) for c in country.INDICATOR_COLS]).first()
    assert all(abs(v - 1.004494) < 1e-6 for v in sd)


def test_vif_and_high_corr(merged):
    p = country.processed(merged)
    v = {r["feature"]: r["vif"] for r in stats.vif(p, country.INDICATOR_COLS).collect()}
    want = [2.157828, 1.136914, 1.060527, 2.733621, 2.178769]
    assert np.allclose([v[c] for c in country.INDICATOR_COLS], want, atol=1e-6)
    pairs = stats.high_corr_pairs(stats.corr_long(p, country.INDICATOR_COLS), 0.7).collect()
    assert len(pairs) == 1 and abs(pairs[0]["r"] - 0.706) < 5e-4


def test_shapiro_wilk(merged):
    p = country.processed(merged)
    got = [stats.shapiro_wilk(p, c)["W"] for c in country.INDICATOR_COLS]
    assert np.allclose(got, [0.781000, 0.786610, 0.385227, 0.950313, 0.941898], atol=1e-6)


def test_covariance_distance(merged):
    clean = merged.dropna()
    cov = stats.group_covariance(clean, country.INDICATOR_COLS, "Income group")
    d = stats.cov_frobenius(cov, "Income group").collect()
    assert len(d) == 6
    assert abs(d[0]["mean_distance"] - 363514182.948) < 1e-2


def test_lda_golden(merged):
    p = country.processed(merged)
    m = discrim.lda_fit(p, "Income_group_encoded", country.INDICATOR_COLS)
    assert np.allclose(m.explained_variance_ratio[:2], [0.9252, 0.0702], atol=5e-5)
    pred = discrim.lda_predict(p, m)
    cm = evaluate.confusion_matrix(pred, "Income_group_encoded", "predicted", [0, 1, 2, 3])
    rows = {r["true_label"]: [r[str(i)] for i in range(4)] for r in cm.collect()}
    assert [rows[i] for i in range(4)] == [[3, 0, 0, 0], [3, 8, 12, 0], [0, 4, 31, 0],
                                           [0, 0, 7, 44]]
    rep = {r["label"]: r for r in
           evaluate.classification_report(pred, "Income_group_encoded", "predicted",
                                          [0, 1, 2, 3]).collect()}
    assert abs(rep["accuracy"]["f1"] - 0.7679) < 5e-5
    assert abs(rep["macro avg"]["f1"] - 0.6949) < 5e-5
    assert abs(rep["weighted avg"]["f1"] - 0.7615) < 5e-5
    imp = {r["feature"]: r["mean_abs_coef"] for r in
           discrim.importance(discrim.coefficients_table(p.sparkSession, m)).collect()}
    assert abs(imp["School_enrollment"] - 2.1128) < 5e-4
    assert abs(imp["Inflation_CPI"] - 0.3519) < 5e-4
