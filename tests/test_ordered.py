"""Order statistics, samples, lags, clusters and tails under repeated keys, hot
values, narrow columns and different partitionings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkstats.functions import dist
from sparkstats.operators import cluster, encode, linear, logistic, ordered, relate, sampling, stats


@pytest.fixture(scope="module")
def repeated(spark):
    """400 rows, each key twice, the two rows of a key unlike."""
    rng = np.random.default_rng(4)
    rows = [(f"k{i // 2:03d}", float(x), float(2 * x + e), i % 3) for i, (x, e) in enumerate(zip(rng.normal(size=400), rng.normal(size=400)))]
    return spark.createDataFrame(rows, "key string, x double, y double, label int")


def test_narrow_and_wide_columns_together(spark):
    rng = np.random.default_rng(1)
    narrow, wide = 5 + 1e-9 * rng.integers(0, 50, 5000), 10.0 ** rng.uniform(-5, 9, 5000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(narrow, wide)], "narrow double, wide double").repartition(5)
    got = {r["column"]: [r.a, r.b, r.c] for r in ordered.multi_quantiles(df, ["narrow", "wide"], [0.1, 0.5, 0.99], ["a", "b", "c"]).collect()}
    assert np.allclose(got["narrow"], np.quantile(narrow, [0.1, 0.5, 0.99]), rtol=0, atol=1e-15)
    assert np.allclose(got["wide"], np.quantile(wide, [0.1, 0.5, 0.99]), rtol=1e-12)


def test_quantiles_of_a_hot_value(spark):
    x = [7.0] * 3000 + [float(i) for i in range(100)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    r = ordered.quantiles_wide(df, "x", [0.01, 0.5, 0.999], ["a", "b", "c"]).first()
    assert np.allclose([r.a, r.b, r.c], np.quantile(x, [0.01, 0.5, 0.999]))


@pytest.mark.parametrize("n", [1, 10, 105, 399, 400, 500])
def test_samples_have_exactly_n_rows(repeated, n):
    got = [sorted(map(tuple, sampling.sample_exact(repeated.repartition(p), n, "key").collect())) for p in (1, 3, 7)]
    assert len(got[0]) == min(n, 400) and got[0] == got[1] == got[2]


def test_split_keeps_ratios_and_does_not_depend_on_partitions(repeated):
    got = [sorted(map(tuple, sampling.stratified_split(repeated.repartition(p), "label", "key").collect())) for p in (1, 3, 7)]
    assert got[0] == got[1] == got[2]
    for label in range(3):
        rows = [r for r in got[0] if r[0] == label or r[3] == label]
        assert sum(r[-1] for r in rows) == math.floor(len(rows) * 0.8 + 0.5)


def test_durbin_watson_with_repeated_keys(repeated):
    got = []
    for p in (1, 3, 7):
        data = repeated.repartition(p)
        res, _ = linear.ols(data, "y", ["x"])
        got.append(linear.durbin_watson(data, res, "y", "key")["dw"])
    assert np.allclose(got, got[0], rtol=1e-12)
    res, _ = linear.ols(repeated, "y", ["x"])
    rows = sorted((r.key, 1.0, r.x, r.y - res.coef[0] - res.coef[1] * r.x) for r in repeated.collect())
    e = np.array([r[-1] for r in rows])
    assert np.isclose(got[0], (np.diff(e) ** 2).sum() / (e ** 2).sum())


def test_kmeans_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [tuple(map(float, c + rng.normal(size=4))) for c in ([0] * 4, [6] * 4, [0, 8, 0, 8], [9, 0, 9, 0]) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cluster.CLUSTER_FEATURES))
    got = []
    for p in (1, 2, 7):
        out = cluster.kmeans_tiers(df.repartition(p), n_init=2)
        got.append(sorted((r.cluster, round(r.dep_delay, 9), round(r._cost, 6)) for r in out.collect()))
    assert got[0] == got[1] == got[2]
    sizes = np.bincount([r[0] for r in got[0]])
    assert sorted(sizes) == [300] * 4


def _points(df, cols):
    return cluster.weighted_points(df, cols, {c: (0.0, 1.0) for c in cols})


def test_kmeans_starts_weigh_copies(spark):
    """Points of very many copies are one candidate each; every one of them is found."""
    df = spark.range(6 * 2500).selectExpr("CAST(id % 6 AS DOUBLE) AS a", "CAST(id % 6 AS DOUBLE) AS b")
    points = _points(df, ["a", "b"])
    assert points.count() == 6
    centres = cluster.starting_centres(points, 6, 2, 42)
    assert [sorted(c[:, 0]) for c in centres] == [[0, 1, 2, 3, 4, 5]] * 2
    with pytest.raises(ValueError, match="6 distinct points"):
        cluster.starting_centres(points, 7, 2, 42)


def test_kmeans_starts_see_rare_clusters(spark):
    """A far cluster of 5 in 20,000 rows gets a start, whatever the partitioning."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(20_000, 2)), [500.0, 500.0] + 0.1 * rng.normal(size=(5, 2))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = [cluster.starting_centres(_points(df.repartition(p), ["a", "b"]), 3, 3, 1) for p in (1, 6)]
    assert np.array_equal(got[0], got[1])
    assert all((np.linalg.norm(c - 500, axis=1) < 1).sum() == 1 for c in got[0])


def test_lloyd_steps_match_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 2))
    start = np.array([[[0.0, 0.0], [1.0, 1.0], [-1.0, 1.0]], [[2.0, 0.0], [1.0, -1.0], [50.0, 50.0]]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [tuple(map(float, x[0]))] * 30, "a double, b double")
    x = np.concatenate([x, [x[0]] * 30])
    got, cost = cluster.lloyd(_points(df, ["a", "b"]), start, 5, tol=0.0)
    for s in range(2):
        c = start[s].copy()
        for _ in range(5):
            own = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(3)])
        assert np.allclose(got[s], c) and np.isclose(cost[s], ((x[:, None] - c) ** 2).sum(2).min(1).sum())


def test_anderson_darling_with_heavy_tail(spark):
    x = np.concatenate([np.random.default_rng(2).normal(size=2000), [80, 90, 120], [0.5] * 300])
    r = stats.normality_large_n(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    n = len(z)

    def log_cdf(v):
        if v > -30:
            return math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v < 0 else math.log1p(-0.5 * math.erfc(v / math.sqrt(2)))
        return -v * v / 2 - math.log(-v) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / v ** 2 + 3 / v ** 4 - 15 / v ** 6)
    i = np.arange(1, n + 1)
    ad = -n - np.mean([(2 * k - 1) * (log_cdf(a) + log_cdf(-b)) for k, a, b in zip(i, z, z[::-1])])
    f = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    assert np.isclose(r.ad_a2, ad, rtol=1e-9)
    assert np.isclose(r.cvm_w2, ((f - (2 * i - 1) / (2 * n)) ** 2).sum() + 1 / (12 * n), rtol=1e-9)
    assert np.isclose(r.ks_d, max((i / n - f).max(), (f - (i - 1) / n).max()), rtol=1e-9)
    assert r.ad_p < 1e-6 and r.cvm_p < 1e-6


def test_shapiro_domain(spark):
    x = [float(i % 7) for i in range(6000)]
    r = stats.shapiro_wilk(spark.createDataFrame([(v,) for v in x], "x double"), "x")
    assert 0 < r["W"] < 1 and r["p_value"] is None
    small = stats.shapiro_wilk(spark.createDataFrame([(v,) for v in x[:50]], "x double"), "x")
    assert 0 < small["p_value"] < 1


def test_tails():
    assert math.isclose(dist.t_sf2(0.5, 6e12), math.erfc(0.5 / math.sqrt(2)), rel_tol=1e-6)
    assert math.isclose(dist.t_sf2(2.0, 10), 0.07338803477074039, rel_tol=1e-12)
    assert math.isclose(dist.chi2_sf(3.0, 4), math.exp(-1.5) * 2.5, rel_tol=1e-13)
    assert math.isclose(dist.f_sf(2.0, 2, 8), (1 + 2 * 2.0 / 8) ** -4, rel_tol=1e-13)
    assert dist.betainc(2, 3, 0) == 0 and dist.betainc(2, 3, 1) == 1


def test_log_cdf_column(spark):
    z = [-45.0, -31.0, -29.0, -9.0, -1.0, 0.0, 1.0, 9.0, 20.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(dist.norm_log_cdf_col("z")).collect()]
    want = [math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v < 0 and v > -37 else math.log1p(-0.5 * math.erfc(v / math.sqrt(2))) if v >= 0 else None for v in z]
    assert all(math.isclose(g, w, rel_tol=1e-8, abs_tol=1e-15) for g, w in zip(got, want) if w is not None)
    assert math.isclose(got[0], -1017.2260942, rel_tol=1e-9) and math.isclose(got[3], -43.62814911903972, rel_tol=1e-9)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(-1.5 + x @ [0.8, -0.5])))).astype(int)
    df = spark.createDataFrame([(i, int(b), float(a[0]), float(a[1])) for i, (a, b) in enumerate(zip(x, y))], "k long, y int, a double, b double")
    r = logistic.logistic_unpenalised(df, "y", ["a", "b"])
    w = np.where(y == 1, 1500 / y.sum(), 1500 / (3000 - y.sum()))
    design, beta = np.column_stack([np.ones(3000), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        info = (design * (w * p * (1 - p))[:, None]).T @ design
        beta = beta + np.linalg.solve(info, design.T @ (w * (y - p)))
    assert np.allclose([v[1] for v in r["rows"]], beta, atol=1e-4)
    assert np.allclose([v[2] for v in r["rows"]], np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-4)


def test_checked_bounds(spark):
    df = spark.createDataFrame([(f"v{i:05d}",) for i in range(encode.MAX_LEVELS + 1)], "c string")
    with pytest.raises(ValueError):
        encode.levels(df, "c")
    wide = df.withColumn("t", F.repeat(F.lit("x"), 100))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(relate.small_side(wide)) and not hinted(relate.small_side(wide, max_bytes=1000)) and not hinted(relate.small_side(wide, max_rows=10))


def test_centroid_distances_of_many_groups(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "g int, a double, b double")
    got = {(r.group_a, r.group_b): r.distance for r in stats.centroid_distances(df, "g", ["a", "b"], block=16).collect()}
    assert len(got) == 70 * 69 and all(np.isclose(d, np.linalg.norm(x[i] - x[j])) for (i, j), d in got.items())


def test_split_orders_the_rows_of_one_hash_prefix_only(spark, monkeypatch):
    """The same split as by the whole hash order, and no global order of all rows."""
    import hashlib

    from sparkstats.operators import sampling
    ordered = []
    whole = sampling.row_positions
    monkeypatch.setattr(sampling, "row_positions", lambda df, *a: (ordered.append(df.count()), whole(df, *a))[1])
    rows = [(f"k{i}", i % 3 == 0) for i in range(3000)] + [(None, True)] * 5 + [("k0", None)] * 4
    got = sampling.stratified_split(spark.createDataFrame(rows, "k string, g boolean"), "g", "k", 0.8).collect()
    md5 = lambda k: hashlib.md5(("42?" if k is None else f"42:{k}").encode()).hexdigest()
    want = []
    for g in (True, False, None):
        mine = sorted((md5(k), str(k)) for k, v in rows if v is g)
        want += [(g, k, int(i < int(0.8 * len(mine) + 0.5))) for i, (_, k) in enumerate(mine)]
    assert sorted(map(str, want)) == sorted(str((r.g, str(r.k), r.is_train)) for r in got)
    assert ordered and max(ordered) < 50


def test_packed_blocks_hold_every_number(spark):
    from sparkstats.operators.blocks import packed, unpacked
    df = spark.range(25_001).selectExpr("cast(id as double) AS a", "if(id % 7 = 0, null, -id / 3D) AS b")

    def sums(batches):
        import pyarrow as pa
        for x in unpacked(batches, 2):
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)]), "a": pa.array([float(x[:, 0].sum())]), "nan": pa.array([int((x[:, 1] != x[:, 1]).sum())])})
    r = packed(df).mapInArrow(sums, "n long, a double, nan long").groupBy().sum("n", "a", "nan").first()
    assert tuple(r) == (25_001, 25_000 * 25_001 / 2, 3572)


def test_cleaning_passes_read_no_other_columns(spark, tmp_path):
    """Rows with nulls, NaN and none: as the cleaning of an input without the stored flag, by narrower scans."""
    from sparkstats.operators import clean, encode
    nan = float("nan")
    rows = [(f"k{i}", "ABC"[i % 3], "xy"[i % 2], "yx"[i % 2], float(i % 7), float(i % 5), float(i), float(i % 4)) for i in range(200)]
    rows += [("n1", "A", "x", "y", None, None, 3.0, None), ("n2", "A", "x", "y", nan, 1.0, 3.0, 1.0), ("n3", "B", "x", "y", 1.0, 1.0, nan, 1.0),
             ("n4", "B", "x", "y", 1.0, 1.0, None, 1.0), (None, "B", "x", "y", 1.0, 1.0, 1.0, 1.0), ("n5", None, "x", "y", 1.0, 1.0, 1.0, 1.0),
             ("n6", "B", "x", "y", 1.0, 1.0, 1.0, nan), ("n7", "C", "y", "x", 1.0, None, 1.0, 0.0)]
    kinds = "flight_key string, op_unique_carrier string, origin string, dest string, dep_delay double, arr_delay double, distance double, carrier_delay double"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "t"))
    for df in (spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "t")).withColumn("dep_delay", F.lit(None).cast("double"))):
        flagged, plain = clean.load_clean(df), clean.load_clean(df, materialize_input=False)
        assert flagged.columns == plain.columns and sorted(flagged.collect()) == sorted(plain.collect())
    flagged = clean.load_clean(spark.read.parquet(str(tmp_path / "t")))
    assert flagged.count() == 202
    plan = flagged.select("origin")._jdf.queryExecution().executedPlan().toString()
    assert "flight_key" not in plan.split("ReadSchema")[1] and "distance" not in plan.split("ReadSchema")[1]
    after = encode.build_features(flagged).agg(F.avg("distance"), F.stddev_pop("distance"), F.sum("op_unique_carrier_B")).first()
    assert abs(after[0]) < 1e-9 and abs(after[1] - 1) < 1e-9 and after[2] == 67
