"""Stored models, nearest-neighbour trends, format tables, sparse designs, sketches, rank-span
sums, binned densities, aliased terms, exact small-sample tests, and nulls, NaN and
constants in the statistics, each against numpy or DuckDB."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkstats.functions import dist, labels
from sparkstats.operators import (blocks, cluster, discrim, encode, evaluate, formats, linear, local, logistic, model_store, ordered,
                                  sampling, sparse, stats)

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAN = float("nan")


# --- stored models ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=600), rng.normal(size=600) * 40 + 3
    c = [None if i % 17 == 0 else "xyzw"[i % 4] for i in range(600)]
    y = 2 * a - 0.1 * b + rng.normal(size=600)
    frame = pd.DataFrame({"k": np.arange(600), "a": a, "b": b, "c": c, "y": y, "hit": (y > 0).astype(int)})
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.createDataFrame(frame, "k long, a double, b double, c string, y double, hit int").write.parquet(path)
    return spark.read.parquet(path)


def _fitted(rows):
    scale = encode.scaler_table(rows, ["a", "b"], 1)
    res, _ = linear.ols(rows, "y", ["a", "b"])
    weights, _ = logistic.class_weights(rows, "hit")
    lr = logistic.newton(encode.apply_scaler(rows, scale, ["a", "b"]), "hit", ["a", "b"], weights, 1.0)
    km = cluster.fit_kmeans(rows, ["a", "b"], 3, 2, rank_by="y")
    lda = discrim.lda_fit(rows, "hit", ["a", "b"])
    return {"scaler": model_store.of_scaler(scale), "label_encoder": model_store.of_label_encoder(rows, ["c"]),
            "one_hot": model_store.of_one_hot(rows, ["c"]), "ols": model_store.of_ols(res, "y"),
            "logistic": model_store.of_logistic(["a", "b"], lr.coef[1:], lr.coef[0], "hit", scale=scale),
            "kmeans": model_store.of_kmeans(km), "lda": model_store.of_lda(lda, "hit")}


def _same(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_every_kind_scores_alike_after_the_store(spark, rows, tmp_path):
    models = _fitted(rows)
    for kind, model in models.items():
        path = str(tmp_path / kind)
        assert model_store.load(spark, path) is None
        assert model_store.save(spark, path, model) == 1
        loaded = model_store.load(spark, path, kind=kind)
        assert _same(model_store.apply(rows, loaded)) == _same(model_store.apply(rows, model)), kind
        with pytest.raises(ValueError, match="not other"):
            model_store.load(spark, path, kind="other")
        with pytest.raises(ValueError, match="needs the columns"):
            model_store.apply(rows.drop("a", "c"), loaded)
    # against the operators that fitted them
    scaled = encode.standard_scale(rows, ["a", "b"], 1)
    assert _same(model_store.apply(rows, models["scaler"])) == _same(scaled)
    assert _same(model_store.apply(rows, models["label_encoder"]).select("k", "c")) == _same(encode.label_encode(rows, ["c"]).select("k", "c"))
    hot = encode.one_hot(rows, ["c"])
    assert _same(model_store.apply(rows, models["one_hot"]).select(hot.columns)) == _same(hot)


def test_label_types_survive(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float(i % 7), float(i * i % 11)) for i in range(90)], "g long, a double, b double")
    for cast, kind in (("long", int), ("string", str), ("double", float), ("boolean", bool)):
        d = df.where("g < 2").withColumn("g", F.col("g").cast(cast)) if cast == "boolean" else df.withColumn("g", F.col("g").cast(cast))
        path = str(tmp_path / cast)
        model_store.save(spark, path, model_store.of_lda(discrim.lda_fit(d, "g", ["a", "b"]), "g"))
        loaded = model_store.load(spark, path)
        assert all(type(c) is kind for c in model_store.lda(loaded).classes)
        assert model_store.apply(d, loaded).schema["predicted"].dataType == d.schema["g"].dataType


def test_changed_input_is_fitted_again(spark, rows, tmp_path):
    path, fits = str(tmp_path / "m"), []

    def run(df):
        def fit():
            fits.append(1)
            return model_store.of_scaler(encode.scaler_table(df, ["a"]))
        return model_store.load_or_fit(spark, path, fit, model_store.data_fingerprint(df, ["a"]))

    assert [run(rows).version, run(rows).version, len(fits)] == [1, 1, 1]
    assert run(rows.repartition(5)).version == 1  # order is no change
    other = rows.withColumn("a", F.when(F.col("k") == 3, F.col("a") + 1e-9).otherwise(F.col("a")))
    assert run(other).version == 2 and len(fits) == 2
    assert model_store.data_fingerprint(rows, ["a"]) != model_store.data_fingerprint(rows.withColumn("a", F.col("a").cast("float")), ["a"])
    assert model_store.versions(spark, path) == [1, 2]
    assert model_store.load(spark, path, version=1).fingerprint != model_store.load(spark, path).fingerprint


def test_versions_are_whole_or_absent(spark, rows, tmp_path):
    """Another writer's version is kept, and an unfinished one is never seen."""
    path = str(tmp_path / "m")
    model = model_store.of_scaler(encode.scaler_table(rows, ["a"]))
    assert [model_store.save(spark, path, model) for _ in range(3)] == [1, 2, 3]
    os.makedirs(f"{path}/_writing-x/model")
    os.makedirs(f"{path}/v4/foreign")
    assert model_store.save(spark, path, model) == 5
    assert sorted(os.listdir(f"{path}/v4")) == ["foreign"]
    assert model_store.load(spark, path, version=2).kind == "scaler"
    assert not [n for n in os.listdir(path) if n.startswith("_writing") and n != "_writing-x"]


def test_stored_in_one_process_scored_in_another(spark, rows, tmp_path):
    for kind, model in _fitted(rows).items():
        model_store.save(spark, str(tmp_path / kind), model)
    want = {kind: model_store.apply(rows, model_store.load(spark, str(tmp_path / kind))) for kind in ("ols", "logistic", "kmeans")}
    want = [round(want["ols"].agg(F.sum("predicted")).first()[0], 6), round(want["logistic"].agg(F.sum("prob")).first()[0], 6),
            want["kmeans"].agg(F.sum("cluster")).first()[0]]
    rows.write.parquet(str(tmp_path / "rows"))
    code = f"""
from pyspark.sql import functions as F
from sparkstats.session import local_session
from sparkstats.operators import model_store
s = local_session(1)
rows = s.read.parquet({str(tmp_path / 'rows')!r})
out = {{k: model_store.apply(rows, model_store.load(s, {str(tmp_path)!r} + '/' + k)) for k in ('ols', 'logistic', 'kmeans')}}
print('SUMS', [round(out['ols'].agg(F.sum('predicted')).first()[0], 6), round(out['logistic'].agg(F.sum('prob')).first()[0], 6), out['kmeans'].agg(F.sum('cluster')).first()[0]])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert f"SUMS {want}" in out.stdout, out.stdout + out.stderr[-500:]


# --- nearest-neighbour trend ---------------------------------------------------------------

def brute_trend(x, y, k):
    out = {}
    for g in np.unique(x):
        d = x - g
        h = np.sort(np.abs(d))[min(k, len(x)) - 1]
        w = np.clip(1 - (np.abs(d) / h) ** 3, 0, None) ** 3 if h > 0 else (d == 0).astype(float)
        s0, s1, s2, t0, t1 = (w * v for v in (1, d, d * d, y, y * d))
        s0, s1, s2, t0, t1 = s0.sum(), s1.sum(), s2.sum(), t0.sum(), t1.sum()
        det = s0 * s2 - s1 * s1
        out[g] = ((s2 * t0 - s1 * t1) / det if det > 1e-10 * s0 * s2 else t0 / s0, h, int((x == g).sum()))
    return out


@pytest.mark.parametrize("k", [1, 2, 25, 150, 5000])
def test_nearest_trend_for_any_partitioning(spark, k):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=400).round(2), np.repeat(0.5, 130), rng.exponential(size=200), [1e6, 1e6 + 1]])
    y = np.sin(3 * x) + rng.normal(size=len(x))
    want = brute_trend(x, y, k)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(NAN, 1.0), (1.0, NAN), (None, 2.0), (3.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    for parts in (1, 3, 7):
        got = {r.x: (r.y_hat, r.reach, r.n) for r in local.nearest_trend(df, "x", "y", k, parts).collect()}
        assert got.keys() == want.keys()
        assert np.allclose([got[g] for g in want], [want[g] for g in want], rtol=1e-7, atol=1e-7)


def test_nearest_trend_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (NAN, 2.0)], "x double, y double")
    assert local.nearest_trend(df, "x", "y", 3).count() == 0
    one = local.nearest_trend(spark.createDataFrame([(2.0, 1.0), (2.0, 4.0)], "x double, y double"), "x", "y", 3).collect()
    assert [(r.x, r.n, r.y_hat, r.reach) for r in one] == [(2.0, 2, 2.5, 0.0)]


def test_nearest_trend_in_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    x, n = np.sort(rng.normal(size=300)), rng.integers(1, 5, 300).astype(float)
    sy, at = rng.normal(size=300) * n, np.arange(300)
    whole = local.smoothed(x, n, sy, at, 40)
    monkeypatch.setattr(local, "PIECE", 50)
    assert np.allclose(whole, local.smoothed(x, n, sy, at, 40), rtol=1e-12)


# --- format tables ------------------------------------------------------------------------------

def test_hundred_thousand_bands(spark, tmp_path):
    rng = np.random.default_rng(1)
    edges = np.unique(rng.exponential(size=110_000) * 1000)[:100_001]
    bands = pd.DataFrame({"lo": edges[:-1], "hi": edges[1:], "label": [f"b{i}" for i in range(100_000)]})
    bands = bands[bands.index % 7 != 3]
    values = pd.DataFrame({"v": np.concatenate([rng.exponential(size=20_000) * 1000, edges[::50], [edges[0] - 1, edges[-1] + 1], np.repeat(edges[5], 8000)])})
    bands.to_parquet(tmp_path / "bands.parquet"), values.to_parquet(tmp_path / "values.parquet")
    got = formats.range_format(spark.createDataFrame(values), "v", spark.createDataFrame(bands), "out", "none")
    got = sorted((r.v, r.out, r.n) for r in got.groupBy("v", "out").agg(F.count(F.lit(1)).alias("n")).collect())
    want = duckdb.sql(f"""SELECT v, coalesce(label, 'none'), count(*) FROM '{tmp_path}/values.parquet' LEFT JOIN '{tmp_path}/bands.parquet'
                          ON v >= lo AND v < hi GROUP BY 1, 2""").fetchall()
    assert got == sorted(want)


def test_bands_open_ends_gaps_and_odd_values(spark):
    bands = spark.createDataFrame([(None, 0.0, "below"), (0.0, 16.0, "low"), (60.0, None, "high")], "lo double, hi double, label string")
    values = [-math.inf, -5.0, 0.0, 15.9, 16.0, 59.0, 60.0, math.inf, NAN, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {str(r.v): r.out for r in formats.range_format(df, "v", bands, "out").collect()}
    assert got == {"-inf": "below", "-5.0": "below", "0.0": "low", "15.9": "low", "16.0": None, "59.0": None, "60.0": "high", "inf": "high", "nan": None, "None": None}
    got = {str(r.v): r.out for r in formats.range_format(df, "v", bands, "out", "gap").collect()}
    assert got["16.0"] == "gap" and got["None"] is None and got["nan"] is None
    # the literal bands of the library as a table
    table = spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b), c) for a, b, c in labels.DELAY_BANDS], bands.schema)
    df = spark.range(-100, 200).select(F.col("id").cast("double").alias("v"))
    both = formats.range_format(df, "v", table, "out").withColumn("same", F.col("out").eqNullSafe(labels.range_label("v")))
    assert both.where("NOT same").count() == 0 and both.count() == 300
    for bad in ([(0.0, 5.0, "a"), (4.0, 6.0, "b")], [(1.0, None, "a"), (3.0, 4.0, "b")], [(2.0, 2.0, "a")], [(2.0, 1.0, "a")]):
        with pytest.raises(ValueError, match="overlap|holds nothing"):
            formats.range_format(df, "v", spark.createDataFrame(bad, bands.schema), "out")
    assert formats.range_format(df, "v", bands.limit(0), "out", "x").where("out = 'x'").count() == 300


def test_value_format(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    table = spark.createDataFrame([("a", "first"), (None, "never")], "value string, label string")
    assert {r.c: r.out for r in formats.value_format(df, "c", table, "out", "other").collect()} == {"a": "first", "b": "other", None: None}
    with pytest.raises(ValueError, match="twice|2 times"):
        formats.value_format(df, "c", table.unionByName(table), "out")


# --- sparse designs -----------------------------------------------------------------------------------

def test_ten_thousand_levels(spark):
    rng = np.random.default_rng(3)
    n, levels = 40_000, 10_000
    g = np.concatenate([np.arange(levels), rng.integers(0, levels, n - levels)])
    x, z = rng.normal(size=n) + g % 5, rng.normal(size=n) * 1e4
    y = 3 * x - 2e-4 * z + np.sin(g) + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"g": [f"l{v:05d}" for v in g], "x": x, "z": z, "y": y}))
    table, fit = sparse.sparse_ols(df, "y", ["x", "z"], ["g"])
    got = {(r.term, r.level): r.estimate for r in table.collect()}
    assert len(got) == 3 + levels and fit.gradient < 1e-9 and fit.n == n
    sums = pd.DataFrame({"g": g, "x": x, "z": z, "y": y})
    away = sums - sums.groupby("g").transform("mean").reindex(columns=sums.columns)
    b = np.linalg.lstsq(away[["x", "z"]].to_numpy(), away["y"].to_numpy(), rcond=None)[0]
    assert np.allclose([got["x", None], got["z", None]], b, rtol=1e-8)
    means = sums.groupby("g").mean()
    a = (means["y"] - means[["x", "z"]] @ b).to_numpy()
    assert np.allclose([got["g", f"l{i:05d}"] for i in range(levels)], a - a[0], atol=1e-6)
    e = y - np.column_stack([x, z]) @ b - a[g]
    assert np.isclose(fit.sse, e @ e, rtol=1e-9)


def test_two_factors_match_dense(spark):
    rng = np.random.default_rng(8)
    rows = [(["p", "q", "r", None][rng.integers(4)], "abcde"[rng.integers(5)], float(rng.normal()), float(rng.normal())) for _ in range(500)]
    df = spark.createDataFrame(rows, "u string, v string, x double, y double")
    got = {(r.term, r.level): r.estimate for r in sparse.sparse_ols(df, "y", ["x"], ["u", "v"])[0].collect()}
    whole = [r for r in rows if r[0]]
    d = np.array([[1, r[2], r[0] == "q", r[0] == "r", *(r[1] == c for c in "bcde")] for r in whole], float)
    want = np.linalg.lstsq(d, np.array([r[3] for r in whole]), rcond=None)[0]
    keys = [("Intercept", None), ("x", None), ("u", "q"), ("u", "r"), *(("v", c) for c in "bcde")]
    assert np.allclose([got[k] for k in keys], want, atol=1e-8) and got["u", "p"] == got["v", "a"] == 0
    vec = sparse.sparse_one_hot(df, ["u", "v"])[0].select("u", "v", "one_hot.*").collect()
    for r in vec:
        assert r["size"] == 6 and len(r["indices"]) == (r.u in ("q", "r")) + (r.v != "a") == len(r["values"])
    with pytest.raises(ValueError, match="no complete rows"):
        sparse.sparse_ols(df.limit(0), "y", ["x"], ["u"])


def test_no_vector_by_level_reaches_the_driver(spark, monkeypatch):
    """3,000 levels of one feature and 4 of another, the gradient taken anew in between: as the dense fit."""
    rng = np.random.default_rng(12)
    n, levels = 6000, 3000
    u = np.concatenate([np.arange(levels), rng.integers(0, levels, n - levels)])
    v, x = rng.integers(0, 4, n), rng.normal(size=n)
    y = 2 * x + np.cos(u) - np.sin(v) + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"u": [f"u{i:04d}" for i in u], "v": [f"v{i}" for i in v], "x": x, "y": y}))
    fetched, kind = [], type(df)
    for name in ("collect", "toLocalIterator", "toPandas"):
        def counted(self, *args, _of=getattr(kind, name), **more):
            out = list(_of(self, *args, **more))
            fetched.append(len(out))
            return out
        monkeypatch.setattr(kind, name, counted)
    monkeypatch.setattr(sparse, "REFRESH", 4, raising=False)
    table, fit = sparse.sparse_ols(df, "y", ["x"], ["u", "v"])
    monkeypatch.undo()
    assert max(fetched, default=0) < 100 and fit.iterations > 4
    got = {(r.term, r.level): r.estimate for r in table.collect()}
    within = np.column_stack([x, *(v == i for i in (1, 2, 3)), y]).astype(float)
    mean = pd.DataFrame(within).groupby(u).transform("mean").to_numpy()
    b = np.linalg.lstsq((within - mean)[:, :4], (within - mean)[:, 4], rcond=None)[0]
    assert np.allclose([got["x", None], *(got["v", f"v{i}"] for i in (1, 2, 3))], b, atol=1e-8)
    a = pd.Series(y - within[:, :4] @ b).groupby(u).mean().to_numpy()
    assert np.allclose([got["u", f"u{i:04d}"] for i in range(levels)], a - a[0], atol=1e-7) and np.isclose(got["Intercept", None], a[0])
    assert np.isclose(fit.sse, np.square(y - within[:, :4] @ b - a[u]).sum(), rtol=1e-9)


# --- rank spans ------------------------------------------------------------------------------------------

def test_normal_scores_by_span(spark):
    """Sums over spans against rank by rank, ends and middle, and a value of 10^9 rows."""
    n = 200_000
    m = np.array([dist.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    spans = [(1, 30_000), (30_001, 30_001), (30_002, 30_010), (30_011, 30_040), (30_041, 199_000), (199_001, 199_990), (199_991, 200_000)]
    df = spark.createDataFrame([(float(i), a, b, n) for i, (a, b) in enumerate(spans)], "x double, first_rank long, last_rank long, n long")
    pieces = stats._normal_scores(df)
    assert pieces.count() < 600
    got = {r.x: (r.m, r.mm) for r in pieces.groupBy("x").agg(F.sum("m").alias("m"), F.sum("mm").alias("mm")).collect()}
    for i, (a, b) in enumerate(spans):
        part = m[a - 1:b]
        assert np.allclose(got[float(i)], [part.sum(), (part ** 2).sum()], rtol=1e-9, atol=1e-9), (a, b)
    big = 10 ** 9
    df = spark.createDataFrame([(0.0, 1, 5, big + 10), (1.0, 6, big + 5, big + 10), (2.0, big + 6, big + 10, big + 10)], df.schema.simpleString()[7:-1].replace(":", " "))
    total = stats._normal_scores(df).agg(F.sum("m").alias("m"), F.sum("mm").alias("mm")).first()
    assert abs(total.m) < 1e-6  # the scores are symmetric
    half = spark.createDataFrame([(0.0, 1, (big + 10) // 2, big + 10)], "x double, first_rank long, last_rank long, n long")
    assert np.isclose(2 * stats._normal_scores(half).agg(F.sum("mm")).first()[0], total.mm, rtol=1e-9)


def test_shapiro_wilk_with_a_repeated_value(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=3000), np.repeat(0.25, 1500)])
    got = stats.shapiro_wilk(spark.createDataFrame([(float(v),) for v in x] + [(NAN,), (None,)], "x double"), "x")
    n, xs = len(x), np.sort(x)
    m = np.array([dist.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = m @ m, 1 / math.sqrt(n)
    an = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(ss)], u)
    an1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ss)], u)
    phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
    a = np.concatenate([[-an, -an1], m[2:-2] / math.sqrt(phi), [an1, an]])
    assert got["n"] == n and abs(got["W"] - (a @ xs) ** 2 / ((x - x.mean()) ** 2).sum()) < 1e-9


# --- densities, sketches -----------------------------------------------------------------------------------

def test_binned_density_is_exact(spark):
    rng = np.random.default_rng(4)
    groups = {"a": np.concatenate([rng.normal(size=3000), [40.0, -25.0]]), None: rng.exponential(size=500).round(2), "c": np.array([3.0, 3.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", NAN), (None, None)]
    out = stats.kde(spark.createDataFrame(rows, "g string, x double"), "x", 64, ["g"]).collect()
    assert len(out) == 3 * 64
    for g, x in groups.items():
        got = {r.point: (r.x, r.density) for r in out if r.g == g}
        if g == "c":
            assert all(v == (3.0, 0.0) for v in got.values())
            continue
        h = len(x) ** -0.2 * x.std(ddof=1)
        at = np.linspace(x.min(), x.max(), 64)
        want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
        assert np.allclose([got[i][0] for i in range(64)], at)
        assert np.abs(np.array([got[i][1] for i in range(64)]) - want).max() < 1e-12 * want.max()


def test_sketched_quantiles(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.lognormal(size=20_000), np.repeat(1.0, 9000)])
    df = spark.createDataFrame([(i % 2 or None, float(v)) for i, v in enumerate(x)] + [(1, NAN)], "g int, x double").repartition(9)
    probs, acc = [0.001, 0.25, 0.5, 0.9, 0.999], 500
    for g, r in ((r.g, r) for r in ordered.quantiles_wide(df, "x", probs, list("abcde"), ["g"], "sketch", acc).collect()):
        own = np.sort(x[1::2] if g else x[::2])
        for p, v in zip(probs, r[1:]):
            low, high = np.searchsorted(own, v, "left"), np.searchsorted(own, v, "right")
            assert low - len(own) / acc - 1 <= p * len(own) <= high + len(own) / acc + 1
    assert ordered.multi_quantiles(df, ["x"], [0.5], ["m"], method="sketch").count() == 1
    with pytest.raises(ValueError, match="exact or sketch"):
        ordered.quantiles_wide(df, "x", probs, list("abcde"), method="other")


def test_sketched_auc(spark):
    rng = np.random.default_rng(10)
    s = rng.normal(size=20_000)
    label = (s + rng.normal(size=20_000) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"label": label, "s": s})).repartition(4)
    near, exact = evaluate.auc(df, "label", "s", "sketch", 100).first(), evaluate.auc(df, "label", "s").first()
    assert abs(near.auc - exact.auc) <= near.error < 0.01 and (near.n_pos, near.n_neg) == (exact.n_pos, exact.n_neg)
    curve = evaluate.roc_curve(df, "label", "s", "sketch", 100).collect()
    assert 90 <= len(curve) <= 103
    for r in curve:
        assert np.isclose(r.tpr, (s[label == 1] >= r.threshold).mean()) and np.isclose(r.fpr, (s[label == 0] >= r.threshold).mean())


# --- aliased terms, Durbin-Watson, logistic -----------------------------------------------------------------------

def test_redundant_classes_are_aliased(spark):
    rng = np.random.default_rng(11)
    g = rng.integers(0, 6, 400)
    x, y = rng.normal(size=400), rng.normal(size=400) + g
    frame = pd.DataFrame({"x": x, "y": y, **{f"g{i}": (g == i) * 1.0 for i in range(5)}, "h0": (g < 2) * 1.0, "h1": (g % 2 == 0) * 1.0, "flat": np.ones(400)})
    df = spark.createDataFrame(frame)
    xs = ["x", *[f"g{i}" for i in range(5)], "h0", "h1", "flat"]
    res, gm = linear.ols(df, "y", xs)
    d = np.column_stack([np.ones(400), frame[xs[:6]]])
    want, *_ = np.linalg.lstsq(d, y, rcond=None)
    e = y - d @ want
    assert res.extra["aliased"] == ["h0", "h1", "flat"] and res.k == 7
    assert np.allclose(res.coef[:7], want) and (res.coef[7:] == 0).all() and np.isnan(res.se[7:]).all()
    assert np.isclose(res.sse, e @ e) and np.allclose(res.se[:7], np.sqrt(np.diag(np.linalg.inv(d.T @ d)) * (e @ e) / 393))
    marked = {r.term: (r.aliased, r.std_err) for r in linear.coef_table(spark, res, with_aliased=True).collect()}
    assert marked["h1"] == (True, None) and marked["g0"][0] is False
    tests = {r["source"]: r for r in linear.type3_ss(gm, "y", {"x": ["x"], "g": xs[1:6], "h": ["h0", "h1"]})}
    assert tests["h"]["df"] == 0 and tests["h"]["f_value"] is None and tests["g"]["df"] == 3  # beside h, g has three contrasts
    fewer = np.column_stack([np.ones(400), x, frame[["h0", "h1"]]])
    rest = y - fewer @ np.linalg.lstsq(fewer, y, rcond=None)[0]
    assert np.isclose(tests["g"]["ss3"], rest @ rest - e @ e)


#: Published 5 % bounds for one regressor beside the intercept: n, lower, upper.
DW_BOUNDS = [(15, 1.077, 1.361), (20, 1.201, 1.411), (25, 1.288, 1.454), (30, 1.352, 1.489)]


@pytest.mark.parametrize("n,lower,upper", DW_BOUNDS)
def test_durbin_watson_bounds(n, lower, upper):
    roots = 2 * (1 - np.cos(np.pi * np.arange(1, n) / n))
    assert abs(linear.quadratic_ratio_cdf(roots[:-1], lower) - 0.05) < 4e-4
    assert abs(linear.quadratic_ratio_cdf(roots[1:], upper) - 0.05) < 4e-4


def test_durbin_watson_exact_p(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=24)
    y = 1 + x + np.cumsum(rng.normal(size=24))
    df = spark.createDataFrame([(f"k{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k string, x double, y double").repartition(3)
    res, _ = linear.ols(df, "y", ["x"])
    got = linear.durbin_watson(df, res, "y", "k")
    d = np.column_stack([np.ones(24), x])
    hat = d @ np.linalg.inv(d.T @ d) @ d.T
    e = rng.standard_normal((200_000, 24)) @ (np.eye(24) - hat)
    simulated = ((np.diff(e, axis=1) ** 2).sum(1) / (e ** 2).sum(1) <= got["dw"]).mean()
    assert abs(got["p_value"] - simulated) < 4 * math.sqrt(max(simulated, 1e-4) / 200_000) + 1e-4
    # any share of a chi-square: P(z1^2 < d (z1^2 + z2^2)) has the arc sine law
    assert np.isclose(linear.quadratic_ratio_cdf(np.array([1.0, 0.0]), 0.3), 2 / math.pi * math.asin(math.sqrt(0.3)), atol=1e-7)


def test_blocks_are_read_a_few_at_a_time(spark):
    rows = spark.range(400_000, numPartitions=1).select(*[(F.col("id") * k).cast("double").alias(f"x{k}") for k in range(1, 11)])
    table = blocks.packed(rows)
    stored = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in stored for i in range(m.num_row_groups)]
    assert sum(sizes) > 30 << 20 and max(sizes) < 12 << 20
    got = np.concatenate([np.frombuffer(r.block).reshape(-1, 10) for r in table.collect()])
    assert (got[got[:, 0].argsort()] == np.arange(400_000.0)[:, None] * np.arange(1, 11)).all()


def test_logistic_newton(spark):
    rng = np.random.default_rng(13)
    x = np.column_stack([rng.normal(size=2000), 1e4 * rng.normal(size=2000), np.zeros(2000)])
    y = (rng.random(2000) < 1 / (1 + np.exp(-(x[:, 0] - 1e-4 * x[:, 1] - 2)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1], "flat": x[:, 2]})).repartition(4).cache()
    weights, n = logistic.class_weights(df, "y")
    assert n == 2000 and np.isclose(weights[1] * y.sum(), 1000)
    for penalty in (0.0, 3.0):
        fit = logistic.newton(df, "y", ["a", "b", "flat"], weights, penalty)
        z = np.column_stack([np.ones(2000), x])
        p = 1 / (1 + np.exp(-z @ fit.coef))
        slope = z.T @ (np.where(y == 1, weights[1], weights[0]) * (p - y)) + penalty * np.r_[0, fit.coef[1:]]
        assert fit.converged and np.abs(slope / np.r_[1, 1, 1e4, 1]).max() < 1e-6 and fit.coef[3] == 0 and fit.steps < 15
    apart = spark.createDataFrame([(int(i > 5), float(i)) for i in range(12)], "y int, a double")
    assert not logistic.newton(apart, "y", ["a"], {0: 1, 1: 1}).converged or logistic.newton(apart, "y", ["a"], {0: 1, 1: 1}).loss < 1e-6
    with pytest.raises(ValueError, match="labels 0 and 1"):
        logistic.class_weights(df.where("y = 1"), "y")


def test_balanced_logistic_solves_its_equations(spark):
    """Gradient of the penalised, class-weighted loss at the fit of M3."""
    rng = np.random.default_rng(14)
    frame = pd.DataFrame({"k": [f"k{i}" for i in range(900)], "a": rng.normal(size=900), "b": rng.normal(size=900) * 9 + 4})
    frame["y"] = (frame["a"] + rng.normal(size=900) > 1.2).astype(int)
    r = logistic.logistic_balanced(spark.createDataFrame(frame), "y", "k", ["a", "b"], c=0.5)
    train = r["train"].toPandas()
    z, y = np.column_stack([np.ones(len(train)), train[["a", "b"]]]), train["y"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = np.r_[r["intercept"], r["coef"]]
    slope = z.T @ (w * (1 / (1 + np.exp(-z @ b)) - y)) + np.r_[0, b[1:]] / 0.5
    assert np.abs(slope).max() < 1e-6 and np.allclose(z[:, 1:].mean(0), 0, atol=1e-9)
    assert r["test"].count() + len(train) == 900


# --- nulls, NaN and constants ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """100 rows: null groups, null keys, a NaN, a constant column."""
    frame = [(None if i % 3 == 0 else f"g{i % 3}", None if i % 5 == 0 else i, NAN if i == 7 else float(i), 4.0, float(i * i % 13)) for i in range(100)]
    path = str(tmp_path_factory.mktemp("odd") / "t")
    spark.createDataFrame(frame, "g string, k int, x double, flat double, y double").write.parquet(path)
    return spark.read.parquet(path)


def test_samples_keep_null_keys(odd):
    assert sampling.sample_exact(odd, 90, "k").count() == 90
    assert sampling.sample_exact(odd, 95, "k").where("k IS NULL").count() >= 15
    assert sampling.hash_split(odd, "k", 0.5).where("is_train IS NULL").count() == 0
    split = sampling.stratified_split(odd, "g", "k", 0.5)
    assert {r.g: r.n for r in split.groupBy("g").agg(F.sum("is_train").alias("n")).collect()} == {None: 17, "g1": 17, "g2": 17}


def test_null_groups_are_groups(odd):
    want = {g: np.array([float(i) for i in range(100) if i != 7 and (None if i % 3 == 0 else f"g{i % 3}") == g]) for g in (None, "g1", "g2")}
    box = {r.g: r for r in stats.box_stats(odd, "x", ["g"]).collect()}
    quant = {r.g: r.m for r in ordered.quantiles_wide(odd, "x", [0.5], ["m"], ["g"]).collect()}
    hist = stats.histogram(odd, "x", 7, ["g"]).collect()
    dens = stats.kde(odd, "x", 20, ["g"]).collect()
    for g, x in want.items():
        assert box[g].n == len(x) and np.isclose(box[g].q1, np.quantile(x, 0.25)) and np.isclose(quant[g], np.median(x))
        assert [r["count"] for r in sorted((r for r in hist if r.g == g), key=lambda r: r.bin)] == np.histogram(x, 7)[0].tolist()
        assert sum(r.density > 0 for r in dens if r.g == g) == 20
    assert np.isclose(stats.histogram(odd, "x", 5).agg(F.max("bin_end")).first()[0], 99)


def test_constants_give_nulls(odd):
    r = {(r.var1, r.var2): r.r for r in stats.corr_long(odd, ["x", "flat", "y"]).collect()}
    x, y = (np.array([v for i, v in enumerate(c) if i != 7]) for c in (np.arange(100.0), np.arange(100) ** 2 % 13.0))
    assert r["x", "flat"] is None and r["flat", "y"] is None and np.isclose(r["x", "y"], np.corrcoef(x, y)[0, 1])
    v = {r.feature: r.vif for r in stats.vif(odd, ["x", "flat", "y"]).collect()}
    assert v["flat"] is None and np.isclose(v["x"], 1 / (1 - np.corrcoef(x, y)[0, 1] ** 2))
    t = stats.anova_test(odd, "flat", "g").first()
    assert t.f_stat is None and t.r2 is None and t.p_value is None
    assert stats.anova_table(odd, "x", "g").first().n == 65
    assert stats.corr_pvalues(stats.corr_long(odd, ["x", "flat"])).first().p_value is None


def test_frobenius_of_many_groups(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(40, 12, 3))
    df = spark.createDataFrame([(g, *map(float, r)) for g in range(40) for r in x[g]], "g int, a double, b double, c double")
    out = stats.cov_frobenius(stats.group_covariance(df, ["a", "b", "c"], "g"), "g", block=7).collect()
    cov = [np.cov(v.T) for v in x]
    assert len(out) == 40 * 39 // 2
    assert np.allclose([r.distance for r in out], [np.linalg.norm(cov[r.group_a] - cov[r.group_b]) for r in out])
    assert np.isclose(out[0].mean_distance, np.mean([r.distance for r in out]))
