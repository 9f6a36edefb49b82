"""One typed store for every fitted model, and its application to later data.

A stored version of a model is two Parquet tables: ``model`` (one row: kind, layout
version, features in order, label and its type, classes, fingerprint of the fitted
data, named arrays) and ``levels`` (an encoder's values and codes, of any number, which
never pass through the driver). Both are written into a folder of their own beside
the versions and then published by one rename, so a reader sees a whole version or
none; a writer that loses the race for a number takes the next one.

``load`` gives the newest version, or None if the fingerprint asked for is not
the stored one; ``apply`` adds the model's columns to a table. A wrong kind, an
unknown layout or a missing feature raises.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster, discrim, encode, linear, logistic
from .relate import small_side

LAYOUT = 1
MODEL = ("kind string, layout int, features array<string>, label string, label_type string, classes array<string>, "
         "fingerprint string, arrays map<string,struct<shape:array<int>,values:array<double>>>, texts map<string,string>")
LEVELS = "feature string, value string, value_type string, code long"


@dataclass
class Model:
    """A fitted model in its stored form."""
    kind: str
    features: list
    arrays: dict = field(default_factory=dict)   # name -> numpy array
    label: str | None = None
    label_type: str | None = None
    classes: list = field(default_factory=list)  # as strings; label_type has their type
    fingerprint: str = ""
    texts: dict = field(default_factory=dict)
    levels: DataFrame | None = None              # LEVELS
    version: int = 0


# --- files ------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending; empty if the folder is absent."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(m[1]) for m in (re.fullmatch(r"v(\d+)", n) for n in names) if m)


def save(spark: SparkSession, path: str, model: Model) -> int:
    """Publish ``model`` as the next version below ``path``; its number."""
    aside = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    arrays = {k: ([int(n) for n in np.shape(v)], [float(x) for x in np.ravel(v)]) for k, v in model.arrays.items()}
    row = (model.kind, LAYOUT, list(model.features), model.label, model.label_type, [str(c) for c in model.classes],
           model.fingerprint, arrays, dict(model.texts))
    spark.createDataFrame([row], MODEL).coalesce(1).write.parquet(f"{aside}/model")
    levels = model.levels if model.levels is not None else spark.createDataFrame([], LEVELS)
    levels.select("feature", "value", "value_type", F.col("code").cast("long").alias("code")).write.parquet(f"{aside}/levels")
    fs, source = _fs(spark, aside)
    number = max(versions(spark, path), default=0)
    while True:
        number += 1
        target = _fs(spark, f"{path.rstrip('/')}/v{number}")[1]
        if fs.exists(target):
            continue
        if not fs.rename(source, target):
            if not fs.exists(source):
                raise IOError(f"{aside} is gone")
            continue
        inside = _fs(spark, f"{target.toString()}/{source.getName()}")[1]
        if not fs.exists(inside):
            return number
        source = inside  # another writer was first, and the rename went into its folder


def load(spark: SparkSession, path: str, kind: str | None = None, fingerprint: str | None = None,
         version: int | None = None) -> Model | None:
    """The newest (or the given) version; None if there is none, or if it was fitted on other data."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    number = known[-1] if version is None else version
    row = spark.read.schema(MODEL).parquet(f"{path.rstrip('/')}/v{number}/model").first()
    if row["layout"] != LAYOUT:
        raise ValueError(f"{path} v{number} has layout {row['layout']}, this library reads {LAYOUT}")
    if kind is not None and row["kind"] != kind:
        raise ValueError(f"{path} v{number} holds a {row['kind']} model, not {kind}")
    if fingerprint is not None and row["fingerprint"] != fingerprint:
        return None
    arrays = {k: np.array(v["values"], float).reshape(v["shape"]) for k, v in row["arrays"].items()}
    return Model(row["kind"], list(row["features"]), arrays, row["label"], row["label_type"], list(row["classes"]),
                 row["fingerprint"], dict(row["texts"]), spark.read.schema(LEVELS).parquet(f"{path.rstrip('/')}/v{number}/levels"), number)


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[], Model], fingerprint: str = "") -> Model:
    """The stored model if it was fitted on data of this fingerprint; else fit, store and load it."""
    found = load(spark, path, fingerprint=fingerprint)
    if found is None:
        model = fit()
        model.fingerprint = fingerprint
        found = load(spark, path, version=save(spark, path, model))
    return found


def data_fingerprint(df: DataFrame, columns: list) -> str:
    """Columns with their types, row count and an order-free content hash of a fit's input."""
    types = dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return "|".join([",".join(f"{c}:{types[c]}" for c in columns), str(row[0]), str(row[1])])


# --- the kinds ----------------------------------------------------------------------

def of_scaler(table: dict) -> Model:
    """From ``encode.scaler_table``."""
    cols = list(table)
    return Model("scaler", cols, {"mean": np.array([np.nan if table[c][0] is None else table[c][0] for c in cols], float),
                                  "std": np.array([table[c][1] for c in cols], float)})


def scaler(model: Model) -> dict:
    return {c: (None if np.isnan(m) else float(m), float(s)) for c, m, s in zip(model.features, model.arrays["mean"], model.arrays["std"])}


def _level_rows(codes: DataFrame, col: str, kind: str) -> DataFrame:
    return codes.select(F.lit(col).alias("feature"), F.col(col).cast("string").alias("value"),
                        F.lit(kind).alias("value_type"), F.col("code").cast("long").alias("code"))


def of_label_encoder(df: DataFrame, cols: list) -> Model:
    """Codes of every column in string order."""
    types, levels = dict(df.dtypes), None
    for c in cols:
        rows = _level_rows(encode.label_codes(df, c), c, types[c])
        levels = rows if levels is None else levels.unionByName(rows)
    return Model("label_encoder", list(cols), levels=levels)


def of_one_hot(df: DataFrame, cols: list, drop_first: bool = True) -> Model:
    """Levels of every column in string order; the first one has no column if ``drop_first``."""
    model = of_label_encoder(df, cols)
    model.kind, model.texts = "one_hot", {"drop_first": str(drop_first).lower()}
    return model


def of_ols(res: linear.OLSResult, label: str) -> Model:
    """M6 - M9: coefficients with what standard errors of predictions need."""
    return Model("ols", list(res.terms[1:]), {"coef": res.coef, "se": res.se, "xtx_inv": res.xtx_inv,
                                              "fit": np.array([res.n, res.k, res.sse, res.sst, res.sigma])}, label, "double")


def of_logistic(features: list, coef, intercept: float, label: str, threshold: float = 0.5,
                scale: dict | None = None) -> Model:
    """M3, M4: coefficients, threshold and, where the fit ran on scaled features, their scaler."""
    arrays = {"coef": np.asarray(coef, float), "intercept": np.array([intercept]), "threshold": np.array([threshold])}
    if scale:
        arrays |= {"mean": np.array([scale[c][0] for c in features], float), "std": np.array([scale[c][1] for c in features], float)}
    return Model("logistic", list(features), arrays, label, "int", ["0", "1"])


def of_kmeans(fit: cluster.KMeansFit) -> Model:
    """M1, M2: scaler, centres of the scaled features and the tier of each centre."""
    return Model("kmeans", list(fit.features), {"mean": fit.mean, "std": fit.std, "centres": fit.centres,
                                                "tiers": np.asarray(fit.tiers, float), "cost": np.array([fit.cost])})


def kmeans(model: Model) -> cluster.KMeansFit:
    a = model.arrays
    return cluster.KMeansFit(list(model.features), a["mean"], a["std"], a["centres"], [int(t) for t in a["tiers"]], float(a["cost"][0]))


def of_lda(model: discrim.LDAModel, label: str) -> Model:
    """The discriminant model."""
    names = ("priors", "means", "xbar", "scalings", "coef", "intercept", "explained_variance_ratio")
    return Model("lda", list(model.features), {n: getattr(model, n) for n in names} | {"n": np.array([model.n])}, label,
                 discrim._class_type(model.classes), model.classes)


def lda(model: Model) -> discrim.LDAModel:
    read = {"boolean": lambda c: c == "True", "long": int, "double": float, "string": str}[model.label_type]
    a = model.arrays
    return discrim.LDAModel(list(model.features), [read(c) for c in model.classes], a["priors"], a["means"], a["xbar"], a["scalings"],
                            a["coef"], a["intercept"], a["explained_variance_ratio"], int(a["n"][0]))


# --- application ----------------------------------------------------------------------

def _linear(model: Model, coef: np.ndarray, intercept: float, scaled: bool = False) -> Column:
    out = F.lit(float(intercept))
    for i, (f, b) in enumerate(zip(model.features, coef)):
        x = F.col(f"`{f}`").cast("double")
        if scaled:
            x = (x - float(model.arrays["mean"][i])) / float(model.arrays["std"][i])
        out = out + x * float(b)
    return out


def _codes(df: DataFrame, model: Model, out: Callable[[str], str]) -> DataFrame:
    """Adds a code column per feature by one join each; unknown and null values get null."""
    for c in model.features:
        enc = small_side(model.levels.where(F.col("feature") == c).select(F.col("value").alias("_lv"), F.col("code").alias("_code")))
        df = df.join(enc, F.col(c).cast("string") == F.col("_lv"), "left").withColumn(out(c), F.col("_code")).drop("_lv", "_code")
    return df


def one_hot_columns(model: Model) -> dict[str, list[str]]:
    """Per feature the levels that have a column; a schema, so it is collected (and refused beyond ``encode.MAX_LEVELS``)."""
    first = 1 if model.texts["drop_first"] == "true" else 0
    out = {}
    for c in model.features:
        rows = model.levels.where((F.col("feature") == c) & (F.col("code") >= first)).limit(encode.MAX_LEVELS + 1).collect()
        if len(rows) > encode.MAX_LEVELS:
            raise ValueError(f"{c} has more than {encode.MAX_LEVELS} levels")
        out[c] = [r["value"] for r in sorted(rows, key=lambda r: r["code"])]
    return out


def apply(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with the model's result: scaled or encoded columns in place, or ``predicted`` (ols, lda), ``prob``
    and ``pred`` (logistic), ``cluster`` (kmeans). Rows with a null feature get null."""
    lacking = [f for f in model.features if f not in df.columns]
    if lacking:
        raise ValueError(f"the {model.kind} model needs the columns {lacking}")
    if model.kind == "scaler":
        return encode.apply_scaler(df, scaler(model), model.features)
    if model.kind == "label_encoder":
        return _codes(df, model, lambda c: c)
    if model.kind == "one_hot":
        for c, values in one_hot_columns(model).items():
            df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)) for v in values}).drop(c)
        return df
    if model.kind == "ols":
        return df.withColumn("predicted", _linear(model, model.arrays["coef"][1:], model.arrays["coef"][0]))
    if model.kind == "logistic":
        eta = _linear(model, model.arrays["coef"], model.arrays["intercept"][0], "mean" in model.arrays)
        prob = F.col("prob")
        return df.withColumn("prob", 1.0 / (1.0 + F.exp(-eta))).withColumn("pred", (prob >= float(model.arrays["threshold"][0])).cast("int"))
    if model.kind == "kmeans":
        return df.withColumn("cluster", kmeans(model).tier())
    if model.kind == "lda":
        whole = F.lit(True)
        for f in model.features:
            whole = whole & F.col(f).isNotNull()
        out = discrim.lda_predict(df, lda(model))
        return out.withColumn("predicted", F.when(whole, F.col("predicted")).cast(model.label_type))
    raise ValueError(f"unknown kind {model.kind}")
