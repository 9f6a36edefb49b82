"""E1 and M6 for any number of levels: sparse one-hot rows and least squares on them.

A row of the design holds its few numbers (an intercept of 1, then the numeric features,
centred and in units of their spread: the head) and, for each categorical feature, the number of
the one 0/1 column that is set; columns are numbered in string order of the levels. Least squares
runs as conjugate gradients on the normal equations, preconditioned by the columns' own sums of
squares. Their cells that are not 0 are summed over the rows once: a level's row count and sums of
the head, and the row counts of pairs of levels of different features. Vectors as long as
the design is wide are stored tables with a row per level: an iteration is a pass over them, and only
sums are collected. Joins may broadcast such a table while it is small; no p x p matrix exists anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .encode import label_codes, scaler_table
from .relate import small_side

#: Columns of a design: their numbers are 32-bit integers.
MAX_COLUMNS = 2**31 - 1
#: Sums taken in one aggregate, so that its generated code stays small.
SUMS = 200
#: Steps after which the gradient is taken anew from the rows.
REFRESH = 25


@dataclass
class Design:
    """Stored rows ``x0 .., c0 .., y`` (the head; for each categorical feature the column that is 1, null
    at the reference level) and what their columns mean; column 0 is the intercept."""
    rows: DataFrame
    width: int
    numeric: list
    categorical: list
    scale: dict
    levels: DataFrame        # feature, level, column (null: the reference level)
    n: int

    @property
    def head(self) -> list:
        return [f"x{i}" for i in range(1 + len(self.numeric))]

    @property
    def sets(self) -> list:
        return [f"c{i}" for i in range(len(self.categorical))]


def level_columns(df: DataFrame, cols, first: int = 0, drop_first: bool = True) -> tuple[DataFrame, int]:
    """E1 fitted: every feature's levels in string order with their column numbers from ``first``
    on (null for the first level, if dropped), stored, and the next free number."""
    table = None
    for c in cols:
        codes = materialize(label_codes(df, c).select(F.col(c).alias("level"), "code"), "level_codes")
        found = codes.count()
        column = F.when(F.col("code") >= int(drop_first), F.col("code") + (first - int(drop_first)))
        part = codes.select(F.lit(c).alias("feature"), "level", column.cast("int").alias("column"))
        table = part if table is None else table.unionByName(part)
        first += max(found - int(drop_first), 0)
    return table, first


def _set_columns(df: DataFrame, cols, levels: DataFrame) -> DataFrame:
    """``df`` with ``_c0, _c1 ..``: the column of each feature's level, null for none."""
    for i, c in enumerate(cols):
        at = small_side(levels.where(F.col("feature") == c).select(F.col("level").alias("_lv"), F.col("column").alias(f"_c{i}")))
        df = df.join(at, F.col(c).cast("string") == F.col("_lv"), "left").drop("_lv")
    return df


def sparse_one_hot(df: DataFrame, cols, drop_first: bool = True, out: str = "one_hot") -> tuple[DataFrame, DataFrame, int]:
    """E1 in sparse form: ``df`` with a struct ``out`` (size, indices, values: the 0/1 columns of
    all ``cols``), the table of levels and columns, and the size. A null or first level has no column."""
    cols = list(cols)
    levels, width = level_columns(df, cols, 0, drop_first)
    df = _set_columns(df, cols, levels)
    indices = F.array_compact(F.array(*[F.col(f"_c{i}") for i in range(len(cols))]))
    vector = F.struct(F.lit(width).alias("size"), indices.alias("indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
    return df.withColumn(out, vector).drop(*[f"_c{i}" for i in range(len(cols))]), levels, width


def design(df: DataFrame, y: str, numeric, categorical) -> Design:
    """Complete rows (no null y, number or level) as a stored sparse design with an intercept."""
    numeric, categorical = list(numeric), list(categorical)
    rows = materialize(df.select(F.col(y).cast("double").alias("_y"), *numeric, *categorical).dropna(), "sparse_input")
    scale = scaler_table(rows, numeric) if numeric else {}
    offset = 1 + len(numeric)
    levels, width = level_columns(rows, categorical, offset) if categorical else (None, offset)
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} columns, at most {MAX_COLUMNS}")
    coded = _set_columns(rows, categorical, levels)
    head = [F.lit(1.0), *[(F.col(c).cast("double") - F.lit(scale[c][0]).cast("double")) / F.lit(scale[c][1]).cast("double") for c in numeric]]
    stored = materialize(coded.select(*[x.alias(f"x{i}") for i, x in enumerate(head)],
                                      *[F.col(f"_c{i}").alias(f"c{i}") for i in range(len(categorical))], F.col("_y").alias("y")), "sparse_design")
    return Design(stored, width, numeric, categorical, scale, levels, stored.count())


def _sums(df: DataFrame, columns: dict) -> dict:
    """The sums of some columns, 0 over no rows; at most ``SUMS`` in a pass."""
    names, out = list(columns), {}
    for i in range(0, len(names), SUMS):
        out |= df.agg(*[F.coalesce(F.sum(columns[c]), F.lit(0.0)).alias(c) for c in names[i:i + SUMS]]).first().asDict()
    return out


def _dot(names: list, numbers) -> F.Column:
    """Sum of columns times numbers."""
    return sum((F.col(c) * F.lit(float(v)) for c, v in zip(names, numbers)), F.lit(0.0))


@dataclass
class NormalEquations:
    """The cells of x'x and x'y that are not 0."""
    head: np.ndarray         # head by head
    head_y: np.ndarray
    yy: float
    levels: DataFrame        # column, n (its rows), y (their sum), x0 .. (sums of the head)
    pairs: DataFrame | None  # column, other, n: rows in which both are 1, either way round


def normal_equations(d: Design) -> NormalEquations:
    """Summed over the rows: one aggregate for the head, one by level of every feature and of every two."""
    cross = {f"{i}_{j}": F.col(a) * F.col(b) for (i, a), (j, b) in combinations(enumerate([*d.head, "y"]), 2)}
    got = _sums(d.rows, cross | {f"{i}_{i}": F.col(c) * F.col(c) for i, c in enumerate([*d.head, "y"])})
    p = len(d.head)
    whole = np.array([[got[f"{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)], float)
    levels = d.rows.sparkSession.createDataFrame([], ", ".join(["column int", "n long", "y double", *[f"{x} double" for x in d.head]]))
    for c in d.sets:
        levels = levels.unionByName(d.rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("column")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[F.sum(x).alias(x) for x in d.head]))
    pairs = None
    for a, b in combinations(d.sets, 2):
        both = d.rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
        for one, other in permutations((a, b)):
            part = both.select(F.col(one).alias("column"), F.col(other).alias("other"), "n")
            pairs = part if pairs is None else pairs.unionByName(part)
    return NormalEquations(whole[:p, :p], whole[:p, p], whole[p, p], materialize(levels, "sparse_levels"),
                           None if pairs is None else materialize(pairs, "sparse_pairs"))


@dataclass
class Residuals:
    """x'e and e'e of some coefficients, taken from the rows."""
    head: np.ndarray
    levels: DataFrame        # column, e: sum over its rows
    sse: float


def residuals(d: Design, head: np.ndarray, levels: DataFrame) -> Residuals:
    """``levels``: column, b."""
    rows, fitted = d.rows, _dot(d.head, head)
    for c in d.sets:
        rows = rows.join(small_side(levels.select(F.col("column").alias("_at"), F.col("b").alias(f"_{c}"))), F.col(c) == F.col("_at"), "left").drop("_at")
        fitted = fitted + F.coalesce(F.col(f"_{c}"), F.lit(0.0))
    rows = rows.withColumn("e", F.col("y") - fitted)
    sums = [F.sum(F.col("e") * F.col(x)).alias(x) for x in d.head] + [F.sum(F.col("e") * F.col("e")).alias("ee")]
    by = d.sets[:1]
    if len(d.sets) > 1:
        rows = materialize(rows.select(*d.head, *d.sets, "e"), "sparse_residuals")
    first = materialize(rows.groupBy(*by).agg(F.sum("e").alias("e"), *sums), "sparse_gradient")
    total = _sums(first, {c: F.col(c) for c in [*d.head, "ee"]})
    parts = [first.select(F.col(c).alias("column"), "e") for c in by]
    parts += [rows.groupBy(F.col(c).alias("column")).agg(F.sum("e").alias("e")) for c in d.sets[1:]]
    at = d.rows.sparkSession.createDataFrame([], "column int, e double")
    for part in parts:
        at = at.unionByName(part.where(F.col("column").isNotNull()))
    return Residuals(np.array([total[x] for x in d.head]), at, total["ee"])


@dataclass
class SparseFit:
    """Coefficients by column (of the scaled design), and how well the normal equations hold."""
    head: np.ndarray
    levels: DataFrame        # column, b
    iterations: int
    gradient: float          # greatest |x_j'e| / (|x_j| |y - mean|)
    sse: float
    sst: float
    n: int


def least_squares(d: Design, tol: float = 1e-12, max_iter: int = 1000) -> SparseFit:
    """Least squares by preconditioned conjugate gradients; stops once the preconditioned
    gradient has fallen by ``tol``. Raises if ``max_iter`` passes do not get there."""
    if not d.n:
        raise ValueError("no complete rows")
    eq = normal_equations(d)
    diagonal = np.diag(eq.head)
    scale = np.where(diagonal > 0, diagonal, 1)
    coef, gradient = np.zeros(len(d.head)), eq.head_y
    way = gradient / scale
    # by level: its cells, the coefficient b, gradient g, direction p and the direction's image q
    at = eq.levels.select("column", "n", *d.head, F.lit(0.0).alias("b"), F.col("y").alias("g"), (F.col("y") / F.col("n")).alias("p"))
    length = {"size": F.col("g") * F.col("g") / F.col("n")}
    size = start_size = float(gradient @ way) + _sums(at, length)["size"]
    steps = 0
    while size > tol * tol * start_size and steps < max_iter:
        image = _dot(d.head, way) + F.col("n") * F.col("p")
        if eq.pairs is not None:
            across = eq.pairs.join(at.select(F.col("column").alias("other"), "p"), "other").groupBy("column").agg(F.sum(F.col("n") * F.col("p")).alias("_across"))
            at = at.join(across, "column", "left")
            image = image + F.coalesce(F.col("_across"), F.lit(0.0))
        at = materialize(at.select("column", "n", *d.head, "b", "g", "p", image.alias("q")), "sparse_vectors")
        got = _sums(at, {"pq": F.col("p") * F.col("q")} | {x: F.col("p") * F.col(x) for x in d.head})
        image = eq.head @ way + np.array([got[x] for x in d.head])
        step = size / (float(way @ image) + got["pq"])
        coef, gradient = coef + step * way, gradient - step * image
        at = at.withColumns({"b": F.col("b") + F.lit(step) * F.col("p"), "g": F.col("g") - F.lit(step) * F.col("q")})
        if steps % REFRESH == REFRESH - 1:  # the recurrence drifts: take it anew
            rest = residuals(d, coef, at.select("column", "b"))
            gradient = rest.head
            at = materialize(at.drop("g").join(rest.levels.withColumnRenamed("e", "g"), "column"), "sparse_vectors")
        pre = gradient / scale
        next_size = float(gradient @ pre) + _sums(at, length)["size"]
        way = pre + (next_size / size) * way
        at = at.withColumn("p", F.col("g") / F.col("n") + F.lit(next_size / size) * F.col("p"))
        size, steps = next_size, steps + 1
    at = materialize(at.select("column", "n", "b"), "sparse_coefficients")
    rest = residuals(d, coef, at)
    sst = max(eq.yy - eq.head_y[0] ** 2 / d.n, 0.0)
    unit = sst if sst > 0 else 1.0
    norm = np.sqrt(scale * unit) if sst > 0 else np.ones(len(d.head))
    by_level = F.abs("e") / (F.sqrt(F.col("n") * F.lit(unit)) if sst > 0 else F.lit(1.0))
    level_worst = rest.levels.join(at, "column").agg(F.max(by_level)).first()[0]
    worst = max(float(np.abs(rest.head / norm).max()), level_worst or 0.0)
    if worst > 1e-6:
        raise ValueError(f"the normal equations hold to {worst:.1e} only after {steps} steps")
    return SparseFit(coef, at.select("column", "b"), steps, worst, rest.sse, sst, d.n)


def coefficients(spark, d: Design, fit: SparseFit) -> DataFrame:
    """``term, level, estimate`` in the units of the input; a reference level has 0."""
    b = fit.head.copy()
    for i, c in enumerate(d.numeric, 1):
        b[i] /= d.scale[c][1]
        b[0] -= b[i] * d.scale[c][0]
    head = [("Intercept", None, float(b[0]))] + [(c, None, float(v)) for c, v in zip(d.numeric, b[1:])]
    out = spark.createDataFrame(head, "term string, level string, estimate double")
    if d.levels is None:
        return out
    rows = d.levels.join(fit.levels, "column", "left").select(F.col("feature").alias("term"), "level", F.coalesce("b", F.lit(0.0)).alias("estimate"))
    return out.unionByName(rows)


def sparse_ols(df: DataFrame, y: str, numeric, categorical, tol: float = 1e-12, max_iter: int = 1000) -> tuple[DataFrame, SparseFit]:
    """M6 with any number of levels: coefficient table and fit."""
    d = design(df, y, numeric, categorical)
    fit = least_squares(d, tol, max_iter)
    return coefficients(df.sparkSession, d, fit), fit
