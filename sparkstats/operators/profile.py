"""Profiling and data-quality summaries (Q*).

Each profile is one aggregate over the table (one expression per column),
turned into rows with an ``explode`` of a small struct array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_even
from .ordered import join_by, multi_quantiles


def _rows(one_row: DataFrame, specs: list[tuple[str, dict]]) -> DataFrame:
    """Turn a 1-row wide aggregate into rows: specs = [(column, {field: agg_col})]."""
    arr = F.array(*[F.struct(F.lit(name).alias("column"),
                             *[F.col(src).alias(f) for f, src in fields.items()])
                    for name, fields in specs])
    return one_row.select(F.explode(arr).alias("_r")).select("_r.*")


def missing_summary(df: DataFrame, digits: int = 2, sort_by: str = "missing_pct"
                    ) -> DataFrame:
    """Q1: null count and percent per column; only columns with nulls; sorted desc."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    long = _rows(agg, [(c, {"missing_count": f"_m{i}", "_rows": "_rows"})
                       for i, c in enumerate(cols)])
    long = long.where(F.col("missing_count") > 0).withColumn(
        "missing_pct", half_even(F.col("missing_count") / F.col("_rows") * 100, digits)
    ).drop("_rows")
    return long.orderBy(F.desc(sort_by), "column")


def missing_matrix(df: DataFrame, key: str, n: int = 500) -> DataFrame:
    """Q2: 0/1 null indicators of the first n rows (by key), columns with nulls only."""
    with_nulls = [r["column"] for r in missing_summary(df).select("column").collect()]
    head = df.orderBy(key).limit(n)
    return head.select(key, *[F.col(c).isNull().cast("int").alias(c) for c in with_nulls])


def column_inventory(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q3: name, type, non-null count, distinct count (exact, or HLL++ if approx).

    The exact form counts (column, value) pairs: narrow rows that combine before
    the shuffle, instead of a copy of the whole row per counted column."""
    cols = df.columns
    types = dict(df.dtypes)
    type_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    if approx:
        agg = df.agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(cols)],
                     *[F.approx_count_distinct(c).alias(f"_d{i}") for i, c in enumerate(cols)])
        long = _rows(agg, [(c, {"non_null": f"_n{i}", "n_distinct": f"_d{i}"})
                           for i, c in enumerate(cols)])
        return long.withColumn("dtype", type_map[F.col("column")])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                                for c in cols]))
    counts = df.select(pairs.alias("_p")).select("_p.*").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    long = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("v").alias("n_distinct"))
    return long.withColumn("dtype", type_map[F.col("column")])


def describe(df: DataFrame, cols, by=(), with_nmiss: bool = False, method: str = "exact") -> DataFrame:
    """Q4: count, mean, sample std, min, quartiles (exact, interpolated; or by ``method`` "sketch"), max per column.

    Moments come from one wide aggregate; quartiles from the bucketed exact
    quantiles of the stacked columns; both joined on (by..., column).
    """
    by = list(by)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"_n{i}"), F.avg(c).alias(f"_a{i}"),
                 F.stddev_samp(c).alias(f"_s{i}"), F.min(c).cast("double").alias(f"_lo{i}"),
                 F.max(c).cast("double").alias(f"_hi{i}")]
        if with_nmiss:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"_z{i}"))
    wide = df.groupBy(*by).agg(*aggs)
    fields = lambda i: {"count": f"_n{i}", "mean": f"_a{i}", "std": f"_s{i}",
                        "min": f"_lo{i}", "max": f"_hi{i}",
                        **({"nmiss": f"_z{i}"} if with_nmiss else {})}
    arr = F.array(*[F.struct(F.lit(c).alias("column"),
                             *[F.col(s).alias(f) for f, s in fields(i).items()])
                    for i, c in enumerate(cols)])
    moments = wide.select(*by, F.explode(arr).alias("_r")).select(*by, "_r.*")
    qs = multi_quantiles(df, cols, [0.25, 0.5, 0.75], ["p25", "median", "p75"], by, method)
    return join_by(moments, qs, [*by, "column"], "left")


def head(df: DataFrame, key, n: int = 10, cols=None) -> DataFrame:
    """Q5: first n rows by key (TakeOrderedAndProject)."""
    out = df.orderBy(*([key] if isinstance(key, str) else key)).limit(n)
    return out.select(*cols) if cols else out


def kpis(df: DataFrame) -> DataFrame:
    """Q6: rows, distinct carriers, distinct origins, mean departure delay."""
    return df.agg(F.count(F.lit(1)).alias("n_flights"),
                  F.count_distinct("op_unique_carrier").alias("n_airlines"),
                  F.count_distinct("origin").alias("n_origins"),
                  F.avg("dep_delay").alias("avg_dep_delay"))


def delay_shares(df: DataFrame, col: str = "dep_delay") -> DataFrame:
    """Q7: percent on time (<= 15), percent >= 60, median."""
    shares = df.agg(
        (F.avg(F.when(F.col(col).isNotNull(), (F.col(col) <= 15).cast("double"))) * 100
         ).alias("pct_on_time"),
        (F.avg(F.when(F.col(col).isNotNull(), (F.col(col) >= 60).cast("double"))) * 100
         ).alias("pct_severe"))
    med = multi_quantiles(df, [col], [0.5], ["median"]).select("median")
    return shares.crossJoin(med)


def winsor_bounds(df: DataFrame, cols, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Q8: p01 / p99 per column."""
    return multi_quantiles(df, cols, [lo, hi], ["p_low", "p_high"])


def scaling_summary(before: DataFrame, after: DataFrame, cols) -> DataFrame:
    """Q9: mean / sample std before (3 digits) and after (6 digits)."""
    def stats(df, sfx, d):
        one = df.agg(*[F.avg(c).alias(f"_a{i}") for i, c in enumerate(cols)],
                     *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(cols)])
        long = _rows(one, [(c, {f"mean_{sfx}": f"_a{i}", f"std_{sfx}": f"_s{i}"})
                           for i, c in enumerate(cols)])
        return long.withColumns({f"mean_{sfx}": half_even(f"mean_{sfx}", d),
                                 f"std_{sfx}": half_even(f"std_{sfx}", d)})
    return stats(before, "before", 3).join(stats(after, "after", 6), "column")


def scaling_check(df: DataFrame, cols, mean_tol: float = 0.01, std_tol: float = 0.01
                  ) -> DataFrame:
    """Q10: flags |mean| < tol and 1 - tol < std < 1 + tol per column."""
    one = df.agg(*[F.avg(c).alias(f"_a{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    long = _rows(one, [(c, {"mean": f"_a{i}", "std": f"_s{i}"}) for i, c in enumerate(cols)])
    return long.withColumns({
        "mean_ok": F.abs("mean") < mean_tol,
        "std_ok": (F.col("std") > 1 - std_tol) & (F.col("std") < 1 + std_tol)})


def encoding_summary(original: DataFrame, encoded: DataFrame, changed) -> DataFrame:
    """Q11: new (one-hot) columns and label-encoded columns with distinct counts."""
    new_cols = sorted(set(encoded.columns) - set(original.columns))
    changed = sorted(changed)
    specs = ([(c, "one-hot (new)") for c in new_cols]
             + [(c, "label-encoded") for c in changed])
    agg = encoded.agg(*[F.count_distinct(c).alias(f"_d{i}") for i, (c, _) in
                        enumerate(specs)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"),
                             F.col(f"_d{i}").alias("unique_values"))
                    for i, (c, t) in enumerate(specs)])
    return agg.select(F.explode(arr).alias("_r")).select("_r.*")


def row_audit(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Q12: rows and columns per named stage, and rows removed versus the first."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows",
        F.lit(len(df.columns)).alias("columns")) for i, (name, df) in enumerate(stages)]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    first = u.where(F.col("step") == 0).select(F.col("rows").alias("_first"))
    return u.crossJoin(F.broadcast(first)).withColumn(
        "rows_removed", F.col("_first") - F.col("rows")).drop("_first")
