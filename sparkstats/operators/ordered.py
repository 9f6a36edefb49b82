"""Order statistics without a single-partition step.

A global ``Window.orderBy`` (no partition) or an exact ``percentile`` over one
big group pulls every value into one task. Everything here instead:

1. collapses duplicates first (``groupBy(by, value).count()``, map-side combine),
2. range-partitions the distinct (group, value) rows by group and value, sorts
   inside the partitions and stores the result, so partitions follow the data
   (one group or a narrow column cannot crowd into one bucket of another's),
   their number follows the session's shuffle settings and AQE, and a lost
   executor costs a file read,
3. runs a running sum inside each (group, partition) and adds offsets computed
   on the small (group, partition) totals table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def in_order(rows: DataFrame, keys: list, tag: str, partitions: int | None = None) -> DataFrame:
    """``rows`` range-partitioned (the session's number of partitions, unless given) and
    sorted by ``keys`` and stored, with ``_seq`` (ascending in that order) and ``_part``
    (its partition). Rows that tie in all keys must be interchangeable."""
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return materialize(ranged.sortWithinPartitions(*keys)
                       .withColumn("_seq", F.monotonically_increasing_id())
                       .withColumn("_part", F.shiftright("_seq", 33)), tag)


def without_nan(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with NaN as null in the named columns of floating type."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in dict.fromkeys(cols) if kinds.get(c) in ("double", "float")})


def join_by(left: DataFrame, right: DataFrame, by: list, how: str = "inner") -> DataFrame:
    """Join on the columns ``by`` with null equal to null, keeping the left side's; without
    columns, ``right`` is a one-row table."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return left.join(other, on, how).drop(*[f"_by_{c}" for c in by])


def prefix_sums(rows: DataFrame, by: list, value: str, weights: list) -> DataFrame:
    """For rows unique on (by, value): add ``<w>_before`` (sum of w over smaller
    values in the same group) and ``<w>_total`` (group sum) for each weight w."""
    by = list(by)
    b = in_order(rows, [*by, value], "ordered")
    w_in = (Window.partitionBy(*by, "_part").orderBy("_seq")
            .rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumns({f"_{w}_in": F.coalesce(F.sum(w).over(w_in), F.lit(0))
                       for w in weights})
    # at most one row per partition and group that it holds
    totals = b.groupBy(*by, "_part").agg(*[F.sum(w).alias(f"_{w}_pt") for w in weights])
    w_pt = Window.partitionBy(*by).orderBy("_part")
    grp = Window.partitionBy(*by)
    cols = {}
    for w in weights:
        cols[f"_{w}_off"] = F.coalesce(
            F.sum(f"_{w}_pt").over(w_pt.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0))
        cols[f"{w}_total"] = F.sum(f"_{w}_pt").over(grp)
    totals = totals.withColumns(cols).drop(*[f"_{w}_pt" for w in weights])
    out = join_by(b, totals, [*by, "_part"])
    out = out.withColumns({f"{w}_before": F.col(f"_{w}_off") + F.col(f"_{w}_in")
                           for w in weights})
    return out.drop("_seq", "_part", *[f"_{w}_in" for w in weights],
                    *[f"_{w}_off" for w in weights])


def row_positions(df: DataFrame, by: list, order: list, tag: str = "positions") -> DataFrame:
    """``df`` with ``_pos``, a row's 1-based place in its group by ``order`` and
    then all other columns, and ``_total``, the group's rows. Stored once, so the
    order is not computed again by later passes."""
    by = list(by)
    rest = [c for c in df.columns if c not in {*by, *order}]
    b = in_order(df, [*by, *order, *rest], tag)
    counts = b.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    grp = Window.partitionBy(*by)
    counts = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(grp.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_n").over(grp)})
    return (join_by(b, counts, [*by, "_part"])
            .withColumn("_pos", F.col("_before") + F.col("_seq") - F.col("_first") + 1)
            .drop("_seq", "_part", "_n", "_first", "_before"))


def value_counts(df: DataFrame, col: str, by=()) -> DataFrame:
    """Distinct (by, value) with their row count ``_n``; null and NaN values dropped, null groups kept."""
    return (without_nan(df, col).where(F.col(col).isNotNull()).groupBy(*by, col)
              .agg(F.count(F.lit(1)).alias("_n")))


def quantiles_long(df: DataFrame, col: str, probs, by=(),
                   value_name: str = "value") -> DataFrame:
    """Exact linearly interpolated quantiles (pandas / R type 7 / quantile_cont).

    Returns (by..., prob_index, prob, value).
    """
    return quantiles_from_counts(value_counts(df, col, by), col, probs, by, value_name)


def quantiles_from_counts(counts: DataFrame, col: str, probs, by=(),
                          value_name: str = "value") -> DataFrame:
    """``quantiles_long`` of a table of distinct (by, value) with their count ``_n``."""
    by = list(by)
    ranked = prefix_sums(counts, by, col, ["_n"])
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    x = ranked.select(*by, col, "_n", "_n_before", "_n_total",
                      F.posexplode(probs_arr).alias("_qi", "_qp"))
    pos = (F.col("_n_total") - 1) * F.col("_qp")
    x = x.withColumn("_pos", pos).withColumns({
        "_lo": F.floor("_pos"), "_hi": F.ceil("_pos")})

    def holds(k):
        return (F.col("_n_before") <= F.col(k)) & (F.col(k) < F.col("_n_before") + F.col("_n"))

    x = x.where(holds("_lo") | holds("_hi"))
    agg = x.groupBy(*by, "_qi", "_qp").agg(
        F.max(F.when(holds("_lo"), F.col(col))).cast("double").alias("_vlo"),
        F.max(F.when(holds("_hi"), F.col(col))).cast("double").alias("_vhi"),
        F.first("_pos").alias("_pos"), F.first("_lo").alias("_lo"))
    val = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_pos") - F.col("_lo"))
    return agg.select(*by, F.col("_qi").alias("prob_index"), F.col("_qp").alias("prob"),
                      val.alias(value_name))


def quantiles_sketched(df: DataFrame, col: str, probs, names, by=(), accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles by a mergeable quantile sketch: one aggregate per group, no sort.

    A value for probability p has a rank within n / ``accuracy`` of p * n (n: rows of the
    group), whatever the order of the merges; it is one of the values, not interpolated."""
    q = F.percentile_approx(F.col(col).cast("double"), [float(p) for p in probs], accuracy)
    return (without_nan(df, col).where(F.col(col).isNotNull()).groupBy(*by).agg(q.alias("_q"))
            .select(*by, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(names)]))


def quantiles_wide(df: DataFrame, col: str, probs, names, by=(), method: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """Quantiles as one column per probability: (by..., names...); exact, or by ``method`` "sketch"."""
    if method == "sketch":
        return quantiles_sketched(df, col, probs, names, by, accuracy)
    if method != "exact":
        raise ValueError(f"method is exact or sketch, not {method}")
    long = quantiles_long(df, col, probs, by)
    return long.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob_index") == i, F.col("value"))).alias(n)
        for i, n in enumerate(names)])


def stacked(df: DataFrame, cols, name="column", value="value", by=()) -> DataFrame:
    """Long form (by..., column, value) of several numeric columns: one scan, each row expanded
    without an array of its values."""
    plain = df.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[F.col(c).cast("double").alias(c) for c in cols])
    ids = [f"_b{i}" for i in range(len(by))]
    long = plain.unpivot(ids, list(cols), "_column", "_value")
    return long.select(*[F.col(f"_b{i}").alias(c) for i, c in enumerate(by)], F.col("_column").alias(name), F.col("_value").alias(value))


def multi_quantiles(df: DataFrame, cols, probs, names, by=(), method: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """Quantiles of several columns at once: (by..., column, names...)."""
    long = stacked(df, cols, by=by)
    return quantiles_wide(long, "value", probs, names, [*by, "column"], method, accuracy)


def row_ranks(df: DataFrame, col: str, by=()) -> DataFrame:
    """Distinct values with the 1-based rank span [first_rank, last_rank] they
    occupy in the sorted column, and the group size: (by..., col, _n, first_rank,
    last_rank, n)."""
    counts = value_counts(df, col, by)
    r = prefix_sums(counts, list(by), col, ["_n"])
    return r.select(*by, col, "_n", (F.col("_n_before") + 1).alias("first_rank"),
                    (F.col("_n_before") + F.col("_n")).alias("last_rank"),
                    F.col("_n_total").alias("n"))


def quantiles_averaged(df: DataFrame, col: str, percents, names, by=()) -> DataFrame:
    """Percentiles by the averaged empirical distribution (definition 5): with
    n * p / 100 = j + g, the mean of the j-th and the next value where g = 0, else
    the value after the j-th. ``percents`` are whole numbers, so g is exact."""
    by = list(by)
    r = row_ranks(df, col, by)
    cols = []
    for p, name in zip(percents, names):
        at = F.col("n") * int(p)
        j, whole = F.floor(at / 100), at % 100 == 0

        def value(k):
            return F.max(F.when((F.col("first_rank") <= k) & (k <= F.col("last_rank")), F.col(col)))

        low, high = value(F.greatest(F.when(whole, j).otherwise(j + 1), F.lit(1))), value(F.least(j + 1, F.col("n")))
        cols.append(((low + high) / 2).alias(name))
    return r.groupBy(*by).agg(*cols)
