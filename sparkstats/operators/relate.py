"""Joins, grouped summaries, windows, sorts, sets and reshapes (J*, A*, W*, L*, U*, R*).

Grouped summaries are plain ``groupBy().agg()``: partial aggregation runs
map-side, so a carrier holding a third of all rows costs one partial row
per task, not a hot shuffle partition. Top-k is ``orderBy().limit()``
(TakeOrderedAndProject: per-task top-k, no global sort) with a key as
tie-break so the kept set is deterministic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derive
from ..functions.rounding import half_even
from ..sources.flights import CAUSES

# Dimension tables up to this size are broadcast after a check of rows and bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows of together at most
    ``max_bytes`` (their length as text, which a LIMIT on the rows bounds); otherwise
    leave the join strategy to Catalyst / AQE (sort-merge with skew splitting)."""
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    n, b = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= max_rows and (b or 0) <= max_bytes else df


def dedupe_first(df: DataFrame, key: str, order=None) -> DataFrame:
    """Drop null keys, keep one row per key: the smallest by ``order``.

    ``min_by`` over a struct is a partial aggregate: a hot key is combined
    map-side instead of sorting its whole group in one task.
    """
    others = [c for c in df.columns if c != key]
    order = order or others
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
              .select(key, "_r.*"))


AIRPORT_RENAME = {"Name": "origin_airport_name", "City": "origin_city",
                  "Country": "origin_country", "Latitude": "origin_lat",
                  "Longitude": "origin_lon"}


def join_airports(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Inner join to the de-duplicated airport dimension on origin."""
    dim = dedupe_first(airports.select("IATA", *AIRPORT_RENAME), "IATA")
    dim = dim.withColumnsRenamed(AIRPORT_RENAME)
    return flights.join(small_side(dim), flights.origin == dim.IATA).drop("IATA")


def join_airports_raw(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Inner join on origin = IATA without de-duplication (fan-out kept)."""
    return flights.join(small_side(airports), flights.origin == airports.IATA)


def join_airports_normalized(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Join on upper(strip(key)) on both sides, no de-duplication.

    The normalised key is a column on each side, so this stays an equi-join.
    """
    f = flights.withColumn("_k", derive.upper_strip("origin"))
    a = airports.select(derive.upper_strip("IATA").alias("_ka"),
                        F.col("Name").alias("airport_name"),
                        F.col("City").alias("origin_city"),
                        F.col("Country").alias("origin_country"),
                        F.col("Latitude").alias("origin_lat"),
                        F.col("Longitude").alias("origin_lon"))
    return f.join(small_side(a), f._k == a._ka).drop("_k", "_ka")


def merge_all(frames, on, how="inner") -> DataFrame:
    """Fold of equi-joins on the same key list."""
    return reduce(lambda a, b: a.join(b, on=on, how=how), frames)


# ---------------------------------------------------------------------------
# Grouped summaries of the interactive analysis (pandas rounding: half-even)
# ---------------------------------------------------------------------------

def _round_all(df: DataFrame, cols, digits) -> DataFrame:
    return df.withColumns({c: half_even(c, digits) for c in cols})


def delay_by_carrier(df: DataFrame) -> DataFrame:
    """A1."""
    g = df.groupBy(F.col("op_unique_carrier").alias("carrier")).agg(
        F.count("arr_delay").alias("flight_count"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        F.avg("dep_delay").alias("avg_dep_delay"),
        F.avg("cancelled").alias("cancellation_rate"),
        F.avg("distance").alias("avg_distance"))
    g = _round_all(g, ["avg_arr_delay", "avg_dep_delay", "cancellation_rate",
                       "avg_distance"], 2)
    return g.orderBy(F.desc("avg_arr_delay"), "carrier")


def delay_by_origin_all(df: DataFrame) -> DataFrame:
    """A2 before its cut: every origin."""
    g = df.groupBy("origin").agg(
        F.count("arr_delay").alias("flight_count"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        F.avg("dep_delay").alias("avg_dep_delay"),
        F.avg("cancelled").alias("cancellation_rate"))
    return _round_all(g, ["avg_arr_delay", "avg_dep_delay", "cancellation_rate"], 2)


def delay_by_origin(df: DataFrame, top_n: int = 20) -> DataFrame:
    """A2: busiest ``top_n`` origins."""
    return delay_by_origin_all(df).orderBy(F.desc("flight_count"), "origin").limit(top_n)


def delay_by_month(df: DataFrame) -> DataFrame:
    """A3."""
    g = df.groupBy("month").agg(
        F.count("dep_delay").alias("flight_count"),
        F.avg("dep_delay").alias("avg_dep_delay"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        F.avg("cancelled").alias("cancellation_rate"))
    return _round_all(g, ["avg_dep_delay", "avg_arr_delay", "cancellation_rate"], 2
                      ).orderBy("month")


def delay_breakdown_by_carrier(df: DataFrame, causes=CAUSES) -> DataFrame:
    """A4: mean of each cause per carrier."""
    g = df.groupBy(F.col("op_unique_carrier").alias("carrier")).agg(
        *[F.avg(c).alias(c) for c in causes])
    return _round_all(g, causes, 2).orderBy("carrier")


def route_stats(merged: DataFrame) -> DataFrame:
    """A5: per route and origin attributes; null group keys dropped (pandas rule)."""
    keys = ["origin", "dest", "origin_lat", "origin_lon", "origin_airport_name",
            "origin_city"]
    g = merged.dropna(subset=keys).groupBy(*keys).agg(
        F.count("arr_delay").alias("flight_count"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        F.avg("cancelled").alias("cancellation_rate"))
    return _round_all(g, ["avg_arr_delay", "cancellation_rate"], 2).orderBy(
        F.desc("flight_count"), "origin", "dest")


def airport_summary(merged: DataFrame, digits: int = 3) -> DataFrame:
    """Per origin airport with its name, city and coordinates."""
    keys = ["origin", "origin_airport_name", "origin_city", "origin_lat", "origin_lon"]
    g = merged.dropna(subset=keys).groupBy(*keys).agg(
        F.count("arr_delay").alias("flight_count"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        F.avg("dep_delay").alias("avg_dep_delay"),
        F.avg("cancelled").alias("cancellation_rate"))
    return _round_all(g, ["avg_arr_delay", "avg_dep_delay", "cancellation_rate"], digits)


def top_k(df: DataFrame, order, n: int) -> DataFrame:
    """L2: first n rows by ``order`` (list of Columns; add a key as tie-break)."""
    return df.orderBy(*order).limit(n)


# ---------------------------------------------------------------------------
# Summaries of the batch report (SAS: COUNT(*), unrounded means)
# ---------------------------------------------------------------------------

def carrier_summary(df: DataFrame) -> DataFrame:
    """A7."""
    return df.groupBy(F.col("op_unique_carrier").alias("carrier")).agg(
        F.count(F.lit(1)).alias("flight_count"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        F.avg("dep_delay").alias("avg_dep_delay"),
        (F.avg("cancelled") * 100).alias("cancellation_pct"),
        *[F.avg(c).alias(f"avg_{c}") for c in CAUSES],
        F.avg("distance").alias("avg_distance"),
    ).orderBy(F.desc("avg_arr_delay"), "carrier")


def monthly_summary(df: DataFrame) -> DataFrame:
    """A8."""
    return df.groupBy("month").agg(
        F.count(F.lit(1)).alias("flight_count"),
        F.avg("dep_delay").alias("avg_dep_delay"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        (F.avg("cancelled") * 100).alias("cancellation_pct")).orderBy("month")


def airport_summary_pct(geo: DataFrame) -> DataFrame:
    """Over the normalised (not de-duplicated) airport join."""
    return geo.groupBy(
        "origin", F.col("airport_name"), F.col("origin_city").alias("city"),
        F.col("origin_lat").alias("lat"), F.col("origin_lon").alias("lon")).agg(
        F.count(F.lit(1)).alias("flight_count"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        F.avg("dep_delay").alias("avg_dep_delay"),
        (F.avg("cancelled") * 100).alias("cancellation_pct"))


def cause_summary(df: DataFrame) -> DataFrame:
    """A10: cause means and the sum of four cause sums (security left out)."""
    total = reduce(lambda a, b: a + b, [F.sum(c) for c in derive.FOUR_CAUSES])
    return df.groupBy(F.col("op_unique_carrier").alias("carrier")).agg(
        F.avg("carrier_delay").alias("avg_carrier"),
        F.avg("weather_delay").alias("avg_weather"),
        F.avg("nas_delay").alias("avg_nas"),
        F.avg("security_delay").alias("avg_security"),
        F.avg("late_aircraft_delay").alias("avg_late_aircraft"),
        total.alias("total_delay_minutes")).orderBy(F.desc("avg_carrier"), "carrier")


def route_summary(df: DataFrame, min_count: int = 50, top: int = 30) -> DataFrame:
    """Routes with at least ``min_count`` flights, worst ``top`` by arrival delay."""
    g = df.groupBy("origin", "dest").agg(
        F.count(F.lit(1)).alias("flight_count"),
        F.avg("arr_delay").alias("avg_arr_delay"),
        F.avg("dep_delay").alias("avg_dep_delay"),
        (F.avg("cancelled") * 100).alias("cancellation_pct"))
    g = g.where(F.col("flight_count") >= min_count).withColumn(
        "route", derive.route("origin", "dest"))
    return g.orderBy(F.desc("avg_arr_delay"), "route").limit(top)


def freq_table(df: DataFrame, col: str, digits: int | None = None) -> DataFrame:
    """One-way counts and percent of non-null total, most frequent first."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).alias("frequency"))
    total = g.agg(F.sum("frequency").alias("_total"))
    out = g.crossJoin(F.broadcast(total)).withColumn(
        "percent", F.col("frequency") * 100.0 / F.col("_total")).drop("_total")
    if digits is not None:
        out = out.withColumn("percent", half_even("percent", digits))
    return out.orderBy(F.desc("frequency"), col)


def crosstab_pct(df: DataFrame, row: str, col: str, levels) -> DataFrame:
    """Two-way counts for fixed column levels, plus row percentages."""
    g = df.groupBy(row).pivot(col, levels).count().na.fill(0)
    names = [str(v) for v in levels]
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    g = g.withColumn("row_total", total)
    for n in names:
        g = g.withColumn(f"pct_{n}", F.col(n) * 100.0 / F.col("row_total"))
    return g.withColumnsRenamed({n: f"n_{n}" for n in names}).orderBy(row)


def share_within(df: DataFrame, group: str, count_col: str, out: str = "pct") -> DataFrame:
    """Value / group total (window over a grouped table)."""
    w = Window.partitionBy(group)
    return df.withColumn(out, F.col(count_col) * 100.0 / F.sum(count_col).over(w))


def cause_share_by_carrier(derived: DataFrame) -> DataFrame:
    """Primary-cause counts per carrier and share within the carrier."""
    g = (derived.where(F.col("primary_cause") != "None")
         .groupBy(F.col("op_unique_carrier").alias("carrier"), "primary_cause")
         .agg(F.count(F.lit(1)).alias("n")))
    return share_within(g, "carrier", "n", "pct_of_carrier")


def mode_first(df: DataFrame, col: str, order_key: str, by=()) -> DataFrame:
    """Most frequent value; a tie goes to the value seen first (smallest key).

    Counts per value are combined map-side; the winner is the row with the
    largest count and, among equal counts, the smallest first key: a
    ``min_by`` over (-count, first key), itself a partial aggregate.
    """
    g = (df.where(F.col(col).isNotNull()).groupBy(*by, col)
         .agg(F.count(F.lit(1)).alias("_n"), F.min(order_key).alias("_first")))
    return g.groupBy(*by).agg(
        F.min_by(F.col(col), F.struct(-F.col("_n"), F.col("_first"))).alias("mode"),
        F.max("_n").alias("mode_count"))


def best_worst(df: DataFrame, label: str, value: str) -> DataFrame:
    """Labels of the smallest and largest value (ties: smallest label)."""
    return df.where(F.col(value).isNotNull()).agg(
        F.min_by(label, F.struct(F.col(value), F.col(label))).alias("best_label"),
        F.min(value).alias("best_value"),
        F.min_by(label, F.struct(-F.col(value), F.col(label))).alias("worst_label"),
        F.max(value).alias("worst_value"))


def rank_tiers(df: DataFrame, label: str, value: str, out: str = "tier") -> DataFrame:
    """0-based rank of small per-label aggregates by value ascending.

    Input is a k-row table (one row per group), so the single ordered window
    runs over k rows only.
    """
    w = Window.orderBy(F.col(value), F.col(label))
    return df.withColumn(out, F.row_number().over(w) - 1)


def subset_sizes(df: DataFrame, subsets) -> DataFrame:
    """Row count of each labelled subset, all in one scan (count_if)."""
    counts = df.agg(*[F.count_if(cond).alias(f"_s{i}") for i, (_, cond) in
                      enumerate(subsets)])
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(name).alias("subset"),
                               F.col(f"_s{i}").alias("n"))
                      for i, (name, _) in enumerate(subsets)])
    return counts.select(F.explode(pairs).alias("_p")).select("_p.*")


def wide_to_long(df: DataFrame, ids, cols, var="cause", val="minutes") -> DataFrame:
    """Unpivot value columns into (ids..., var, val)."""
    return df.unpivot(list(ids), list(cols), var, val)


def matrix_pivot(df: DataFrame, row: str, col: str, levels, value=None) -> DataFrame:
    """R2: long (row, col[, value]) -> square table with fixed levels on both axes.

    Missing cells are 0; rows for levels absent from the data are added from
    the fixed level list (k rows), so the matrix is always k x k.
    """
    g = df.groupBy(row).pivot(col, list(levels))
    g = g.count() if value is None else g.agg(F.sum(value))
    names = [str(v) for v in levels]
    spark = df.sparkSession
    axis = spark.range(len(levels)).select(
        F.element_at(F.array(*[F.lit(v) for v in levels]),
                     (F.col("id") + 1).cast("int")).alias(row))
    out = F.broadcast(axis).join(g, row, "left")
    return out.na.fill(0, subset=names)


def top_groups_semi(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Rows of the n most frequent values of ``col`` (ties: smallest value).

    The kept list has at most n rows (a proven bound), so the semi join is
    a broadcast."""
    top = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.desc("_n"), col).limit(n).select(col))
    return df.join(F.broadcast(top), col, "left_semi")
