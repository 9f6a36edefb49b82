"""Derived columns and row predicates of the flight analysis (F*, P*, X*).

Each function returns a Column (or a DataFrame for table-level steps) built
from native expressions, so a whole derivation collapses into one projection
inside one whole-stage-codegen span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.flights import CAUSES
from .rounding import half_away

# Expected mean departure delay per month (Jan..Dec).
SEASON_AVG = [8.2, 9.1, 10.3, 11.5, 13.2, 15.8, 18.9, 17.4, 12.1, 4.3, 9.8, 11.2]
# The four causes that compete for "primary cause" (security is left out).
PRIMARY_CAUSES = [("carrier_delay", "Carrier"), ("weather_delay", "Weather"),
                  ("nas_delay", "NAS / ATC"), ("late_aircraft_delay", "Late Aircraft")]
FOUR_CAUSES = [c for c, _ in PRIMARY_CAUSES]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_active_causes(cols=CAUSES) -> Column:
    """how many cause columns are positive (null counts as 0)."""
    return reduce(lambda a, b: a + b,
                  [F.when(_c(c) > 0, 1).otherwise(0) for c in cols])


def seasonal_benchmark(month="month") -> Column:
    """the month's expected delay; null outside 1..12."""
    m = _c(month)
    arr = F.array(*[F.lit(v) for v in SEASON_AVG])
    return F.when(m.between(1, 12), F.element_at(arr, m.cast("int")))


def delay_vs_seasonal(dep="dep_delay", month="month") -> Column:
    """F2: deviation from the benchmark, rounded to 0.1 (half away from zero)."""
    return half_away(_c(dep) - seasonal_benchmark(month), 1)


def above_seasonal_avg(dep="dep_delay", month="month") -> Column:
    """1 if above the benchmark; a missing delay compares as not above."""
    b = seasonal_benchmark(month)
    return F.when(b.isNotNull(), F.coalesce((_c(dep) > b).cast("int"), F.lit(0)))


def flight_status(cancelled="cancelled", dep="dep_delay") -> Column:
    """ordered status rules."""
    d = _c(dep)
    return (F.when(_c(cancelled) == 1, "Cancelled").when(d >= 60, "Severe")
            .when(d >= 16, "Moderate").when(d > 0, "Minor").otherwise("On Time"))


def primary_cause(causes=PRIMARY_CAUSES) -> Column:
    """label of the largest cause, ties resolved in list order; 'None' if <= 0."""
    mx = F.greatest(*[_c(c) for c, _ in causes])
    expr = F.when(mx.isNull() | (mx <= 0), "None")
    for c, label in causes:
        expr = expr.when(mx == _c(c), label)
    return expr


def is_weekend(dow="day_of_week") -> Column:
    """Saturday or Sunday with 1 = Monday."""
    return _c(dow).isin(6, 7).cast("int")


def log_delay_row(col="arr_delay") -> Column:
    """per-row shift: log(x + max(0, -x) + 1)."""
    x = _c(col)
    return F.log(x + F.greatest(F.lit(0.0), -x) + 1)


def log_delay_global(df: DataFrame, col="arr_delay", out="log_arr_delay") -> DataFrame:
    """one table-wide shift max(0, -min(x)) + 1, then log(x + shift).

    The shift is fitted by one aggregate and inlined as a literal.
    """
    shift = df.agg((F.greatest(F.lit(0.0), -F.min(col)) + 1).alias("_shift")).first()[0]
    return df.withColumn(out, F.log(F.col(col) + F.lit(shift).cast("double")))


def null_skipping_sum(cols) -> Column:
    """F8: SAS SUM(): nulls skipped, null only when all are null."""
    cs = [_c(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    return F.when(F.coalesce(*cs).isNotNull(), total)


def total_cause_delay(cols=FOUR_CAUSES) -> Column:
    return null_skipping_sum(cols)


def blank_to_null(col) -> Column:
    t = F.trim(_c(col))
    return F.when(t != "", t)


def route(a="origin", b="dest", sep="-") -> Column:
    """trimmed parts joined with sep, blanks and nulls skipped."""
    return F.concat_ws(sep, blank_to_null(a), blank_to_null(b))


def upper_strip(col) -> Column:
    """F10."""
    return F.upper(F.trim(_c(col)))


def delay_per_mile(dep="dep_delay", dist="distance") -> Column:
    """dep / max(distance, 1) rounded to 0.001."""
    return half_away(_c(dep) / F.greatest(_c(dist), F.lit(1.0)), 3)


def on_time_flag(dep="dep_delay", cancelled="cancelled") -> Column:
    return ((_c(dep) <= 0) & (_c(cancelled) == 0)).cast("int")


def month_start(month="month", year=2024) -> Column:
    """first day of the month of a fixed year."""
    return F.make_date(F.lit(year), _c(month), F.lit(1))


def date_parts(month="month", year=2024) -> dict:
    """calendar columns derived from the month number."""
    start = month_start(month, year)
    end = F.last_day(start)
    quarter = F.quarter(start)
    noon = F.make_timestamp_ntz(F.lit(year), _c(month), F.lit(1), F.lit(12), F.lit(0),
                                F.lit(0))
    return {
        "month_start": start,
        "month_end": end,
        "next_month": F.add_months(start, 1),
        "quarter": quarter,
        "days_in_month": F.dayofmonth(end),
        "is_peak_season": quarter.isin(2, 3).cast("int"),
        "month_date": F.to_date(noon),
    }


def derive_flights(df: DataFrame) -> DataFrame:
    """The row-by-row derivation step over the flights table, in its rule order.

    Causes are zero-filled first, the seasonal columns use the delay before
    imputation, then dep/arr delays are zero-filled and the cancellation code
    gets 'N'; all later columns see the imputed values. One projection.
    """
    cause_fill = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in CAUSES}
    step1 = df.withColumns(cause_fill).withColumns({
        "n_active_causes": n_active_causes(),
        "seasonal_benchmark": seasonal_benchmark(),
        "delay_vs_seasonal": delay_vs_seasonal(),
        "above_seasonal_avg": above_seasonal_avg(),
    })
    step2 = step1.withColumns({
        "dep_delay": F.coalesce(F.col("dep_delay"), F.lit(0.0)),
        "arr_delay": F.coalesce(F.col("arr_delay"), F.lit(0.0)),
        "cancellation_code": F.coalesce(blank_to_null("cancellation_code"), F.lit("N")),
    })
    return step2.withColumns({
        "flight_status": flight_status(),
        "primary_cause": primary_cause(),
        "is_weekend": is_weekend(),
        "log_arr_delay": log_delay_row(),
        "total_cause_delay": total_cause_delay(),
        "route": route(),
        "abs_arr_delay": F.abs("arr_delay"),
        "delay_per_mile": delay_per_mile(),
        "on_time_flag": on_time_flag(),
        **date_parts(),
    })


# ---------------------------------------------------------------------------
# Predicates (P*)
# ---------------------------------------------------------------------------

def severe() -> Column:
    """Severe delay on an operated flight."""
    return (F.col("dep_delay") >= 60) & (F.col("cancelled") == 0)


def cancelled_only() -> Column:
    return F.col("cancelled") == 1


def in_list(col, values) -> Column:
    return _c(col).isin(*values)


def long_haul(threshold=1500) -> Column:
    return (F.col("distance") > threshold) & (F.col("cancelled") == 0)


# The bounding box (inclusive) and the subset definitions.
BBOX = {"lon": (-170, -60), "lat": (15, 72)}
WORST_CARRIERS = ["F9", "AA", "B6"]
BEST_CARRIERS = ["AS", "HA"]


def bbox_filter(lat="lat", lon="lon", box=BBOX) -> Column:
    """Inclusive longitude / latitude box."""
    return (_c(lon).between(*box["lon"]) & _c(lat).between(*box["lat"]))


def not_missing(*cols) -> Column:
    """Complete cases over the given columns."""
    return reduce(lambda a, b: a & b, [_c(c).isNotNull() for c in cols])


def subsets() -> list[tuple[str, Column]]:
    """The labelled subsets of the derived flights table."""
    return [
        ("All cleaned flights", F.lit(True)),
        ("Severe delays (dep >= 60 min)", severe()),
        ("Cancelled flights", cancelled_only()),
        ("Summer (July + August)", in_list("month", [7, 8])),
        ("Worst carriers (F9, AA, B6)", in_list("op_unique_carrier", WORST_CARRIERS)),
        ("Best carriers (AS, HA)", in_list("op_unique_carrier", BEST_CARRIERS)),
        ("Long-haul (distance > 1500 mi)", long_haul()),
    ]
