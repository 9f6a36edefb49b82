"""Frequency tables, cross tabs, shares, modes, reshapes and the formatted
reports of the batch analysis (A13-A15, A17, A20, A21, R1, F18, F19, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derive, labels
from ..functions.rounding import half_away
from ..operators import relate
from ..sources.flights import flights
from .catalog import query
from ..sources.flights import AIRPORTS_SQL
from .flight_queries import DERIVE_SQL, GEO_SQL, _sql, derived
from .profile_queries import _CARRIER_LABEL_SQL

_CANCEL_LABEL_SQL = ("MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in
                                         labels.CANCEL_REASONS.items()) + "}[cancellation_code]")


def _freq_sql(src, expr, name, where=""):
    w = f" WHERE {where}" if where else ""
    return f"""
  , g AS (SELECT {expr} AS {name}, count(*) AS frequency FROM {src}{w} GROUP BY 1)
  SELECT {name}, frequency, frequency * 100.0 / (SELECT sum(frequency) FROM g) AS percent
  FROM g WHERE {name} IS NOT NULL"""


@query("freq_flight_status", _sql(
    _freq_sql("dflights", "flight_status", "flight_status"), DERIVE_SQL),
    rounded=["percent"], digits=9)
def q_freq_status(spark, sf):
    """One-way frequency of the flight status."""
    return relate.freq_table(derived(spark, sf), "flight_status")


@query("freq_cancel_reason", _sql(
    _freq_sql("dflights", _CANCEL_LABEL_SQL, "cancel_reason"), DERIVE_SQL),
    rounded=["percent"], digits=9)
def q_freq_cancel(spark, sf):
    """A13 on the formatted cancellation code."""
    d = derived(spark, sf).withColumn(
        "cancel_reason", labels.value_label("cancellation_code", labels.CANCEL_REASONS))
    return relate.freq_table(d, "cancel_reason")


@query("freq_primary_cause", _sql(
    _freq_sql("dflights", "primary_cause", "primary_cause", "primary_cause <> 'None'"),
    DERIVE_SQL), rounded=["percent"], digits=9)
def q_freq_cause(spark, sf):
    """A13 with a WHERE: primary causes other than 'None'."""
    return relate.freq_table(derived(spark, sf).where(F.col("primary_cause") != "None"),
                             "primary_cause")


@query("crosstab_carrier_cancelled", _sql(f"""
  , g AS (SELECT {_CARRIER_LABEL_SQL} AS carrier_name,
                 count(*) FILTER (WHERE cancelled = 0) AS n_0,
                 count(*) FILTER (WHERE cancelled = 1) AS n_1 FROM dflights GROUP BY 1)
  SELECT carrier_name, n_0, n_1, n_0 + n_1 AS row_total,
         n_0 * 100.0 / (n_0 + n_1) AS pct_0, n_1 * 100.0 / (n_0 + n_1) AS pct_1 FROM g""",
    DERIVE_SQL), rounded=["pct_0", "pct_1"], digits=9)
def q_crosstab(spark, sf):
    """Formatted carrier by cancelled, counts and row percentages."""
    d = derived(spark, sf).withColumn(
        "carrier_name", labels.value_label("op_unique_carrier", labels.CARRIER_NAMES, "Other"))
    return relate.crosstab_pct(d, "carrier_name", "cancelled", [0, 1])


@query("cause_share_by_carrier", _sql("""
  , g AS (SELECT op_unique_carrier AS carrier, primary_cause, count(*) AS n FROM dflights
          WHERE primary_cause <> 'None' GROUP BY 1, 2)
  SELECT carrier, primary_cause, n, n * 100.0 / sum(n) OVER (PARTITION BY carrier)
         AS pct_of_carrier FROM g""", DERIVE_SQL), rounded=["pct_of_carrier"], digits=9)
def q_cause_share(spark, sf):
    """Primary-cause counts and share within each carrier."""
    return relate.cause_share_by_carrier(derived(spark, sf))


@query("mode_dest_by_carrier", _sql("""
  , g AS (SELECT op_unique_carrier, dest, count(*) AS n, min(flight_key) AS first_key
          FROM flights WHERE dest IS NOT NULL GROUP BY 1, 2)
  SELECT op_unique_carrier, dest AS mode, n AS mode_count FROM g
  QUALIFY row_number() OVER (PARTITION BY op_unique_carrier ORDER BY n DESC, first_key) = 1"""))
def q_mode(spark, sf):
    """Most frequent destination per carrier; ties go to the first seen
    (smallest flight_key)."""
    return relate.mode_first(flights(spark, sf), "dest", "flight_key", by=["op_unique_carrier"])


@query("best_worst_month", _sql("""
  , m AS (SELECT month, avg(dep_delay) AS v FROM flights GROUP BY month)
  SELECT (SELECT month FROM m ORDER BY v, month LIMIT 1) AS best_label,
         (SELECT min(v) FROM m) AS best_value,
         (SELECT month FROM m ORDER BY v DESC, month LIMIT 1) AS worst_label,
         (SELECT max(v) FROM m) AS worst_value"""),
    rounded=["best_value", "worst_value"], digits=9)
def q_best_worst(spark, sf):
    """Best and worst month by mean departure delay."""
    m = flights(spark, sf).groupBy("month").agg(F.avg("dep_delay").alias("v"))
    return relate.best_worst(m, "month", "v")


@query("causes_long", _sql("""
  , m AS (SELECT op_unique_carrier AS carrier, avg(carrier_delay) AS carrier_delay,
                 avg(weather_delay) AS weather_delay, avg(nas_delay) AS nas_delay,
                 avg(late_aircraft_delay) AS late_aircraft_delay FROM dflights GROUP BY 1)
  SELECT carrier, cause, minutes FROM (
    UNPIVOT m ON carrier_delay, weather_delay, nas_delay, late_aircraft_delay
    INTO NAME cause VALUE minutes)""", DERIVE_SQL), rounded=["minutes"], digits=9)
def q_causes_long(spark, sf):
    """Per-carrier cause means in long form (security left out)."""
    m = derived(spark, sf).groupBy(F.col("op_unique_carrier").alias("carrier")).agg(
        *[F.avg(c).alias(c) for c in derive.FOUR_CAUSES])
    return relate.wide_to_long(m, ["carrier"], derive.FOUR_CAUSES, "cause", "minutes")


def _ha(expr, d):
    from ..functions.rounding import sql_half_away
    return sql_half_away(expr, d)


@query("report_carrier", _sql(f"""
  , s AS (SELECT op_unique_carrier AS carrier, count(*) AS flight_count,
                 avg(arr_delay) AS a, avg(dep_delay) AS d, avg(cancelled) * 100 AS c,
                 avg(nas_delay) AS nas, avg(carrier_delay) AS car, avg(weather_delay) AS wea
          FROM dflights GROUP BY 1)
  SELECT carrier, {_CARRIER_LABEL_SQL.replace('op_unique_carrier', 'carrier')} AS airline,
         format('{{:,}}', flight_count) AS flights,
         {_ha('a', 1)} AS avg_arr_delay, {_ha('d', 1)} AS avg_dep_delay,
         {_ha('c', 2)} AS cancel_pct, {_ha('nas', 1)} AS nas_delay,
         {_ha('car', 1)} AS carrier_delay, {_ha('wea', 1)} AS weather_delay,
         a > 10 AS flag_high_arr_delay FROM s""", DERIVE_SQL))
def q_report_carrier(spark, sf):
    """A21 + F18 + F19: airline league table with display formats and the
    'average arrival delay above 10' flag (cell styling becomes a column)."""
    s = relate.carrier_summary(derived(spark, sf))
    return s.select(
        "carrier",
        labels.value_label("carrier", labels.CARRIER_NAMES, "Other").alias("airline"),
        F.format_number("flight_count", 0).alias("flights"),
        half_away("avg_arr_delay", 1).alias("avg_arr_delay"),
        half_away("avg_dep_delay", 1).alias("avg_dep_delay"),
        half_away("cancellation_pct", 2).alias("cancel_pct"),
        half_away("avg_nas_delay", 1).alias("nas_delay"),
        half_away("avg_carrier_delay", 1).alias("carrier_delay"),
        half_away("avg_weather_delay", 1).alias("weather_delay"),
        (F.col("avg_arr_delay") > 10).alias("flag_high_arr_delay"))


_MONTH_SQL = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in labels.MONTH_NAMES.items()) + "}[month]"


@query("report_month", _sql(f"""
  , s AS (SELECT month, count(*) AS flight_count, avg(dep_delay) AS d, avg(arr_delay) AS a,
                 avg(cancelled) * 100 AS c FROM dflights GROUP BY month)
  SELECT month, {_MONTH_SQL} AS month_name, format('{{:,}}', flight_count) AS flights,
         {_ha('d', 1)} AS avg_dep_delay, {_ha('a', 1)} AS avg_arr_delay, {_ha('c', 2)} AS cancel_pct,
         {_ha('a - d', 1)} AS delay_gap, a - d > 2 AS flag_gap_over_2,
         month IN (7, 8) AS flag_summer FROM s""", DERIVE_SQL))
def q_report_month(spark, sf):
    """Monthly table with delay_gap = arr - dep (positive: time lost in the
    air, whatever the report title says) and the gap / summer flags."""
    s = relate.monthly_summary(derived(spark, sf))
    gap = F.col("avg_arr_delay") - F.col("avg_dep_delay")
    return s.select(
        "month", labels.value_label("month", labels.MONTH_NAMES).alias("month_name"),
        F.format_number("flight_count", 0).alias("flights"),
        half_away("avg_dep_delay", 1).alias("avg_dep_delay"),
        half_away("avg_arr_delay", 1).alias("avg_arr_delay"),
        half_away("cancellation_pct", 2).alias("cancel_pct"),
        half_away(gap, 1).alias("delay_gap"), (gap > 2).alias("flag_gap_over_2"),
        F.col("month").isin(7, 8).alias("flag_summer"))


@query("report_airport", _sql(f"""
  , s AS (SELECT origin, airport_name, origin_city AS city, count(*) AS flight_count,
                 avg(arr_delay) AS a, avg(cancelled) * 100 AS c
          FROM geo GROUP BY origin, airport_name, origin_city, origin_lat, origin_lon)
  SELECT origin, airport_name, city, format('{{:,}}', flight_count) AS flights,
         {_ha('a', 1)} AS avg_arr_delay, {_ha('c', 2)} AS cancel_pct, flight_count
  FROM s ORDER BY flight_count DESC, origin, airport_name LIMIT 10""", DERIVE_SQL,
    AIRPORTS_SQL, GEO_SQL))
def q_report_airport(spark, sf):
    """The ten busiest origins of the normalised airport join."""
    from ..sources.flights import airports
    geo = relate.join_airports_normalized(derived(spark, sf), airports(spark, sf))
    s = relate.airport_summary_pct(geo)
    top = s.orderBy(F.desc("flight_count"), "origin", "airport_name").limit(10)
    return top.select("origin", "airport_name", "city",
                      F.format_number("flight_count", 0).alias("flights"),
                      half_away("avg_arr_delay", 1).alias("avg_arr_delay"),
                      half_away("cancellation_pct", 2).alias("cancel_pct"), "flight_count")


@query("carrier_bars", _sql("""
  SELECT op_unique_carrier AS carrier, round_even(avg(arr_delay) * 100.0, 0) / 100.0 + 0.0
         AS avg_arr_delay, avg(arr_delay) > 0 AS positive FROM flights GROUP BY 1"""))
def q_carrier_bars(spark, sf):
    """Bar heights by carrier with the sign flag used for the bar colour."""
    a = relate.delay_by_carrier(flights(spark, sf))
    return a.select("carrier", "avg_arr_delay", (F.col("avg_arr_delay") > 0).alias("positive"))
