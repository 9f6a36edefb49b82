"""Queries of the flight analysis: joins, grouped summaries, reports, subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derive, labels
from ..functions.rounding import sql_half_away, sql_half_even
from ..operators import relate
from ..sources.flights import AIRPORTS_SQL, CAUSES, FLIGHTS_SQL, airports, flights
from .catalog import query


def _sql(body: str, *ctes: str) -> str:
    """Oracle text: the view CTEs, then ``body`` (which may open with
    ``, name AS (...)`` to add CTEs of its own)."""
    return "WITH " + ",\n".join([FLIGHTS_SQL, *ctes]) + "\n" + body


def HE(expr, d=2):
    return sql_half_even(expr, d)


def HA(expr, d=2):
    return sql_half_away(expr, d)


def merged(spark, sf):
    return relate.join_airports(flights(spark, sf), airports(spark, sf))


def derived(spark, sf, raw: str | None = None):
    """Flights with all derived columns; ``raw`` names a copy of the arrival delay
    as it was before its nulls are filled."""
    f = flights(spark, sf)
    return derive.derive_flights(f.withColumn(raw, F.col("arr_delay")) if raw else f)


DIM_SQL = """dim AS (
  SELECT IATA, Name AS origin_airport_name, City AS origin_city,
         Country AS origin_country, Latitude AS origin_lat, Longitude AS origin_lon
  FROM airports WHERE IATA IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY IATA
                             ORDER BY Name, City, Country, Latitude, Longitude) = 1
), merged AS (
  SELECT f.*, d.* EXCLUDE (IATA) FROM flights f JOIN dim d ON f.origin = d.IATA
)"""

AIRPORT_SUMMARY_SQL = f"""airport_stats AS (
  SELECT origin, origin_airport_name, origin_city, origin_lat, origin_lon,
         count(arr_delay) AS flight_count,
         {HE('avg(arr_delay)', 3)} AS avg_arr_delay,
         {HE('avg(dep_delay)', 3)} AS avg_dep_delay,
         {HE('avg(cancelled)', 3)} AS cancellation_rate
  FROM merged
  WHERE origin IS NOT NULL AND origin_airport_name IS NOT NULL AND origin_city IS NOT NULL
    AND origin_lat IS NOT NULL AND origin_lon IS NOT NULL
  GROUP BY origin, origin_airport_name, origin_city, origin_lat, origin_lon
)"""


# --- the flagship: busiest airports inside the map box -----------------------

def geo_top_airports(spark, sf, n=20):
    stats = relate.airport_summary(merged(spark, sf))
    in_box = stats.where(derive.bbox_filter("origin_lat", "origin_lon"))
    return relate.top_k(in_box, [F.desc("flight_count"), F.asc("origin")], n).select(
        "origin", "origin_airport_name", "origin_city", "flight_count",
        "avg_arr_delay", "cancellation_rate")


query("geo_top_airports", _sql(
    """SELECT origin, origin_airport_name, origin_city, flight_count, avg_arr_delay,
              cancellation_rate
       FROM airport_stats
       WHERE origin_lon BETWEEN -170 AND -60 AND origin_lat BETWEEN 15 AND 72
       ORDER BY flight_count DESC, origin LIMIT 20""",
    AIRPORTS_SQL, DIM_SQL, AIRPORT_SUMMARY_SQL))(geo_top_airports)


@query("airport_summary", _sql("SELECT * FROM airport_stats", AIRPORTS_SQL, DIM_SQL,
                               AIRPORT_SUMMARY_SQL))
def q_airport_summary(spark, sf):
    return relate.airport_summary(merged(spark, sf))


@query("airport_map_points", _sql(
    """, boxed AS (
         SELECT * FROM airport_stats
         WHERE origin_lon BETWEEN -170 AND -60 AND origin_lat BETWEEN 15 AND 72),
       b AS (SELECT min(avg_arr_delay) AS dmin, max(avg_arr_delay) AS dmax,
                    max(flight_count) AS cmax FROM boxed),
       top5 AS (SELECT origin FROM boxed ORDER BY flight_count DESC, origin LIMIT 5)
    SELECT x.origin, x.origin_lon, x.origin_lat, x.avg_arr_delay, x.flight_count,
           CAST(x.flight_count AS DOUBLE) / b.cmax * 300 + 10 AS marker_size,
           (x.avg_arr_delay - b.dmin) / nullif(b.dmax - b.dmin, 0) AS color_pos,
           x.origin IN (SELECT origin FROM top5) AS labelled
    FROM boxed x CROSS JOIN b""",
    AIRPORTS_SQL, DIM_SQL, AIRPORT_SUMMARY_SQL), rounded=["marker_size", "color_pos"])
def q_airport_map_points(spark, sf):
    """Map points, marker size and colour position, top-5 labels."""
    boxed = relate.airport_summary(merged(spark, sf)).where(
        derive.bbox_filter("origin_lat", "origin_lon"))
    bounds = boxed.agg(F.min("avg_arr_delay").alias("dmin"),
                       F.max("avg_arr_delay").alias("dmax"),
                       F.max("flight_count").alias("cmax"))
    top5 = relate.top_k(boxed, [F.desc("flight_count"), F.asc("origin")], 5).select(
        F.col("origin").alias("_t"), F.lit(True).alias("_lab"))
    x = boxed.crossJoin(F.broadcast(bounds)).join(
        F.broadcast(top5), F.col("origin") == F.col("_t"), "left")
    return x.select(
        "origin", "origin_lon", "origin_lat", "avg_arr_delay", "flight_count",
        (F.col("flight_count").cast("double") / F.col("cmax") * 300 + 10).alias("marker_size"),
        ((F.col("avg_arr_delay") - F.col("dmin"))
         / F.when(F.col("dmax") - F.col("dmin") != 0, F.col("dmax") - F.col("dmin"))
         ).alias("color_pos"),
        F.coalesce(F.col("_lab"), F.lit(False)).alias("labelled"))


# --- joins ------------------------------------------------------------------

@query("join_airports_dedup", _sql(
    "SELECT flight_key, origin, origin_airport_name, origin_country, origin_lat "
    "FROM merged", AIRPORTS_SQL, DIM_SQL))
def q_join_airports_dedup(spark, sf):
    """J3 rows: every flight once, enriched with its origin airport."""
    return merged(spark, sf).select("flight_key", "origin", "origin_airport_name",
                                    "origin_country", "origin_lat")


@query("join_airports_raw", _sql(
    """SELECT f.flight_key, f.origin, a.IATA, a.Name
       FROM flights f JOIN airports a ON f.origin = a.IATA""", AIRPORTS_SQL))
def q_join_airports_raw(spark, sf):
    """No de-duplication: the duplicate key fans out, the null key never joins."""
    return relate.join_airports_raw(flights(spark, sf), airports(spark, sf)).select(
        "flight_key", "origin", "IATA", "Name")


@query("join_counts", _sql(
    """, d AS (SELECT count(*) AS n FROM merged),
       r AS (SELECT count(*) AS n FROM flights f JOIN airports a ON f.origin = a.IATA)
    SELECT (SELECT count(*) FROM flights) AS flights_rows,
           (SELECT n FROM r) AS raw_join_rows, (SELECT n FROM d) AS dedup_join_rows
    """, AIRPORTS_SQL, DIM_SQL))
def q_join_counts(spark, sf):
    """J2 vs J3 row audit (the reference's join smoke check)."""
    f = flights(spark, sf)
    a = airports(spark, sf)
    raw = relate.join_airports_raw(f, a).agg(F.count(F.lit(1)).alias("raw_join_rows"))
    ded = relate.join_airports(f, a).agg(F.count(F.lit(1)).alias("dedup_join_rows"))
    tot = f.agg(F.count(F.lit(1)).alias("flights_rows"))
    return tot.crossJoin(raw).crossJoin(ded)


GEO_SQL = """geo AS (
  SELECT f.*, a.Name AS airport_name, a.City AS origin_city, a.Country AS origin_country,
         a.Latitude AS origin_lat, a.Longitude AS origin_lon
  FROM dflights f JOIN airports a ON upper(trim(f.origin)) = upper(trim(a.IATA))
)"""


# --- the derived flights table (row-wise derivation) ---------------------------

def _derive_sql_body(src="flights"):
    season = "[" + ", ".join(str(v) for v in derive.SEASON_AVG) + "]"
    cause_fill = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in CAUSES)
    n_active = " + ".join(f"(CASE WHEN coalesce({c}, 0.0) > 0 THEN 1 ELSE 0 END)"
                          for c in CAUSES)
    four = derive.FOUR_CAUSES
    mx = f"greatest({', '.join(four)})"
    prim = (f"CASE WHEN {mx} IS NULL OR {mx} <= 0 THEN 'None' "
            + " ".join(f"WHEN {mx} = {c} THEN '{lab}'" for c, lab in derive.PRIMARY_CAUSES)
            + " END")
    total = (f"CASE WHEN coalesce({', '.join(four)}) IS NOT NULL THEN "
             + " + ".join(f"coalesce({c}, 0.0)" for c in four) + " END")
    return f"""d1 AS (
  SELECT * REPLACE ({cause_fill}),
         CAST({n_active} AS INTEGER) AS n_active_causes,
         CASE WHEN month BETWEEN 1 AND 12 THEN ({season})[month] END AS seasonal_benchmark
  FROM {src}
), d2 AS (
  SELECT *,
         {HA('dep_delay - seasonal_benchmark', 1)} AS delay_vs_seasonal,
         CASE WHEN seasonal_benchmark IS NOT NULL
              THEN coalesce(CAST(dep_delay > seasonal_benchmark AS INTEGER), 0) END
           AS above_seasonal_avg
  FROM d1
), d3 AS (
  SELECT * REPLACE (coalesce(dep_delay, 0.0) AS dep_delay,
                    coalesce(arr_delay, 0.0) AS arr_delay,
                    coalesce(CASE WHEN trim(cancellation_code) <> ''
                                  THEN trim(cancellation_code) END, 'N') AS cancellation_code)
  FROM d2
), dflights AS (
  SELECT *,
    CASE WHEN cancelled = 1 THEN 'Cancelled' WHEN dep_delay >= 60 THEN 'Severe'
         WHEN dep_delay >= 16 THEN 'Moderate' WHEN dep_delay > 0 THEN 'Minor'
         ELSE 'On Time' END AS flight_status,
    {prim} AS primary_cause,
    CAST(day_of_week IN (6, 7) AS INTEGER) AS is_weekend,
    ln(arr_delay + greatest(0.0, -arr_delay) + 1) AS log_arr_delay,
    {total} AS total_cause_delay,
    concat_ws('-', CASE WHEN trim(origin) <> '' THEN trim(origin) END,
                   CASE WHEN trim(dest) <> '' THEN trim(dest) END) AS route,
    abs(arr_delay) AS abs_arr_delay,
    {HA('dep_delay / greatest(distance, 1.0)', 3)} AS delay_per_mile,
    CAST(dep_delay <= 0 AND cancelled = 0 AS INTEGER) AS on_time_flag,
    make_date(2024, month, 1) AS month_start,
    last_day(make_date(2024, month, 1)) AS month_end,
    CAST(make_date(2024, month, 1) + INTERVAL 1 MONTH AS DATE) AS next_month,
    CAST(quarter(make_date(2024, month, 1)) AS INTEGER) AS quarter,
    CAST(day(last_day(make_date(2024, month, 1))) AS INTEGER) AS days_in_month,
    CAST(quarter(make_date(2024, month, 1)) IN (2, 3) AS INTEGER) AS is_peak_season,
    CAST(make_timestamp(2024, month, 1, 12, 0, 0) AS DATE) AS month_date
  FROM d3
)"""


DERIVE_SQL = _derive_sql_body()


def _dsql(body, *ctes):
    return _sql(body, DERIVE_SQL, *ctes)


@query("derive_flights", _dsql("SELECT * FROM dflights"), rounded=["log_arr_delay"],
       digits=9)
def q_derive_flights(spark, sf):
    """Every derived column of the row-wise step, all rows."""
    return derived(spark, sf)


@query("value_labels", _sql(f"""
  SELECT flight_key,
    coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in labels.CARRIER_NAMES.items())}}}[op_unique_carrier], 'Other') AS carrier_name,
    MAP {{{', '.join(f"{k}: '{v}'" for k, v in labels.MONTH_NAMES.items())}}}[month] AS month_name,
    MAP {{{', '.join(f"{k}: '{v}'" for k, v in labels.DAY_NAMES.items())}}}[day_of_week] AS day_name,
    MAP {{{', '.join(f"'{k}': '{v}'" for k, v in labels.CANCEL_REASONS.items())}}}[cancellation_code] AS cancel_reason,
    MAP {{{', '.join(f"'{k}': '{v}'" for k, v in labels.STATUS_LABELS.items())}}}[flight_status] AS status_label,
    CASE WHEN dep_delay < 0 THEN 'Early' WHEN dep_delay >= 0 AND dep_delay < 16 THEN 'On Time / Minor'
         WHEN dep_delay >= 16 AND dep_delay < 60 THEN 'Moderate' WHEN dep_delay >= 60 THEN 'Severe'
         END AS dep_band,
    CASE WHEN a < 0 THEN 'Early' WHEN a >= 0 AND a < 16 THEN 'On Time / Minor'
         WHEN a >= 16 AND a < 60 THEN 'Moderate' WHEN a >= 60 THEN 'Severe' END AS raw_arr_band
  FROM dflights""", "fraw AS (SELECT *, arr_delay AS a FROM flights)", _derive_sql_body("fraw")))
def q_value_labels(spark, sf):
    """Formatted labels; the raw arrival delay keeps its nulls unlabelled."""
    d = derived(spark, sf, "raw_arr_delay")
    return d.select(
        "flight_key",
        labels.value_label("op_unique_carrier", labels.CARRIER_NAMES, "Other").alias("carrier_name"),
        labels.value_label("month", labels.MONTH_NAMES).alias("month_name"),
        labels.value_label("day_of_week", labels.DAY_NAMES).alias("day_name"),
        labels.value_label("cancellation_code", labels.CANCEL_REASONS).alias("cancel_reason"),
        labels.value_label("flight_status", labels.STATUS_LABELS).alias("status_label"),
        labels.range_label("dep_delay").alias("dep_band"),
        labels.range_label("raw_arr_delay").alias("raw_arr_band"))


# --- grouped summaries (interactive analysis: pandas rounding) ------------------

@query("delay_by_carrier", _sql(f"""
  SELECT op_unique_carrier AS carrier, count(arr_delay) AS flight_count,
         {HE('avg(arr_delay)')} AS avg_arr_delay, {HE('avg(dep_delay)')} AS avg_dep_delay,
         {HE('avg(cancelled)')} AS cancellation_rate, {HE('avg(distance)')} AS avg_distance
  FROM flights GROUP BY op_unique_carrier"""))
def q_delay_by_carrier(spark, sf):
    """A1."""
    return relate.delay_by_carrier(flights(spark, sf))


@query("delay_by_origin", _sql(f"""
  SELECT origin, count(arr_delay) AS flight_count,
         {HE('avg(arr_delay)')} AS avg_arr_delay, {HE('avg(dep_delay)')} AS avg_dep_delay,
         {HE('avg(cancelled)')} AS cancellation_rate
  FROM flights GROUP BY origin ORDER BY flight_count DESC, origin LIMIT 20"""))
def q_delay_by_origin(spark, sf):
    """A2."""
    return relate.delay_by_origin(flights(spark, sf), 20)


@query("delay_by_month", _sql(f"""
  SELECT month, count(dep_delay) AS flight_count,
         {HE('avg(dep_delay)')} AS avg_dep_delay, {HE('avg(arr_delay)')} AS avg_arr_delay,
         {HE('avg(cancelled)')} AS cancellation_rate
  FROM flights GROUP BY month"""))
def q_delay_by_month(spark, sf):
    """A3."""
    return relate.delay_by_month(flights(spark, sf))


@query("delay_breakdown_by_carrier", _sql(
    "SELECT op_unique_carrier AS carrier, "
    + ", ".join(f"{HE(f'avg({c})')} AS {c}" for c in CAUSES)
    + " FROM flights GROUP BY op_unique_carrier"))
def q_delay_breakdown(spark, sf):
    """A4."""
    return relate.delay_breakdown_by_carrier(flights(spark, sf))


@query("route_stats", _sql(f"""
  SELECT origin, dest, origin_lat, origin_lon, origin_airport_name, origin_city,
         count(arr_delay) AS flight_count, {HE('avg(arr_delay)')} AS avg_arr_delay,
         {HE('avg(cancelled)')} AS cancellation_rate
  FROM merged GROUP BY ALL""", AIRPORTS_SQL, DIM_SQL))
def q_route_stats(spark, sf):
    """A5."""
    return relate.route_stats(merged(spark, sf))


# --- batch report summaries over the derived table -------------------------------

_MEANS6 = ["avg_arr_delay", "avg_dep_delay", "cancellation_pct"]


@query("carrier_summary", _dsql(
    "SELECT op_unique_carrier AS carrier, count(*) AS flight_count, "
    "avg(arr_delay) AS avg_arr_delay, avg(dep_delay) AS avg_dep_delay, "
    "avg(cancelled) * 100 AS cancellation_pct, "
    + ", ".join(f"avg({c}) AS avg_{c}" for c in CAUSES)
    + ", avg(distance) AS avg_distance FROM dflights GROUP BY op_unique_carrier"),
    rounded=_MEANS6 + [f"avg_{c}" for c in CAUSES] + ["avg_distance"])
def q_carrier_summary(spark, sf):
    """A7."""
    return relate.carrier_summary(derived(spark, sf))


@query("monthly_summary", _dsql(
    "SELECT month, count(*) AS flight_count, avg(dep_delay) AS avg_dep_delay, "
    "avg(arr_delay) AS avg_arr_delay, avg(cancelled) * 100 AS cancellation_pct "
    "FROM dflights GROUP BY month"), rounded=_MEANS6)
def q_monthly_summary(spark, sf):
    """A8."""
    return relate.monthly_summary(derived(spark, sf))


@query("airport_summary_pct", _dsql(
    """SELECT origin, airport_name, origin_city AS city, origin_lat AS lat, origin_lon AS lon,
              count(*) AS flight_count, avg(arr_delay) AS avg_arr_delay,
              avg(dep_delay) AS avg_dep_delay, avg(cancelled) * 100 AS cancellation_pct
       FROM geo GROUP BY origin, airport_name, origin_city, origin_lat, origin_lon""",
    AIRPORTS_SQL, GEO_SQL), rounded=_MEANS6)
def q_airport_summary_pct(spark, sf):
    """A9 over J4 (normalised key, no de-duplication)."""
    geo = relate.join_airports_normalized(derived(spark, sf), airports(spark, sf))
    return relate.airport_summary_pct(geo)


@query("cause_summary", _dsql(
    "SELECT op_unique_carrier AS carrier, avg(carrier_delay) AS avg_carrier, "
    "avg(weather_delay) AS avg_weather, avg(nas_delay) AS avg_nas, "
    "avg(security_delay) AS avg_security, avg(late_aircraft_delay) AS avg_late_aircraft, "
    "sum(carrier_delay) + sum(weather_delay) + sum(nas_delay) + sum(late_aircraft_delay) "
    "AS total_delay_minutes FROM dflights GROUP BY op_unique_carrier"),
    rounded=["avg_carrier", "avg_weather", "avg_nas", "avg_security", "avg_late_aircraft",
             "total_delay_minutes"])
def q_cause_summary(spark, sf):
    """A10."""
    return relate.cause_summary(derived(spark, sf))


@query("route_summary", _dsql(
    """SELECT origin, dest, count(*) AS flight_count, avg(arr_delay) AS avg_arr_delay,
              avg(dep_delay) AS avg_dep_delay, avg(cancelled) * 100 AS cancellation_pct,
              concat_ws('-', origin, dest) AS route
       FROM dflights GROUP BY origin, dest HAVING count(*) >= 50
       ORDER BY avg_arr_delay DESC, route LIMIT 30"""), rounded=_MEANS6)
def q_route_summary(spark, sf):
    """HAVING count >= 50, worst 30 routes."""
    return relate.route_summary(derived(spark, sf))


@query("subset_sizes", _dsql(
    """SELECT * FROM (VALUES (0, 'All cleaned flights'), (1, 'Severe delays (dep >= 60 min)'),
         (2, 'Cancelled flights'), (3, 'Summer (July + August)'),
         (4, 'Worst carriers (F9, AA, B6)'), (5, 'Best carriers (AS, HA)'),
         (6, 'Long-haul (distance > 1500 mi)')) AS s(pos, subset)
       JOIN (SELECT 0 AS pos, count(*) AS n FROM dflights
             UNION ALL SELECT 1, count(*) FROM dflights WHERE dep_delay >= 60 AND cancelled = 0
             UNION ALL SELECT 2, count(*) FROM dflights WHERE cancelled = 1
             UNION ALL SELECT 3, count(*) FROM dflights WHERE month IN (7, 8)
             UNION ALL SELECT 4, count(*) FROM dflights WHERE op_unique_carrier IN ('F9', 'AA', 'B6')
             UNION ALL SELECT 5, count(*) FROM dflights WHERE op_unique_carrier IN ('AS', 'HA')
             UNION ALL SELECT 6, count(*) FROM dflights WHERE distance > 1500 AND cancelled = 0
       ) c USING (pos)"""))
def q_subset_sizes(spark, sf):
    """U1 with P2-P5: seven labelled counts in one scan."""
    return relate.subset_sizes(derived(spark, sf), derive.subsets())
