"""The flight-shaped view over the driver's TPC-H-like tables.

The reference analyses a flights table and an airports dimension. Neither
ships with the data, so both are derived from ``lineitem``, ``orders``,
``supplier``, ``customer``, ``nation`` and ``region`` by fixed rules, once
as a Spark plan and once as SQL text for the DuckDB oracle. Both must stay
value-for-value equal.

Join plan: ``orders`` is joined to ``customer`` first (orders is the smaller
fact table), then ``lineitem`` meets ``supplier`` and that pre-joined order
side. No side is forced to broadcast: the sizes of supplier and customer
grow with the data, so Catalyst / AQE decide from measured sizes and fall
back to a sort-merge join (with AQE skew splitting) beyond the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Carrier code by l_suppkey % 16, in this order.
CARRIERS = ["AA", "AS", "B6", "DL", "F9", "G4", "HA", "NK", "OH", "OO", "UA",
            "WN", "YV", "YX", "MQ", "9E"]
# The five delay-cause columns, numbered 0..4 in this order.
CAUSES = ["carrier_delay", "weather_delay", "nas_delay", "security_delay",
          "late_aircraft_delay"]
# Cancellation code by l_partkey % 3.
CANCEL_CODES = ["A", "B", "C"]

FLIGHT_COLUMNS = ["flight_key", "op_unique_carrier", "origin", "dest", "month",
                  "day_of_week", "fl_date", "cancelled", "cancellation_code",
                  "dep_delay", "arr_delay", "distance", "air_time", *CAUSES,
                  "o_orderpriority"]


def _code(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 2, "0"))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with planned nulls (FIXTURES.md section 5)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
               "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
               "l_shipdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    supp = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")

    order_side = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", "o_orderpriority", "c_nationkey")
    joined = (li.join(supp, li.l_suppkey == supp.s_suppkey)
                .join(order_side, li.l_orderkey == order_side.o_orderkey))

    cancelled = (F.col("l_orderkey") % 67 == 0)
    arr = F.when(~cancelled, F.col("l_quantity") * 4 - 65 + F.col("l_discount") * 100)
    # computed once: five causes, the delay itself and the air time read them
    joined = joined.withColumns({"_arr": arr, "_distance": F.round(F.col("l_extendedprice") / 20, 0)})
    joined = joined.withColumn("_half", F.floor(F.col("_arr") / 2).cast("double"))
    arr, half, distance = F.col("_arr"), F.col("_half"), F.col("_distance")

    def cause(j: int) -> Column:
        share = (F.when(F.col("l_partkey") % 5 == j, half).otherwise(F.lit(0.0))
                 + F.when(F.col("l_suppkey") % 5 == j, half).otherwise(F.lit(0.0)))
        return F.when(arr > 15, share)

    carriers = F.array(*[F.lit(c) for c in CARRIERS])
    codes = F.array(*[F.lit(c) for c in CANCEL_CODES])
    return joined.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
                    ).alias("flight_key"),
        F.element_at(carriers, (F.col("l_suppkey") % 16 + 1).cast("int")).alias(
            "op_unique_carrier"),
        _code("N", F.col("s_nationkey")).alias("origin"),
        _code("N", F.col("c_nationkey")).alias("dest"),
        F.month("l_shipdate").alias("month"),
        (F.weekday("l_shipdate") + 1).alias("day_of_week"),
        F.to_date("l_shipdate").alias("fl_date"),
        cancelled.cast("int").alias("cancelled"),
        F.when(cancelled, F.element_at(codes, (F.col("l_partkey") % 3 + 1).cast("int"))
               ).alias("cancellation_code"),
        F.when(~(cancelled & (F.col("l_linenumber") % 2 == 0)),
               F.col("l_quantity") * 4 - 60).alias("dep_delay"),
        arr.alias("arr_delay"),
        distance.alias("distance"),
        F.when(~cancelled, F.round(distance / 8 + 20, 0)).alias("air_time"),
        *[cause(j).alias(name) for j, name in enumerate(CAUSES)],
        "o_orderpriority",
    )


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airport dimension: one row per nation plus one duplicate and one null key."""
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    # nation and region are fixed-size dimensions (25 and 5 rows): safe to broadcast.
    base = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        _code("N", F.col("n_nationkey")).alias("IATA"),
        F.col("n_name").alias("Name"),
        F.col("n_name").alias("City"),
        F.col("r_name").alias("Country"),
        (F.lit(-10.0) + F.col("n_nationkey") * 4).alias("Latitude"),
        (F.lit(-180.0) + F.col("n_nationkey") * 6).alias("Longitude"),
    )
    dup = base.where(F.col("IATA") == "N03").select(
        "IATA", F.concat("Name", F.lit(" Annex")).alias("Name"), "City", "Country",
        (F.col("Latitude") + 0.5).alias("Latitude"),
        (F.col("Longitude") + 0.5).alias("Longitude"))
    nul = base.where(F.col("IATA") == "N00").select(
        F.lit(None).cast("string").alias("IATA"), F.lit("Unknown").alias("Name"),
        "City", "Country", "Latitude", "Longitude")
    return base.unionByName(dup).unionByName(nul)


# ---------------------------------------------------------------------------
# The same two views as SQL text (DuckDB dialect) for the oracle.
# ---------------------------------------------------------------------------

def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _cause_sql(j: int) -> str:
    return (f"CASE WHEN arr_delay > 15 THEN "
            f"(CASE WHEN l_partkey % 5 = {j} THEN half ELSE 0.0 END) + "
            f"(CASE WHEN l_suppkey % 5 = {j} THEN half ELSE 0.0 END) END")


FLIGHTS_SQL = f"""flights_base AS (
  SELECT l.*, s.s_nationkey, c.c_nationkey, o.o_orderpriority,
         (l.l_orderkey % 67 = 0) AS is_cancelled,
         CASE WHEN NOT (l.l_orderkey % 67 = 0)
              THEN l.l_quantity * 4 - 65 + l.l_discount * 100 END AS arr_delay,
         round(l.l_extendedprice / 20, 0) AS distance
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN customer c ON o.o_custkey = c.c_custkey
), flights_half AS (
  SELECT *, CAST(floor(arr_delay / 2) AS DOUBLE) AS half FROM flights_base
), flights AS (
  SELECT
    concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
              CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS flight_key,
    ({_sql_list(CARRIERS)})[CAST(l_suppkey % 16 AS INTEGER) + 1] AS op_unique_carrier,
    'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS origin,
    'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS dest,
    CAST(month(l_shipdate) AS INTEGER) AS month,
    CAST(isodow(l_shipdate) AS INTEGER) AS day_of_week,
    CAST(l_shipdate AS DATE) AS fl_date,
    CAST(is_cancelled AS INTEGER) AS cancelled,
    CASE WHEN is_cancelled THEN ({_sql_list(CANCEL_CODES)})[CAST(l_partkey % 3 AS INTEGER) + 1]
         END AS cancellation_code,
    CASE WHEN NOT (is_cancelled AND l_linenumber % 2 = 0)
         THEN l_quantity * 4 - 60 END AS dep_delay,
    arr_delay,
    distance,
    CASE WHEN NOT is_cancelled THEN round(distance / 8 + 20, 0) END AS air_time,
    {', '.join(f'{_cause_sql(j)} AS {name}' for j, name in enumerate(CAUSES))},
    o_orderpriority
  FROM flights_half
)"""

AIRPORTS_SQL = """airports_base AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS IATA,
         n_name AS Name, n_name AS City, r_name AS Country,
         -10.0 + 4 * n_nationkey AS Latitude, -180.0 + 6 * n_nationkey AS Longitude
  FROM nation JOIN region ON n_regionkey = r_regionkey
), airports AS (
  SELECT IATA, Name, City, Country, CAST(Latitude AS DOUBLE) AS Latitude,
         CAST(Longitude AS DOUBLE) AS Longitude FROM airports_base
  UNION ALL
  SELECT IATA, Name || ' Annex', City, Country, CAST(Latitude + 0.5 AS DOUBLE),
         CAST(Longitude + 0.5 AS DOUBLE) FROM airports_base WHERE IATA = 'N03'
  UNION ALL
  SELECT CAST(NULL AS VARCHAR), 'Unknown', City, Country, CAST(Latitude AS DOUBLE),
         CAST(Longitude AS DOUBLE) FROM airports_base WHERE IATA = 'N00'
)"""


def with_views(body: str, airports_view: bool = False, extra: str = "") -> str:
    """Prefix an oracle query with the flights (and airports) CTEs."""
    ctes = [FLIGHTS_SQL]
    if airports_view:
        ctes.append(AIRPORTS_SQL)
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body
