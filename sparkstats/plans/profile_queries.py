"""Queries of profiling, cleaning, sampling and encoding (Q*, C*, SA*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.rounding import sql_half_even as HE
from ..operators import clean, encode, profile, sampling
from ..session import materialize
from ..sources.flights import CARRIERS, CAUSES, FLIGHT_COLUMNS, flights
from .catalog import query
from .flight_queries import DERIVE_SQL, _sql, derived

NUM = encode.NUMERIC_FEATURES
# Spark type names of the flights view columns (for the inventory oracle).
FLIGHT_TYPES = {"flight_key": "string", "op_unique_carrier": "string", "origin": "string",
                "dest": "string", "month": "int", "day_of_week": "int", "fl_date": "date",
                "cancelled": "int", "cancellation_code": "string",
                "o_orderpriority": "string",
                **{c: "double" for c in ["dep_delay", "arr_delay", "distance", "air_time",
                                         *CAUSES]}}


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@query("missing_summary", _sql(
    f"""SELECT "column", missing_count, {HE('missing_count / n * 100', 2)} AS missing_pct
    FROM ({_union([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS "
                   f"missing_count, count(*) AS n FROM flights" for c in FLIGHT_COLUMNS])})
    WHERE missing_count > 0"""))
def q_missing_summary(spark, sf):
    """Q1 on the raw flights view."""
    return profile.missing_summary(flights(spark, sf))


_NULLY = ["cancellation_code", "dep_delay", "arr_delay", "air_time", *CAUSES]


@query("missing_matrix", _sql(
    "SELECT flight_key, "
    + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in _NULLY)
    + " FROM flights ORDER BY flight_key LIMIT 500"))
def q_missing_matrix(spark, sf):
    """Q2: first 500 rows by key, columns that have nulls."""
    return profile.missing_matrix(flights(spark, sf), "flight_key", 500)


@query("column_inventory", _sql(_union([
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
    f"count(DISTINCT {c}) AS n_distinct FROM flights" for c, t in FLIGHT_TYPES.items()])))
def q_column_inventory(spark, sf):
    """Q3."""
    return profile.column_inventory(flights(spark, sf))


def _describe_sql(src, cols, by=None, nmiss=False):
    g = f"{by} AS {by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return _union([
        f"SELECT {g}'{c}' AS \"column\", count({c}) AS \"count\", avg({c}) AS mean, "
        f"stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max, "
        + (f"count(*) FILTER (WHERE {c} IS NULL) AS nmiss, " if nmiss else "")
        + f"quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS median, "
        f"quantile_cont({c}, 0.75) AS p75 FROM {src}{grp}" for c in cols])


_DESC_ROUND = ["mean", "std", "min", "max", "p25", "median", "p75"]


@query("describe_numeric", _sql(_describe_sql("flights", NUM)), rounded=_DESC_ROUND)
def q_describe_numeric(spark, sf):
    """Q4 on the raw numeric features (nulls skipped)."""
    return profile.describe(flights(spark, sf), NUM)


DERIVED_DESC = ["dep_delay", "arr_delay", "distance", "air_time", *CAUSES,
                "total_cause_delay", "log_arr_delay"]


@query("describe_derived", _sql(_describe_sql("dflights", DERIVED_DESC, nmiss=True),
                                DERIVE_SQL), rounded=_DESC_ROUND)
def q_describe_derived(spark, sf):
    """Q4 with NMISS over the derived table (eleven variables)."""
    return profile.describe(derived(spark, sf), DERIVED_DESC, with_nmiss=True)


_CARRIER_LABEL_SQL = ("coalesce(MAP {" + ", ".join(
    f"'{k}': '{v}'" for k, v in labels.CARRIER_NAMES.items())
    + "}[op_unique_carrier], 'Other')")


@query("class_means_carrier", _sql(
    _describe_sql("labelled", ["dep_delay", "arr_delay"], by="carrier_name"),
    DERIVE_SQL, f"labelled AS (SELECT *, {_CARRIER_LABEL_SQL} AS carrier_name FROM dflights)"),
    rounded=_DESC_ROUND)
def q_class_means_carrier(spark, sf):
    """Statistics by the FORMATTED carrier (unlisted codes merge into 'Other')."""
    d = derived(spark, sf).withColumn(
        "carrier_name",
        labels.value_label("op_unique_carrier", labels.CARRIER_NAMES, "Other"))
    return profile.describe(d, ["dep_delay", "arr_delay"], by=["carrier_name"])


@query("head_preview", _sql(
    "SELECT flight_key, op_unique_carrier, origin, dest, month, dep_delay, arr_delay "
    "FROM flights ORDER BY flight_key LIMIT 10"))
def q_head_preview(spark, sf):
    """Q5."""
    return profile.head(flights(spark, sf), "flight_key", 10,
                        ["flight_key", "op_unique_carrier", "origin", "dest", "month",
                         "dep_delay", "arr_delay"])


@query("kpis", _sql(
    "SELECT count(*) AS n_flights, count(DISTINCT op_unique_carrier) AS n_airlines, "
    "count(DISTINCT origin) AS n_origins, avg(dep_delay) AS avg_dep_delay FROM flights"),
    rounded=["avg_dep_delay"])
def q_kpis(spark, sf):
    """Q6 / A18."""
    return profile.kpis(flights(spark, sf))


@query("delay_shares", _sql(
    "SELECT avg(CAST(dep_delay <= 15 AS DOUBLE)) * 100 AS pct_on_time, "
    "avg(CAST(dep_delay >= 60 AS DOUBLE)) * 100 AS pct_severe, "
    "quantile_cont(dep_delay, 0.5) AS median FROM flights"),
    rounded=["pct_on_time", "pct_severe", "median"])
def q_delay_shares(spark, sf):
    """Q7."""
    return profile.delay_shares(flights(spark, sf))


@query("winsor_bounds", _sql(_union([
    f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.01) AS p_low, "
    f"quantile_cont({c}, 0.99) AS p_high FROM flights" for c in clean.NUMERIC_COLS_TO_CAP])),
    rounded=["p_low", "p_high"])
def q_winsor_bounds(spark, sf):
    """Q8."""
    return profile.winsor_bounds(flights(spark, sf), clean.NUMERIC_COLS_TO_CAP)


IMPUTED_SQL = ("imputed AS (SELECT * REPLACE (coalesce(cancellation_code, 'N') AS "
               "cancellation_code, "
               + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in CAUSES)
               + ", coalesce(dep_delay, (SELECT quantile_cont(dep_delay, 0.5) FROM flights))"
               " AS dep_delay, coalesce(arr_delay, (SELECT quantile_cont(arr_delay, 0.5) "
               "FROM flights)) AS arr_delay, coalesce(air_time, 0.0) AS air_time) "
               "FROM flights WHERE "
               + " AND ".join(f"{c} IS NOT NULL" for c in FLIGHT_COLUMNS
                              if c not in ("cancellation_code", "dep_delay", "arr_delay",
                                           "air_time", *CAUSES)) + ")")

_CAP = clean.NUMERIC_COLS_TO_CAP
CLEAN_SQL = (IMPUTED_SQL + ", bounds AS (SELECT "
             + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}"
                         for c in _CAP)
             + " FROM imputed), cleaned AS (SELECT i.* REPLACE ("
             + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest(CAST({c} AS DOUBLE), "
                         f"lo_{c}), hi_{c}) END AS {c}" for c in _CAP)
             + ") FROM imputed i CROSS JOIN bounds)")


@query("handle_missing", _sql("SELECT * FROM imputed", IMPUTED_SQL))
def q_handle_missing(spark, sf):
    """C5 (with C1, C3, C4) over all rows."""
    return clean.handle_missing(materialize(flights(spark, sf), "handle_missing_input"))


@query("load_clean", _sql("SELECT * FROM cleaned", CLEAN_SQL))
def q_load_clean(spark, sf):
    """C7 over the whole table: impute, then winsorize eight columns."""
    return clean.load_clean(flights(spark, sf))


@query("winsorize_flights", _sql(
    "SELECT flight_key, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS {c}"
                for c in ["dep_delay", "arr_delay", "distance"])
    + " FROM flights CROSS JOIN (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}"
                for c in ["dep_delay", "arr_delay", "distance"]) + " FROM flights)"))
def q_winsorize_flights(spark, sf):
    """C6 alone on the raw view: nulls stay null."""
    f = flights(spark, sf).select("flight_key", "dep_delay", "arr_delay", "distance")
    return clean.winsorize(f, ["dep_delay", "arr_delay", "distance"])


@query("fill_median_zero", _sql(
    "SELECT flight_key, coalesce(dep_delay, 0.0) AS dep_delay, "
    "coalesce(arr_delay, 0.0) AS arr_delay FROM flights"))
def q_fill_median_zero(spark, sf):
    """C4 with strategy='zero' (the batch variant)."""
    f = flights(spark, sf).select("flight_key", "dep_delay", "arr_delay")
    return clean.fill_median(f, ["dep_delay", "arr_delay"], strategy="zero")


@query("sample_exact", _sql(
    "SELECT * FROM flights ORDER BY md5('42:' || flight_key), flight_key LIMIT 5000"))
def q_sample_exact(spark, sf):
    """SA1: exactly 5000 rows (or all if fewer), seed 42, key flight_key."""
    return sampling.sample_exact(flights(spark, sf), 5000, "flight_key", 42)


@query("stratified_split", _sql(
    """SELECT flight_key, cancelled,
         CAST(row_number() OVER (PARTITION BY cancelled ORDER BY md5('42:' || flight_key)
                                 || ':' || flight_key) - 1
              < floor(count(*) OVER (PARTITION BY cancelled) * 0.8 + 0.5) AS INTEGER) AS is_train
       FROM flights"""))
def q_stratified_split(spark, sf):
    """SA2: 80/20 split keeping the cancelled ratio."""
    f = flights(spark, sf).select("flight_key", "cancelled")
    return sampling.stratified_split(f, "cancelled", "flight_key", 0.8, 42)


_CARRIER_LEVELS = sorted(CARRIERS)


@query("one_hot_carrier", _sql(
    "SELECT flight_key, "
    + ", ".join(f"CAST(coalesce(op_unique_carrier = '{v}', false) AS INTEGER) "
                f"AS op_unique_carrier_{v}" for v in _CARRIER_LEVELS[1:])
    + " FROM flights"))
def q_one_hot_carrier(spark, sf):
    """First sorted level dropped."""
    return encode.one_hot(flights(spark, sf).select("flight_key", "op_unique_carrier"),
                          ["op_unique_carrier"])


@query("label_encode_airports", _sql(
    """SELECT flight_key,
              CAST(dense_rank() OVER (ORDER BY origin) - 1 AS INTEGER) AS origin,
              CAST(dense_rank() OVER (ORDER BY dest) - 1 AS INTEGER) AS dest
       FROM flights"""))
def q_label_encode(spark, sf):
    """0-based codes in sorted order."""
    return encode.label_encode(flights(spark, sf).select("flight_key", "origin", "dest"),
                               ["origin", "dest"])


# Fixed order for the ordinal example; '5-LOW' is left out to exercise unknown = -1.
PRIORITY_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("ordinal_encode_priority", _sql(
    "SELECT flight_key, coalesce(MAP {"
    + ", ".join(f"'{v}': {i}" for i, v in enumerate(PRIORITY_ORDER))
    + "}[o_orderpriority], -1) AS priority_code FROM flights"))
def q_ordinal_encode(spark, sf):
    """E3."""
    f = flights(spark, sf)
    return f.select("flight_key",
                    encode.ordinal_encode("o_orderpriority", PRIORITY_ORDER).alias(
                        "priority_code"))


def _scaled_sql(src, ddof=0):
    sd = "stddev_pop" if ddof == 0 else "stddev_samp"
    st = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN coalesce({sd}({c}), 0) = 0 THEN 1.0 "
                   f"ELSE {sd}({c}) END AS s_{c}" for c in NUM)
    return (f"st AS (SELECT {st} FROM {src}), scaled AS (SELECT x.* REPLACE ("
            + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in NUM)
            + f") FROM {src} x CROSS JOIN st)")


@query("scaling_summary", _sql(_union([
    f"SELECT '{c}' AS \"column\", {HE(f'(SELECT avg({c}) FROM cleaned)', 3)} AS mean_before, "
    f"{HE(f'(SELECT stddev_samp({c}) FROM cleaned)', 3)} AS std_before, "
    f"{HE(f'(SELECT avg({c}) FROM scaled)', 6)} AS mean_after, "
    f"{HE(f'(SELECT stddev_samp({c}) FROM scaled)', 6)} AS std_after" for c in NUM]),
    CLEAN_SQL, _scaled_sql("cleaned")))
def q_scaling_summary(spark, sf):
    """Q9 + E4: population-std scaling of the cleaned numeric features."""
    before = clean.load_clean(flights(spark, sf))
    after = encode.standard_scale(before, NUM, ddof=0)
    return profile.scaling_summary(before, after, NUM)


@query("scaling_check", _sql(_union([
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"abs(avg({c})) < 0.01 AS mean_ok, stddev_samp({c}) > 0.99 AND stddev_samp({c}) < 1.01 "
    f"AS std_ok FROM scaled" for c in NUM]), CLEAN_SQL, _scaled_sql("cleaned", ddof=1)),
    rounded=["mean", "std"])
def q_scaling_check(spark, sf):
    """Q10 + E5: sample-std scaling passes the |mean| < .01, .99 < std < 1.01 check."""
    scaled = encode.standard_scale(clean.load_clean(flights(spark, sf)), NUM, ddof=1)
    return profile.scaling_check(scaled, NUM)


@query("build_features", _sql(
    "SELECT * EXCLUDE (op_unique_carrier) REPLACE ("
    "CAST(dense_rank() OVER (ORDER BY origin) - 1 AS INTEGER) AS origin, "
    "CAST(dense_rank() OVER (ORDER BY dest) - 1 AS INTEGER) AS dest), "
    + ", ".join(f"CAST(coalesce(op_unique_carrier = '{v}', false) AS INTEGER) "
                f"AS op_unique_carrier_{v}" for v in _CARRIER_LEVELS[1:])
    + " FROM scaled", CLEAN_SQL, _scaled_sql("cleaned")), rounded=NUM, digits=9)
def q_build_features(spark, sf):
    """One-hot, label codes, population-std scaling on the cleaned table."""
    return encode.build_features(clean.load_clean(flights(spark, sf)))


@query("encoding_summary", _sql(
    _union([f"SELECT 'op_unique_carrier_{v}' AS \"column\", 'one-hot (new)' AS type, "
            f"count(DISTINCT CAST(op_unique_carrier = '{v}' AS INTEGER)) AS unique_values "
            f"FROM flights" for v in _CARRIER_LEVELS[1:]]
           + [f"SELECT '{c}' AS \"column\", 'label-encoded' AS type, count(DISTINCT {c}) "
              f"AS unique_values FROM flights" for c in encode.LABEL_ENC_COLS])))
def q_encoding_summary(spark, sf):
    """Q11."""
    f = flights(spark, sf)
    return profile.encoding_summary(f, encode.encode(f), encode.LABEL_ENC_COLS)


@query("row_audit", _sql(
    f"""SELECT step, stage, rows, columns, (SELECT count(*) FROM flights) - rows AS rows_removed
    FROM (SELECT 0 AS step, 'raw' AS stage, (SELECT count(*) FROM flights) AS rows,
                 {len(FLIGHT_COLUMNS)} AS columns
          UNION ALL SELECT 1, 'complete cases', (SELECT count(*) FROM flights WHERE
                 {' AND '.join(f'{c} IS NOT NULL' for c in FLIGHT_COLUMNS)}), {len(FLIGHT_COLUMNS)}
          UNION ALL SELECT 2, 'imputed', (SELECT count(*) FROM imputed), {len(FLIGHT_COLUMNS)})""",
    IMPUTED_SQL))
def q_row_audit(spark, sf):
    """Q12: shapes before / after each cleaning step."""
    f = materialize(flights(spark, sf), "audit_input")
    return profile.row_audit([("raw", f), ("complete cases", clean.drop_missing_rows(f)),
                              ("imputed", clean.handle_missing(f))])
