"""Cleaning: missing values and extreme values (C*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.flights import CAUSES
from .ordered import multi_quantiles
from .sampling import sample_exact

# Columns of a finished flight, zero-filled when present.
COMPLETION_COLS = ["dep_time", "taxi_out", "wheels_off", "wheels_on", "taxi_in",
                   "arr_time", "actual_elapsed_time", "air_time"]
# Columns capped by the cleaning step.
NUMERIC_COLS_TO_CAP = ["dep_delay", "arr_delay", "distance", "carrier_delay",
                       "weather_delay", "nas_delay", "late_aircraft_delay", "air_time"]


def drop_missing_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop a row with any null (in ``subset`` if given)."""
    return df.dropna(how="any", subset=subset)


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    """Per-column constants for nulls; only columns present are touched."""
    present = {c: v for c, v in values.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in present.items()})


def column_quantiles(df: DataFrame, cols, probs, method: str = "exact", accuracy: int = 10_000) -> dict:
    """{column: [quantile per prob]}: exact, one bucketed pass for all columns; by ``method`` "sketch"
    one aggregate of quantile sketches with ranks within n / ``accuracy``.

    The result is len(cols) x len(probs) numbers; it is fitted state (like a
    fitted scaler) and is inlined into later plans as literals, so those plans
    stay a single projection over one scan.
    """
    names = [f"_q{i}" for i in range(len(probs))]
    rows = multi_quantiles(df, cols, probs, names, method=method, accuracy=accuracy).collect()
    out = {c: [None] * len(probs) for c in cols}
    for r in rows:
        out[r["column"]] = [r[n] for n in names]
    return out


def fill_median(df: DataFrame, cols, strategy: str = "median", method: str = "exact") -> DataFrame:
    """C4: nulls to the column median (or 0 with strategy='zero').

    The medians are fitted first (exact unless ``method`` is "sketch", distributed) and inlined as literals.
    """
    if strategy == "zero":
        return fill_constant(df, {c: 0.0 for c in cols})
    med = column_quantiles(df, cols, [0.5], method)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c][0]).cast("double"))
                           for c in cols})


#: Columns whose nulls C5 fills, by a constant or by their median.
FILLED = {"cancellation_code": "N", **{c: 0.0 for c in CAUSES}, **{c: 0.0 for c in COMPLETION_COLS}}
FILLED_BY_MEDIAN = ("dep_delay", "arr_delay")


def fillable(df: DataFrame) -> Column:
    """Whether C5 keeps a row: it drops NaN, and null where it fills none. True or false, never null."""
    keeps = F.lit(True)
    for c, kind in df.dtypes:
        if c not in FILLED and c not in FILLED_BY_MEDIAN:
            keeps = keeps & F.col(c).isNotNull()
        if kind in ("double", "float"):
            keeps = keeps & ~F.coalesce(F.isnan(c), F.lit(False))
    return keeps


def handle_missing(df: DataFrame, keeps: str | None = None) -> DataFrame:
    """Code 'N', causes 0, delays to median, completion columns 0, then drop.

    ``keeps`` names a stored column of ``fillable``, which the result loses: passes then read it in place
    of every column."""
    medians = [c for c in FILLED_BY_MEDIAN if c in df.columns]
    out = fill_median(fill_constant(df, FILLED), medians)
    if keeps is None:
        return drop_missing_rows(out)
    out = out.where(F.col(keeps)).drop(keeps)
    # a delay without any value has no median: its nulls stay, and so no row does
    empty = [c for c in medians if df.where(F.col(c).isNotNull() & ~F.isnan(c)).isEmpty()]
    return drop_missing_rows(out, empty) if empty else out


def winsorize(df: DataFrame, cols, lower: float = 0.01, upper: float = 0.99, method: str = "exact",
              accuracy: int = 10_000) -> DataFrame:
    """Clip each column at its own percentiles, exact or by ``method`` "sketch"; nulls stay null.

    All bounds come from one bucketed quantile pass over the stacked columns
    and are inlined as literals (2 numbers per column).
    """
    cols = [c for c in cols if c in df.columns]
    b = column_quantiles(df, cols, [lower, upper], method, accuracy)
    clipped = {c: F.when(F.col(c).isNotNull(),
                         F.least(F.greatest(F.col(c).cast("double"),
                                            F.lit(b[c][0]).cast("double")),
                                 F.lit(b[c][1]).cast("double")))
               for c in cols}
    return df.withColumns(clipped)


def load_clean(flights: DataFrame, n: int | None = None, key: str = "flight_key",
               seed: int = 42, materialize_input: bool = True) -> DataFrame:
    """Optional exact sample, then C5, then C6 on the capped columns.

    The input is written once to the shared checkpoint folder (four fitting
    passes follow), with a column that says which rows C5 keeps, unless the
    caller already passes a stored table.
    """
    from ..session import materialize
    base = sample_exact(flights, n, key, seed) if n is not None else flights
    keeps = None
    if materialize_input:
        keeps = "_keeps"
        while keeps in base.columns:
            keeps += "_"
        base = materialize(base.withColumn(keeps, fillable(base)), "load_clean_input")
    return winsorize(handle_missing(base, keeps), NUMERIC_COLS_TO_CAP)
