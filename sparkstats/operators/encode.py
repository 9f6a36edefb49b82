"""Feature encoding and scaling (E*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import prefix_sums
from .relate import small_side


#: A one-hot encoding has a column per level; beyond this many it is refused.
MAX_LEVELS = 2000


def levels(df: DataFrame, col: str, most: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null levels: a schema decision, so it is collected.

    Only for the one-hot case, whose column count equals this list anyway; no more
    than ``most`` + 1 of them are ever fetched.
    """
    found = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct()
             .limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} levels: sparse.sparse_one_hot or label_encode fits it, one_hot does not")
    return sorted(found)


def one_hot(df: DataFrame, cols, drop_first: bool = True) -> DataFrame:
    """0/1 column ``<col>_<level>`` per level (first sorted level dropped);
    the source column is replaced; a null row is all 0."""
    out = df
    for c in cols:
        lv = levels(df, c)
        keep = lv[1:] if drop_first else lv
        out = out.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"),
                                                       F.lit(0)) for v in keep}).drop(c)
    return out


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """E2 fitted encoder: (value, code) with 0-based codes in sorted string order.

    Codes are prefix counts over the distinct values (bucketed, no global
    window), so the encoder scales with the number of levels.
    """
    d = (df.select(F.col(col).cast("string").alias("_v")).where(F.col("_v").isNotNull())
           .distinct().withColumn("_one", F.lit(1)))
    r = prefix_sums(d, [], "_v", ["_one"])
    return r.select(F.col("_v").alias(col), F.col("_one_before").cast("int").alias("code"))


def label_encode(df: DataFrame, cols) -> DataFrame:
    """Replace each column by its code (string order). The levels of all columns
    come from one pass and one aggregate; the codes are one table, joined per column."""
    cols = list(cols)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in cols]))
    found = df.select(pairs.alias("_p")).select("_p.*").where(F.col("_v").isNotNull()).distinct()
    ranked = prefix_sums(found.withColumn("_one", F.lit(1)), ["_c"], "_v", ["_one"])
    codes = materialize(ranked.select("_c", F.col("_v").alias("_lv"), F.col("_one_before").cast("int").alias("_code")), "codes")
    out = df
    for c in cols:
        enc = small_side(codes.where(F.col("_c") == c).select("_lv", "_code"))
        out = (out.join(enc, F.col(c).cast("string") == F.col("_lv"), "left")
                  .withColumn(c, F.col("_code")).drop("_lv", "_code"))
    return out


def ordinal_encode(col, order, unknown: int = -1):
    """Code by position in a given category order; unknown or null -> -1."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(m[c], F.lit(unknown))


def scaler_table(df: DataFrame, cols, ddof: int = 0) -> dict:
    """E4/E5/E7 fitted scaler: {column: (mean, std)} from one aggregate; a zero
    or undefined std becomes 1. Small fitted state, inlined as literals."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"_m{i}"), sd(c).alias(f"_s{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        s = r[f"_s{i}"]
        out[c] = (r[f"_m{i}"], 1.0 if s is None or s == 0 else s)
    return out


def apply_scaler(df: DataFrame, table: dict, cols) -> DataFrame:
    """Apply a fitted scaler: (x - mean) / std with literal constants."""
    return df.withColumns({c: (F.col(c) - F.lit(table[c][0]).cast("double"))
                           / F.lit(table[c][1]).cast("double") for c in cols})


def standard_scale(df: DataFrame, cols, ddof: int = 0) -> DataFrame:
    """E4 (population std, ddof=0) / E5 (sample std, ddof=1)."""
    cols = [c for c in cols if c in df.columns]
    return apply_scaler(df, scaler_table(df, cols, ddof), cols)


# The encoding and scaling column lists of the interactive analysis.
OHE_COLS = ["op_unique_carrier"]
LABEL_ENC_COLS = ["origin", "dest"]
NUMERIC_FEATURES = ["dep_delay", "arr_delay", "distance", "air_time", "carrier_delay",
                    "weather_delay", "nas_delay", "late_aircraft_delay"]


def encode(df: DataFrame) -> DataFrame:
    """E1 then E2."""
    return label_encode(one_hot(df, OHE_COLS), LABEL_ENC_COLS)


def build_features(df: DataFrame) -> DataFrame:
    """E1, E2, then E4 on the numeric features that are present. The scaler is fitted before
    the encoding, which leaves these features and the rows as they are: its pass joins nothing."""
    cols = [c for c in NUMERIC_FEATURES if c in df.columns]
    scale = scaler_table(df, cols, ddof=0)
    return apply_scaler(encode(df), scale, cols)
