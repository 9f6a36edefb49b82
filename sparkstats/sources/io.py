"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Types a column is tried against, narrowest first.
_GUESSES = ("int", "bigint", "double", "date", "timestamp", "boolean")


def _guessed(text: DataFrame, rows: int) -> str:
    """Schema of a table of strings: per column the narrowest type that the first
    ``rows`` rows all fit, from one aggregate; string if none does."""
    head = text.limit(rows)
    misses = [F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {t}) IS NULL")).alias(f"m{i}_{t}")
              for i, c in enumerate(text.columns) for t in _GUESSES]
    filled = [F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(text.columns)]
    r = head.agg(*misses, *filled).first()
    kinds = [next((t for t in _GUESSES if r[f"n{i}"] and not r[f"m{i}_{t}"]), "string") for i in range(len(text.columns))]
    return ", ".join(f"`{c}` {t}" for c, t in zip(text.columns, kinds))


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   encoding: str = "UTF-8", infer_rows: int | None = None) -> DataFrame:
    """CSV with a header. A declared schema is preferred; without
    one, types are inferred from the first ``infer_rows`` rows (values further down
    that do not fit become NULL), or from the whole file when None. NaN becomes
    NULL on read."""
    r = spark.read.option("header", True).option("encoding", encoding).option(
        "multiLine", False).option("quote", '"').option("escape", '"')
    if schema is None and infer_rows is not None:
        schema = _guessed(r.csv(path), infer_rows)
    if schema is not None:
        df = r.schema(schema).csv(path)
    else:
        df = r.option("inferSchema", True).csv(path)
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
                           for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def coerce_schema(df: DataFrame, types: list[str], names: list[str] | None = None
                  ) -> DataFrame:
    """Positional types (``try_cast``: unparsable -> NULL) and positional rename."""
    cols = [F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in zip(df.columns, types)]
    out = df.select(*cols, *df.columns[len(types):])
    return out.toDF(*names, *out.columns[len(names):]) if names else out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Overwrite a table (Parquet by default, CSV with header on request)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """A named intermediate table (temporary view)."""
    df.createOrReplaceTempView(name)
    return df
