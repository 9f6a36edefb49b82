"""The country-indicator chain: merge five indicators with the income group,
drop incomplete rows, standardise, encode the ordered class, check the
discriminant-analysis assumptions and fit the discriminant model."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode
from ..sources.io import read_csv_table

# Indicator files and their column names, and the class order.
INDICATORS = [("GDP_per_capita.csv", "GDP_per_capita"),
              ("Unemployment.csv", "Unemployment_rate"),
              ("Inflation_CPI.csv", "Inflation_CPI"),
              ("Life_expectancy.csv", "Life_expectancy"),
              ("School_enrollment.csv", "School_enrollment")]
INDICATOR_COLS = [c for _, c in INDICATORS]
INCOME_ORDER = ["Low income", "Lower middle income", "Upper middle income", "High income"]
KEYS = ["Country Name", "Country Code"]


def merge_indicators(spark: SparkSession, datasets_dir: str) -> DataFrame:
    """Inner equi-join fold on (name, code); ``2022`` renamed per indicator."""
    income = read_csv_table(spark, os.path.join(datasets_dir, "Income_group.csv")).select(
        *KEYS, "Income group")
    frames = [income]
    for f, name in INDICATORS:
        d = read_csv_table(spark, os.path.join(datasets_dir, f),
                           "`Country Name` string, `Country Code` string, `2022` double")
        frames.append(d.select(*KEYS, F.col("2022").alias(name)))
    merged = reduce(lambda a, b: a.join(b, on=KEYS, how="inner"), frames)
    return merged.select(*KEYS, *INDICATOR_COLS, "Income group")


def processed(merged: DataFrame) -> DataFrame:
    """C1, E4 (population std) and E3 (ordered class code, -1 unknown)."""
    clean = merged.dropna()
    scaled = encode.standard_scale(clean, INDICATOR_COLS, ddof=0)
    return scaled.withColumn("Income_group_encoded",
                             encode.ordinal_encode("Income group", INCOME_ORDER))

