"""Rounding with the two conventions of the reference, as binary arithmetic.

``half_even`` is numpy's / pandas' ``round``: scale, round-half-even on the
binary product (``rint``), unscale. ``half_away`` is SAS ``ROUND``. Both are
written as IEEE operations, so any engine that evaluates the same operations
(DuckDB in the oracle) gets bit-identical results, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(col, digits: int = 2) -> Column:
    s = float(10 ** digits)
    # "+ 0.0" turns a rounded -0.0 into 0.0 (IEEE), identically in both engines.
    return F.rint(_c(col).cast("double") * s) / s + 0.0


def half_away(col, digits: int = 2) -> Column:
    s = float(10 ** digits)
    x = _c(col).cast("double")
    return F.signum(x) * F.floor(F.abs(x) * s + 0.5) / s + 0.0


# SQL text twins (DuckDB dialect) for the oracle.
def sql_half_even(expr: str, digits: int = 2) -> str:
    s = repr(float(10 ** digits))
    return f"(round_even(CAST({expr} AS DOUBLE) * {s}, 0) / {s} + 0.0)"


def sql_half_away(expr: str, digits: int = 2) -> str:
    s = repr(float(10 ** digits))
    return (f"(CAST(sign(CAST({expr} AS DOUBLE)) AS DOUBLE) * "
            f"floor(abs(CAST({expr} AS DOUBLE)) * {s} + 0.5) / {s} + 0.0)")
