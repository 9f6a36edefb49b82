"""Registry of named queries: a Spark builder and, where SQL can say the same
thing, the DuckDB oracle text. Builders take (spark, sf_dir) and return a
DataFrame over the whole tables. Building one may already run jobs: fitted state
(medians, scalers, model coefficients) is inlined, and ordered or multi-pass inputs
are stored under the checkpoint folder.

``digits`` names double columns that both sides round (half-even, binary) as
a final presentation step, so tiny summation-order differences between two
engines cannot reach a value hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import half_even, sql_half_even


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rounded: dict = field(default_factory=dict)   # column -> digits

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if self.rounded:
            df = df.withColumns({c: half_even(c, d) for c, d in self.rounded.items()})
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rounded:
            return self.sql
        repl = ", ".join(f'{sql_half_even(chr(34) + c + chr(34), d)} AS "{c}"'
                         for c, d in self.rounded.items())
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql}\n) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, rounded=None, digits: int = 6):
    """Decorator: register a builder. ``rounded`` is a list of double columns
    (rounded to ``digits``) or a dict column -> digits."""
    if isinstance(rounded, (list, tuple)):
        rounded = {c: digits for c in rounded}

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, rounded or {})
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens at import)."""
    from . import (flight_queries, model_queries, more_queries, profile_queries,  # noqa: F401
                   report_queries, scale_queries, stat_queries)
    return REGISTRY
