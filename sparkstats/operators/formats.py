"""Labels from a format table.

A value format is a table (value, label), a range format a table of bands (lower bound,
upper bound, label): a band holds its lower bound and ends before its upper one, a
null bound is open. Bands must not overlap, so the only band that can hold a value is the
one with the greatest lower bound at or below it. The distinct values and the bands are put
into one order by range partitions, a running "last band" inside each partition and the last band of the
partitions before it give every value its band, and the labelled values meet the rows by an
equi-join. A value is compared with one band, whatever their number, and the sort grows
with the distinct values and the bands.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .linear import with_neighbors
from .ordered import in_order
from .relate import small_side


def with_cell(df: DataFrame, col: str, out: str, edges: list) -> DataFrame:
    """``df`` with ``out``, how many of the ascending ``edges`` are at or below the value ``col`` (binary
    search in the JVM); null for null and NaN."""
    finite = sorted({float(e) + 0.0 for e in edges if float(e) > float("-inf")}) or [0.0]
    value = F.col(col).cast("double") + 0.0  # one zero
    known = df.withColumn("_v", F.when(~F.isnan(value), value))
    cells = Bucketizer(splits=[float("-inf"), *finite, float("inf")], inputCol="_w", outputCol="_cell_of", handleInvalid="keep")
    placed = cells.transform(known.withColumn("_w", F.coalesce("_v", F.lit(0.0))))
    return placed.withColumn(out, F.when(F.col("_v").isNotNull(), F.col("_cell_of").cast("int"))).drop("_v", "_w", "_cell_of")


def checked_bands(bands: DataFrame, lower: str, upper: str, label: str) -> DataFrame:
    """Bands as doubles ``lo, hi, label``, stored; raises if two overlap or one is empty or reversed."""
    table = materialize(bands.select(F.coalesce(F.col(lower).cast("double"), F.lit(float("-inf"))).alias("lo"),
                                     F.coalesce(F.col(upper).cast("double"), F.lit(float("inf"))).alias("hi"),
                                     F.col(label).alias("label")), "bands")
    odd = table.where(F.isnan("lo") | F.isnan("hi") | (F.col("lo") >= F.col("hi"))).first()
    if odd is not None:
        raise ValueError(f"band {odd['label']!r} holds nothing: {odd['lo']} to {odd['hi']}")
    after = with_neighbors(table, "lo", ["lo", "label"])
    clash = after.where(F.col("next_lo") < F.col("hi")).first()
    if clash is not None:
        raise ValueError(f"bands {clash['label']!r} and {clash['next_label']!r} overlap")
    return table


def range_format(df: DataFrame, col: str, bands: DataFrame, out: str, default: str | None = None, lower: str = "lo", upper: str = "hi",
                 label: str = "label") -> DataFrame:
    """``df`` with ``out``, the label of the band that holds ``col``; null for a null or NaN value, ``default`` for
    a value in no band."""
    table = checked_bands(bands, lower, upper, label)
    total = table.count()
    if not total:
        return df.withColumn(out, F.when(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")), F.lit(default)))
    value = F.col(col).cast("double")
    rows = df.withColumn("_value", F.when(~F.isnan(value), value + 0.0))  # one zero
    values = rows.select("_value").where(F.col("_value").isNotNull()).distinct()
    held = F.struct(F.col("hi").alias("hi"), F.col("label").alias("label"))
    points = (values.select(F.col("_value").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(table.select(held.alias("b")).schema[0].dataType).alias("band"))
              .unionByName(table.select((F.col("lo") + 0.0).alias("at"), F.lit(0).alias("kind"), held.alias("band"))))
    points = in_order(points, ["at", "kind"], "band_points")
    running = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = points.groupBy("_part").agg(F.max_by("band", F.when(F.col("kind") == 0, F.col("_seq"))).alias("end"))  # a row a partition
    before = parts.select("_part", F.last("end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("entry"))
    met = points.withColumn("own", F.last("band", ignorenulls=True).over(running)).where(F.col("kind") == 1).join(F.broadcast(before), "_part")
    band = F.coalesce("own", "entry")
    # an open upper end holds positive infinity as well
    inside = (F.col("at") < band["hi"]) | (band["hi"] == float("inf"))
    found = materialize(met.where(inside).select(F.col("at").alias("_at"), band["label"].alias("_label")), "band_values")
    joined = rows.join(small_side(found), F.col("_value") == F.col("_at"), "left")
    label_of = F.col("_label") if default is None else F.coalesce("_label", F.when(F.col("_value").isNotNull(), F.lit(default)))
    return joined.withColumn(out, label_of).drop("_value", "_at", "_label")


def value_format(df: DataFrame, col: str, table: DataFrame, out: str, default: str | None = None, value: str = "value", label: str = "label") -> DataFrame:
    """``df`` with ``out``, the label of the value ``col``; null stays null, an unlisted value gets ``default``. Raises if
    the table lists a value twice."""
    listed = materialize(table.select(F.col(value).alias("_value"), F.col(label).alias("_label")).where(F.col("_value").isNotNull()), "value_format")
    twice = listed.groupBy("_value").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"the format lists {twice['_value']!r} {twice['count']} times")
    joined = df.join(small_side(listed), F.col(col) == F.col("_value"), "left")
    found = F.col("_label") if default is None else F.coalesce("_label", F.when(F.col(col).isNotNull(), F.lit(default)))
    return joined.withColumn(out, found).drop("_value", "_label")
