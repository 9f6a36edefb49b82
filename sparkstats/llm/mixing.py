"""Mix sources to target weights by systematic sampling.

Sources get targets that follow their weights up to a multiple of their size;
a document's expected copies are its source's target over the source's size.
Within a source the expected copies are summed along the documents in order of
size (ties by a hash of the id), one random offset is added, and a document is
emitted once per integer boundary that its share of the sum crosses. The order
by size makes the words taken, and not only the documents, follow the target.

Defined cases: a null text has size 0; a null source is a source of its own,
after all others; empty documents take 0 words; repeated rows each get their own
share of copies; an empty table gives an empty result; further columns pass
through ``emitted`` and are ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, carrying, identity, positions, stored, text_of


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) with ``target``: ``share`` of all sizes split by
    weight, where weights repeat over the sources in code point order. A target
    above ``cap`` times its source stops there and the excess is shared again
    among the others, until none is above."""
    placed = positions(sizes.select(F.lit(0).alias("_all"), F.col("source").isNull().alias("_null"), "source", "source_size"),
                       "_all", ["_null", "source"], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = stored(placed.select("source", "source_size", weight.alias("_w")), "weights")
    limit = F.lit(float(cap)) * F.col("source_size")
    total, w_all = placed.agg(F.sum("source_size"), F.sum("_w")).first()
    total = share * (total or 0)
    spent, w_left, stopped = 0.0, w_all or 0.0, 0
    while True:  # each round is one aggregate over the sources; capped sources only grow in number
        above = (F.lit(total - spent) * F.col("_w")) / F.lit(w_left) > limit if w_left else F.lit(True)
        n, s, w = placed.agg(F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("_w")))).first()
        if n == stopped:
            break
        stopped, spent, w_left = n, s or 0.0, w or 0.0
    rest = (F.lit(total - spent) * F.col("_w")) / F.lit(w_left) if w_left else limit
    return placed.select("source", "source_size", F.when(above, limit).otherwise(rest).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
             cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target,
    copies`` and the two identity columns."""
    sized = stored(docs.select("doc_id", "source", *identity(),
                               F.regexp_count(text_of(), F.lit(SPACED_WORD)).cast("long").alias("size")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    keyed = sized.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    placed = positions(keyed, "source", ["size", "_h", "_id", "_th"], "mix")
    named = F.when(F.col("source").isNull(), F.lit(f"{seed}?")).otherwise(F.concat(F.lit(f"{seed}="), F.col("source")))
    offset = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(offset + rate * F.col("_pos")) - F.floor(offset + rate * (F.col("_pos") - 1))
    t = targets.withColumnRenamed("source", "_source")
    return (placed.join(t, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "_id", "_th", "source", "size", "source_size", "target",
                    F.least(crossed, F.ceil(rate)).cast("long").alias("copies")))


@carrying("doc_id", "text", "source")
def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: all columns of ``docs``, each document as many times as
    it is drawn, and ``copy`` (from 1). Repeated rows pool their copies."""
    drawn = mix_plan(docs, **options).groupBy("_id", "_th").agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    once = docs.select("*", *identity()).dropDuplicates(["_id", "_th"])
    return (once.join(drawn, ["_id", "_th"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .drop("_id", "_th", "_copies"))
