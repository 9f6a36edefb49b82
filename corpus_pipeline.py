"""The corpus pipeline: documents through five stages, each stored before the next.

Every stage works on all rows that the stage before it kept. A row is known by
its id and text, so that rows of equal id are judged apart and repeated rows alike.
Null and empty texts pass every stage that does not judge them bad and count 0 words
in the mix, so the last stage draws none of them; an empty table stays empty; further columns of any name pass
through (the mix's own ``copy`` replaces one of that name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstats.llm import decontaminate, line_dedup, mixing, quality, simhash
from sparkstats.llm.common import carrying, identity, read, stored

KEEP_SCORE = 0.5


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def stage(fn):
    """A stage: the columns of documents are its own, all others travel under fresh names."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return carrying(*DOCUMENT)(lambda table: fn(spark, table, sf_dir))(docs)
    run.__doc__ = fn.__doc__
    return run


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds more likely bad than good go."""
    scored = quality.scored(docs, read(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= KEEP_SCORE).select(*docs.columns)


@stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go everywhere but in the first place; of what remains, so do
    repeated passages of fewer lines or inside a line."""
    windows = stored(line_dedup.dedup_lines(docs).select(*docs.columns), "line-windows")
    out = line_dedup.dedup_passages(windows).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id (of
    several texts under that id the one of least hash, and of repeated rows one)."""
    found = stored(simhash.near_duplicates(docs), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "_id", "_th")).alias("first")
    # rows without an id have no component id of their own; their fingerprint stands in
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    kept = stored(found.groupBy(group.alias("group")).agg(first).select("first._id", "first._th"), "kept").distinct()
    rows = docs.select("*", *identity()).join(kept, ["_id", "_th"], "left_semi")
    return rows.dropDuplicates(["_id", "_th"]).select(*docs.columns)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in twenty is a benchmark's go."""
    report = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    gone = stored(report.filter("contaminated").select("_id", "_th").distinct(), "contaminated")
    return docs.select("*", *identity()).join(gone, ["_id", "_th"], "left_anti").select(*docs.columns)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per drawn copy, with its number ``copy``."""
    return mixing.emitted(docs)


STAGES = [("quality_classifier", quality_stage), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", near_dedup_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: None: neither the classifier's fit nor the fingerprints have a SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
