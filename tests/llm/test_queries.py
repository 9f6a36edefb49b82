"""Registered corpus queries against DuckDB, and the pipeline's stages on odd rows."""

from __future__ import annotations

import corpus_pipeline
import pytest
from fixtures import ODD, docs, tables
from oracle import compare, duck
from pyspark.sql import functions as F

from sparkstats.llm import queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLES[name]) > 0


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages(spark, tmp_path):
    frame = docs(spark)
    d = tables(spark, tmp_path, documents=frame,
               labels=spark.createDataFrame([(4, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int"),
               benchmark=spark.createDataFrame([(1, "garçon")], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame.withColumn("_extra", F.lit(1)), d)
        assert out.columns == [*frame.columns, "_extra"], name
        assert stage(spark, frame.limit(0), d).count() == 0
    near = corpus_pipeline.near_dedup_stage(spark, frame, d)
    assert [r.doc_id for r in near.filter("doc_id IN (4, 5)").collect()] == [4]
    assert near.filter("text IS NULL OR trim(text) = ''").count() == 1
    clean = corpus_pipeline.decontamination_stage(spark, frame, d)
    assert clean.count() == len(ODD) - 1
    assert corpus_pipeline.run(spark, d).columns[:5] == frame.columns
