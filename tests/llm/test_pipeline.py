"""The stages of the pipeline, each fed by the one before."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF


def test_stages_keep_columns_and_their_decisions_take_effect(spark, docs):
    frame, ids = docs, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        found = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert found <= {r["doc_id"] for r in frame.select("doc_id").collect()} and found, name
        assert name == "secret_scan" or len(found) < frame.count(), name
        frame, ids = out, found
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF).toPandas()
    assert set(packed["doc_id"]) == ids
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").toPandas()
    assert set(rows["doc_id"]) == ids and rows["length"].sum() == packed["length"].sum()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_all_stages(spark, docs, odd, empty):
    rows = odd.drop("source", "n_chars").withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    rows = rows.where("1 = 0") if empty else rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        found = out.collect()
        if name != "packing":
            assert out.columns == rows.columns, name
            rows = spark.createDataFrame(found, rows.schema)
    assert not (empty and found)
