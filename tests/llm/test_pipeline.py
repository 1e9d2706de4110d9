"""The pipeline's stages against brute force, each on its own input."""

import re

import corpus_pipeline
import pyarrow as pa
import pytest
from messy import empty, messy
from test_dedup_ops import _brute_components
from pyspark.sql import functions as F
from test_text_ops import _leaks

from tagloom.llm.shared import BATCH_BYTES, written

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if name != "packing" else before
        docs = written(function(spark, docs, SF), name)
        if name == "packing":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language":
            assert kept[name] == {i for i, _ in before}
        if name == "exact_dedup":
            first = {}
            for i, t in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert kept[name] == set(first.values())
        if name == "near_dedup":
            assert kept[name] == {i for i, _, c in _brute_components(sorted(before), 5, 80) if i == c}
        if name == "decontaminate":
            assert kept[name] == {i for i, t in before if not _leaks(t, items)[1]}
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept["decontaminate"]


def test_stages_bear_messy_and_empty_tables(spark):
    for docs in (messy(spark), empty(spark)):
        for _, function in corpus_pipeline.STAGES:
            out = function(spark, docs, SF)
            out.count()


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_bounds_the_bytes_of_a_batch(spark, name):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    def told():
        wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
        return wide.mapInArrow(sizes, "bytes long, rows long").collect()

    try:
        spark.conf.unset(bound)
        dict(corpus_pipeline.STAGES)[name](spark, empty(spark), SF)
        got = told()
        assert sum(r.rows for r in got) == 4000 and max(r.bytes for r in got) < 2 * BATCH_BYTES
        spark.conf.set(bound, "1m")  # a bound of the session's own stays
        dict(corpus_pipeline.STAGES)[name](spark, empty(spark), SF)
        assert max(r.bytes for r in told()) < 2 << 20
    finally:
        spark.conf.unset(bound)
