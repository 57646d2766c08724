import corpus_pipeline
import pytest

from evidence.llm.dart_minhash import near_duplicates
from evidence.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "mixing", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL)
        assert after.schema == docs.schema, name
        rows, before = after.collect(), {repr(r) for r in now.collect()}
        assert rows and {repr(r) for r in rows} <= before
        if name == "near_dedup":
            want = {r["class_id"] for r in near_duplicates(now).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(want)
        now = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL).collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted({r["doc_id"] for r in now.collect()})


def test_run_is_the_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_docs, SMALL)
    if name != "packing":
        assert out.columns == odd_docs.columns
    assert out.count() >= 0 and stage(spark, no_docs, SMALL).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES
