"""The pipeline and the registered corpus queries on the smallest tables."""

import oracle
import pytest

import corpus_pipeline
from tickloom.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    cols, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == cols and docs.join(spark.read.parquet(f"{D}/documents.parquet"), cols, "left_anti").count() == 0
    assert n * 0.5 < docs.count() < n
    final = corpus_pipeline.run(spark, D)
    assert {"shard", "slot", "size"} <= set(final.columns) and set(cols) <= set(final.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_duckdb(spark, name):
    fn, sql = QUERIES[name]
    ok, _, got, want, _, _ = oracle.compare(spark, oracle.connect(D), D, fn, sql)
    assert ok, (list((got - want).items())[:3], list((want - got).items())[:3])
