import corpus_pipeline
import pytest
from tidewell.llm import queries as llm

from .conftest import odd_rows, prose


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    import random

    rng = random.Random(12)
    rows = [(500 + i, prose(rng, 200), "en", f"src{i % 3}", 1) for i in range(40)]
    rows += [(600 + i, rows[i][1] + " tail", "en", "src0", 1) for i in range(5)]
    path = tmp_path_factory.mktemp("sf")
    odd.unionAll(spark.createDataFrame(rows, odd.schema)).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_return_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names, name
        now = docs.count()
        assert 0 < now <= before
        before = now
    ids = {r.doc_id for r in docs.collect()}
    assert len(ids & {1, 2, 3}) <= 1 and not ids & {4, 5, 6, 9}


def test_run_packs_what_is_left(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)


def test_tables_of_a_stage_go_when_nothing_reads_them(spark, folder, tmp_path):
    import os

    application = spark.sparkContext.applicationId
    there = lambda: [s for s in corpus_pipeline._held.get(application, []) if os.path.isdir(s.root.removeprefix("file:"))]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    second = corpus_pipeline.STAGES[1][1](spark, first, folder)  # reads what the first holds
    assert second.count() > 0
    second.write.parquet(f"{tmp_path}/second")
    held = there()
    third = corpus_pipeline.STAGES[2][1](spark, spark.read.parquet(f"{tmp_path}/second"), folder)
    assert len(held) >= 2 and not set(held) & set(there()) and len(there()) == 1 and third.count() > 0
    corpus_pipeline.run(spark, folder)
    assert not there()


def test_stages_keep_extra_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'own' AS kept", "'own' AS tokens", "'own' AS fingerprint", "'own' AS `a.b`", "'own' AS _")
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        assert got.where("kept <> 'own' OR tokens <> 'own' OR fingerprint <> 'own' OR `a.b` <> 'own'").count() == 0 and got.count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() >= len(odd_rows())


def test_stages_on_an_empty_table(spark, nothing, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))
