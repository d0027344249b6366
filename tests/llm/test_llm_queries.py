import importlib

import pytest

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


@pytest.mark.parametrize("number", range(1, 11))
def test_query_returns_a_row_for_each_input(spark, entry, number):
    names = [n for n in entry.queries() if n.startswith(f"op{number}_")]
    assert len(names) == 1
    rows = entry.queries()[names[0]](spark, ROOT)
    table = "pages" if number == 10 else "documents"
    key = "page_id" if number == 10 else "doc_id"
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{ROOT}/{table}.parquet").select(key).distinct().count()


def test_pipeline_stages_take_effect(spark, entry):
    import corpus_pipeline

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "packing"]
    kept = docs.where("doc_id % 2 = 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, ROOT)
        assert out.columns == docs.columns and out.count() <= kept.count()
    packed = corpus_pipeline.run(spark, ROOT)
    assert 0 < packed.select("doc_id").distinct().count() <= docs.count()


def test_stages_bear_odd_tables(spark, documents, clashing, nothing):
    import corpus_pipeline

    for docs in (clashing, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, ROOT)
            assert out.columns == docs.columns and out.count() <= docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, clashing, ROOT)
    assert packed.select("doc_id").distinct().count() == documents.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, ROOT).count() == 0
