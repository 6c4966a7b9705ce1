"""The pipeline's stages and registration."""

from __future__ import annotations

import corpus_pipeline
from plumbline.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_registration():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "decontamination", "source_mixing"]


def test_stages_run_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == before.columns, name
        docs = kept.cache()
        assert 0 < docs.count() <= before.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert final and {r.doc_id for r in final} <= ids


def test_dedup_keeps_one_row_of_a_repeated_id(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A B c d e f", "en", "s", 11), (3, None, None, None, None)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_stages_on_empty_tables_and_clashing_columns(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    clash = documents.limit(60).selectExpr("*", "1.0 AS score", "'x' AS lang_pred", "5L AS component_id", "true AS kept", "7L AS item_id", "0 AS label", "1L AS n")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), sf).count() == 0, name
        kept = stage(spark, clash, sf)
        assert kept.count() <= 60 and (name == "source_mixing" or kept.columns == documents.columns), name


def test_dedup_choice_does_not_depend_on_order(spark):
    rows = [(1, "q r s t u v", "en", "s2", 11), (1, "a b c d e f", "en", "s1", 11), (1, None, "fr", "s0", 0)]
    picks = {tuple(corpus_pipeline.near_dedup(spark, spark.createDataFrame(r, DOCS).repartition(3), "").collect()[0]) for r in (rows, rows[::-1])}
    assert len(picks) == 1
