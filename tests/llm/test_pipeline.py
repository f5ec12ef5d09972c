"""The pipeline from end to end on tables that the given ones are not."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def run_over(spark, tmp_path):
    def run(docs):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        return corpus_pipeline.run(spark, str(tmp_path))

    return run


def test_an_empty_table_gives_no_rows(spark, run_over):
    result = run_over(spark.createDataFrame([], DOCUMENTS))
    assert result.columns == ["doc_id", "ids", "decoded"] and result.count() == 0


def test_nulls_empty_texts_repeated_rows_and_a_very_long_text(spark, run_over):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    english = {r.doc_id: r.text for r in given.filter("lang = 'en' AND length(text) BETWEEN 600 AND 900").orderBy("doc_id").limit(6).collect()}
    (a, b, c, *_), long = english.values(), " ".join(r.text for r in given.filter("lang = 'en'").collect())
    odd = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "en", None, 1), (3, None, None, None, None), (4, "", "en", "s", 0),
           (5, "  \n ", "en", "s", 4), (None, b, "en", "t", 1), (None, b, "en", "t", 1), (None, None, None, None, None), (6, "12 34", "en", "s", 5),
           (7, long, "en", "t", len(long))]
    result = run_over(spark.createDataFrame(odd, DOCUMENTS))
    found = Counter((r.doc_id, r.decoded) for r in result.collect())
    assert {i for i, _ in found} <= {1, None, 7} and all(n <= 2 for n in found.values())
    texts = {t for _, t in found}
    assert texts <= {a, b} | {t for t in texts if t not in (a, b) and len(t) > 100_000}
    assert all(len(r.ids) > 0 for r in result.collect())


def test_exact_copies_go_and_clean_documents_stay(spark, run_over):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) > 300")
    distinct = given.dropDuplicates(["text"])
    copies = distinct.limit(20).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = distinct.unionByName(copies)
    steps = corpus_pipeline.STAGES
    kept = docs
    for _, step in steps[:3]:
        kept = step(spark, kept, "")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not any(i >= 10_000 for i in ids)
    assert len(ids) > 0.9 * distinct.count()
    assert run_over(docs).count() > 0
