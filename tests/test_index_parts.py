"""What a task of the text index sorts does not grow with the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from heartwood.operators import text_index
from heartwood.operators.text_index import TextIndex

SCHEMA = "customer_id string, search_text string, source_type string, channel string, event_date timestamp_ntz, document_key string"


def corpus_of(spark, texts):
    return spark.createDataFrame([(str(k), text, "n", "c", None, f"d{k}") for k, text in enumerate(texts)], SCHEMA)


def test_rare_terms_of_one_folder_are_dealt_out(spark, tmp_path, monkeypatch):
    letters = "abcdefghijklmnopqrst"
    corpus = corpus_of(spark, [f"{a}{b} {a}{b} x{b}{a}" for a in letters for b in letters])
    monkeypatch.setattr(text_index, "DOCUMENTS_PER_PART", 50)
    index = TextIndex.build(corpus, str(tmp_path), buckets=1)
    per_file = index.postings(spark).groupBy(F.input_file_name()).count()
    assert per_file.agg(F.max("count")).first()[0] < 400 and index.postings(spark).count() == 800


def test_sums_of_a_search_are_kept_by_hash(spark, tmp_path):
    corpus = corpus_of(spark, ["one two", "two three three", "one one two"])
    index = TextIndex.build(corpus, str(tmp_path), buckets=2)
    asked = spark.createDataFrame([("q", "one three")], "query_id string, text string")
    found = index.search(asked, 2)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    lines = [line for line in plan.splitlines() if "sum(" in line]
    assert lines and not any("SortAggregate" in line for line in lines)
    assert [(r.document_key, r.customer_id, r["rank"]) for r in found.collect()] == [("d1", "1", 1), ("d2", "2", 2)]
