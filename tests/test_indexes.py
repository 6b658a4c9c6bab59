"""Stored indexes: the same answers as the searches without one, from less work."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import heartwood.operators.text_index as text_index
from heartwood.operators.search import search_bm25, search_knn_every
from heartwood.operators.text_index import TextIndex
from heartwood.operators.vector_index import VectorIndex
from heartwood.sources.tables import load_table


@pytest.fixture(scope="module")
def corpus(tables, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    tables["search_corpus"].write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return TextIndex.build(corpus, str(tmp_path_factory.mktemp("index")), buckets=8)


def test_two_hundred_queries_in_one_call(spark, corpus, index):
    texts = [r.search_text for r in corpus.orderBy("document_key").limit(400).collect()][::2]
    asked = {f"q{n}": " ".join(text.split()[:5]) for n, text in enumerate(texts)}
    found = index.search(spark.createDataFrame(list(asked.items()), "query_id string, text string"), 3).collect()
    assert len(asked) == 200 and len({r.query_id for r in found}) == 200
    some = list(asked)[::10]  # a plan without an index holds the terms of all its queries
    want = search_bm25(corpus, {name: asked[name] for name in some}, 3).collect()
    assert sorted(r for r in found if r.query_id in some) == sorted(want)


def test_a_filter_limits_hits_not_statistics(spark, corpus, index):
    asked, where = {"a": "the error request and note", "b": "unseenword"}, F.col("source_type") == "interaction_note"
    found = index.search(spark.createDataFrame(list(asked.items()), "query_id string, text string"), 7, where)
    assert sorted(found.collect()) == sorted(search_bm25(corpus, asked, 7, where).collect())


def test_searches_read_the_named_folders_and_no_text(spark, index):
    found = index.search(spark.createDataFrame([("a", "request")], "query_id string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "search_text" not in plan and "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_many_asked_terms_are_joined_by_a_shuffle(spark, index, monkeypatch):
    asked = spark.createDataFrame([("a", "the error request and note"), ("b", "was it")], "query_id string, text string")
    want = sorted(index.search(asked).collect())
    monkeypatch.setattr(text_index, "FEW_TERMS", 1)
    assert sorted(index.search(asked).collect()) == want


def test_a_frequent_term_is_dealt_out(spark, corpus, index, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "DOCUMENTS_PER_PART", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these parts are far below its size
    try:
        dealt = TextIndex.build(corpus, str(tmp_path), buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = dealt.postings(spark).filter("term = 'request'").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1
    asked = spark.createDataFrame([("a", "the error request and note")], "query_id string, text string")
    assert sorted(dealt.search(asked).collect()) == sorted(index.search(asked).collect())


def test_an_index_of_odd_texts(spark, tmp_path):
    schema = "customer_id string, search_text string, source_type string, channel string, event_date timestamp_ntz, document_key string"
    rows = [("1", None, "n", "c", None, "x"), ("2", "", "n", "c", None, "y"), ("3", "Word word", None, None, None, "z"), ("4", "word", "n", "c", None, "w")]
    corpus = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([("a", "WORD"), ("b", None), ("c", "")], "query_id string, text string")
    found = TextIndex.build(corpus, str(tmp_path / "i"), 2).search(asked).collect()
    assert [(r.query_id, r.document_key, r["rank"]) for r in found] == [("a", "z", 1), ("a", "w", 2)]
    assert TextIndex.build(corpus.limit(0), str(tmp_path / "e"), 2).search(asked).collect() == []


def asked_of(embeddings, step):
    return embeddings.filter(f"vec_id % {step} = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def test_pivots_find_the_exact_neighbours_with_fewer_pairs(spark, sf_dir, tmp_path):
    embeddings = load_table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(embeddings, str(tmp_path), pivots=24, rings=3)
    found, pairs = index.search(asked_of(embeddings, 10), 5)
    assert sorted(found.collect()) == sorted(search_knn_every(embeddings, 10, 5).collect())
    assert pairs.agg(F.sum("compared")).first()[0] > 0


@pytest.fixture(scope="module")
def clusters(spark):
    """Tight groups, one with a third of all vectors, among them exact copies."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(30, 16))
    which = np.where(draw.random(3000) < 0.33, 0, draw.integers(0, 30, 3000))
    vectors = centres[which] + 0.02 * draw.normal(size=(3000, 16))
    vectors[10:200] = vectors[10]
    rows = [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, which, strict=True))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)


def test_clusters_are_skipped(spark, clusters, tmp_path):
    index = VectorIndex.build(clusters, str(tmp_path), pivots=64, rings=4)
    found, pairs = index.search(asked_of(clusters, 20), 10)
    assert sorted(found.collect()) == sorted(search_knn_every(clusters, 20, 10).collect())
    assert pairs.agg(F.sum("compared")).first()[0] < 0.4 * 150 * 3000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_odd_vectors_are_left_out(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [0.9, 0.1], [0.0, 0.0], None, [nan, 1.0], [inf, 1.0], [0.0, 1.0], [None, 1.0], [-1.0, 0.0], [1.0, 0.0]]
    rows = [(i, v, None if i == 1 else i) for i, v in enumerate(vectors)] + [(None, [1.0, 0.0], 1)]
    embeddings = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, _ = VectorIndex.build(embeddings, str(tmp_path / "a")).search(asked_of(embeddings, 1), 3)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [9, 1, 6], 1: [0, 9, 6], 6: [1, 0, 8], 8: [6, 1, 0], 9: [0, 1, 6]}
    none, pairs = VectorIndex.build(embeddings.limit(0), str(tmp_path / "b")).search(asked_of(embeddings, 1), 3)
    assert none.collect() == [] and pairs.collect() == []
    with pytest.raises(Exception, match="several lengths"):
        VectorIndex.build(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], embeddings.schema).coalesce(1), str(tmp_path / "c"))
