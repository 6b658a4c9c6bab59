"""The pipeline's stages on awkward rows, and the queries that SQL can express."""

from __future__ import annotations

from collections import Counter

import pytest
from compare import connect, difference

import corpus_pipeline
from heartwood.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query_equals_its_oracle(spark, sf_dir, key):
    assert difference(queries()[key](spark, sf_dir), connect(sf_dir), oracle_sql()[key]) is None


def test_stages_hand_on_the_columns_of_documents(spark, awkward, tmp_path):
    docs, folder = awkward, tmp_path
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(folder / name))
        before, docs = docs, spark.read.parquet(str(folder / name))
        if number < 4:
            assert docs.schema.simpleString() == before.schema.simpleString()
    copies = spark.read.parquet(str(folder / "near_duplicates"))
    assert copies.where("doc_id in (110, 111, 112, 113)").count() == 1
    mixture = Counter(r.doc_id for r in spark.read.parquet(str(folder / "mixture")).collect())
    assert Counter(r.doc_id for r in docs.where("piece = 0").collect()) == mixture


def test_an_empty_table_stays_empty(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_on_the_given_documents(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    room = Counter()
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= corpus_pipeline.CAPACITY
    assert len(room) <= sum(room.values()) / corpus_pipeline.CAPACITY * 1.05 + 1
