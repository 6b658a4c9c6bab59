"""Bounds of the operators: long vectors, groups of copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from heartwood.llm.langid import SAMPLE, identify, sample
from heartwood.llm.mixing import mix
from heartwood.llm.neardup import embedding_groups


def test_vectors_of_more_than_65535_components_link(spark):
    ones = F.array_repeat(F.lit(1.0), 70_000)
    embedding = F.when(F.col("id") < 2, ones).otherwise(F.concat(F.array_repeat(F.lit(0.5), 5), F.array_repeat(F.lit(1.0), 69_995)))
    found = embedding_groups(spark.range(3).select(F.col("id").alias("vec_id"), embedding.alias("embedding"))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(0, 2, 0), (1, 2, 0), (2, 2, 0)]


def test_copies_do_not_fill_the_training_sample(spark):
    letters = [chr(97 + k % 26) + chr(97 + k // 26) * 3 for k in range(600)]
    docs = spark.createDataFrame([("en", text) for text in letters], "lang string, text string")
    first = docs.orderBy(F.xxhash64("text")).first().text  # the copied text has the smallest hash
    copies = spark.range(SAMPLE + 100).select(F.lit("en").alias("lang"), F.lit(first).alias("text"))
    passages, labels = sample(docs.unionByName(copies), "text", "lang")
    assert len(set(passages)) == SAMPLE and set(labels) == {"en"}


def test_rows_of_one_id_are_one_node(spark):
    near = lambda x, y: [x, y, 0.01]
    rows = [(1, near(1.0, 0.0)), (5, near(1.0, 0.01)), (5, near(0.0, 1.0)), (7, near(0.01, 1.0)), (7, None), (9, None), (9, None), (11, near(-1.0, 0.0))]
    found = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    told = sorted((r.vec_id, r.component_id, r.kept) for r in found)
    assert told == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (7, 1, False), (9, 9, True), (9, 9, True), (11, 11, True)]


def test_figures_are_no_letters(spark):
    docs = [(k, "word and more words " * 9, "en") for k in range(8)] + [(20, "½ ² 3", None), (21, "①", None), (22, "日", None), (23, "", None)]
    found = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert (found[20], found[21], found[22], found[23]) == ("und", "und", "en", "und")


def test_no_column_is_lost_in_mixing(spark):
    docs = spark.createDataFrame([(k, "text", "a", k) for k in range(5)], "doc_id long, text string, source string, `mixing copy` long")
    assert mix(docs).columns == docs.columns and mix(docs, copy_col="text").columns == ["doc_id", "source", "mixing copy", "text"]
    assert all(r["mixing copy"] == r.doc_id for r in mix(docs, copy_col="copy").collect())
