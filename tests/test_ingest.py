from __future__ import annotations

from pyspark.sql import functions as F

from heartwood.functions.frames import number_rows, outer_key, top_per_key
from heartwood.sources import ingest


def test_batch_sizes_are_at_least_one():
    assert ingest.batch_sizes(20) == {"customers": 20, "policies": 30, "claims": 12, "loans": 16, "interactions": 60, "transcripts": 10}
    assert set(ingest.batch_sizes(0.1).values()) == {1}


def test_numbers_are_consecutive_in_order(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS bucket").repartition(9)
    found = number_rows(df, [F.col("bucket").desc(), F.col("id").asc()], "no").collect()
    ordered = sorted(found, key=lambda r: (-r.bucket, r.id))
    assert [r.no for r in ordered] == list(range(1, 5001))


def test_new_ids_follow_the_largest(spark, rows):
    new = rows("name", "('b'), ('a'), ('c')")
    order = [F.col("name").asc()]
    found = ingest.assign_batch_ids(new, rows("id", "(3L), (41L)"), "id", order).collect()
    assert {r.name: r.id for r in found} == {"a": 42, "b": 43, "c": 44}
    empty = rows("id", "(3L)").filter("false")
    assert sorted(r.id for r in ingest.assign_batch_ids(new, empty, "id", order).collect()) == [1, 2, 3]


def test_writing_a_batch_again_adds_nothing(spark, rows, tmp_path):
    folder, first, second = str(tmp_path / "t"), rows("id", "(1L)"), rows("id", "(2L), (3L)")
    ingest.append_batch(first, folder, 0)
    ingest.append_batch(second, folder, 1)
    ingest.append_batch(second, folder, 1)
    assert sorted(r.id for r in ingest.read_batches(spark, folder, first).collect()) == [1, 2, 3]


def test_newest(rows):
    df = rows("id", "(5), (9), (7), (9)")
    assert [r.id for r in ingest.newest(df, "id", 3).collect()] == [9, 9, 7]
    assert sorted(r.id for r in ingest.keys_above(df, "id", 3).collect()) == [7, 9]


def test_sample_is_stable_and_spread(spark):
    df = spark.range(2000)
    dims = {"kind": ["a", "b", "c"]}
    one = ingest.sample_by_hash(df, "id", dims, 600).collect()
    two = ingest.sample_by_hash(df.repartition(5), "id", dims, 600).collect()
    assert sorted(one) == sorted(two) and len({r.id for r in one}) == 600
    counts = [sum(r.kind == k for r in one) for k in "abc"]
    assert min(counts) > 140


def test_csv_round_trip(spark, rows, tmp_path):
    df = rows("a, b", "('x, \"y\"', 1), (NULL, 2), ('', 3)")
    ingest.export_csv(df, str(tmp_path / "csv"))
    back = ingest.read_csv(spark, str(tmp_path / "csv"), df)
    assert sorted((r.b, r.a) for r in back.collect()) == [(1, 'x, "y"'), (2, None), (3, "")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS t").repartition(6)
    top = top_per_key(df, ["k"], [F.col("t").desc()], 2)
    text = plan(top)
    assert text.index("Final") < text.index("Exchange hashpartitioning(k") < text.index("Partial")
    assert sorted(r.t for r in top.filter("k = 0").collect()) == [29994, 29997]
    assert top.count() == 20002


def test_many_rows_per_key_are_exact(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS k", "id AS t").repartition(6)
    top = top_per_key(df, ["k"], [F.col("t").desc()], 2000, rank="rank")
    zeros = sorted((r.rank, r.t) for r in top.filter("k = 0").collect())
    assert zeros == [(i + 1, 8997 - 3 * i) for i in range(2000)]
    assert top.count() == 4000


def test_null_keys_of_an_outer_join_are_spread_and_kept(spark):
    left = spark.range(900).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS k").repartition(6)
    keyed = left.withColumn("key", outer_key(F.col("k")))
    assert keyed.filter("k IS NULL").select("key").distinct().count() == 6
    right = spark.range(900).selectExpr("CAST(id AS STRING) AS key", "id AS v")
    joined = keyed.join(right, "key", "left")
    assert joined.count() == 900
    assert joined.filter("v IS NULL").count() == 300
