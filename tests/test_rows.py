"""Counts move keys only, stored layers sort only rows whose keys repeat."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from heartwood.functions.frames import dedup_latest, repeated_keys
from heartwood.operators import quality
from heartwood.plans import catalog
from heartwood.plans import queries as registry
from heartwood.plans.tables import KEYED, LAYERS, ROWS_OF


def test_counted_rows_are_those_of_the_table(tables):
    for name in (*KEYED, *ROWS_OF, "next_best_action", "interaction_timeline"):
        assert tables.rows(name).count() == tables[name].count() > 0
        assert tables.rows(name, any_row=True).limit(1).count() == 1
    kinds = tables["interaction_timeline"].groupBy("event_category").count()
    assert sorted(tables.rows("interaction_timeline").groupBy("event_category").count().collect()) == sorted(kinds.collect())


def test_counts_sort_no_rows_but_those_of_documents_and_customers(spark, sf_dir):
    plan = registry.queries()["layer_row_counts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") <= 2  # timeline documents with a known customer, customers with a score


def test_given_tables_are_counted_as_given(tables, spark, sf_dir):
    from heartwood.plans.tables import build

    own = build(spark, sf_dir)
    own["clean_customers"] = tables["clean_customers"].limit(3)
    assert own.rows("clean_customers").count() == 3 and own.rows("customer_360_unified").count() == 3


def test_newest_rows_by_repeated_keys(rows):
    df = rows("k, at, v", "(1, 1, 'a'), (1, 2, 'b'), (2, 1, 'c'), (NULL, 1, 'd'), (NULL, 3, 'e'), (3, NULL, 'f'), (3, 5, 'g')")
    repeated = repeated_keys(df, ["k"])
    assert sorted(str(r.k) for r in repeated.collect()) == ["1", "3", "None"]
    newest = dedup_latest(df, ["k"], "at", repeated=repeated)
    assert sorted(r.v for r in newest.collect()) == sorted(r.v for r in dedup_latest(df, ["k"], "at").collect()) == ["b", "c", "e", "f"]
    alone = df.filter("k = 2")
    assert dedup_latest(alone, ["k"], "at", repeated=repeated_keys(alone, ["k"])).collect() == alone.collect()


def test_raw_tables_are_counted_and_not_copied(tables, tmp_path):
    written = catalog.write_layers(tables, str(tmp_path), quality.DATA_CHECKS, registry.app_tables)
    assert not any(name in os.listdir(tmp_path) for name in LAYERS["RAW"])
    for name in ("clean_interactions", "clean_customers", "parsed_documents"):
        columns = [F.xxhash64(*tables[name].columns)]
        assert sorted(written[name].select(*columns).collect()) == sorted(tables[name].select(*columns).collect())
