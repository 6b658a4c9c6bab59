"""What the plans read and move."""

from __future__ import annotations

import re

import pytest

from heartwood.plans import semantic
from heartwood.plans.reports import REPORTS, name_pattern
from heartwood.session import own_work_dir, work_dir


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sources(df) -> set[str]:
    return set(re.findall(r"/(\w+)\.parquet", plan(df)))


@pytest.mark.parametrize(
    ("name", "read"),
    [
        ("vq_customer_count_by_segment_country", {"customer", "nation", "region"}),
        ("vq_avg_premium_by_country", {"customer", "nation", "region", "orders"}),
        ("vq_documents_by_type", {"documents"}),
        ("recent_claims", {"lineitem", "orders"}),
    ],
)
def test_unused_domains_are_not_read(tables, name, read):
    assert sources(REPORTS[name](tables)) == read


def test_scan_reads_the_columns_it_needs(tables):
    schemas = re.findall(r"documents\.parquet.*?ReadSchema: struct<([^>]*)>", plan(REPORTS["vq_documents_by_type"](tables)))
    assert schemas and all("lang" not in s and "source" not in s for s in schemas)


def test_key_filter_reaches_the_scan(tables):
    assert "EqualTo(c_custkey,7)" in plan(REPORTS["customer_by_id"](tables, 7))


@pytest.mark.parametrize("name", ["home_kpis", "high_risk_detail", "customer_insights", "nb_revenue_at_risk"])
def test_reports_join_each_domain_once(tables, name):
    """Scores and customers come from one frame: lineitem is read once, and nothing is a cross join."""
    text = plan(REPORTS[name](tables))
    assert text.count("lineitem.parquet") <= 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_reports_do_not_sort_everything(tables):
    assert "TakeOrderedAndProject" in plan(REPORTS["high_risk_detail"](tables))


def test_call_summary_moves_nothing_between_calls(tables):
    """The clean layer's one exchange by conversation serves sentences, words and the choice."""
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plan(REPORTS["sentiment_by_reason"](tables)))
    assert "word" not in keys


def test_names_are_reduced_to_safe_characters():
    assert name_pattern("O'Neil; DROP--x_1.") == "oneil drop--x1."


def test_semantic_query_refuses_what_the_model_does_not_hold(tables):
    with pytest.raises(ValueError, match="unknown measure"):
        semantic.semantic_query(semantic.MODEL, tables, ["customer.nothing"])
    with pytest.raises(ValueError, match="unknown dimensions"):
        semantic.semantic_query(semantic.MODEL, tables, ["customer.age"], ["customer.nothing"])
    with pytest.raises(ValueError, match="relationship"):
        semantic.semantic_query(semantic.MODEL, tables, ["customer.age"], ["call.call_reason"])


def test_measures_do_not_fan_out(tables):
    """Customers with several calls count once."""
    both = semantic.semantic_query(
        semantic.MODEL, tables, ["customer.total_customers", "call.sentiment_score"], ["customer.country"]
    )
    alone = semantic.semantic_query(semantic.MODEL, tables, ["customer.total_customers"], ["customer.country"])
    found = {r.country: r.total_customers for r in both.collect()}
    assert found == {r.country: r.total_customers for r in alone.collect()}


def test_written_tables_give_the_same_scores(spark, sf_dir, tmp_path):
    from heartwood.plans.tables import build

    lazy, written = build(spark, sf_dir), build(spark, sf_dir)
    assert "lineitem.parquet" in plan(written["scored"])
    written.write(str(tmp_path), ["customer_360_unified", "customer_calls"])
    assert "lineitem.parquet" not in plan(written["scored"])
    columns = ["customer_id", "churn_risk_score", "action_type", "health_score"]
    assert sorted(written["scored"].select(*columns).collect(), key=lambda r: r.customer_id) == sorted(
        lazy["scored"].select(*columns).collect(), key=lambda r: r.customer_id
    )


def test_own_raw_data_takes_the_place_of_a_view(spark, sf_dir):
    from heartwood.plans.tables import build

    own = build(spark, sf_dir)
    everyone = own["customer_360_unified"].count()
    own["raw_customers"] = own["raw_customers"].filter("customer_id < 10")
    assert own["customer_360_unified"].count() == 10 < everyone


def test_new_raw_data_reaches_written_tables(spark, sf_dir, tmp_path):
    from heartwood.plans.tables import build

    own = build(spark, sf_dir)
    own.write(str(tmp_path), ["clean_customers"])
    own["raw_customers"] = own["raw_customers"].filter("customer_id < 10")
    assert own["clean_customers"].count() == 10


def test_work_folder_comes_from_the_session(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host"
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext, conf = Context(), {}

    own_work_dir(Session)
    with pytest.raises(ValueError):
        work_dir(Session)
    Session.sparkContext.master = "local[2]"
    own_work_dir(Session)
    assert work_dir(Session) == Session.sparkContext.folder


def test_a_hot_customer_is_split_in_the_document_join(spark):
    """A third of the documents name one customer: the adaptive join cuts that partition and keeps every row."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        documents = spark.range(30000).repartition(8).selectExpr(
            "id AS document_id", "concat('f', id) AS file_name", "'Claim Form' AS document_type", "sha2(CAST(id AS STRING), 512) AS reference_number",
            "CASE id % 3 WHEN 0 THEN '42' WHEN 1 THEN 'unknown' ELSE CAST(id AS STRING) END AS customer_id", "'$1' AS amount",
        )
        people = spark.range(20000).selectExpr(
            "id AS customer_id", "concat('C', id) AS full_name", "'VIP' AS customer_segment", "true AS is_active", "0.5D AS churn_risk_score"
        )
        found = REPORTS["document_xref"]({"document_extracted": documents, "scored": people})
        rows = found.collect()
        assert len(rows) == 30000
        assert sum(r.c360_name == "C42" for r in rows) == 10000
        assert sum(r.c360_name is None for r in rows) == 10000 + sum(1 for i in range(30000) if i % 3 == 2 and i >= 20000)
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
