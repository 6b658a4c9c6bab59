from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from heartwood.operators import curated


@pytest.mark.parametrize(
    ("dpd", "complaints", "lapsed", "expected"),
    [
        (90, 0, 0, "High"), (89, 0, 0, "Medium"), (30, 0, 0, "Medium"), (29, 0, 0, "Low"),
        (0, 3, 0, "High"), (0, 2, 0, "Medium"), (0, 1, 0, "Medium"),
        (0, 0, 2, "High"), (0, 0, 1, "Medium"), (0, 0, 0, "Low"),
    ],
)
def test_composite_risk_limits(spark, dpd, complaints, lapsed, expected):
    column = curated.composite_risk(F.lit(dpd), F.lit(complaints), F.lit(lapsed))
    assert spark.range(1).select(column).first()[0] == expected


@pytest.mark.parametrize(("tenure", "expected"), [("24", 200.0), ("0", 100.0 / 12), ("NULL", None)])
def test_estimated_clv(rows, tenure, expected):
    df = rows("premium, tenure", f"(CAST(100 AS DECIMAL(12,2)), CAST({tenure} AS INT))")
    assert df.select(curated.estimated_clv(F.col("premium"), F.col("tenure"))).first()[0] == expected


def test_policy_agg_over_several_categories(rows):
    df = rows(
        "customer_id, risk_category, policy_status, premium_amount, coverage_amount, policy_type, days_to_renewal",
        "(1L, 'Low', 'ACTIVE', 10.00, 5, 'LIFE', 9), (1L, 'High', 'LAPSED', 20.00, 8, 'AUTO', -3),"
        "(1L, 'High', 'CANCELLED', 30.01, 1, 'LIFE', 4), (2L, 'Low', 'RENEWED', 1.00, 1, NULL, NULL)",
    )
    found = {r.customer_id: r for r in curated.policy_agg(df).collect()}
    one, two = found[1], found[2]
    assert (one.total_policies, one.active_policies, one.lapsed_policies) == (3, 1, 2)
    assert (float(one.total_premium), one.avg_premium, one.max_coverage) == (60.01, 60.01 / 3, 8)
    assert (one.policy_types, one.primary_risk_category, one.next_renewal_days) == ("AUTO, LIFE", "High", -3)
    assert (two.policy_types, two.next_renewal_days) == ("", None)


def test_policy_agg_moves_the_rows_of_a_customer_once_after_the_types(rows):
    df = rows(
        "customer_id, risk_category, policy_status, premium_amount, coverage_amount, policy_type, days_to_renewal",
        "(1L, 'Low', 'ACTIVE', 1.00, 5, 'LIFE', 9), (1L, 'Low', 'ACTIVE', 1.00, 5, 'AUTO', 9), (1L, 'High', 'ACTIVE', 1.00, 5, 'LIFE', 9),"
        "(1L, NULL, 'ACTIVE', 1.00, 5, 'LIFE', 9), (1L, NULL, 'ACTIVE', 1.00, 5, NULL, 9), (1L, NULL, 'ACTIVE', 1.00, 5, 'AUTO', 9),"
        "(NULL, 'Low', 'ACTIVE', 1.00, 5, 'LIFE', 9), (NULL, 'High', 'ACTIVE', 1.00, 5, 'LIFE', 9), (2L, NULL, 'ACTIVE', 1.00, 5, 'LIFE', 9)",
    )
    found = curated.policy_agg(df)
    assert {(r.customer_id, r.total_policies, r.policy_types, r.primary_risk_category) for r in found.collect()} == {
        (1, 6, "AUTO, LIFE", "Low"),  # the categories count over all types, unknown ones do not
        (2, 1, "LIFE", None),
        (None, 2, "LIFE", "High"),  # the smaller one of a tie
    }
    plan = curated.policy_agg(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_customers_without_rows_read_as_zero(tables, spark):
    t = tables
    nobody = {name: t[name].filter("false") for name in ("policy_agg", "claims_agg", "loan_agg", "interaction_agg", "transcript_agg", "document_agg")}
    row = curated.customer_360_unified(t["clean_customers"], *nobody.values()).first()
    assert all(row[name] == 0 for name in curated.ZERO_FILLED)
    assert (row.days_since_last_interaction, row.composite_risk_level) == (999, "Low")
    assert (row.avg_premium, row.policy_types, row.last_call_date) == (None, None, None)


def test_one_row_per_customer(tables):
    unified = tables["customer_360_unified"]
    assert unified.count() == tables["clean_customers"].count() == unified.select("customer_id").distinct().count()


def test_timeline_holds_every_source_row(tables):
    sources = ["clean_policies", "clean_claims", "clean_loans", "clean_interactions", "clean_call_transcripts"]
    expected = sum(tables[name].count() for name in sources)
    expected += tables["document_extracted"].filter("source_customer_id IS NOT NULL").count()
    timeline = tables["interaction_timeline"]
    assert timeline.count() == expected
    assert timeline.select("event_category").distinct().count() == 6
    assert [f.simpleString() for f in timeline.schema] == [f"{name}:{kind}" for name, kind in curated.TIMELINE]


def test_days_since_last_interaction_counts_days(rows):
    df = rows(
        "customer_id, channel, interaction_type, resolution_status, interaction_date",
        "(1L, 'Phone', 'Complaint', 'ESCALATED', TIMESTAMP_NTZ '2024-01-31 23:59:00'), (1L, 'Chat', 'Payment', 'PENDING', TIMESTAMP_NTZ '2024-01-01 00:00:00')",
    )
    row = curated.interaction_agg(df, datetime.date(2024, 2, 1)).first()
    assert (row.days_since_last_interaction, row.preferred_channel, row.complaint_count, row.escalation_count) == (1, "Chat", 1, 1)
