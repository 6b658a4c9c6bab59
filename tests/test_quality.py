from __future__ import annotations

import re

import pytest

from heartwood.operators import alerts, quality


@pytest.mark.parametrize(("nulls", "rows_", "status"), [(10, 100, "PASS"), (11, 100, "FAIL"), (0, 5, "PASS")])
def test_completeness_limit(spark, nulls, rows_, status):
    df = spark.range(rows_).selectExpr(f"CASE WHEN id >= {nulls} THEN 0.5D END AS churn_risk_score")
    row = quality.check_churn_completeness(df).first()
    assert (row.status, row.metric_value, row.threshold) == (status, round(100 * nulls / rows_, 2), 10.0)


def test_checks_on_an_empty_table(rows):
    empty = rows("churn_risk_score", "(0.5D)").filter("false")
    row = quality.check_churn_completeness(empty).first()
    assert (row.metric_value, row.status) == (None, "PASS")
    assert quality.check_churn_range(empty).first().metric_value == 0


def test_range_check(rows):
    row = quality.check_churn_range(rows("churn_risk_score", "(0.0D), (1.0D), (1.01D), (-0.1D), (NULL)")).first()
    assert (row.metric_value, row.status) == (2.0, "FAIL")


def test_orphans(rows):
    customers = rows("customer_id", "(1), (1), (2)")
    policies = rows("policy_id, customer_id", "(10, 1), (11, 9), (12, 9), (13, NULL)")
    claims = rows("policy_id, customer_id", "(10, 1), (10, 9), (99, 1), (99, 9), (99, 9)")
    assert quality.orphan_policies(policies, customers).first().violations == 3
    assert quality.orphan_claims(claims, policies, customers).first().violations == 4
    assert quality.orphan_loans(customers, customers).first().violations == 0


def test_quality_log_is_read_newest_first(spark, tmp_path):
    folder = str(tmp_path / "log")
    for run in ("a", "b", "b"):  # the second run is tried again
        quality.write_log(quality.heartbeat(spark), folder, run)
    times = [r.check_timestamp for r in quality.latest_log(spark, folder).collect()]
    assert len(times) == 2 and times == sorted(times, reverse=True)


def test_check_suite_rules(rows, spark):
    df = rows("churn_risk_score, customer_segment", "(0.5D, 'A'), (0.9D, 'B'), (NULL, 'C')")
    chosen = [check for check in quality.DATA_CHECKS if check.id in (9, 21, 22, 27)]
    found = {r.test_id: (r.status, r.detail, r.row_count) for r in quality.check_suite({"scored": df}, chosen).collect()}
    assert found == {
        9: ("FAIL", "2 segments", 2),
        21: ("WARN", "67% non-null", 67),
        22: ("PASS", "0 violations", 0),
        27: ("FAIL", "33% null scores (need < 5%)", 33),
    }


def test_populated_counts_tables_with_rows(rows):
    full, empty = rows("a", "(1), (2)"), rows("a", "(1)").filter("false")
    assert quality.populated({"x": full, "y": empty, "z": full}).count() == 2


def churn(rows, *scores):
    values = ", ".join(f"({i}L, 'C{i}', 'VIP', {s}D, 'Critical')" for i, s in enumerate(scores))
    return rows("customer_id, full_name, customer_segment, churn_risk_score, retention_urgency", values)


def test_alert_lines_are_split_over_messages_in_order(rows):
    df = churn(rows, 0.8, 0.95, 0.79, 0.9, 0.95, 0.85)
    line = df["full_name"]
    found = alerts.messages(df.filter("churn_risk_score >= 0.8"), "a", line, "churn_risk_score", "H: ", size=2)
    bodies = [(r.message_no, r.lines, r.body) for r in found.orderBy("message_no").collect()]
    assert bodies == [(1, 2, "H: C1\nC4"), (2, 2, "H: C3\nC5"), (3, 1, "H: C0")]


def test_critical_alert(rows):
    row = alerts.alert_critical_churn(churn(rows, 0.8, 0.79)).collect()
    assert [r.body for r in row] == ["Critical churn risk customers detected:\n\nC0 (VIP) - Score: 0.8 - Critical"]
    assert alerts.alert_critical_churn(churn(rows, 0.5)).count() == 0


def test_quality_alert(rows):
    dashboard = rows(
        "model, total_records, parse_failures, failure_rate_pct",
        "('A', 100L, 5L, 5.0D), ('B', 100L, 6L, 6.0D), ('C', 100L, 50L, 50.0D)",
    )
    row = alerts.alert_quality(dashboard).collect()
    assert [(r.lines, r.body) for r in row] == [(2, "C: 50.0% failure rate (50/100)\nB: 6.0% failure rate (6/100)")]
    assert alerts.alert_quality(dashboard, 60.0).collect() == []


def test_campaign_limits(tables):
    found = alerts.retention_campaign(tables["scored"], threshold=0.6).collect()
    assert 0 < len(found) <= 10
    assert all(r.churn_risk >= 0.6 and r.status == "DRAFTED" and len(r.email_body) <= 1000 for r in found)
    assert alerts.campaign_digest(alerts.retention_campaign(tables["scored"], threshold=2.0)).count() == 0


def test_orphan_claims_count_each_row_and_sort_claims_once(spark):
    claims = spark.createDataFrame(
        [(1, 10, 5), (2, 10, 5), (3, 11, 5), (4, None, 5), (5, 10, None), (6, 12, 9), (7, 10, 9)],
        "claim_id long, policy_id long, customer_id long",
    )
    policies = spark.createDataFrame([(10,), (10,), (None,)], "policy_id long")
    customers = spark.createDataFrame([(5,), (5,), (None,)], "customer_id long")
    found = quality.orphan_claims(claims, policies, customers)
    assert found.first().violations == 5  # 3, 4, 5, 6 and 7
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [policy_id#" in plan and not re.search(r"Aggregate \[policy_id#\w+, customer_id#", plan)
