from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heartwood.operators import scoring
from heartwood.operators.whatif import Scenario, whatif

NUMBERS = (
    "lapsed_policies complaint_count max_days_past_due problem_loans open_claims denied_claims"
    " days_since_last_interaction active_policies total_policies total_claims total_loans total_interactions total_calls"
).split()


@pytest.fixture
def scored(spark):
    """Scored row of one customer with the given features; everything else is quiet."""

    def make(calls: str = "CAST(NULL AS DOUBLE) AS avg_sentiment_score, 0L AS negative_call_count", **features):
        values = {name: 0 for name in NUMBERS} | {"tenure_months": 24, "is_active": "true", "next_renewal_days": 400, "preferred_channel": "'Email'"}
        values |= features
        unified = spark.sql(
            "SELECT 1L AS customer_id, 'Ann Lee' AS full_name, 'VIP' AS customer_segment, 700 AS credit_score,"
            " CAST(1200 AS DECIMAL(14,2)) AS total_premium, 0L AS escalation_count, 'Low' AS composite_risk_level,"
            " CAST(10 AS DOUBLE) AS estimated_clv, 'a@b.c' AS email, "
            + ", ".join(f"{value} AS {name}" for name, value in values.items())
        )
        call_row = spark.sql(
            f"SELECT 1L AS customer_id, {calls}, CAST(NULL AS DOUBLE) AS worst_sentiment_score, CAST(NULL AS STRING) AS latest_call_summary,"
            " CAST(NULL AS DOUBLE) AS latest_sentiment_score, CAST(NULL AS STRING) AS latest_sentiment_label, CAST(NULL AS STRING) AS latest_call_reason"
        )
        return scoring.scored_customers(unified, call_row)

    return make


@pytest.mark.parametrize(
    ("features", "score"),
    [
        ({}, 0.15),
        ({"lapsed_policies": 1}, 0.25), ({"lapsed_policies": 2}, 0.40),
        ({"complaint_count": 2}, 0.27), ({"complaint_count": 3}, 0.35),
        ({"max_days_past_due": 29}, 0.15), ({"max_days_past_due": 30}, 0.25), ({"max_days_past_due": 90}, 0.35),
        ({"problem_loans": 1}, 0.25), ({"open_claims": 1}, 0.15), ({"open_claims": 2}, 0.25), ({"denied_claims": 1}, 0.20),
        ({"days_since_last_interaction": 13}, 0.15), ({"days_since_last_interaction": 14}, 0.18), ({"days_since_last_interaction": 180}, 0.25),
        ({"is_active": "false"}, 0.30), ({"tenure_months": 60}, 0.05), ({"tenure_months": 60, "active_policies": 8}, 0.0),
        ({"tenure_months": "CAST(NULL AS INT)"}, None),
        ({"lapsed_policies": 2, "complaint_count": 3, "max_days_past_due": 90, "problem_loans": 1, "open_claims": 2, "denied_claims": 1, "days_since_last_interaction": 180, "is_active": "false"}, 1.0),
    ],
)
def test_churn_points(scored, features, score):
    row = scored(**features).first()
    assert row.churn_risk_score == score
    assert (row.action_type is None) == (score is None)
    assert (row.risk_factors is None) == (score is None)


@pytest.mark.parametrize(("score", "label"), [(0.8, "Critical"), (0.79, "High"), (0.6, "High"), (0.59, "Medium"), (0.4, "Medium"), (0.39, "Low"), (0.0, "Low"), (None, None)])
def test_urgency_limits(spark, score, label):
    assert spark.range(1).select(scoring.urgency(F.lit(score).cast("double"))).first()[0] == label


def test_factors_keep_their_order_and_stop_at_four(scored):
    row = scored(lapsed_policies=1, complaint_count=1, problem_loans=1, denied_claims=1, is_active="false").first()
    assert row.risk_factors == ["lapsed policies", "complaints", "problem loans", "denied claims"]
    assert row.rationale == "Main driver: lapsed policies."


@pytest.mark.parametrize(
    ("features", "action"),
    [
        ({"complaint_count": 3, "max_days_past_due": 90}, "Complaint_Resolution"),
        ({"lapsed_policies": 1, "max_days_past_due": 90}, "Payment_Assistance"),
        ({"lapsed_policies": 2, "max_days_past_due": 90}, "Retention_Offer"),
        ({"open_claims": 2}, "Claims_Followup"),
        ({"next_renewal_days": 30}, "Renewal_Reminder"),
        ({"next_renewal_days": -30}, "Renewal_Reminder"),
        ({"next_renewal_days": 31, "lapsed_policies": 1}, "Policy_Review"),
        ({"days_since_last_interaction": 14}, "Proactive_Outreach"),
        ({}, "Upsell"),
    ],
)
def test_actions_in_order(scored, features, action):
    row = scored(**features).first()
    assert row.action_type == action
    assert row.action_description == scoring.ACTIONS[action]


@pytest.mark.parametrize(("channel", "expected"), [("'Phone'", "Phone"), ("'Branch'", "Branch"), ("'Chat'", "InApp"), ("'Email'", "Email"), ("CAST(NULL AS STRING)", "Email")])
def test_channels(scored, channel, expected):
    assert scored(preferred_channel=channel).first().recommended_channel == expected


@pytest.mark.parametrize(
    ("features", "parts"),
    [
        ({}, (85.0, 50.0, 80.0, 85.0, 60.0)),
        ({"total_claims": 3}, (85.0, 50.0, 90.0, 85.0, 60.0)),
        ({"total_claims": 3, "open_claims": 1, "total_loans": 1, "max_days_past_due": 15}, (85.0, 50.0, 72.5, 70.0, 60.0)),
        ({"total_claims": 9, "open_claims": 9, "total_loans": 1, "max_days_past_due": 89}, (65.0, 50.0, 0.0, 40.0, 60.0)),
        ({"total_loans": 1, "tenure_months": 60}, (95.0, 50.0, 80.0, 95.0, 95.0)),
        ({"total_loans": 1, "max_days_past_due": 90, "tenure_months": 11}, (65.0, 50.0, 80.0, 10.0, 40.0)),
        ({"tenure_months": "CAST(NULL AS INT)"}, (50.0, 50.0, 80.0, 85.0, 40.0)),
    ],
)
def test_health_parts(scored, features, parts):
    row = scored(**features).first()
    assert (row.retention_score, row.sentiment_part, row.claims_health, row.payment_health, row.loyalty_score) == parts
    weights = (0.30, 0.20, 0.15, 0.20, 0.15)
    assert row.health_score == pytest.approx(sum(p * w for p, w in zip(parts, weights, strict=True)), abs=0.051)


def test_grade_uses_the_unrounded_sum(spark):
    base = "SELECT CAST(NULL AS DOUBLE) AS avg_sentiment, {score} AS churn_risk_score, 0L AS total_claims, 0L AS open_claims, 0 AS max_days_past_due, 0L AS total_loans, 60 AS tenure_months"
    row = scoring.with_health(spark.sql(base.format(score="CAST(0.325 AS DOUBLE)"))).first()
    # 67.5 * .30 + 50 * .20 + 80 * .15 + 85 * .20 + 95 * .15 = 73.5
    assert (row.health_score, row.health_grade) == (73.5, "B")
    grades = {}
    for score in (0.0, 0.44, 0.45, 0.95):
        row = scoring.with_health(spark.sql(base.format(score=f"CAST({score} AS DOUBLE)"))).first()
        grades[score] = (row.health_points, row.health_grade)
    assert {s: g for s, (_, g) in grades.items()} == {0.0: "B", 0.44: "B", 0.45: "C", 0.95: "D" if grades[0.95][0] < 55 else "C"}


def test_sentiment_moves_health(scored):
    happy = scored(calls="CAST(0.037 AS DOUBLE) AS avg_sentiment_score, 0L AS negative_call_count").first()
    assert happy.sentiment_part == 51.9
    assert scored(calls="CAST(-1 AS DOUBLE) AS avg_sentiment_score, 1L AS negative_call_count").first().sentiment_part == 0.0


def test_scores_stay_in_range(tables):
    row = tables["scored"].selectExpr(
        "min(churn_risk_score)", "max(churn_risk_score)", "min(health_score)", "max(health_score)", "min(model_confidence)", "max(model_confidence)"
    ).first()
    assert 0 <= row[0] <= row[1] <= 1
    assert 0 <= row[2] <= row[3] <= 100
    assert 0.5 <= row[4] <= row[5] <= 1


def test_no_change_leaves_the_score(tables):
    found = whatif(tables["scored"], [Scenario()]).filter("delta <> 0 OR risk_change <> 'unchanged' OR modified_premium IS NULL")
    assert found.count() == 0


def test_every_change_lowers_or_keeps_the_risk(tables):
    found = whatif(tables["scored"])
    assert found.count() == 48 * tables["scored"].count()
    assert found.filter("NOT outreach AND delta > 0").count() == 0


def test_resolving_complaints(scored):
    row = whatif(scored(complaint_count=3), [Scenario(resolve_complaints=True, premium_discount=10)]).first()
    assert (row.current_churn_risk, row.predicted_churn_risk, row.delta, row.risk_change) == (0.35, 0.13, -0.22, "decreased")
    assert row.modified_premium == 1080.0


def test_a_lower_premium_lowers_the_risk(scored):
    found = [whatif(scored(complaint_count=3), [Scenario(premium_discount=d)]).first().delta for d in (0, 10, 25, 50, 100)]
    assert found == [0.0, -0.02, -0.05, -0.1, -0.2]
    free = scored(complaint_count=3).withColumn("total_premium", F.lit(0).cast("decimal(14,2)"))
    assert whatif(free, [Scenario(premium_discount=50)]).first().delta == 0.0


def test_days_past_due_come_down_to_their_target(scored):
    late = scored(max_days_past_due=120)
    scores = [whatif(late, [Scenario(clear_past_due=True, past_due_target=n)]).first().predicted_churn_risk for n in (0, 45, 100, 500)]
    assert scores[0] < scores[1] < scores[2] == scores[3] == whatif(late, [Scenario()]).first().predicted_churn_risk
