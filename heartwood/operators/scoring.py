"""Deterministic customer scores: churn risk, next best action, health grade, summary line.

All of them are row-local rules over one frame: the unified record joined once
with the call roll-up. Churn, action and health tables are projections of that
frame, and so are the reports that read several of them together: no report
joins customers to customers again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.functions.columns import greatest_strict, least_strict

# Points in hundredths of a churn score: (reason, [(condition, points), ...]), first match counts.
BASE_POINTS = 15


def risk_points() -> dict[str, Column]:
    c = F.col
    return {
        "lapsed policies": F.when(c("lapsed_policies") >= 2, 25).when(c("lapsed_policies") == 1, 10).otherwise(0),
        "complaints": F.when(c("complaint_count") >= 3, 20).when(c("complaint_count") >= 1, 12).otherwise(0),
        "days past due": F.when(c("max_days_past_due") >= 90, 20).when(c("max_days_past_due") >= 30, 10).otherwise(0),
        "problem loans": F.when(c("problem_loans") > 0, 10).otherwise(0),
        "open claims": F.when(c("open_claims") >= 2, 10).otherwise(0),
        "denied claims": F.when(c("denied_claims") > 0, 5).otherwise(0),
        "negative calls": F.when(c("negative_call_count") > 0, 10).otherwise(0),
        "no recent contact": F.when(c("days_since_last_interaction") >= 180, 10)
        .when(c("days_since_last_interaction") >= 14, 3)
        .otherwise(0),
        "inactive account": F.when(~c("is_active"), 15).otherwise(0),
    }


def has_score() -> Column:
    """Which customers get a churn score, and with it an action."""
    return F.col("tenure_months").isNotNull() & F.col("is_active").isNotNull()


def churn_columns() -> dict[str, Column]:
    """Score, urgency, factors and confidence; all NULL when tenure or activity is unknown."""
    points = risk_points()
    total = F.lit(BASE_POINTS)
    for value in points.values():
        total = total + value
    total = total - F.when(F.col("tenure_months") >= 60, 10).otherwise(0)
    total = total - F.when(F.col("active_policies") >= 8, 5).otherwise(0)
    known = has_score()
    score = F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("double") / F.lit(100.0)
    raised = F.array_compact(F.array(*[F.when(value > 0, name) for name, value in points.items()]))
    domains = ["total_policies", "total_claims", "total_loans", "total_interactions", "total_calls"]
    present = sum((F.when(F.col(name) > 0, 10).otherwise(0) for name in domains), F.lit(50))
    return {
        "churn_risk_score": F.when(known, score),
        "risk_factors": F.when(known, F.slice(raised, 1, 4)),
        "model_confidence": F.when(known, present.cast("double") / F.lit(100.0)),
    }


def urgency(score: Column) -> Column:
    return (
        F.when(score >= 0.8, "Critical").when(score >= 0.6, "High").when(score >= 0.4, "Medium").when(score >= 0, "Low")
    )


# One recommendation per action.
ACTIONS: dict[str, str] = {
    "Complaint_Resolution": "Call the customer and close every open complaint with a named owner.",
    "Retention_Offer": "Offer a loyalty discount and a review of the current cover.",
    "Payment_Assistance": "Offer a payment plan for the overdue loan balance.",
    "Claims_Followup": "Update the customer on the open claims and agree a settlement date.",
    "Renewal_Reminder": "Send the renewal terms and confirm them before the renewal date.",
    "Policy_Review": "Review the lapsed cover and propose a reinstatement.",
    "Proactive_Outreach": "Get in touch with a short check-in on current needs.",
    "Upsell": "Suggest additional cover that fits the present policies.",
}


def action_type() -> Column:
    c = F.col
    return (
        F.when(c("complaint_count") >= 3, "Complaint_Resolution")
        .when(c("churn_risk_score") >= 0.6, "Retention_Offer")
        .when(c("max_days_past_due") >= 30, "Payment_Assistance")
        .when(c("open_claims") >= 2, "Claims_Followup")
        .when(c("next_renewal_days").between(-30, 30), "Renewal_Reminder")
        .when(c("lapsed_policies") > 0, "Policy_Review")
        .when(c("days_since_last_interaction") >= 14, "Proactive_Outreach")
        .otherwise("Upsell")
    )


def _describe(action: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for name, text in ACTIONS.items():
        chosen = F.when(action == name, text).otherwise(chosen)
    return chosen


def scored_customers(unified: DataFrame, calls: DataFrame) -> DataFrame:
    """Unified record with call roll-up, churn score, action and health score in one row.

    Action columns are NULL for customers without a churn score, who have no action.
    """
    c = F.col
    base = unified.join(calls, "customer_id", "left").withColumns(
        {
            "avg_sentiment": c("avg_sentiment_score"),
            "avg_sentiment_score": F.coalesce("avg_sentiment_score", F.lit(0.0)),
            "negative_call_count": F.coalesce("negative_call_count", F.lit(0)),
            "latest_sentiment_score": F.coalesce("latest_sentiment_score", F.lit(0.0)),
        }
    )
    churn = base.withColumns(churn_columns()).withColumn("retention_urgency", urgency(c("churn_risk_score")))
    has_score = c("churn_risk_score").isNotNull()
    acted = churn.withColumns(
        {
            "action_type": F.when(has_score, action_type()),
            "priority": F.when(c("retention_urgency").isin("Critical", "High"), "High").otherwise(c("retention_urgency")),
            "recommended_channel": F.when(
                has_score,
                F.when(c("preferred_channel").isin("Phone", "Branch"), c("preferred_channel"))
                .when(c("preferred_channel").isin("Web", "Mobile", "Chat"), "InApp")
                .otherwise("Email"),
            ),
            "rationale": F.when(
                has_score,
                F.concat(F.lit("Main driver: "), F.coalesce(F.try_element_at("risk_factors", F.lit(1)), F.lit("none")), F.lit(".")),
            ),
        }
    ).withColumn("action_description", _describe(c("action_type")))
    return with_health(acted)


def with_health(scored: DataFrame) -> DataFrame:
    """Five parts from 0 to 100 and their weighted sum, in exact decimals."""
    c = F.col
    late, claims = c("max_days_past_due"), c("open_claims")
    mood = (c("avg_sentiment").cast("decimal(18,10)") + 1) * 50
    low, high = (F.lit(n).cast("decimal(18,10)") for n in (0, 100))
    parts = {
        "retention_score": F.round(100 - F.coalesce("churn_risk_score", F.lit(0.5)) * 100, 1),
        "sentiment_part": F.coalesce(F.round(greatest_strict(low, least_strict(high, mood)), 1).cast("double"), F.lit(50.0)),
        "claims_health": F.when(c("total_claims") == 0, 80.0)
        .when(claims == 0, 90.0)
        .otherwise(F.greatest(F.lit(0.0), 100 - claims * 20 - late * F.lit(0.5))),
        "payment_health": F.when(c("total_loans") == 0, 85.0)
        .when(late == 0, 95.0)
        .when(late < 30, 70.0)
        .when(late < 90, 40.0)
        .otherwise(10.0),
        "loyalty_score": F.when(c("tenure_months") >= 60, 95.0)
        .when(c("tenure_months") >= 36, 80.0)
        .when(c("tenure_months") >= 12, 60.0)
        .otherwise(40.0),
    }
    weights = {
        "retention_score": "0.30",
        "sentiment_part": "0.20",
        "claims_health": "0.15",
        "payment_health": "0.20",
        "loyalty_score": "0.15",
    }
    weighted = [c(n).cast("decimal(5,1)") * F.lit(w).cast("decimal(3,2)") for n, w in weights.items()]
    total = sum(weighted[1:], weighted[0])
    points = c("health_points")
    return (
        scored.withColumns(parts)
        .withColumn("health_points", total)
        .withColumns(
            {
                "health_score": F.round(points, 1).cast("double"),
                "health_grade": F.when(points >= 85, "A")
                .when(points >= 70, "B")
                .when(points >= 55, "C")
                .when(points >= 40, "D")
                .otherwise("F"),
            }
        )
    )


CHURN_RISK = (
    "customer_id full_name customer_segment tenure_months credit_score is_active active_policies lapsed_policies"
    " total_premium open_claims denied_claims complaint_count escalation_count max_days_past_due problem_loans"
    " days_since_last_interaction composite_risk_level avg_sentiment_score negative_call_count churn_risk_score"
    " retention_urgency risk_factors model_confidence"
).split()

NEXT_BEST_ACTION = (
    "customer_id full_name customer_segment churn_risk_score retention_urgency risk_factors latest_sentiment_score"
    " latest_sentiment_label latest_call_reason latest_call_summary total_premium active_policies open_claims"
    " next_renewal_days max_days_past_due estimated_clv action_type action_description priority recommended_channel"
    " rationale"
).split()


def churn_risk(scored: DataFrame) -> DataFrame:
    return scored.select(*CHURN_RISK)


def next_best_action(scored: DataFrame) -> DataFrame:
    """Actions exist for customers with a churn score only."""
    return scored.filter(F.col("churn_risk_score").isNotNull()).select(*NEXT_BEST_ACTION)


def customer_health_score(scored: DataFrame) -> DataFrame:
    return scored.select(
        "customer_id",
        "full_name",
        "customer_segment",
        "is_active",
        "retention_score",
        F.col("sentiment_part").alias("sentiment_score"),
        "claims_health",
        "payment_health",
        "loyalty_score",
        "health_score",
        "health_grade",
    )


def customer_summary(scored: DataFrame) -> DataFrame:
    """One English line per customer."""
    text = lambda col, missing: F.coalesce(col.cast("string"), F.lit(missing))
    line = F.concat(
        F.lit("Customer: "), "full_name", F.lit(" ("), "customer_segment", F.lit("). Churn Risk: "),
        text(F.round("churn_risk_score", 2), "N/A"), F.lit(". Recommended Action: "),
        text(F.col("action_type"), "None"), F.lit(" - "), text(F.col("action_description"), "No recommendation"),
        F.lit(". Health Grade: "), text(F.col("health_grade"), "N/A"), F.lit(" ("),
        text(F.col("health_score"), "0"), F.lit("/100)."),
    )
    return scored.select("customer_id", line.alias("summary"))
