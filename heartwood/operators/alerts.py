"""Alert bodies and the retention campaign. Sending them is the caller's job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.functions.frames import number_rows

c = F.col
LINES_PER_MESSAGE = 500


def messages(
    rows: DataFrame, alert: str, line: Column, first_by: str, header: str = "", size: int = LINES_PER_MESSAGE
) -> DataFrame:
    """Text bodies of at most ``size`` lines each, largest ``first_by`` first; no row when there is nothing to report.

    The number of customers in an alert grows with the data, so one text cannot
    hold them all. Every line gets its place in the overall order, and the lines
    of one message form one small group. Up to ``size`` lines this is one message.
    """
    lines = rows.select(line.alias("_line"), first_by, "customer_id")
    numbered = number_rows(lines, [c(first_by).desc(), c("customer_id").asc()], "_no")
    grouped = numbered.groupBy(F.floor((c("_no") - 1) / size).cast("bigint").alias("_page")).agg(
        F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("_no", "_line"))).alias("_body")
    )
    body = F.array_join(F.transform("_body", lambda x: x["_line"]), "\n")
    return grouped.select(
        F.lit(alert).alias("alert"),
        (c("_page") + 1).alias("message_no"),
        "lines",
        F.concat(F.lit(header), body).alias("body"),
    )


def alert_critical_churn(churn: DataFrame, lines_per_message: int = LINES_PER_MESSAGE) -> DataFrame:
    critical = churn.filter((c("churn_risk_score") >= 0.8) & (c("retention_urgency") == "Critical"))
    line = F.concat(
        "full_name", F.lit(" ("), "customer_segment", F.lit(") - Score: "),
        F.round("churn_risk_score", 2).cast("string"), F.lit(" - "), "retention_urgency",
    )
    return messages(critical, "critical_churn", line, "churn_risk_score", "Critical churn risk customers detected:\n\n", lines_per_message)


def alert_vip_complaint(unified: DataFrame, lines_per_message: int = LINES_PER_MESSAGE) -> DataFrame:
    at_risk = unified.filter(
        c("customer_segment").isin("VIP", "Premium") & (c("complaint_count") >= 3) & (c("composite_risk_level") == "High")
    )
    line = F.concat(
        "full_name", F.lit(" ("), "customer_segment", F.lit(") - "), c("complaint_count").cast("string"),
        F.lit(" complaints, Risk: "), "composite_risk_level",
    )
    return messages(at_risk, "vip_complaint", line, "complaint_count", size=lines_per_message)


def _one_message(rows: DataFrame, alert: str, line: Column, *order: Column) -> DataFrame:
    """A single body over a bounded number of rows; no row when there are none."""
    parts = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return (
        rows.agg(F.count("*").alias("lines"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("body"))
        .filter(c("lines") > 0)
        .select(F.lit(alert).alias("alert"), F.lit(1).cast("bigint").alias("message_no"), "lines", "body")
    )


def alert_quality(dashboard: DataFrame, limit: float = 5.0) -> DataFrame:
    """The dashboard has one row per producer, three in all."""
    degraded = dashboard.filter(c("failure_rate_pct") > limit)
    line = F.concat(
        "model", F.lit(": "), c("failure_rate_pct").cast("string"), F.lit("% failure rate ("),
        c("parse_failures").cast("string"), F.lit("/"), c("total_records").cast("string"), F.lit(")"),
    )
    return _one_message(degraded, "quality", line, (-c("failure_rate_pct")).alias("first"), c("model"))


def retention_campaign(
    scored: DataFrame, threshold: float = 0.6, limit: int = 10, sender: str = "Your customer team"
) -> DataFrame:
    """Drafts for the ``limit`` riskiest customers with a high-priority action."""
    body = F.concat(
        F.lit("Dear "), "full_name", F.lit(",\n\nThank you for being a "), "customer_segment",
        F.lit(" customer. We would like to help: "), F.lcase("action_description"),
        F.lit(" Please reply to this message and we will arrange it.\n\n"), F.lit(sender),
    )
    chosen = scored.filter((c("churn_risk_score") >= threshold) & (c("priority") == "High"))
    return (
        chosen.orderBy(c("churn_risk_score").desc(), c("customer_id").asc())
        .limit(limit)
        .select(
            "customer_id",
            "full_name",
            "email",
            "customer_segment",
            "action_type",
            F.round("churn_risk_score", 2).alias("churn_risk"),
            F.left(body, F.lit(1000)).alias("email_body"),
            F.lit("DRAFTED").alias("status"),
        )
    )


def campaign_digest(campaign: DataFrame) -> DataFrame:
    """One text over the drafts, which the campaign limits."""
    line = F.concat("full_name", F.lit(" - Churn: "), c("churn_risk").cast("string"), F.lit(" - "), "action_type")
    return _one_message(campaign, "campaign", line, (-c("churn_risk")).alias("first"), c("customer_id"))
