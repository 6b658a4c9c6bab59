"""Curated layer: one aggregate per domain, the unified customer record, the event timeline.

Every aggregate is taken at customer grain before the joins, so no join fans
out. Most-common values come from rows counted per (customer, value) first:
a second, small grouping then picks the winner, and a customer with a third of
all rows reaches the shuffle as a handful of partial counts.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heartwood.functions.columns import (
    as_date,
    count_when,
    greatest_strict,
    mean_exact,
    most_common,
    parse_amount,
    ratio,
)


def policy_agg(policies: DataFrame) -> DataFrame:
    status = F.col("policy_status")
    # Plain sums by type first: sets are collected over the few types left, not over the policies.
    per_type = policies.groupBy("customer_id", "risk_category", "policy_type").agg(
        F.count("*").alias("n"),
        count_when(status == "ACTIVE").alias("active"),
        count_when(status.isin("LAPSED", "CANCELLED")).alias("lapsed"),
        F.sum("premium_amount").alias("premium"),
        F.count("premium_amount").alias("premiums"),
        F.max("coverage_amount").alias("coverage"),
        F.min("days_to_renewal").alias("renewal"),
    )
    # From here on the few rows of a customer stay together: one exchange for the category's count and the customer.
    in_category = F.sum("n").over(Window.partitionBy("customer_id", "risk_category"))
    counted = per_type.repartition("customer_id").withColumn("in_category", in_category)
    return counted.groupBy("customer_id").agg(
        F.sum("n").alias("total_policies"),
        F.sum("active").alias("active_policies"),
        F.sum("lapsed").alias("lapsed_policies"),
        F.sum("premium").alias("total_premium"),
        ratio(F.sum("premium"), F.sum("premiums")).alias("avg_premium"),
        F.max("coverage").alias("max_coverage"),
        F.array_join(F.array_sort(F.collect_set("policy_type")), ", ").alias("policy_types"),
        most_common("risk_category", "in_category").alias("primary_risk_category"),
        F.min("renewal").alias("next_renewal_days"),
    )


def claims_agg(claims: DataFrame) -> DataFrame:
    status = F.col("claim_status")
    return claims.groupBy("customer_id").agg(
        F.count("*").alias("total_claims"),
        count_when(status == "OPEN").alias("open_claims"),
        count_when(status == "DENIED").alias("denied_claims"),
        F.sum("claim_amount").alias("total_claim_amount"),
        mean_exact(F.col("settlement_ratio"), "decimal(18,2)").alias("avg_settlement_ratio"),
        ratio(F.sum("days_to_resolve"), F.count("days_to_resolve")).alias("avg_claim_resolution_days"),
        F.max("filed_date").alias("last_claim_date"),
    )


def loan_agg(loans: DataFrame) -> DataFrame:
    status = F.col("loan_status")
    per_type = loans.groupBy("customer_id", "loan_type").agg(
        F.count("*").alias("total_loans"),
        count_when(status == "ACTIVE").alias("active_loans"),
        count_when(status.isin("DEFAULT", "DELINQUENT")).alias("problem_loans"),
        F.sum("outstanding_balance").alias("total_outstanding_balance"),
        F.sum("monthly_payment").alias("total_monthly_payment"),
        F.max("days_past_due").alias("max_days_past_due"),
    )
    sums = ("total_loans", "active_loans", "problem_loans", "total_outstanding_balance", "total_monthly_payment")
    return per_type.groupBy("customer_id").agg(
        *[F.sum(name).cast(per_type.schema[name].dataType).alias(name) for name in sums],
        F.max("max_days_past_due").alias("max_days_past_due"),
        F.array_join(F.array_sort(F.collect_set("loan_type")), ", ").alias("loan_types"),
    )


def interaction_agg(interactions: DataFrame, as_of: datetime.date | str) -> DataFrame:
    return days_since(interaction_sums(interactions), as_of)


def days_since(aggregate: DataFrame, as_of: datetime.date | str) -> DataFrame:
    return aggregate.withColumn("days_since_last_interaction", F.datediff(as_date(as_of), "last_interaction_date"))


def interaction_sums(interactions: DataFrame) -> DataFrame:
    """The part of the interaction aggregate that does not depend on today."""
    per_channel = interactions.groupBy("customer_id", "channel").agg(
        F.count("*").alias("n"),
        count_when(F.col("interaction_type") == "Complaint").alias("complaints"),
        count_when(F.col("resolution_status") == "ESCALATED").alias("escalations"),
        F.max("interaction_date").alias("last_date"),
    )
    return per_channel.groupBy("customer_id").agg(
        F.sum("n").alias("total_interactions"),
        F.sum("complaints").alias("complaint_count"),
        F.sum("escalations").alias("escalation_count"),
        F.max("last_date").alias("last_interaction_date"),
        most_common("channel", "n").alias("preferred_channel"),
    )


def transcript_agg(transcripts: DataFrame) -> DataFrame:
    per_reason = transcripts.groupBy("customer_id", "call_reason").agg(
        F.count("*").alias("n"),
        F.max("call_date").alias("last_date"),
        F.sum("duration_seconds").alias("seconds"),
        F.count("duration_seconds").alias("timed"),
    )
    return per_reason.groupBy("customer_id").agg(
        F.sum("n").alias("total_calls"),
        F.max("last_date").alias("last_call_date"),
        ratio(F.sum("seconds"), F.sum("timed")).alias("avg_call_duration"),
        most_common("call_reason", "n").alias("most_common_call_reason"),
    )


def document_agg(documents: DataFrame) -> DataFrame:
    return (
        documents.filter(F.col("source_customer_id").isNotNull())
        .groupBy(F.col("source_customer_id").alias("customer_id"))
        .agg(
            F.count("*").alias("total_documents"),
            F.array_join(F.array_sort(F.collect_set("document_type")), ", ").alias("document_types"),
            F.max("file_modified_at").alias("last_document_date"),
        )
    )


def composite_risk(days_past_due: Column, complaints: Column, lapsed: Column) -> Column:
    return (
        F.when((days_past_due >= 90) | (complaints >= 3) | (lapsed >= 2), "High")
        .when((days_past_due >= 30) | (complaints >= 1) | (lapsed >= 1), "Medium")
        .otherwise("Low")
    )


def estimated_clv(premium: Column, tenure_months: Column) -> Column:
    """Premium times years of tenure; an unknown tenure gives no value."""
    return (premium * greatest_strict(tenure_months, F.lit(1))).cast("double") / F.lit(12.0)


# Metrics that read as zero for a customer without rows in the domain.
ZERO_FILLED = (
    "total_policies active_policies lapsed_policies total_premium total_claims open_claims denied_claims"
    " total_claim_amount total_loans active_loans problem_loans total_outstanding_balance total_monthly_payment"
    " max_days_past_due total_interactions complaint_count escalation_count total_calls total_documents"
).split()


def customer_360_unified(
    customers: DataFrame,
    policies: DataFrame,
    claims: DataFrame,
    loans: DataFrame,
    interactions: DataFrame,
    transcripts: DataFrame,
    documents: DataFrame,
) -> DataFrame:
    """One row per customer. The right sides are the six aggregates, all keyed by customer.

    They leave their grouping partitioned by customer, so at scale the joins are
    sort-merge joins without a further exchange of the right sides, and a domain
    that no selected column needs is dropped by the optimizer.
    """
    profile = customers.select(
        "customer_id",
        F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
        "email",
        "phone",
        "age",
        "city",
        "state",
        "country",
        "customer_segment",
        "credit_score",
        "annual_income",
        "employment_status",
        "is_active",
        "tenure_months",
    )
    domains = [policies, claims, loans, interactions, transcripts, documents]
    joined = reduce(lambda left, right: left.join(right, "customer_id", "left"), domains, profile)
    filled = joined.withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in ZERO_FILLED}
        | {"days_since_last_interaction": F.coalesce("days_since_last_interaction", F.lit(999))}
    )
    return filled.withColumns(
        {
            "composite_risk_level": composite_risk(
                F.col("max_days_past_due"), F.col("complaint_count"), F.col("lapsed_policies")
            ),
            "estimated_clv": estimated_clv(F.col("total_premium"), F.col("tenure_months")),
        }
    )


TIMELINE = (
    ("customer_id", "bigint"),
    ("event_date", "timestamp_ntz"),
    ("event_category", "string"),
    ("event_description", "string"),
    ("event_status", "string"),
    ("event_amount", "double"),
    ("event_notes", "string"),
    ("event_id", "string"),
)


def _events(source: DataFrame, *values: Column) -> DataFrame:
    return source.select(*[value.cast(kind).alias(name) for value, (name, kind) in zip(values, TIMELINE, strict=True)])


def interaction_timeline(
    policies: DataFrame,
    claims: DataFrame,
    loans: DataFrame,
    interactions: DataFrame,
    transcripts: DataFrame,
    documents: DataFrame,
) -> DataFrame:
    c, text, none = F.col, F.lit, F.lit(None)
    branches = [
        _events(
            policies,
            c("customer_id"),
            c("created_at"),
            text("Policy"),
            F.concat("policy_type", text(" policy "), F.lower("policy_status")),
            c("policy_status"),
            c("premium_amount"),
            none,
            F.concat(text("policy_"), "policy_id"),
        ),
        _events(
            claims,
            c("customer_id"),
            c("filed_date"),
            text("Claim"),
            F.concat("claim_type", text(" claim - "), F.lower("claim_status")),
            c("claim_status"),
            c("claim_amount"),
            c("description"),
            F.concat(text("claim_"), "claim_id"),
        ),
        _events(
            loans,
            c("customer_id"),
            c("origination_date"),
            text("Loan"),
            F.concat("loan_type", text(" loan - "), F.lower("loan_status")),
            c("loan_status"),
            c("principal_amount"),
            none,
            F.concat(text("loan_"), "loan_id"),
        ),
        _events(
            interactions,
            c("customer_id"),
            c("interaction_date"),
            text("Interaction"),
            F.concat("channel", text(" - "), "interaction_type", text(": "), "subject"),
            c("resolution_status"),
            none,
            c("notes"),
            F.concat(text("interaction_"), "interaction_id"),
        ),
        _events(
            transcripts,
            c("customer_id"),
            c("call_date"),
            text("Call"),
            F.concat(text("Phone call - "), "call_reason"),
            none,
            none,
            F.left("transcript_text", text(500)),
            F.concat(text("call_"), "transcript_id"),
        ),
        _events(
            documents.filter(c("source_customer_id").isNotNull()),
            c("source_customer_id"),
            c("file_modified_at"),
            text("Document"),
            F.concat("document_type", text(" - "), F.coalesce("reference_number", "file_name")),
            F.coalesce("status", text("Processed")),
            parse_amount(c("amount")),
            F.left("description", text(500)),
            F.concat(text("doc_"), "file_name"),
        ),
    ]
    return reduce(DataFrame.unionByName, branches)
