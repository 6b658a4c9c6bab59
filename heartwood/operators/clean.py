"""Clean layer: latest version of each row, normalised and enriched."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.functions.columns import as_date, is_blank, months_apart, rounded_quotient, title_case, years_apart
from heartwood.functions.frames import dedup_latest

AsOf = datetime.date | str


def upper_trim(name: str):
    return F.upper(F.trim(F.col(name)))


def or_zero(name: str):
    return F.coalesce(F.col(name), F.lit(0))


def clean_customers(raw: DataFrame, as_of: AsOf, repeated: DataFrame | None = None) -> DataFrame:
    today = as_date(as_of)
    return dedup_latest(raw, ["customer_id"], "updated_at", ["created_at", "city"], repeated).select(
        "customer_id",
        title_case(F.col("first_name")).alias("first_name"),
        title_case(F.col("last_name")).alias("last_name"),
        F.lower(F.trim("email")).alias("email"),
        F.regexp_replace("phone", r"[^0-9+\-]", "").alias("phone"),
        "dob",
        years_apart(F.col("dob"), today).alias("age"),
        F.trim("address").alias("address"),
        title_case(F.col("city")).alias("city"),
        upper_trim("state").alias("state"),
        upper_trim("country").alias("country"),
        F.coalesce("customer_segment", F.lit("Standard")).alias("customer_segment"),
        "credit_score",
        "annual_income",
        F.coalesce("employment_status", F.lit("Unknown")).alias("employment_status"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
        "created_at",
        "updated_at",
        months_apart(F.col("created_at"), today).alias("tenure_months"),
        F.lower(F.split_part("email", F.lit("@"), F.lit(2))).alias("email_domain"),
    )


def clean_policies(raw: DataFrame, as_of: AsOf, repeated: DataFrame | None = None) -> DataFrame:
    """``is_expired`` compares the normalised status, so an active policy past its end date is found."""
    today = as_date(as_of)
    status = upper_trim("policy_status")
    return dedup_latest(raw, ["policy_id"], "created_at", ["customer_id"], repeated).select(
        "policy_id",
        "customer_id",
        upper_trim("policy_type").alias("policy_type"),
        status.alias("policy_status"),
        or_zero("premium_amount").alias("premium_amount"),
        or_zero("coverage_amount").alias("coverage_amount"),
        or_zero("deductible_amount").alias("deductible_amount"),
        "start_date",
        "end_date",
        "renewal_date",
        "underwriting_score",
        F.coalesce("risk_category", F.lit("Medium")).alias("risk_category"),
        "created_at",
        F.coalesce((F.col("end_date") < today) & (status == "ACTIVE"), F.lit(False)).alias("is_expired"),
        F.datediff("renewal_date", today).alias("days_to_renewal"),
    )


def clean_claims(raw: DataFrame, as_of: AsOf, repeated: DataFrame | None = None) -> DataFrame:
    ties = ["claim_amount", "settlement_amount", "filed_date", "resolved_date"]
    settled = F.col("settlement_amount").isNotNull() & (F.col("claim_amount") > 0)
    return dedup_latest(raw, ["claim_id"], "created_at", ties, repeated).select(
        "claim_id",
        "policy_id",
        "customer_id",
        title_case(F.col("claim_type")).alias("claim_type"),
        upper_trim("claim_status").alias("claim_status"),
        or_zero("claim_amount").alias("claim_amount"),
        "settlement_amount",
        "filed_date",
        "resolved_date",
        "description",
        "created_at",
        F.when(settled, rounded_quotient(F.col("settlement_amount"), F.col("claim_amount"))).alias("settlement_ratio"),
        F.datediff(F.coalesce("resolved_date", as_date(as_of)), "filed_date").alias("days_to_resolve"),
    )


def clean_loans(raw: DataFrame, as_of: AsOf, repeated: DataFrame | None = None) -> DataFrame:
    owed = (F.col("outstanding_balance") > 0) & (F.col("principal_amount") > 0)
    late = F.col("days_past_due")
    return dedup_latest(raw, ["loan_id"], "created_at", ["customer_id"], repeated).select(
        "loan_id",
        "customer_id",
        upper_trim("loan_type").alias("loan_type"),
        upper_trim("loan_status").alias("loan_status"),
        or_zero("principal_amount").alias("principal_amount"),
        "interest_rate",
        or_zero("monthly_payment").alias("monthly_payment"),
        or_zero("outstanding_balance").alias("outstanding_balance"),
        "origination_date",
        "maturity_date",
        or_zero("days_past_due").alias("days_past_due"),
        "created_at",
        F.when(owed, rounded_quotient(F.col("principal_amount") - F.col("outstanding_balance"), F.col("principal_amount")))
        .otherwise(1.0)
        .alias("payoff_progress"),
        F.when(late >= 180, "Severe")
        .when(late >= 90, "High")
        .when(late >= 30, "Moderate")
        .when(late > 0, "Low")
        .otherwise("Current")
        .alias("delinquency_category"),
    )


def normalise_interactions(raw: DataFrame) -> DataFrame:
    """The projection of the clean interactions, without the choice of the latest row."""
    return raw.select(
        "interaction_id",
        "customer_id",
        title_case(F.col("channel")).alias("channel"),
        title_case(F.col("interaction_type")).alias("interaction_type"),
        F.trim("subject").alias("subject"),
        F.trim("notes").alias("notes"),
        F.coalesce(upper_trim("resolution_status"), F.lit("PENDING")).alias("resolution_status"),
        "agent_id",
        "interaction_date",
        "duration_seconds",
        "created_at",
    )


def clean_interactions(raw: DataFrame, as_of: AsOf | None = None, repeated: DataFrame | None = None) -> DataFrame:
    return normalise_interactions(dedup_latest(raw, ["interaction_id"], "created_at", ["customer_id"], repeated))


def clean_call_transcripts(raw: DataFrame, as_of: AsOf | None = None, repeated: DataFrame | None = None) -> DataFrame:
    spoken = raw.filter(~is_blank(F.col("transcript_text")))
    return dedup_latest(spoken, ["transcript_id"], "created_at", ["customer_id"], repeated).select(
        "transcript_id",
        "customer_id",
        "interaction_id",
        "call_date",
        "duration_seconds",
        "agent_id",
        title_case(F.col("agent_name")).alias("agent_name"),
        F.trim("transcript_text").alias("transcript_text"),
        title_case(F.col("call_reason")).alias("call_reason"),
        F.length("transcript_text").cast("bigint").alias("transcript_length"),
        "created_at",
    )
