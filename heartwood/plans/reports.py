"""Named reports: one function per question, from the table mapping to a DataFrame.

Filters are keyword arguments that end up as Column expressions. Lists that the
reference shows one customer at a time are ranked for all customers at once.
Every limit is a feature of its report and has a total order.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.functions.columns import count_when, mean_rounded, percentage, ratio, try_number
from heartwood.functions.frames import outer_key, top_per_key
from heartwood.plans.tables import Tables

REPORTS: dict[str, Callable[..., DataFrame]] = {}

c = F.col


def report(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    REPORTS[function.__name__] = function
    return function


def mean(name: str, digits: int) -> Column:
    return mean_rounded(c(name), digits)


def mean_score(name: str, digits: int = 3) -> Column:
    return mean_rounded(c(name), digits, "decimal(9,4)")


def scores(t: Tables) -> DataFrame:
    """Churn rows of one frame; the unified columns are in it, so reports need no join."""
    return t["scored"]


def actions(t: Tables) -> DataFrame:
    return t["scored"].filter(c("churn_risk_score").isNotNull())


def highest_risk() -> list[Column]:
    return [c("churn_risk_score").desc_nulls_last(), c("customer_id").asc()]


# -------------------------------------------------------------------- home


@report
def home_kpis(t: Tables) -> DataFrame:
    """Five counts. The document count comes from its own table as a one-row subquery."""
    documents = t["document_extracted"].agg(F.count("*")).scalar()
    return (
        scores(t)
        .agg(
            F.count("*").alias("total_customers"),
            count_when(c("is_active")).alias("active_customers"),
            count_when(c("churn_risk_score") >= 0.7).alias("high_churn_risk"),
            count_when(c("priority") == "High").alias("high_priority_actions"),
        )
        .withColumn("documents_processed", documents)
    )


@report
def churn_by_segment(t: Tables) -> DataFrame:
    return actions(t).groupBy("customer_segment").agg(mean_score("churn_risk_score").alias("avg_churn_risk"))


def in_call_range(df: DataFrame, date_from: datetime.date | None, date_to: datetime.date | None) -> DataFrame:
    """Calls of a date range. ``date_to`` includes its midnight only, as dates compare with timestamps."""
    if date_from is not None:
        df = df.filter(c("call_date") >= F.lit(date_from))
    if date_to is not None:
        df = df.filter(c("call_date") <= F.lit(date_to))
    return df


@report
def sentiment_distribution(
    t: Tables, date_from: datetime.date | None = None, date_to: datetime.date | None = None
) -> DataFrame:
    calls = in_call_range(t["transcript_sentiment"], date_from, date_to)
    return calls.groupBy("sentiment_label").agg(F.count("*").alias("call_count"))


@report
def onboarding_trend(t: Tables) -> DataFrame:
    month = F.trunc("created_at", "month").cast("timestamp_ntz")
    return t["clean_customers"].groupBy(month.alias("month")).agg(F.count("*").alias("new_customers"))


@report
def top_actions(t: Tables, limit: int = 15) -> DataFrame:
    high = actions(t).filter((c("priority") == "High") & c("action_type").isNotNull())
    return (
        high.orderBy(*highest_risk())
        .limit(limit)
        .select(
            "customer_id",
            "full_name",
            "customer_segment",
            F.round("churn_risk_score", 2).alias("churn_risk"),
            "action_type",
            "action_description",
            "priority",
            "recommended_channel",
        )
    )


# ---------------------------------------------------------------- customer

CUSTOMER_CARD = (
    "customer_id full_name email phone customer_segment city state country age credit_score annual_income is_active"
    " tenure_months total_policies active_policies total_premium total_claims open_claims total_loans"
    " total_outstanding_balance max_days_past_due complaint_count total_calls composite_risk_level"
).split()


def _card(df: DataFrame) -> DataFrame:
    return df.select(*CUSTOMER_CARD, F.round("estimated_clv", 0).alias("estimated_clv"))


@report
def customer_by_id(t: Tables, customer_id: int = 7) -> DataFrame:
    return _card(t["customer_360_unified"].filter(c("customer_id") == customer_id))


def name_pattern(text: str) -> str:
    """Search text reduced to letters, digits, space, '-' and '.', in lower case."""
    return re.sub(r"[^\w .\-]|_", "", text).lower()


@report
def customer_by_name(t: Tables, text: str = "customer 00000001", limit: int = 20) -> DataFrame:
    found = t["customer_360_unified"].filter(F.lower("full_name").contains(name_pattern(text)))
    return _card(found.orderBy("customer_id").limit(limit))


@report
def recent_claims(t: Tables, n: int = 10) -> DataFrame:
    order = [c("filed_date").desc_nulls_first(), c("claim_id").desc()]
    return top_per_key(t["clean_claims"], ["customer_id"], order, n, rank="rank").select(
        "customer_id", "rank", "claim_id", "claim_type", "claim_status", "claim_amount", "filed_date"
    )


@report
def recent_loans(t: Tables, n: int = 10) -> DataFrame:
    order = [c("origination_date").desc_nulls_first(), c("loan_id").desc()]
    return top_per_key(t["clean_loans"], ["customer_id"], order, n, rank="rank").select(
        "customer_id",
        "rank",
        "loan_type",
        "loan_status",
        "principal_amount",
        "outstanding_balance",
        "days_past_due",
        "delinquency_category",
    )


@report
def recent_timeline(t: Tables, n: int = 20) -> DataFrame:
    order = [c("event_date").desc_nulls_first(), c("event_id").asc()]
    return top_per_key(t["interaction_timeline"], ["customer_id"], order, n, rank="rank").select(
        "customer_id", "rank", "event_date", "event_category", "event_description", "event_status"
    )


@report
def customer_documents(t: Tables, n: int = 20) -> DataFrame:
    """Documents per extracted customer number; text that is no number belongs to nobody."""
    keyed = t["document_extracted"].withColumn("customer_id", try_number(c("customer_id")).cast("bigint"))
    order = [c("file_modified_at").desc_nulls_first(), c("file_name").asc()]
    return top_per_key(keyed.filter(c("customer_id").isNotNull()), ["customer_id"], order, n, rank="rank").select(
        "customer_id", "rank", "file_name", "document_type", "reference_number", "amount", "category", "status"
    )


@report
def customer_insights(t: Tables) -> DataFrame:
    return scores(t).select(
        "customer_id",
        "churn_risk_score",
        "retention_urgency",
        "model_confidence",
        "action_type",
        "action_description",
        "priority",
        "recommended_channel",
        "rationale",
    )


@report
def segment_overview(t: Tables) -> DataFrame:
    return (
        t["customer_360_unified"]
        .groupBy("customer_segment")
        .agg(
            F.count("*").alias("customers"),
            count_when(c("is_active")).alias("active"),
            mean("credit_score", 0).alias("avg_credit_score"),
            mean("total_premium", 0).alias("avg_premium"),
        )
    )


# ------------------------------------------------------------------- churn


def risk_bucket(labels: Sequence[str]) -> Column:
    """Five classes at 0.8, 0.6, 0.4 and 0.2, highest first."""
    score = c("churn_risk_score")
    bucket = F.when(score >= 0.8, labels[0])
    for limit, label in zip((0.6, 0.4, 0.2), labels[1:], strict=False):
        bucket = bucket.when(score >= limit, label)
    return bucket.otherwise(labels[4])


def in_segments(df: DataFrame, segments: Sequence[str] | None, min_score: float = 0.0) -> DataFrame:
    """Chosen segments and a minimum score, where an unknown score counts as 0."""
    if segments is not None:
        df = df.filter(c("customer_segment").isin(*segments))
    return df.filter(F.coalesce("churn_risk_score", F.lit(0.0)) >= min_score)


@report
def churn_segments(t: Tables) -> DataFrame:
    return t["churn_risk"].select("customer_segment").distinct()


@report
def churn_kpis(t: Tables, segments: Sequence[str] | None = None, min_score: float = 0.0) -> DataFrame:
    return in_segments(t["churn_risk"], segments, min_score).agg(
        F.count("*").alias("total"),
        count_when(c("churn_risk_score") >= 0.7).alias("high_risk"),
        mean_score("churn_risk_score").alias("avg_risk"),
        mean_score("model_confidence").alias("avg_conf"),
    )


@report
def churn_buckets_page(t: Tables, segments: Sequence[str] | None = None) -> DataFrame:
    labels = ("5-Critical", "4-High", "3-Medium", "2-Low", "1-Minimal")
    known = in_segments(t["churn_risk"], segments).filter(c("churn_risk_score").isNotNull())
    return known.groupBy(risk_bucket(labels).alias("bucket")).agg(F.count("*").alias("customers"))


@report
def avg_risk_by_segment(t: Tables, segments: Sequence[str] | None = None) -> DataFrame:
    known = in_segments(t["churn_risk"], segments).filter(c("churn_risk_score").isNotNull())
    return known.groupBy("customer_segment").agg(mean_score("churn_risk_score").alias("avg_risk"))


@report
def high_risk_detail(
    t: Tables, segments: Sequence[str] | None = None, min_score: float = 0.0, limit: int = 50
) -> DataFrame:
    return (
        in_segments(t["churn_risk"], segments, min_score)
        .orderBy(*highest_risk())
        .limit(limit)
        .select(
            "customer_id",
            "full_name",
            "customer_segment",
            F.round("churn_risk_score", 3).alias("churn_risk"),
            "retention_urgency",
            F.round("model_confidence", 2).alias("confidence"),
            "complaint_count",
            "escalation_count",
            "max_days_past_due",
            F.round("avg_sentiment_score", 2).alias("avg_sentiment"),
            "negative_call_count",
        )
    )


# --------------------------------------------------------------- sentiment



def label_is(label: str) -> Column:
    return c("sentiment_label") == label


@report
def sentiment_kpis(
    t: Tables, date_from: datetime.date | None = None, date_to: datetime.date | None = None
) -> DataFrame:
    return in_call_range(t["transcript_sentiment"], date_from, date_to).agg(
        F.count("*").alias("total"),
        mean_score("sentiment_score").alias("avg_sent"),
        count_when(label_is("Negative")).alias("neg"),
        count_when(label_is("Positive")).alias("pos"),
    )


@report
def sentiment_by_reason(t: Tables) -> DataFrame:
    return (
        t["transcript_sentiment"]
        .groupBy("call_reason")
        .agg(mean_score("sentiment_score").alias("avg_sentiment"), F.count("*").alias("calls"))
    )


@report
def sentiment_by_agent(t: Tables) -> DataFrame:
    return (
        t["transcript_sentiment"]
        .groupBy("agent_name")
        .agg(
            F.count("*").alias("total_calls"),
            mean_score("sentiment_score").alias("avg_sentiment"),
            count_when(label_is("Negative")).alias("negative"),
            count_when(label_is("Positive")).alias("positive"),
        )
    )


@report
def sentiment_weekly(t: Tables) -> DataFrame:
    week = F.trunc("call_date", "week").cast("timestamp_ntz")
    return (
        t["transcript_sentiment"]
        .groupBy(week.alias("week"))
        .agg(mean_score("sentiment_score").alias("avg_sentiment"), F.count("*").alias("call_count"))
    )


@report
def negative_calls(t: Tables, limit: int = 20) -> DataFrame:
    """The inner join drops calls of unknown customers, so it comes before the limit."""
    people = t["customer_360_unified"].select("customer_id", "full_name", "customer_segment")
    return (
        t["transcript_sentiment"]
        .filter(label_is("Negative"))
        .join(people, "customer_id")
        .orderBy("sentiment_score", "transcript_id")
        .limit(limit)
        .select(
            "customer_id",
            "full_name",
            "customer_segment",
            "call_reason",
            "agent_name",
            F.round("sentiment_score", 3).alias("sentiment"),
            "call_summary",
            "call_date",
        )
    )


@report
def transcript_lookup(t: Tables) -> DataFrame:
    """One transcript per customer, the newest, read from the clean table."""
    order = [c("call_date").desc_nulls_first(), c("transcript_id").desc()]
    return top_per_key(t["clean_call_transcripts"], ["customer_id"], order, 1).select("customer_id", "transcript_text")


# ----------------------------------------------------------------- actions

PRIORITIES = ("High", "Medium")


def chosen_actions(t: Tables, priorities: Sequence[str], types: Sequence[str] | None) -> DataFrame:
    kept = t["next_best_action"].filter(c("action_type").isNotNull() & c("priority").isin(*priorities))
    return kept if types is None else kept.filter(c("action_type").isin(*types))


@report
def action_types(t: Tables) -> DataFrame:
    return t["next_best_action"].filter(c("action_type").isNotNull()).select("action_type").distinct()


@report
def action_kpis(t: Tables, priorities: Sequence[str] = PRIORITIES, types: Sequence[str] | None = None) -> DataFrame:
    return chosen_actions(t, priorities, types).agg(
        F.count("*").alias("total"),
        count_when(c("priority") == "High").alias("high_pri"),
        F.count_distinct("action_type").alias("types"),
        mean_score("churn_risk_score").alias("avg_churn"),
    )


@report
def actions_by_type(t: Tables, priorities: Sequence[str] = PRIORITIES, types: Sequence[str] | None = None) -> DataFrame:
    return chosen_actions(t, priorities, types).groupBy("action_type").agg(F.count("*").alias("action_count"))


@report
def actions_by_channel(
    t: Tables, priorities: Sequence[str] = PRIORITIES, types: Sequence[str] | None = None
) -> DataFrame:
    with_channel = chosen_actions(t, priorities, types).filter(c("recommended_channel").isNotNull())
    return with_channel.groupBy("recommended_channel").agg(F.count("*").alias("action_count"))


@report
def action_queue(
    t: Tables, priorities: Sequence[str] = PRIORITIES, types: Sequence[str] | None = None, limit: int = 100
) -> DataFrame:
    rank = F.when(c("priority") == "High", 1).when(c("priority") == "Medium", 2).otherwise(3)
    return (
        chosen_actions(t, priorities, types)
        .orderBy(rank, *highest_risk())
        .limit(limit)
        .select(
            "customer_id",
            "full_name",
            "customer_segment",
            "action_type",
            "action_description",
            "priority",
            "recommended_channel",
            F.round("churn_risk_score", 3).alias("churn_risk"),
        )
    )


# --------------------------------------------------------------- documents


@report
def document_kpis(t: Tables) -> DataFrame:
    return t["document_extracted"].agg(
        F.count("*").alias("total_docs"),
        count_when(c("document_type") == "Claim Form").alias("claim_forms"),
        count_when(c("document_type") == "Policy Summary").alias("policy_summaries"),
    )


@report
def documents_by_kind(t: Tables, document_type: str | None = None) -> DataFrame:
    rows = t["document_extracted"]
    if document_type is not None:
        rows = rows.filter(c("document_type") == document_type)
    return rows.select(
        "file_name",
        "document_type",
        "reference_number",
        "policy_number",
        "customer_name",
        "customer_id",
        "amount",
        "category",
        "status",
        "document_date",
    )


@report
def document_text(t: Tables, file_name: str = "claim_form_CLM-2.txt") -> DataFrame:
    found = t["parsed_documents"].filter(c("file_name") == file_name)
    return found.select("file_name", "parsed_text", "document_type", "file_size_bytes")


@report
def document_xref(t: Tables) -> DataFrame:
    people = scores(t).select(
        c("customer_id").cast("string").alias("_key"), "full_name", "customer_segment", "is_active", "churn_risk_score"
    )
    documents = t["document_extracted"].withColumn("_key", outer_key(try_number(c("customer_id"))))
    return documents.join(people, "_key", "left").select(
        "file_name",
        "document_type",
        "reference_number",
        c("customer_id").alias("doc_customer_id"),
        "amount",
        c("full_name").alias("c360_name"),
        "customer_segment",
        "is_active",
        F.round("churn_risk_score", 3).alias("churn_risk"),
    )


@report
def document_match_rate(t: Tables) -> DataFrame:
    """Documents are counted per number before the join, so a number with many documents is one row."""
    counted = (
        t["document_extracted"]
        .groupBy(try_number(c("customer_id")).cast("bigint").alias("customer_id"))
        .agg(F.count("*").alias("n"))
    )
    people = t["clean_customers"].select("customer_id", F.lit(True).alias("known"))
    matched = F.coalesce(F.sum(F.when(c("known"), c("n"))), F.lit(0))
    return counted.join(people, "customer_id", "left").agg(
        matched.alias("matched"), F.sum("n").alias("total"), percentage(matched, F.sum("n")).alias("matched_pct")
    )


# -------------------------------------------------------- verified queries


@report
def vq_high_risk_premium_customers(t: Tables) -> DataFrame:
    risky = (c("churn_risk_score") >= 0.7) & (c("customer_segment") == "Premium")
    return t["churn_risk"].filter(risky).agg(F.count_distinct("customer_id").alias("high_risk_premium_count"))


def _sentiment_by_segment(t: Tables) -> DataFrame:
    """Calls per customer first, so only one row per customer meets the customer table."""
    calls = t["transcript_sentiment"].groupBy("customer_id").agg(
        F.sum(c("sentiment_score").cast("decimal(9,4)")).alias("total"), F.count("*").alias("calls")
    )
    people = t["customer_360_unified"].select("customer_id", "customer_segment")
    return (
        people.join(calls, "customer_id")
        .groupBy("customer_segment")
        .agg(F.sum("total").alias("total"), F.sum("calls").alias("calls"))
    )


@report
def vq_avg_sentiment_by_segment(t: Tables) -> DataFrame:
    return _sentiment_by_segment(t).select("customer_segment", ratio(c("total"), c("calls")).alias("avg_sentiment"))


@report
def vq_top_churn_risk_with_nba(t: Tables, limit: int = 10) -> DataFrame:
    return (
        actions(t)
        .orderBy(*highest_risk())
        .limit(limit)
        .select(
            "customer_id",
            "full_name",
            "customer_segment",
            "churn_risk_score",
            "retention_urgency",
            "action_type",
            "action_description",
            "priority",
        )
    )


@report
def vq_common_nba_negative_sentiment(t: Tables) -> DataFrame:
    unhappy = t["next_best_action"].filter(c("latest_sentiment_label") == "Negative")
    return unhappy.groupBy("action_type").agg(F.count("*").alias("action_count"))


@report
def vq_customer_count_by_segment_country(t: Tables) -> DataFrame:
    return (
        t["customer_360_unified"].groupBy("customer_segment", "country").agg(F.count("*").alias("customer_count"))
    )


@report
def vq_churn_risk_distribution(t: Tables) -> DataFrame:
    labels = ("Critical (0.8-1.0)", "High (0.6-0.8)", "Medium (0.4-0.6)", "Low (0.2-0.4)", "Minimal (0-0.2)")
    known = t["churn_risk"].filter(c("churn_risk_score").isNotNull())
    return known.groupBy(risk_bucket(labels).alias("risk_bucket")).agg(F.count("*").alias("customer_count"))


def _risky_with_open_claims(t: Tables) -> DataFrame:
    return t["churn_risk"].filter((c("open_claims") > 0) & (c("churn_risk_score") >= 0.6))


@report
def vq_open_claims_high_churn(t: Tables) -> DataFrame:
    return _risky_with_open_claims(t).select(
        "customer_id", "full_name", "customer_segment", F.round("churn_risk_score", 3).alias("churn_risk_score"), "open_claims"
    )


@report
def vq_avg_premium_by_country(t: Tables) -> DataFrame:
    paying = t["customer_360_unified"].filter(c("total_premium") > 0)
    return paying.groupBy("country").agg(
        mean("total_premium", 2).alias("avg_premium"), F.count("*").alias("customer_count")
    )


@report
def vq_delinquent_loans_by_segment(t: Tables) -> DataFrame:
    late = t["customer_360_unified"].filter(c("max_days_past_due") >= 90)
    return late.groupBy("customer_segment").agg(
        F.count("*").alias("customer_count"), mean("max_days_past_due", 0).alias("avg_days_past_due")
    )


@report
def vq_documents_by_type(t: Tables) -> DataFrame:
    return t["document_extracted"].groupBy("document_type").agg(F.count("*").alias("document_count"))


# ---------------------------------------------------------- routed answers


@report
def qa_top_churn(t: Tables, limit: int = 10) -> DataFrame:
    return (
        actions(t)
        .orderBy(*highest_risk())
        .limit(limit)
        .select(
            "customer_id",
            "full_name",
            "customer_segment",
            F.round("churn_risk_score", 3).alias("churn_risk"),
            "retention_urgency",
            "action_type",
            "priority",
        )
    )


@report
def qa_churn_distribution(t: Tables) -> DataFrame:
    known = t["churn_risk"].filter(c("churn_risk_score").isNotNull())
    bucket = risk_bucket(("Critical", "High", "Medium", "Low", "Minimal"))
    return known.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("customers"))


@report
def qa_sentiment_segment(t: Tables) -> DataFrame:
    average = F.round(F.try_divide("total", "calls"), 3).cast("double")
    return _sentiment_by_segment(t).select("customer_segment", average.alias("avg_sentiment"), "calls")


@report
def qa_claims_risk(t: Tables, limit: int = 15) -> DataFrame:
    return (
        _risky_with_open_claims(t)
        .orderBy(*highest_risk())
        .limit(limit)
        .select(
            "customer_id", "full_name", "customer_segment", F.round("churn_risk_score", 3).alias("churn_risk"), "open_claims"
        )
    )


@report
def qa_premium_high(t: Tables) -> DataFrame:
    risky = (c("churn_risk_score") >= 0.7) & (c("customer_segment") == "Premium")
    return t["churn_risk"].filter(risky).agg(F.count("*").alias("cnt"))


@report
def qa_complaints(t: Tables) -> DataFrame:
    return (
        scores(t)
        .filter(c("complaint_count") > 2)
        .select(
            "customer_id",
            "full_name",
            "customer_segment",
            "complaint_count",
            F.round("churn_risk_score", 3).alias("churn_risk"),
            "action_type",
            "priority",
        )
    )


@report
def qa_documents(t: Tables, limit: int = 20) -> DataFrame:
    return (
        t["document_extracted"]
        .orderBy(c("file_modified_at").desc_nulls_first(), c("document_id").asc())
        .limit(limit)
        .select(
            "file_name", "document_type", "reference_number", "customer_name", "customer_id", "amount", "category", "status"
        )
    )


# ---------------------------------------------------------------- analyses


@report
def nb_segment_profile(t: Tables) -> DataFrame:
    return (
        t["customer_360_unified"]
        .groupBy("customer_segment")
        .agg(
            F.count("*").alias("customers"),
            mean("credit_score", 0).alias("avg_credit"),
            mean("annual_income", 0).alias("avg_income"),
            mean("total_premium", 0).alias("avg_premium"),
            mean("estimated_clv", 0).alias("avg_clv"),
            percentage(count_when(c("is_active")), F.count("*"), 1).alias("active_pct"),
        )
    )


@report
def nb_risk_factors(t: Tables) -> DataFrame:
    group = F.when(c("churn_risk_score") >= 0.6, "High Risk").otherwise("Low Risk")
    return (
        actions(t)
        .groupBy(group.alias("risk_group"))
        .agg(
            mean("complaint_count", 2).alias("avg_complaints"),
            mean("max_days_past_due", 0).alias("avg_dpd"),
            mean("lapsed_policies", 2).alias("avg_lapsed"),
            mean("days_since_last_interaction", 0).alias("avg_days_no_contact"),
            F.count("*").alias("customers"),
        )
    )


@report
def nb_health_distribution(t: Tables) -> DataFrame:
    return (
        t["customer_health_score"]
        .groupBy("health_grade", "customer_segment")
        .agg(F.count("*").alias("customers"), mean_score("health_score", 1).alias("avg_score"))
    )


@report
def nb_revenue_at_risk(t: Tables) -> DataFrame:
    return (
        scores(t)
        .filter(c("churn_risk_score") >= 0.4)
        .groupBy("retention_urgency")
        .agg(
            F.count("*").alias("customers"),
            F.round(F.sum("total_premium"), 0).alias("premium_at_risk"),
            F.round(F.sum(c("estimated_clv").cast("decimal(28,4)")), 0).alias("clv_at_risk"),
        )
    )


# ----------------------------------------------------------- demo questions


@report
def daily_churn_digest(t: Tables, limit: int = 5) -> DataFrame:
    return (
        actions(t)
        .filter(c("churn_risk_score") > 0.8)
        .orderBy(*highest_risk())
        .limit(limit)
        .select("customer_id", "full_name", "customer_segment", "churn_risk_score", "action_type")
    )


@report
def profile_raw_customers(t: Tables) -> DataFrame:
    return t["raw_customers"].agg(
        F.count("*").alias("rows"), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created")
    )


@report
def recent_complaint_high_churn(t: Tables, days: int = 30) -> DataFrame:
    """Scored customers above 0.7 with a complaint in the last days: a semi join, so no customer repeats."""
    since = F.lit(t.as_of - datetime.timedelta(days=days))
    complaints = t["clean_interactions"].filter(
        (c("interaction_type") == "Complaint") & (c("interaction_date") >= since)
    )
    complaints = complaints.select("customer_id").distinct()  # one row per customer reaches the join
    return (
        t["churn_risk"]
        .filter(c("churn_risk_score") > 0.7)
        .join(complaints, "customer_id", "left_semi")
        .select("customer_id", "full_name", "customer_segment", "churn_risk_score")
    )


@report
def queue_summary(t: Tables, top: int = 3) -> DataFrame:
    """Totals by action type, then the ``top`` high-priority customers, as labelled rows."""
    totals = t["next_best_action"].groupBy("action_type").agg(F.count("*").alias("actions")).select(
        F.lit("total").alias("part"), "action_type", "actions", F.lit(None).cast("bigint").alias("customer_id")
    )
    first = (
        t["next_best_action"]
        .filter(c("priority") == "High")
        .orderBy(*highest_risk())
        .limit(top)
        .select(F.lit("top").alias("part"), "action_type", F.lit(None).cast("bigint").alias("actions"), "customer_id")
    )
    return totals.unionByName(first)


@report
def top_premium_churn(t: Tables, limit: int = 5) -> DataFrame:
    return (
        t["churn_risk"]
        .filter((c("customer_segment") == "Premium") & c("churn_risk_score").isNotNull())
        .orderBy(*highest_risk())
        .limit(limit)
        .select("customer_id", "full_name", "churn_risk_score", "retention_urgency")
    )
