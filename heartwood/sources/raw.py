"""The seven raw tables, expressed as views over the given tables.

Each view covers every row of its source and carries the defects the clean
layer repairs: padding, mixed case, NULLs, duplicate keys, orphans. See
FIXTURES.md for the definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT_DAYS = 8035  # moves the order dates in front of the events


def raw_customers(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    versions = F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("version", F.explode(versions))
        .selectExpr(
            "c_custkey AS customer_id",
            "concat('  ', lower(substr(c_name, 1, 8)), ' ') AS first_name",
            "substr(c_name, 10) AS last_name",
            "concat(' User', c_custkey, '@Mail', c_custkey % 5, '.COM') AS email",
            "concat(CASE WHEN c_custkey % 3 = 0 THEN concat('+1-', 200 + c_custkey % 800, '-')"
            " ELSE concat('+1 (', 200 + c_custkey % 800, ') 555 ') END, 1000 + (c_custkey * 7919) % 9000) AS phone",
            "date_add(DATE '1945-01-01', CAST((c_custkey * 97) % 20000 AS INT)) AS dob",
            "concat(' ', 100 + c_custkey % 900, ' Main St') AS address",
            "CASE version WHEN 1 THEN 'old town' ELSE lower(n_name) END AS city",
            "lower(r_name) AS state",
            "CASE c_nationkey % 6 WHEN 0 THEN 'usa' WHEN 1 THEN 'uk' WHEN 2 THEN 'canada' WHEN 3 THEN 'india'"
            " WHEN 4 THEN 'singapore' ELSE 'australia' END AS country",
            "CASE WHEN c_custkey % 40 = 7 THEN NULL WHEN c_mktsegment = 'AUTOMOBILE' THEN 'VIP'"
            " WHEN c_mktsegment = 'MACHINERY' THEN 'Premium' WHEN c_mktsegment = 'FURNITURE' THEN 'Basic'"
            " ELSE 'Standard' END AS customer_segment",
            "CAST(480 + (c_custkey * 31) % 371 AS INT) AS credit_score",
            "CAST(20000 + abs(c_acctbal) * 20 AS DECIMAL(12,2)) AS annual_income",
            "CASE c_custkey % 5 WHEN 0 THEN 'Employed' WHEN 1 THEN 'Self-Employed' WHEN 2 THEN 'Retired'"
            " WHEN 3 THEN 'Unemployed' END AS employment_status",
            "CASE WHEN c_custkey % 50 = 3 THEN NULL ELSE c_custkey % 7 <> 0 END AS is_active",
            "CASE WHEN c_custkey % 60 = 11 THEN NULL ELSE CAST(date_sub(DATE '2024-02-01',"
            " CAST(30 + (c_custkey * 37) % 2500 AS INT)) AS TIMESTAMP_NTZ) END AS created_at",
            "CASE WHEN version = 1 AND c_custkey % 20 = 0 THEN NULL ELSE CAST(date_sub(DATE '2024-02-01',"
            " CAST(version * 60 + c_custkey % 60 AS INT)) AS TIMESTAMP_NTZ) END AS updated_at",
        )
    )


def raw_policies(orders: DataFrame) -> DataFrame:
    return orders.withColumn("d", F.expr(f"date_add(CAST(o_orderdate AS DATE), {SHIFT_DAYS})")).selectExpr(
        "o_orderkey AS policy_id",
        "o_custkey AS customer_id",
        "CASE o_orderpriority WHEN '1-URGENT' THEN ' Auto' WHEN '2-HIGH' THEN 'home ' WHEN '3-MEDIUM' THEN 'Life'"
        " WHEN '4-NOT SPECIFIED' THEN 'Health' ELSE 'Travel' END AS policy_type",
        "CASE WHEN o_orderstatus <> 'F' THEN 'Active' WHEN o_orderkey % 3 = 0 THEN 'Lapsed'"
        " WHEN o_orderkey % 9 = 1 THEN 'Cancelled' ELSE 'Renewed' END AS policy_status",
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS premium_amount",
        "CAST(o_totalprice * 10 AS DECIMAL(14,2)) AS coverage_amount",
        "CAST(250 + o_orderkey % 4750 AS DECIMAL(10,2)) AS deductible_amount",
        "d AS start_date",
        "date_add(d, 365) AS end_date",
        "date_add(d, CAST(365 + o_orderkey % 60 AS INT)) AS renewal_date",
        "CAST(20 + o_orderkey % 81 AS DECIMAL(5,2)) AS underwriting_score",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS risk_category",
        "CAST(d AS TIMESTAMP_NTZ) AS created_at",
    )


def raw_claims(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("d", F.expr(f"date_add(CAST(l_shipdate AS DATE), {SHIFT_DAYS})"))
        .selectExpr(
            "l_orderkey * 10 + l_linenumber AS claim_id",
            "l_orderkey AS policy_id",
            "o_custkey AS customer_id",
            "CASE l_linenumber % 3 WHEN 0 THEN 'accident' WHEN 1 THEN 'natural disaster ' ELSE 'THEFT' END AS claim_type",
            "CASE WHEN l_partkey % 40 = 0 THEN 'Open' WHEN l_partkey % 40 = 1 THEN 'InReview'"
            " WHEN l_partkey % 40 = 2 THEN 'Denied' WHEN l_returnflag = 'A' THEN 'Settled' ELSE 'Approved' END AS claim_status",
            "CAST(l_extendedprice AS DECIMAL(12,2)) AS claim_amount",
            "CASE WHEN l_partkey % 40 > 2 THEN CAST(floor(l_extendedprice * (1 - l_discount)) AS DECIMAL(12,2)) END AS settlement_amount",
            "d AS filed_date",
            "CASE WHEN l_partkey % 40 > 1 THEN date_add(d, CAST(l_quantity AS INT)) END AS resolved_date",
            "concat('claim on part ', l_partkey) AS description",
            "CAST(d AS TIMESTAMP_NTZ) AS created_at",
        )
    )


def raw_loans(orders: DataFrame) -> DataFrame:
    return orders.withColumn("d", F.expr(f"date_add(CAST(o_orderdate AS DATE), {SHIFT_DAYS})")).selectExpr(
        "o_orderkey AS loan_id",
        "o_custkey AS customer_id",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Mortgage' WHEN 1 THEN 'auto ' WHEN 2 THEN 'Personal' ELSE 'Business' END AS loan_type",
        "CASE WHEN o_orderkey % 100 = 0 THEN 'Default' WHEN o_orderkey % 50 = 25 THEN 'Delinquent'"
        " WHEN o_orderkey % 20 = 10 THEN 'PaidOff' ELSE 'Active' END AS loan_status",
        "CAST(o_totalprice AS DECIMAL(14,2)) AS principal_amount",
        "CAST(1.5 + o_orderkey % 12 AS DECIMAL(5,3)) AS interest_rate",
        "CAST(floor(o_totalprice / 120) AS DECIMAL(10,2)) AS monthly_payment",
        "CAST(CASE WHEN o_orderkey % 20 = 10 THEN 0 ELSE floor(o_totalprice * (o_orderkey % 100) / 100) END"
        " AS DECIMAL(14,2)) AS outstanding_balance",
        "d AS origination_date",
        "date_add(d, 3650) AS maturity_date",
        "CASE WHEN o_orderkey % 100 = 0 THEN CAST(150 + o_orderkey % 185 AS INT)"
        " WHEN o_orderkey % 50 = 25 THEN CAST(o_orderkey % 180 AS INT)"
        " WHEN o_orderkey % 100 = 15 THEN NULL ELSE 0 END AS days_past_due",
        "CAST(d AS TIMESTAMP_NTZ) AS created_at",
    )


def raw_interactions(events: DataFrame) -> DataFrame:
    versions = F.when(F.col("event_id") % 20 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.withColumn("version", F.explode(versions)).selectExpr(
        "event_id AS interaction_id",
        "user_id * 10 + event_id % 10 AS customer_id",
        "CASE event_id % 6 WHEN 0 THEN 'Email' WHEN 1 THEN ' phone' WHEN 2 THEN 'Chat' WHEN 3 THEN 'Branch'"
        " WHEN 4 THEN 'Web' ELSE 'Mobile' END AS channel",
        "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Complaint' WHEN event_type = 'signup' THEN 'Inquiry'"
        " WHEN event_type = 'purchase' THEN 'Payment' WHEN event_type = 'view' THEN 'ClaimUpdate'"
        " ELSE 'ServiceRequest' END AS interaction_type",
        "concat(event_type, ' request') AS subject",
        "CASE event_id % 8 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE concat('note ', event_type, ' ', props) END AS notes",
        "CASE WHEN version = 1 THEN 'Escalated' WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'Escalated'"
        " WHEN event_id % 5 = 2 THEN ' pending' ELSE 'Resolved' END AS resolution_status",
        "concat('AGT-', lpad(CAST(event_id % 900 AS STRING), 3, '0')) AS agent_id",
        "ts AS interaction_date",
        "CASE WHEN event_id % 6 IN (1, 2, 3) THEN CAST(120 + event_id % 1680 AS INT) END AS duration_seconds",
        "ts - make_dt_interval(version) AS created_at",
    )


def raw_call_transcripts(conversations: DataFrame) -> DataFrame:
    speaker = "CASE role WHEN 'user' THEN 'Customer: ' WHEN 'assistant' THEN 'Agent: ' ELSE 'System: ' END"
    calls = conversations.groupBy("conv_id").agg(
        F.expr(f"listagg(concat({speaker}, text), '\n') WITHIN GROUP (ORDER BY turn)").alias("whole_text")
    )
    day = "CAST(date_sub(DATE '2024-01-31', CAST((conv_id * 13) % 365 AS INT)) AS TIMESTAMP_NTZ)"
    written = "CAST(date_sub(DATE '2024-01-31', CAST((conv_id * 13) % 365 + version * 30 AS INT)) AS TIMESTAMP_NTZ)"
    versions = F.when(F.col("conv_id") % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # None to many calls a customer, one customer with a third of all.
    return calls.withColumn("version", F.explode(versions)).selectExpr(
        "conv_id AS transcript_id",
        "CASE WHEN conv_id % 3 = 0 THEN 1 ELSE conv_id div 4 END AS customer_id",
        "CASE WHEN conv_id % 2 = 0 THEN conv_id * 3 END AS interaction_id",
        f"{day} AS call_date",
        "CAST(120 + conv_id % 1080 AS INT) AS duration_seconds",
        "concat('AGT-', lpad(CAST(conv_id % 900 AS STRING), 3, '0')) AS agent_id",
        "CASE conv_id % 4 WHEN 0 THEN 'sarah mitchell ' WHEN 1 THEN 'Michael Torres' WHEN 2 THEN 'jessica chen'"
        " ELSE 'David Patel' END AS agent_name",
        "CASE WHEN conv_id % 25 = 9 THEN '  ' ELSE whole_text END AS transcript_text",
        "CASE WHEN version = 1 THEN 'unknown' WHEN conv_id % 5 = 0 THEN 'claim status' WHEN conv_id % 5 = 1 THEN 'Complaint'"
        " WHEN conv_id % 5 = 2 THEN 'Policy Renewal' WHEN conv_id % 5 = 3 THEN 'Payment Issue' ELSE 'premium dispute' END AS call_reason",
        f"{written} AS created_at",
    )


def raw_documents(documents: DataFrame) -> DataFrame:
    claim_form = (
        "concat('Claim Number: CLM-', doc_id, '\nPolicy Number: POL-', doc_id * 3, '\nCustomer Name: Customer ', doc_id,"
        " '\nCustomer ID: ', CASE WHEN doc_id % 10 = 8 THEN 'unknown' ELSE CAST(doc_id AS STRING) END,"
        " '\nDate Filed: ', date_sub(DATE '2024-01-01', CAST(doc_id % 300 AS INT)),"
        " '\nClaim Type: ', CASE doc_id % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Home' ELSE 'Health' END,"
        " '\nClaim Amount: $', 1 + doc_id % 50, ',', 100 + doc_id % 900, '.00\nStatus: Open\n\nDescription:\n', text)"
    )
    policy_summary = (
        "concat('Policy Number: POL-', doc_id, '\nCustomer Name: Customer ', doc_id, '\nCustomer ID: ', doc_id,"
        " '\nPolicy Type: Life\nEffective Date: 2023-05-01\nAnnual Premium: $', 300 + doc_id % 700, '.00\n', text)"
    )
    versions = F.when(F.col("doc_id") % 10 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # None to many documents a customer, one customer with a third of all.
    return documents.withColumn("version", F.explode(versions)).selectExpr(
        "doc_id AS document_id",
        "CASE WHEN doc_id % 11 = 4 THEN NULL WHEN doc_id % 3 = 0 THEN 2 ELSE doc_id div 3 END AS customer_id",
        "CASE doc_id % 2 WHEN 0 THEN 'Claim Form' ELSE 'Policy Summary' END AS document_type",
        "concat(CASE doc_id % 2 WHEN 0 THEN 'claim_form_CLM-' ELSE 'policy_summary_POL-' END, doc_id, '.txt') AS file_name",
        f"CASE WHEN doc_id % 13 = 5 THEN '  ' WHEN doc_id % 2 = 0 THEN {claim_form} ELSE {policy_summary} END AS document_text",
        "n_chars + version AS file_size_bytes",
        "CAST(date_sub(DATE '2024-01-15', CAST(doc_id % 90 + version * 20 AS INT)) AS TIMESTAMP_NTZ) AS created_at",
    )


def raw_model_output(customer: DataFrame, *carried: str) -> DataFrame:
    """Stands for the text a hosted model returns: fenced JSON, refusals, broken JSON."""
    reply = (
        "concat('```json\n{\"churn_risk_score\": ', CAST((c_custkey % 101) * 0.01 AS DECIMAL(4,2)),"
        " ', \"retention_urgency\": \"Low\", \"risk_factors\": [\"a\",\"b\"], \"confidence\": 0.5}\n```')"
    )
    return customer.selectExpr(
        "c_custkey AS customer_id",
        "CASE WHEN c_custkey % 17 = 0 THEN 'I cannot answer'"
        f" WHEN c_custkey % 19 = 0 THEN '{{\"churn_risk_score\": }}' ELSE {reply} END AS raw_text",
        *carried,
    )


# raw table -> (view, the given tables it reads)
RAW_VIEWS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "raw_customers": (raw_customers, ("customer", "nation", "region")),
    "raw_policies": (raw_policies, ("orders",)),
    "raw_claims": (raw_claims, ("lineitem", "orders")),
    "raw_loans": (raw_loans, ("orders",)),
    "raw_interactions": (raw_interactions, ("events",)),
    "raw_call_transcripts": (raw_call_transcripts, ("conversations",)),
    "raw_documents": (raw_documents, ("documents",)),
    "raw_model_output": (raw_model_output, ("customer",)),
}
