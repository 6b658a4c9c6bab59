"""DuckDB definitions of the raw views and derived tables.

Each entry of ``CTES`` is one common table expression. An oracle names the
tables it needs; ``with_tables`` puts exactly those, and what they depend on,
in front of it. The text follows the reference semantics directly and shares
nothing with the Spark code.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2024-02-01'"

TITLE = (
    "array_to_string(list_transform(string_split(lower(trim({0})), ' '),"
    " lambda w: concat(upper(w[1]), w[2:])), ' ')"
)


def title(column: str) -> str:
    return TITLE.format(column)


def half_up(part: str, whole: str, digits: int) -> str:
    """Quotient of two whole numbers rounded half away from zero, in whole numbers throughout."""
    p, w, scale = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)", 10**digits
    return f"CAST(sign({p}) * ((2 * abs({p}) * {scale} + {w}) // nullif(2 * {w}, 0)) AS DOUBLE) / {scale}"


def mean(column: str, digits: int, places: int) -> str:
    """Average of values with ``places`` decimals, rounded exactly."""
    return half_up(f"sum(CAST({column} AS DECIMAL(28,{places}))) * {10**places}", f"count({column}) * {10**places}", digits)


def share(part: str, whole: str, digits: int) -> str:
    return half_up(f"({part}) * 100", whole, digits)


CTES: dict[str, str] = {}

# --------------------------------------------------------------------- raw
CTES["raw_customers"] = """
SELECT c_custkey AS customer_id, '  ' || lower(substr(c_name,1,8)) || ' ' AS first_name, substr(c_name,10) AS last_name,
 ' User' || CAST(c_custkey AS VARCHAR) || '@Mail' || CAST(c_custkey % 5 AS VARCHAR) || '.COM' AS email,
 CASE WHEN c_custkey % 3 = 0 THEN '+1-' || CAST(200 + c_custkey % 800 AS VARCHAR) || '-'
      ELSE '+1 (' || CAST(200 + c_custkey % 800 AS VARCHAR) || ') 555 ' END || CAST(1000 + (c_custkey*7919) % 9000 AS VARCHAR) AS phone,
 DATE '1945-01-01' + CAST((c_custkey*97) % 20000 AS INT) AS dob,
 ' ' || CAST(100 + c_custkey % 900 AS VARCHAR) || ' Main St' AS address,
 CASE v.k WHEN 1 THEN 'old town' ELSE lower(n_name) END AS city, lower(r_name) AS state,
 CASE c_nationkey % 6 WHEN 0 THEN 'usa' WHEN 1 THEN 'uk' WHEN 2 THEN 'canada' WHEN 3 THEN 'india' WHEN 4 THEN 'singapore' ELSE 'australia' END AS country,
 CASE WHEN c_custkey % 40 = 7 THEN NULL WHEN c_mktsegment='AUTOMOBILE' THEN 'VIP' WHEN c_mktsegment='MACHINERY' THEN 'Premium' WHEN c_mktsegment='FURNITURE' THEN 'Basic' ELSE 'Standard' END AS customer_segment,
 CAST(480 + (c_custkey*31) % 371 AS INT) AS credit_score, CAST(20000 + abs(c_acctbal)*20 AS DECIMAL(12,2)) AS annual_income,
 CASE c_custkey % 5 WHEN 0 THEN 'Employed' WHEN 1 THEN 'Self-Employed' WHEN 2 THEN 'Retired' WHEN 3 THEN 'Unemployed' ELSE NULL END AS employment_status,
 CASE WHEN c_custkey % 50 = 3 THEN NULL ELSE c_custkey % 7 <> 0 END AS is_active,
 CASE WHEN c_custkey % 60 = 11 THEN NULL ELSE CAST(DATE '2024-02-01' - CAST(30 + (c_custkey*37) % 2500 AS INT) AS TIMESTAMP) END AS created_at,
 CASE WHEN v.k = 1 AND c_custkey % 20 = 0 THEN NULL ELSE CAST(DATE '2024-02-01' - CAST(v.k*60 + c_custkey % 60 AS INT) AS TIMESTAMP) END AS updated_at
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
JOIN (SELECT 0 AS k UNION ALL SELECT 1) v ON v.k = 0 OR c_custkey % 10 = 0"""

CTES["raw_policies"] = """
SELECT o_orderkey AS policy_id, o_custkey AS customer_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN ' Auto' WHEN '2-HIGH' THEN 'home ' WHEN '3-MEDIUM' THEN 'Life' WHEN '4-NOT SPECIFIED' THEN 'Health' ELSE 'Travel' END AS policy_type,
 CASE WHEN o_orderstatus='F' AND o_orderkey % 3 = 0 THEN 'Lapsed' WHEN o_orderstatus='F' AND o_orderkey % 9 = 1 THEN 'Cancelled' WHEN o_orderstatus='F' THEN 'Renewed' ELSE 'Active' END AS policy_status,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS premium_amount,
 CAST(o_totalprice*10 AS DECIMAL(14,2)) AS coverage_amount, CAST(250 + o_orderkey % 4750 AS DECIMAL(10,2)) AS deductible_amount,
 CAST(o_orderdate AS DATE) + 8035 AS start_date, CAST(o_orderdate AS DATE) + 8400 AS end_date,
 CAST(o_orderdate AS DATE) + CAST(8400 + o_orderkey % 60 AS INT) AS renewal_date,
 CAST(20 + o_orderkey % 81 AS DECIMAL(5,2)) AS underwriting_score,
 CASE o_orderkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE NULL END AS risk_category,
 CAST(CAST(o_orderdate AS DATE) + 8035 AS TIMESTAMP) AS created_at
FROM orders"""

CTES["raw_claims"] = """
SELECT l_orderkey*10 + l_linenumber AS claim_id, l_orderkey AS policy_id, o_custkey AS customer_id,
 CASE l_linenumber % 3 WHEN 0 THEN 'accident' WHEN 1 THEN 'natural disaster ' ELSE 'THEFT' END AS claim_type,
 CASE l_partkey % 40 WHEN 0 THEN 'Open' WHEN 1 THEN 'InReview' WHEN 2 THEN 'Denied' ELSE CASE WHEN l_returnflag='A' THEN 'Settled' ELSE 'Approved' END END AS claim_status,
 CAST(l_extendedprice AS DECIMAL(12,2)) AS claim_amount,
 CASE WHEN l_partkey % 40 > 2 THEN CAST(floor(l_extendedprice*(1-l_discount)) AS DECIMAL(12,2)) END AS settlement_amount,
 CAST(l_shipdate AS DATE) + 8035 AS filed_date,
 CASE WHEN l_partkey % 40 > 1 THEN CAST(l_shipdate AS DATE) + CAST(8035 + l_quantity AS INT) END AS resolved_date,
 'claim on part ' || CAST(l_partkey AS VARCHAR) AS description,
 CAST(CAST(l_shipdate AS DATE) + 8035 AS TIMESTAMP) AS created_at
FROM lineitem JOIN orders ON l_orderkey=o_orderkey"""

CTES["raw_loans"] = """
SELECT o_orderkey AS loan_id, o_custkey AS customer_id,
 CASE o_orderkey % 4 WHEN 0 THEN 'Mortgage' WHEN 1 THEN 'auto ' WHEN 2 THEN 'Personal' ELSE 'Business' END AS loan_type,
 CASE o_orderkey % 100 WHEN 0 THEN 'Default' WHEN 25 THEN 'Delinquent' WHEN 75 THEN 'Delinquent' ELSE CASE WHEN o_orderkey % 20 = 10 THEN 'PaidOff' ELSE 'Active' END END AS loan_status,
 CAST(o_totalprice AS DECIMAL(14,2)) AS principal_amount, CAST(1.5 + o_orderkey % 12 AS DECIMAL(5,3)) AS interest_rate,
 CAST(floor(o_totalprice/120) AS DECIMAL(10,2)) AS monthly_payment,
 CAST(CASE WHEN o_orderkey % 20 = 10 THEN 0 ELSE floor(o_totalprice * (o_orderkey % 100) / 100) END AS DECIMAL(14,2)) AS outstanding_balance,
 CAST(o_orderdate AS DATE) + 8035 AS origination_date, CAST(o_orderdate AS DATE) + 11685 AS maturity_date,
 CASE o_orderkey % 100 WHEN 0 THEN CAST(150 + o_orderkey % 185 AS INT) WHEN 25 THEN CAST(o_orderkey % 180 AS INT) WHEN 75 THEN CAST(o_orderkey % 180 AS INT) WHEN 15 THEN NULL ELSE 0 END AS days_past_due,
 CAST(CAST(o_orderdate AS DATE) + 8035 AS TIMESTAMP) AS created_at
FROM orders"""

CTES["raw_interactions"] = """
SELECT event_id AS interaction_id, user_id*10 + event_id % 10 AS customer_id,
 CASE event_id % 6 WHEN 0 THEN 'Email' WHEN 1 THEN ' phone' WHEN 2 THEN 'Chat' WHEN 3 THEN 'Branch' WHEN 4 THEN 'Web' ELSE 'Mobile' END AS channel,
 CASE WHEN event_type='error' AND event_id % 3 = 0 THEN 'Complaint' WHEN event_type='signup' THEN 'Inquiry' WHEN event_type='purchase' THEN 'Payment' WHEN event_type='view' THEN 'ClaimUpdate' ELSE 'ServiceRequest' END AS interaction_type,
 event_type || ' request' AS subject, CASE WHEN event_id % 8 = 0 THEN '  ' WHEN event_id % 8 = 1 THEN NULL ELSE 'note ' || event_type || ' ' || props END AS notes,
 CASE WHEN version = 1 THEN 'Escalated' ELSE CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Escalated' WHEN 2 THEN ' pending' ELSE 'Resolved' END END AS resolution_status,
 'AGT-' || lpad(CAST(event_id % 900 AS VARCHAR), 3, '0') AS agent_id,
 ts AS interaction_date, CASE WHEN event_id % 6 IN (1,2,3) THEN CAST(120 + event_id % 1680 AS INT) END AS duration_seconds, ts - to_days(version) AS created_at
FROM (SELECT *, unnest(CASE WHEN event_id % 20 = 4 THEN [0, 1] ELSE [0] END) AS version FROM events)"""

CTES["raw_call_transcripts"] = """
SELECT conv_id AS transcript_id, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE conv_id // 4 END AS customer_id, CASE WHEN conv_id % 2 = 0 THEN conv_id * 3 END AS interaction_id,
 CAST(DATE '2024-01-31' - CAST((conv_id*13) % 365 AS INT) AS TIMESTAMP) AS call_date, CAST(120 + conv_id % 1080 AS INT) AS duration_seconds,
 'AGT-' || lpad(CAST(conv_id % 900 AS VARCHAR), 3, '0') AS agent_id,
 CASE conv_id % 4 WHEN 0 THEN 'sarah mitchell ' WHEN 1 THEN 'Michael Torres' WHEN 2 THEN 'jessica chen' ELSE 'David Patel' END AS agent_name,
 CASE WHEN conv_id % 25 = 9 THEN '  ' ELSE string_agg(CASE role WHEN 'user' THEN 'Customer: ' WHEN 'assistant' THEN 'Agent: ' ELSE 'System: ' END || text, chr(10) ORDER BY turn) END AS transcript_text,
 CASE WHEN version = 1 THEN 'unknown' ELSE CASE conv_id % 5 WHEN 0 THEN 'claim status' WHEN 1 THEN 'Complaint' WHEN 2 THEN 'Policy Renewal' WHEN 3 THEN 'Payment Issue' ELSE 'premium dispute' END END AS call_reason,
 CAST(DATE '2024-01-31' - CAST((conv_id*13) % 365 + version * 30 AS INT) AS TIMESTAMP) AS created_at
FROM (SELECT *, unnest(CASE WHEN conv_id % 10 = 3 THEN [0, 1] ELSE [0] END) AS version FROM conversations) GROUP BY conv_id, version"""

CTES["raw_documents"] = """
SELECT doc_id AS document_id, CASE WHEN doc_id % 11 = 4 THEN NULL WHEN doc_id % 3 = 0 THEN 2 ELSE doc_id // 3 END AS customer_id,
 CASE doc_id % 2 WHEN 0 THEN 'Claim Form' ELSE 'Policy Summary' END AS document_type,
 CASE doc_id % 2 WHEN 0 THEN 'claim_form_CLM-' ELSE 'policy_summary_POL-' END || CAST(doc_id AS VARCHAR) || '.txt' AS file_name,
 CASE WHEN doc_id % 13 = 5 THEN '  '
  WHEN doc_id % 2 = 0 THEN 'Claim Number: CLM-' || CAST(doc_id AS VARCHAR) || chr(10) || 'Policy Number: POL-' || CAST(doc_id*3 AS VARCHAR) || chr(10)
   || 'Customer Name: Customer ' || CAST(doc_id AS VARCHAR) || chr(10) || 'Customer ID: ' || CASE WHEN doc_id % 10 = 8 THEN 'unknown' ELSE CAST(doc_id AS VARCHAR) END || chr(10)
   || 'Date Filed: ' || CAST(DATE '2024-01-01' - CAST(doc_id % 300 AS INT) AS VARCHAR) || chr(10) || 'Claim Type: ' || CASE doc_id % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Home' ELSE 'Health' END || chr(10)
   || 'Claim Amount: $' || CAST(1 + doc_id % 50 AS VARCHAR) || ',' || CAST(100 + doc_id % 900 AS VARCHAR) || '.00' || chr(10) || 'Status: Open' || chr(10) || chr(10) || 'Description:' || chr(10)
  ELSE 'Policy Number: POL-' || CAST(doc_id AS VARCHAR) || chr(10) || 'Customer Name: Customer ' || CAST(doc_id AS VARCHAR) || chr(10) || 'Customer ID: ' || CAST(doc_id AS VARCHAR) || chr(10)
   || 'Policy Type: Life' || chr(10) || 'Effective Date: 2023-05-01' || chr(10) || 'Annual Premium: $' || CAST(300 + doc_id % 700 AS VARCHAR) || '.00' || chr(10) END
  || CASE WHEN doc_id % 13 = 5 THEN '' ELSE text END AS document_text,
 n_chars + version AS file_size_bytes, CAST(DATE '2024-01-15' - CAST(doc_id % 90 + version * 20 AS INT) AS TIMESTAMP) AS created_at
FROM (SELECT *, unnest(CASE WHEN doc_id % 10 = 7 THEN [0, 1] ELSE [0] END) AS version FROM documents)"""

CTES["raw_model_output"] = """
SELECT c_custkey AS customer_id,
 CASE WHEN c_custkey % 17 = 0 THEN 'I cannot answer' WHEN c_custkey % 19 = 0 THEN '{"churn_risk_score": }'
 ELSE '```json' || chr(10) || '{"churn_risk_score": ' || CAST(CAST((c_custkey % 101)*0.01 AS DECIMAL(4,2)) AS VARCHAR) || ', "retention_urgency": "Low", "risk_factors": ["a","b"], "confidence": 0.5}' || chr(10) || '```' END AS raw_text
FROM customer"""

# ------------------------------------------------------------------- clean
CTES["clean_customers"] = f"""
SELECT customer_id, {title('first_name')} AS first_name, {title('last_name')} AS last_name,
 lower(trim(email)) AS email, regexp_replace(phone, '[^0-9+\\-]', '', 'g') AS phone, dob,
 CAST(date_diff('year', dob, {AS_OF}) AS INT) AS age, trim(address) AS address, {title('city')} AS city,
 upper(trim(state)) AS state, upper(trim(country)) AS country, coalesce(customer_segment, 'Standard') AS customer_segment,
 credit_score, annual_income, coalesce(employment_status, 'Unknown') AS employment_status, coalesce(is_active, TRUE) AS is_active,
 created_at, updated_at, CAST(date_diff('month', CAST(created_at AS DATE), {AS_OF}) AS INT) AS tenure_months,
 lower(split_part(email, '@', 2)) AS email_domain
FROM raw_customers
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC NULLS FIRST, created_at DESC NULLS FIRST, city DESC NULLS FIRST) = 1"""

CTES["clean_policies"] = f"""
SELECT policy_id, customer_id, upper(trim(policy_type)) AS policy_type, upper(trim(policy_status)) AS policy_status,
 coalesce(premium_amount, 0) AS premium_amount, coalesce(coverage_amount, 0) AS coverage_amount, coalesce(deductible_amount, 0) AS deductible_amount,
 start_date, end_date, renewal_date, underwriting_score, coalesce(risk_category, 'Medium') AS risk_category, created_at,
 CASE WHEN end_date < {AS_OF} AND upper(trim(policy_status)) = 'ACTIVE' THEN TRUE ELSE FALSE END AS is_expired,
 CAST(date_diff('day', {AS_OF}, renewal_date) AS INT) AS days_to_renewal
FROM raw_policies
QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY created_at DESC NULLS FIRST, customer_id DESC NULLS FIRST) = 1"""

CTES["clean_claims"] = f"""
SELECT claim_id, policy_id, customer_id, {title('claim_type')} AS claim_type, upper(trim(claim_status)) AS claim_status,
 coalesce(claim_amount, 0) AS claim_amount, settlement_amount, filed_date, resolved_date, description, created_at,
 CASE WHEN settlement_amount IS NOT NULL AND claim_amount > 0 THEN {half_up('settlement_amount * 100', 'claim_amount * 100', 2)} END AS settlement_ratio,
 CAST(date_diff('day', filed_date, coalesce(resolved_date, {AS_OF})) AS INT) AS days_to_resolve
FROM raw_claims
QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC NULLS FIRST, claim_amount DESC NULLS FIRST,
 settlement_amount DESC NULLS FIRST, filed_date DESC NULLS FIRST, resolved_date DESC NULLS FIRST) = 1"""

CTES["clean_loans"] = f"""
SELECT loan_id, customer_id, upper(trim(loan_type)) AS loan_type, upper(trim(loan_status)) AS loan_status,
 coalesce(principal_amount, 0) AS principal_amount, interest_rate, coalesce(monthly_payment, 0) AS monthly_payment,
 coalesce(outstanding_balance, 0) AS outstanding_balance, origination_date, maturity_date, coalesce(days_past_due, 0) AS days_past_due, created_at,
 CASE WHEN outstanding_balance > 0 AND principal_amount > 0 THEN {half_up('(principal_amount - outstanding_balance) * 100', 'principal_amount * 100', 2)} ELSE CAST(1 AS DOUBLE) END AS payoff_progress,
 CASE WHEN days_past_due >= 180 THEN 'Severe' WHEN days_past_due >= 90 THEN 'High' WHEN days_past_due >= 30 THEN 'Moderate' WHEN days_past_due > 0 THEN 'Low' ELSE 'Current' END AS delinquency_category
FROM raw_loans
QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY created_at DESC NULLS FIRST, customer_id DESC NULLS FIRST) = 1"""

CTES["clean_interactions"] = f"""
SELECT interaction_id, customer_id, {title('channel')} AS channel, {title('interaction_type')} AS interaction_type,
 trim(subject) AS subject, trim(notes) AS notes, coalesce(upper(trim(resolution_status)), 'PENDING') AS resolution_status,
 agent_id, interaction_date, duration_seconds, created_at
FROM raw_interactions
QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY created_at DESC NULLS FIRST, customer_id DESC NULLS FIRST) = 1"""

CTES["clean_call_transcripts"] = f"""
SELECT transcript_id, customer_id, interaction_id, call_date, duration_seconds, agent_id, {title('agent_name')} AS agent_name,
 trim(transcript_text) AS transcript_text, {title('call_reason')} AS call_reason, length(transcript_text) AS transcript_length, created_at
FROM raw_call_transcripts WHERE transcript_text IS NOT NULL AND length(trim(transcript_text)) > 0
QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC NULLS FIRST, customer_id DESC NULLS FIRST) = 1"""

CTES["parsed_documents"] = """
SELECT document_id, customer_id, file_name, document_type, file_size_bytes, created_at AS file_modified_at, document_text AS parsed_text
FROM raw_documents WHERE document_text IS NOT NULL AND length(trim(document_text)) > 0
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS FIRST, customer_id DESC NULLS FIRST) = 1"""

CTES["document_extracted"] = r"""
SELECT document_id, file_name, document_type, file_size_bytes, file_modified_at, customer_id AS source_customer_id, parsed_text,
 nullif(regexp_extract(parsed_text, '(?m)^(?:Claim Number|Policy Number): (.*)$', 1), '') AS reference_number,
 nullif(regexp_extract(parsed_text, '(?m)^Policy Number: (.*)$', 1), '') AS policy_number,
 nullif(regexp_extract(parsed_text, '(?m)^Customer Name: (.*)$', 1), '') AS customer_name,
 nullif(regexp_extract(parsed_text, '(?m)^Customer ID: (.*)$', 1), '') AS customer_id,
 nullif(regexp_extract(parsed_text, '(?m)^(?:Date Filed|Effective Date): (.*)$', 1), '') AS document_date,
 nullif(regexp_extract(parsed_text, '(?m)^(?:Claim Amount|Annual Premium): (.*)$', 1), '') AS amount,
 nullif(regexp_extract(parsed_text, '(?m)^(?:Claim Type|Policy Type): (.*)$', 1), '') AS category,
 nullif(regexp_extract(parsed_text, '(?m)^Status: (.*)$', 1), '') AS status,
 nullif(regexp_extract(parsed_text, '(?ms)^Description:\n(.*?)(?:\n\n|\z)', 1), '') AS description
FROM parsed_documents"""

# ----------------------------------------------------------------- curated


def most_common(table: str, column: str, name: str) -> str:
    """Most frequent value per customer, smallest value on a tie."""
    return f"""
SELECT customer_id, {column} AS {name} FROM (
 SELECT customer_id, {column}, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {column}) AS rn
 FROM {table} WHERE {column} IS NOT NULL GROUP BY customer_id, {column}) WHERE rn = 1"""


CTES["policy_mode"] = most_common("clean_policies", "risk_category", "primary_risk_category")
CTES["policy_agg"] = """
SELECT p.customer_id, count(*) AS total_policies,
 count(*) FILTER (policy_status = 'ACTIVE') AS active_policies,
 count(*) FILTER (policy_status IN ('LAPSED', 'CANCELLED')) AS lapsed_policies,
 sum(premium_amount) AS total_premium, CAST(sum(premium_amount) AS DOUBLE) / count(premium_amount) AS avg_premium,
 max(coverage_amount) AS max_coverage, coalesce(string_agg(DISTINCT policy_type, ', ' ORDER BY policy_type), '') AS policy_types,
 any_value(m.primary_risk_category) AS primary_risk_category, min(days_to_renewal) AS next_renewal_days
FROM clean_policies p LEFT JOIN policy_mode m ON p.customer_id = m.customer_id GROUP BY p.customer_id"""

CTES["claims_agg"] = """
SELECT customer_id, count(*) AS total_claims,
 count(*) FILTER (claim_status = 'OPEN') AS open_claims,
 count(*) FILTER (claim_status = 'DENIED') AS denied_claims,
 sum(claim_amount) AS total_claim_amount,
 CAST(sum(CAST(settlement_ratio AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(settlement_ratio), 0) AS avg_settlement_ratio,
 CAST(sum(days_to_resolve) AS DOUBLE) / count(days_to_resolve) AS avg_claim_resolution_days, max(filed_date) AS last_claim_date
FROM clean_claims GROUP BY customer_id"""

CTES["loan_agg"] = """
SELECT customer_id, count(*) AS total_loans,
 count(*) FILTER (loan_status = 'ACTIVE') AS active_loans,
 count(*) FILTER (loan_status IN ('DEFAULT', 'DELINQUENT')) AS problem_loans,
 sum(outstanding_balance) AS total_outstanding_balance, sum(monthly_payment) AS total_monthly_payment,
 max(days_past_due) AS max_days_past_due, coalesce(string_agg(DISTINCT loan_type, ', ' ORDER BY loan_type), '') AS loan_types
FROM clean_loans GROUP BY customer_id"""

CTES["interaction_mode"] = most_common("clean_interactions", "channel", "preferred_channel")
CTES["interaction_agg"] = f"""
SELECT i.customer_id, count(*) AS total_interactions,
 count(*) FILTER (interaction_type = 'Complaint') AS complaint_count,
 count(*) FILTER (resolution_status = 'ESCALATED') AS escalation_count,
 max(interaction_date) AS last_interaction_date, any_value(m.preferred_channel) AS preferred_channel,
 CAST(date_diff('day', CAST(max(interaction_date) AS DATE), {AS_OF}) AS INT) AS days_since_last_interaction
FROM clean_interactions i LEFT JOIN interaction_mode m ON i.customer_id = m.customer_id GROUP BY i.customer_id"""

CTES["transcript_mode"] = most_common("clean_call_transcripts", "call_reason", "most_common_call_reason")
CTES["transcript_agg"] = """
SELECT t.customer_id, count(*) AS total_calls, max(call_date) AS last_call_date,
 CAST(sum(duration_seconds) AS DOUBLE) / nullif(count(duration_seconds), 0) AS avg_call_duration,
 any_value(m.most_common_call_reason) AS most_common_call_reason
FROM clean_call_transcripts t LEFT JOIN transcript_mode m ON t.customer_id = m.customer_id GROUP BY t.customer_id"""

CTES["document_agg"] = """
SELECT source_customer_id AS customer_id, count(*) AS total_documents,
 coalesce(string_agg(DISTINCT document_type, ', ' ORDER BY document_type), '') AS document_types, max(file_modified_at) AS last_document_date
FROM document_extracted WHERE source_customer_id IS NOT NULL GROUP BY source_customer_id"""

# Metrics of each domain aggregate: those that read as 0 without rows, and those that stay NULL.
DOMAINS = {
    "policy_agg": ("total_policies active_policies lapsed_policies total_premium", "avg_premium max_coverage policy_types primary_risk_category next_renewal_days"),
    "claims_agg": ("total_claims open_claims denied_claims total_claim_amount", "avg_settlement_ratio avg_claim_resolution_days last_claim_date"),
    "loan_agg": ("total_loans active_loans problem_loans total_outstanding_balance total_monthly_payment max_days_past_due", "loan_types"),
    "interaction_agg": ("total_interactions complaint_count escalation_count", "last_interaction_date preferred_channel"),
    "transcript_agg": ("total_calls", "last_call_date avg_call_duration most_common_call_reason"),
    "document_agg": ("total_documents", "document_types last_document_date"),
}


def unified() -> str:
    """Customers with all domain metrics, then the two values derived from them."""
    metrics = [f"coalesce({n}, 0) AS {n}" for zero, _ in DOMAINS.values() for n in zero.split()]
    metrics += [n for _, null in DOMAINS.values() for n in null.split()]
    joins = " ".join(f"LEFT JOIN {name} USING (customer_id)" for name in DOMAINS)
    high = "max_days_past_due >= 90 OR complaint_count >= 3 OR lapsed_policies >= 2"
    some = "max_days_past_due >= 30 OR complaint_count + lapsed_policies > 0"
    return f"""
SELECT *, CASE WHEN {high} THEN 'High' WHEN {some} THEN 'Medium' ELSE 'Low' END AS composite_risk_level,
 CAST(total_premium * if(tenure_months < 1, 1, tenure_months) AS DOUBLE) / 12 AS estimated_clv
FROM (SELECT customer_id, concat(first_name, ' ', last_name) AS full_name, email, phone, age, city, state, country, customer_segment, credit_score, annual_income,
  employment_status, is_active, tenure_months, coalesce(days_since_last_interaction, 999) AS days_since_last_interaction, {', '.join(metrics)}
 FROM clean_customers {joins})"""


CTES["unified"] = unified()


def events(source: str, category: str, date: str, key: str, text: str, status: str = "NULL", amount: str = "NULL", notes: str = "NULL", customer: str = "customer_id") -> str:
    return f"""
SELECT {customer} AS customer_id, CAST({date} AS TIMESTAMP) AS event_date, '{category}' AS event_category, {text} AS event_description, CAST({status} AS VARCHAR) AS event_status,
 TRY_CAST({amount} AS DOUBLE) AS event_amount, CAST({notes} AS VARCHAR) AS event_notes, {key} AS event_id FROM {source} WHERE {customer} IS NOT NULL"""


CTES["timeline"] = " UNION ALL ".join(
    [
        events("clean_policies", "Policy", "created_at", "concat('policy_', policy_id)", "policy_type || ' policy ' || lower(policy_status)", "policy_status", "premium_amount"),
        events("clean_claims", "Claim", "filed_date", "concat('claim_', claim_id)", "claim_type || ' claim - ' || lower(claim_status)", "claim_status", "claim_amount", "description"),
        events("clean_loans", "Loan", "origination_date", "concat('loan_', loan_id)", "loan_type || ' loan - ' || lower(loan_status)", "loan_status", "principal_amount"),
        events("clean_interactions", "Interaction", "interaction_date", "concat('interaction_', interaction_id)", "channel || ' - ' || interaction_type || ': ' || subject", "resolution_status", notes="notes"),
        events("clean_call_transcripts", "Call", "call_date", "concat('call_', transcript_id)", "'Phone call - ' || call_reason", notes="left(transcript_text, 500)"),
        events("document_extracted", "Document", "file_modified_at", "concat('doc_', file_name)", "document_type || ' - ' || coalesce(reference_number, file_name)", "coalesce(status, 'Processed')",
               "translate(amount, '$,', '')", "left(description, 500)", "source_customer_id"),
    ]
)

# -------------------------------------------------------------- enrichment
CTES["call_words"] = r"""
SELECT transcript_id, sentence_no, w AS word FROM (
 SELECT transcript_id, sentence_no, unnest(regexp_extract_all(lower(sentence), '[a-z]+')) AS w FROM (
  SELECT transcript_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sentence_no
  FROM (SELECT transcript_id, regexp_split_to_array(transcript_text, '[.!?\n]+') AS s FROM clean_call_transcripts)))"""

CTES["call_summary"] = r"""
SELECT t.transcript_id, coalesce(string_agg(trim(s.sentence), '. ' ORDER BY s.sentence_no) || '.', '') AS call_summary
FROM clean_call_transcripts t LEFT JOIN (
 SELECT x.transcript_id, x.sentence_no, y.sentence FROM (
  SELECT w.transcript_id, w.sentence_no, row_number() OVER (PARTITION BY w.transcript_id ORDER BY round(CAST(sum(f.n) AS DOUBLE) / count(*), 6) DESC, w.sentence_no) AS rn
  FROM call_words w JOIN (SELECT transcript_id, word, count(*) AS n FROM call_words GROUP BY ALL) f ON w.transcript_id = f.transcript_id AND w.word = f.word
  GROUP BY w.transcript_id, w.sentence_no) x
 JOIN (SELECT transcript_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sentence_no
       FROM (SELECT transcript_id, regexp_split_to_array(transcript_text, '[.!?\n]+') AS s FROM clean_call_transcripts)) y
   ON x.transcript_id = y.transcript_id AND x.sentence_no = y.sentence_no
 WHERE rn <= 2) s ON t.transcript_id = s.transcript_id GROUP BY t.transcript_id"""

CTES["call_summary_idf"] = r"""
SELECT t.transcript_id, coalesce(string_agg(trim(s.sentence), '. ' ORDER BY s.sentence_no) || '.', '') AS call_summary
FROM clean_call_transcripts t LEFT JOIN (
 SELECT x.transcript_id, x.sentence_no, y.sentence FROM (
  SELECT w.transcript_id, w.sentence_no, row_number() OVER (PARTITION BY w.transcript_id ORDER BY round(CAST(sum(f.idf) AS DOUBLE) / count(*), 6) DESC, w.sentence_no) AS rn
  FROM call_words w JOIN (SELECT word, CAST(round(ln((SELECT CAST(count(*) AS DOUBLE) FROM clean_call_transcripts) / CAST(count(DISTINCT transcript_id) AS DOUBLE)), 6) AS DECIMAL(18,6)) AS idf
   FROM call_words GROUP BY word) f ON w.word = f.word
  GROUP BY w.transcript_id, w.sentence_no) x
 JOIN (SELECT transcript_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sentence_no
       FROM (SELECT transcript_id, regexp_split_to_array(transcript_text, '[.!?\n]+') AS s FROM clean_call_transcripts)) y
   ON x.transcript_id = y.transcript_id AND x.sentence_no = y.sentence_no
 WHERE rn <= 2) s ON t.transcript_id = s.transcript_id GROUP BY t.transcript_id"""

CTES["transcript_sentiment"] = """
SELECT t.transcript_id, customer_id, call_date, call_reason, agent_name, duration_seconds, transcript_text, sentiment_score,
 CASE WHEN sentiment_score >= 0.3 THEN 'Positive' WHEN sentiment_score <= -0.3 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label, call_summary
FROM (SELECT *, CASE WHEN pos + neg = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(pos - neg AS DOUBLE) / (pos + neg), 4) END AS sentiment_score
 FROM (SELECT *, len(list_filter(words, lambda w: w IN ('is','it','with','und','en','y'))) AS pos, len(list_filter(words, lambda w: w IN ('that','was','by','der','de'))) AS neg
  FROM (SELECT *, regexp_extract_all(lower(transcript_text), '[a-z]+') AS words FROM clean_call_transcripts))) t
JOIN call_summary cs ON t.transcript_id = cs.transcript_id"""

CTES["customer_sentiment"] = """
SELECT customer_id, CAST(sum(CAST(sentiment_score AS DECIMAL(9,4))) AS DOUBLE) / count(*) AS avg_sentiment_score, min(sentiment_score) AS worst_sentiment_score,
 count(CASE WHEN sentiment_label = 'Negative' THEN 1 END) AS negative_call_count FROM transcript_sentiment GROUP BY customer_id"""

CTES["churn_points"] = """
SELECT u.customer_id, s.avg_sentiment_score, coalesce(s.negative_call_count, 0) AS negative_call_count,
 CASE WHEN u.lapsed_policies >= 2 THEN 25 WHEN u.lapsed_policies = 1 THEN 10 ELSE 0 END AS p_lapsed,
 CASE WHEN u.complaint_count >= 3 THEN 20 WHEN u.complaint_count >= 1 THEN 12 ELSE 0 END AS p_complaints,
 CASE WHEN u.max_days_past_due >= 90 THEN 20 WHEN u.max_days_past_due >= 30 THEN 10 ELSE 0 END AS p_dpd,
 CASE WHEN u.problem_loans > 0 THEN 10 ELSE 0 END AS p_loans, CASE WHEN u.open_claims >= 2 THEN 10 ELSE 0 END AS p_open,
 CASE WHEN u.denied_claims > 0 THEN 5 ELSE 0 END AS p_denied, CASE WHEN coalesce(s.negative_call_count, 0) > 0 THEN 10 ELSE 0 END AS p_calls,
 CASE WHEN u.days_since_last_interaction >= 180 THEN 10 WHEN u.days_since_last_interaction >= 14 THEN 3 ELSE 0 END AS p_contact,
 CASE WHEN u.is_active THEN 0 ELSE 15 END AS p_inactive
FROM unified u LEFT JOIN customer_sentiment s ON u.customer_id = s.customer_id"""

CTES["churn_risk"] = """
SELECT u.customer_id, u.full_name, u.customer_segment, u.tenure_months, u.credit_score, u.is_active, u.active_policies, u.lapsed_policies, u.total_premium,
 u.open_claims, u.denied_claims, u.complaint_count, u.escalation_count, u.max_days_past_due, u.problem_loans, u.days_since_last_interaction, u.composite_risk_level,
 coalesce(k.avg_sentiment_score, 0) AS avg_sentiment_score, k.negative_call_count, k.churn_risk_score,
 CASE WHEN k.churn_risk_score IS NULL THEN NULL WHEN k.churn_risk_score >= 0.8 THEN 'Critical' WHEN k.churn_risk_score >= 0.6 THEN 'High' WHEN k.churn_risk_score >= 0.4 THEN 'Medium' ELSE 'Low' END AS retention_urgency,
 CASE WHEN k.churn_risk_score IS NULL THEN NULL ELSE list_filter([
  CASE WHEN p_lapsed > 0 THEN 'lapsed policies' END, CASE WHEN p_complaints > 0 THEN 'complaints' END, CASE WHEN p_dpd > 0 THEN 'days past due' END,
  CASE WHEN p_loans > 0 THEN 'problem loans' END, CASE WHEN p_open > 0 THEN 'open claims' END, CASE WHEN p_denied > 0 THEN 'denied claims' END,
  CASE WHEN p_calls > 0 THEN 'negative calls' END, CASE WHEN p_contact > 0 THEN 'no recent contact' END, CASE WHEN p_inactive > 0 THEN 'inactive account' END],
  lambda f: f IS NOT NULL)[1:4] END AS risk_factors,
 CASE WHEN k.churn_risk_score IS NULL THEN NULL ELSE CAST(50 + 10 * (CAST(u.total_policies > 0 AS INT) + CAST(u.total_claims > 0 AS INT) + CAST(u.total_loans > 0 AS INT)
  + CAST(u.total_interactions > 0 AS INT) + CAST(u.total_calls > 0 AS INT)) AS DOUBLE) / 100 END AS model_confidence
FROM unified u JOIN (SELECT *, CASE WHEN t IS NULL THEN NULL ELSE CAST(least(greatest(t, 0), 100) AS DOUBLE) / 100 END AS churn_risk_score FROM (
 SELECT c.*, 15 + p_lapsed + p_complaints + p_dpd + p_loans + p_open + p_denied + p_calls + p_contact + p_inactive
  - CASE WHEN v.tenure_months IS NULL THEN NULL WHEN v.tenure_months >= 60 THEN 10 ELSE 0 END - CASE WHEN v.active_policies >= 8 THEN 5 ELSE 0 END AS t
 FROM churn_points c JOIN unified v ON c.customer_id = v.customer_id)) k ON u.customer_id = k.customer_id"""

CTES["latest_call"] = """
SELECT customer_id, call_summary, sentiment_score AS latest_sentiment_score, sentiment_label AS latest_sentiment_label, call_reason AS latest_call_reason
FROM transcript_sentiment QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY call_date DESC NULLS FIRST, transcript_id DESC) = 1"""

CTES["action_texts"] = """
SELECT * FROM (VALUES
 ('Complaint_Resolution', 'Call the customer and close every open complaint with a named owner.'),
 ('Retention_Offer', 'Offer a loyalty discount and a review of the current cover.'),
 ('Payment_Assistance', 'Offer a payment plan for the overdue loan balance.'),
 ('Claims_Followup', 'Update the customer on the open claims and agree a settlement date.'),
 ('Renewal_Reminder', 'Send the renewal terms and confirm them before the renewal date.'),
 ('Policy_Review', 'Review the lapsed cover and propose a reinstatement.'),
 ('Proactive_Outreach', 'Get in touch with a short check-in on current needs.'),
 ('Upsell', 'Suggest additional cover that fits the present policies.')) AS a(action_type, action_description)"""

CTES["next_best_action"] = """
SELECT n.customer_id, n.full_name, n.customer_segment, n.churn_risk_score, n.retention_urgency, n.risk_factors, n.latest_sentiment_score, n.latest_sentiment_label,
 n.latest_call_reason, n.latest_call_summary, n.total_premium, n.active_policies, n.open_claims, n.next_renewal_days, n.max_days_past_due, n.estimated_clv,
 n.action_type, a.action_description, n.priority, n.recommended_channel,
 'Main driver: ' || coalesce(n.risk_factors[1], 'none') || '.' AS rationale
FROM (SELECT c.customer_id, c.full_name, c.customer_segment, c.churn_risk_score, c.retention_urgency, c.risk_factors,
  coalesce(l.latest_sentiment_score, 0) AS latest_sentiment_score, l.latest_sentiment_label, l.latest_call_reason, l.call_summary AS latest_call_summary,
  u.total_premium, u.active_policies, u.open_claims, u.next_renewal_days, u.max_days_past_due, u.estimated_clv,
  CASE WHEN u.complaint_count >= 3 THEN 'Complaint_Resolution' WHEN c.churn_risk_score >= 0.6 THEN 'Retention_Offer' WHEN u.max_days_past_due >= 30 THEN 'Payment_Assistance'
   WHEN u.open_claims >= 2 THEN 'Claims_Followup' WHEN u.next_renewal_days BETWEEN -30 AND 30 THEN 'Renewal_Reminder' WHEN u.lapsed_policies > 0 THEN 'Policy_Review'
   WHEN u.days_since_last_interaction >= 14 THEN 'Proactive_Outreach' ELSE 'Upsell' END AS action_type,
  CASE c.retention_urgency WHEN 'Critical' THEN 'High' WHEN 'High' THEN 'High' WHEN 'Medium' THEN 'Medium' ELSE 'Low' END AS priority,
  CASE WHEN u.preferred_channel = 'Phone' THEN 'Phone' WHEN u.preferred_channel = 'Branch' THEN 'Branch' WHEN u.preferred_channel IN ('Web','Mobile','Chat') THEN 'InApp' ELSE 'Email' END AS recommended_channel
 FROM churn_risk c JOIN unified u ON c.customer_id = u.customer_id LEFT JOIN latest_call l ON c.customer_id = l.customer_id WHERE c.churn_risk_score IS NOT NULL) n
JOIN action_texts a ON n.action_type = a.action_type"""

CTES["health"] = """
SELECT *, CAST(round(w, 1) AS DOUBLE) AS health_score, CASE WHEN w >= 85 THEN 'A' WHEN w >= 70 THEN 'B' WHEN w >= 55 THEN 'C' WHEN w >= 40 THEN 'D' ELSE 'F' END AS health_grade
FROM (SELECT *, CAST(retention_score AS DECIMAL(5,1)) * CAST(0.30 AS DECIMAL(3,2)) + CAST(sentiment_score AS DECIMAL(5,1)) * CAST(0.20 AS DECIMAL(3,2))
  + CAST(claims_health AS DECIMAL(5,1)) * CAST(0.15 AS DECIMAL(3,2)) + CAST(payment_health AS DECIMAL(5,1)) * CAST(0.20 AS DECIMAL(3,2)) + CAST(loyalty_score AS DECIMAL(5,1)) * CAST(0.15 AS DECIMAL(3,2)) AS w
 FROM (SELECT c.customer_id, c.full_name, c.customer_segment, c.is_active,
   round(100 - coalesce(r.churn_risk_score, CAST(0.5 AS DOUBLE)) * 100, 1) AS retention_score,
   CASE WHEN s.avg_sentiment_score IS NULL THEN CAST(50 AS DOUBLE) ELSE CAST(round(greatest(0, least(100, (CAST(s.avg_sentiment_score AS DECIMAL(18,10)) + 1) * 50)), 1) AS DOUBLE) END AS sentiment_score,
   CAST(CASE WHEN c.total_claims = 0 THEN 80 WHEN c.open_claims = 0 THEN 90 ELSE greatest(0, 100 - c.open_claims * 20 - c.max_days_past_due * 0.5) END AS DOUBLE) AS claims_health,
   CAST(CASE WHEN c.total_loans = 0 THEN 85 WHEN c.max_days_past_due = 0 THEN 95 WHEN c.max_days_past_due < 30 THEN 70 WHEN c.max_days_past_due < 90 THEN 40 ELSE 10 END AS DOUBLE) AS payment_health,
   CAST(CASE WHEN c.tenure_months >= 60 THEN 95 WHEN c.tenure_months >= 36 THEN 80 WHEN c.tenure_months >= 12 THEN 60 ELSE 40 END AS DOUBLE) AS loyalty_score
  FROM unified c LEFT JOIN churn_risk r ON c.customer_id = r.customer_id LEFT JOIN customer_sentiment s ON c.customer_id = s.customer_id))"""

CTES["role_region_mapping"] = """
SELECT * FROM (VALUES ('ACCOUNTADMIN','ALL'),('SYSADMIN','ALL'),('US_TEAM','USA'),('UK_TEAM','UK'),('APAC_TEAM','JAPAN'),('APAC_TEAM','AUSTRALIA'),('APAC_TEAM','SINGAPORE'),('APAC_TEAM','INDIA')) AS m(role_name, allowed_country)"""

CTES["search_corpus"] = """
SELECT CAST(customer_id AS VARCHAR) AS customer_id, transcript_text AS search_text, 'call_transcript' AS source_type, 'Phone' AS channel, call_date AS event_date,
 'call_' || CAST(transcript_id AS VARCHAR) AS document_key FROM clean_call_transcripts
UNION ALL SELECT CAST(customer_id AS VARCHAR), coalesce(subject, '') || '. ' || coalesce(notes, ''), 'interaction_note', channel, interaction_date,
 'interaction_' || CAST(interaction_id AS VARCHAR) FROM clean_interactions WHERE notes IS NOT NULL AND length(trim(notes)) > 0"""

CTES["docs"] = """
SELECT document_key, customer_id, source_type, channel, event_date, regexp_extract_all(lower(search_text), '[a-z]+') AS words FROM search_corpus"""

CTES["quality_dashboard"] = f"""
SELECT 'Churn Risk' AS model, count(*) AS total_records, count(*) FILTER (churn_risk_score IS NULL) AS parse_failures,
 {share('count(*) FILTER (churn_risk_score IS NULL)', 'count(*)', 2)} AS failure_rate_pct,
 count(*) FILTER (churn_risk_score < 0 OR churn_risk_score > 1) AS out_of_range,
 CAST(sum(CAST(churn_risk_score AS DECIMAL(9,4))) AS DOUBLE) / nullif(count(churn_risk_score), 0) AS avg_score FROM churn_risk
UNION ALL SELECT 'Next Best Action', count(*), count(*) FILTER (action_type IS NULL), {share('count(*) FILTER (action_type IS NULL)', 'count(*)', 2)}, 0, NULL FROM next_best_action
UNION ALL SELECT 'Document Extraction', count(*), count(*) FILTER (reference_number IS NULL AND customer_name IS NULL),
 {share('count(*) FILTER (reference_number IS NULL AND customer_name IS NULL)', 'count(*)', 2)}, 0, NULL FROM document_extracted"""

_ORDER = list(CTES)


def tables_in(sql: str) -> set[str]:
    return {name for name in CTES if re.search(rf"\b{name}\b", sql)}


def with_tables(sql: str) -> str:
    """``sql`` with the CTEs it needs, in definition order, in front."""
    needed: set[str] = set()
    pending = tables_in(sql)
    while pending:
        name = pending.pop()
        needed.add(name)
        pending |= tables_in(CTES[name]) - needed
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in _ORDER if n in needed)
    return f"WITH {head}\n{sql}"
