"""DuckDB statements for the raw, clean and curated tables and the named reports."""

from __future__ import annotations

import re

from heartwood.oracle.base import mean, share

ORACLES: dict[str, str] = {}


def doubles(table: str, *columns: str) -> str:
    """All columns of a table, the named decimals as doubles."""
    casts = ", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in columns)
    return f"SELECT * REPLACE ({casts}) FROM {table}" if casts else f"SELECT * FROM {table}"


def avg(column: str, digits: int) -> str:
    return mean(column, digits, 4)


def wide(column: str, digits: int) -> str:
    return mean(column, digits, 2)


def when(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


ORACLES |= {
    "raw_customers": doubles("raw_customers", "annual_income"),
    "raw_policies": doubles("raw_policies", "premium_amount", "coverage_amount", "deductible_amount", "underwriting_score"),
    "raw_claims": doubles("raw_claims", "claim_amount", "settlement_amount"),
    "raw_loans": doubles("raw_loans", "principal_amount", "interest_rate", "monthly_payment", "outstanding_balance"),
    "raw_interactions": doubles("raw_interactions"),
    "raw_call_transcripts": doubles("raw_call_transcripts"),
    "raw_documents": doubles("raw_documents"),
    "clean_customers": doubles("clean_customers", "annual_income"),
    "clean_policies": doubles("clean_policies", "premium_amount", "coverage_amount", "deductible_amount", "underwriting_score"),
    "clean_claims": doubles("clean_claims", "claim_amount", "settlement_amount"),
    "clean_loans": doubles("clean_loans", "principal_amount", "interest_rate", "monthly_payment", "outstanding_balance"),
    "clean_interactions": doubles("clean_interactions"),
    "clean_call_transcripts": doubles("clean_call_transcripts"),
    "parsed_documents": doubles("parsed_documents"),
    "document_extracted": doubles("document_extracted"),
    "policy_agg": doubles("policy_agg", "total_premium", "max_coverage"),
    "claims_agg": doubles("claims_agg", "total_claim_amount"),
    "loan_agg": doubles("loan_agg", "total_outstanding_balance", "total_monthly_payment"),
    "interaction_agg": doubles("interaction_agg"),
    "transcript_agg": doubles("transcript_agg"),
    "document_agg": doubles("document_agg"),
    "customer_360_unified": doubles(
        "unified", "annual_income", "total_premium", "max_coverage", "total_claim_amount", "total_outstanding_balance", "total_monthly_payment"
    ),
    "composite_risk": "SELECT customer_id, composite_risk_level FROM unified",
    "estimated_clv": "SELECT customer_id, estimated_clv FROM unified",
    "interaction_timeline": "SELECT * FROM timeline",
    "transcript_sentiment": "SELECT * FROM transcript_sentiment",
    "call_summary": "SELECT * FROM call_summary",
    "call_summary_idf": "SELECT * FROM call_summary_idf",
    "customer_sentiment": "SELECT * FROM customer_sentiment",
    "latest_call": "SELECT * FROM latest_call",
    "churn_risk": "SELECT * REPLACE (CAST(total_premium AS DOUBLE) AS total_premium, array_to_string(risk_factors, '; ') AS risk_factors) FROM churn_risk",
    "next_best_action": "SELECT * REPLACE (CAST(total_premium AS DOUBLE) AS total_premium, array_to_string(risk_factors, '; ') AS risk_factors) FROM next_best_action",
    "customer_health_score": "SELECT * EXCLUDE (w) FROM health",
    "search_corpus": "SELECT * FROM search_corpus",
}

CARD = (
    "customer_id, full_name, email, phone, customer_segment, city, state, country, age, credit_score, CAST(annual_income AS DOUBLE) AS annual_income,"
    " is_active, tenure_months, total_policies, active_policies, CAST(total_premium AS DOUBLE) AS total_premium, total_claims, open_claims, total_loans,"
    " CAST(total_outstanding_balance AS DOUBLE) AS total_outstanding_balance, max_days_past_due, complaint_count, total_calls, composite_risk_level,"
    " round(estimated_clv, 0) AS estimated_clv"
)
BUCKET = (
    "CASE WHEN churn_risk_score >= 0.8 THEN '{0}' WHEN churn_risk_score >= 0.6 THEN '{1}' WHEN churn_risk_score >= 0.4 THEN '{2}'"
    " WHEN churn_risk_score >= 0.2 THEN '{3}' ELSE '{4}' END"
)
PAGE = "action_type IS NOT NULL AND priority IN ('High', 'Medium')"

ORACLES |= {
    "home_kpis": f"""
        SELECT count(*) AS total_customers, {when('is_active')} AS active_customers,
         (SELECT count(*) FROM churn_risk WHERE churn_risk_score >= 0.7) AS high_churn_risk,
         (SELECT count(*) FROM next_best_action WHERE priority = 'High') AS high_priority_actions,
         (SELECT count(*) FROM document_extracted) AS documents_processed FROM unified""",
    "churn_by_segment": f"""
        SELECT c.customer_segment, {avg('r.churn_risk_score', 3)} AS avg_churn_risk FROM unified c JOIN churn_risk r ON c.customer_id = r.customer_id
        WHERE r.churn_risk_score IS NOT NULL GROUP BY c.customer_segment""",
    "sentiment_distribution": "SELECT sentiment_label, count(*) AS call_count FROM transcript_sentiment GROUP BY 1",
    "sentiment_distribution_range": """
        SELECT sentiment_label, count(*) AS call_count FROM transcript_sentiment
        WHERE call_date >= DATE '2023-06-01' AND call_date <= DATE '2023-12-31' GROUP BY 1""",
    "onboarding_trend": "SELECT CAST(date_trunc('month', created_at) AS TIMESTAMP) AS month, count(*) AS new_customers FROM clean_customers GROUP BY 1",
    "top_actions": """
        SELECT customer_id, full_name, customer_segment, round(churn_risk_score, 2) AS churn_risk, action_type, action_description, priority, recommended_channel
        FROM next_best_action WHERE priority = 'High' AND action_type IS NOT NULL ORDER BY churn_risk_score DESC, customer_id LIMIT 15""",
    "customer_by_id": f"SELECT {CARD} FROM unified WHERE customer_id = 7",
    "customer_by_name": f"SELECT {CARD} FROM unified WHERE lower(full_name) LIKE '%customer 00000001%' ORDER BY customer_id LIMIT 20",
    "recent_claims": """
        SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY filed_date DESC NULLS FIRST, claim_id DESC) AS rank, claim_id, claim_type, claim_status,
         CAST(claim_amount AS DOUBLE) AS claim_amount, filed_date FROM clean_claims QUALIFY rank <= 10""",
    "recent_loans": """
        SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY origination_date DESC NULLS FIRST, loan_id DESC) AS rank, loan_type, loan_status,
         CAST(principal_amount AS DOUBLE) AS principal_amount, CAST(outstanding_balance AS DOUBLE) AS outstanding_balance, days_past_due, delinquency_category
        FROM clean_loans QUALIFY rank <= 10""",
    "recent_timeline": """
        SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY event_date DESC NULLS FIRST, event_id) AS rank, event_date, event_category,
         event_description, event_status FROM timeline QUALIFY rank <= 20""",
    "customer_documents": """
        SELECT key AS customer_id, row_number() OVER (PARTITION BY key ORDER BY file_modified_at DESC NULLS FIRST, file_name) AS rank, file_name, document_type,
         reference_number, amount, category, status
        FROM (SELECT *, CAST(TRY_CAST(customer_id AS DECIMAL(38,0)) AS BIGINT) AS key FROM document_extracted) WHERE key IS NOT NULL QUALIFY rank <= 20""",
    "customer_insights": """
        SELECT r.customer_id, r.churn_risk_score, r.retention_urgency, r.model_confidence, n.action_type, n.action_description, n.priority, n.recommended_channel, n.rationale
        FROM churn_risk r LEFT JOIN next_best_action n ON r.customer_id = n.customer_id""",
    "segment_overview": f"""
        SELECT customer_segment, count(*) AS customers, {when('is_active')} AS active, {wide('credit_score', 0)} AS avg_credit_score, {wide('total_premium', 0)} AS avg_premium
        FROM unified GROUP BY 1""",
    "churn_segments": "SELECT DISTINCT customer_segment FROM churn_risk",
    "churn_kpis": f"""
        SELECT count(*) AS total, {when('churn_risk_score >= 0.7')} AS high_risk, {avg('churn_risk_score', 3)} AS avg_risk, {avg('model_confidence', 3)} AS avg_conf FROM churn_risk""",
    "churn_kpis_filtered": f"""
        SELECT count(*) AS total, {when('churn_risk_score >= 0.7')} AS high_risk, {avg('churn_risk_score', 3)} AS avg_risk, {avg('model_confidence', 3)} AS avg_conf
        FROM churn_risk WHERE customer_segment IN ('Premium', 'VIP') AND coalesce(churn_risk_score, 0) >= 0.3""",
    "churn_buckets_page": f"""
        SELECT {BUCKET.format('5-Critical', '4-High', '3-Medium', '2-Low', '1-Minimal')} AS bucket, count(*) AS customers FROM churn_risk WHERE churn_risk_score IS NOT NULL GROUP BY 1""",
    "avg_risk_by_segment": f"SELECT customer_segment, {avg('churn_risk_score', 3)} AS avg_risk FROM churn_risk WHERE churn_risk_score IS NOT NULL GROUP BY 1",
    "high_risk_detail": """
        SELECT customer_id, full_name, customer_segment, round(churn_risk_score, 3) AS churn_risk, retention_urgency, round(model_confidence, 2) AS confidence, complaint_count,
         escalation_count, max_days_past_due, round(avg_sentiment_score, 2) AS avg_sentiment, negative_call_count
        FROM churn_risk ORDER BY churn_risk_score DESC NULLS LAST, customer_id LIMIT 50""",
    "sentiment_kpis": f"""
        SELECT count(*) AS total, {avg('sentiment_score', 3)} AS avg_sent, {when("sentiment_label = 'Negative'")} AS neg, {when("sentiment_label = 'Positive'")} AS pos FROM transcript_sentiment""",
    "sentiment_by_reason": f"SELECT call_reason, {avg('sentiment_score', 3)} AS avg_sentiment, count(*) AS calls FROM transcript_sentiment GROUP BY 1",
    "sentiment_by_agent": f"""
        SELECT agent_name, count(*) AS total_calls, {avg('sentiment_score', 3)} AS avg_sentiment, {when("sentiment_label = 'Negative'")} AS negative,
         {when("sentiment_label = 'Positive'")} AS positive FROM transcript_sentiment GROUP BY 1""",
    "sentiment_weekly": f"""
        SELECT CAST(date_trunc('week', call_date) AS TIMESTAMP) AS week, {avg('sentiment_score', 3)} AS avg_sentiment, count(*) AS call_count FROM transcript_sentiment GROUP BY 1""",
    "negative_calls": """
        SELECT s.customer_id, c.full_name, c.customer_segment, s.call_reason, s.agent_name, round(s.sentiment_score, 3) AS sentiment, s.call_summary, s.call_date
        FROM transcript_sentiment s JOIN unified c ON s.customer_id = c.customer_id WHERE s.sentiment_label = 'Negative' ORDER BY s.sentiment_score, s.transcript_id LIMIT 20""",
    "transcript_lookup": """
        SELECT customer_id, transcript_text FROM clean_call_transcripts
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY call_date DESC NULLS FIRST, transcript_id DESC) = 1""",
    "action_types": "SELECT DISTINCT action_type FROM next_best_action WHERE action_type IS NOT NULL",
    "action_kpis": f"""
        SELECT count(*) AS total, {when("priority = 'High'")} AS high_pri, count(DISTINCT action_type) AS types, {avg('churn_risk_score', 3)} AS avg_churn FROM next_best_action WHERE {PAGE}""",
    "actions_by_type": f"SELECT action_type, count(*) AS action_count FROM next_best_action WHERE {PAGE} GROUP BY 1",
    "actions_by_channel": f"""
        SELECT recommended_channel, count(*) AS action_count FROM next_best_action WHERE recommended_channel IS NOT NULL AND {PAGE} GROUP BY 1""",
    "action_queue": f"""
        SELECT customer_id, full_name, customer_segment, action_type, action_description, priority, recommended_channel, round(churn_risk_score, 3) AS churn_risk
        FROM next_best_action WHERE {PAGE}
        ORDER BY CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, churn_risk_score DESC NULLS LAST, customer_id LIMIT 100""",
    "document_kpis": f"""
        SELECT count(*) AS total_docs, {when("document_type = 'Claim Form'")} AS claim_forms, {when("document_type = 'Policy Summary'")} AS policy_summaries FROM document_extracted""",
    "documents_by_kind": """
        SELECT file_name, document_type, reference_number, policy_number, customer_name, customer_id, amount, category, status, document_date FROM document_extracted""",
    "document_text": "SELECT file_name, parsed_text, document_type, file_size_bytes FROM parsed_documents WHERE file_name = 'claim_form_CLM-2.txt'",
    "document_xref": """
        SELECT d.file_name, d.document_type, d.reference_number, d.customer_id AS doc_customer_id, d.amount, c.full_name AS c360_name, c.customer_segment, c.is_active,
         round(r.churn_risk_score, 3) AS churn_risk
        FROM document_extracted d LEFT JOIN unified c ON TRY_CAST(d.customer_id AS DECIMAL(38,0)) = c.customer_id
        LEFT JOIN churn_risk r ON TRY_CAST(d.customer_id AS DECIMAL(38,0)) = r.customer_id""",
    "document_match_rate": f"""
        SELECT count(c.full_name) AS matched, count(*) AS total, {share('count(c.full_name)', 'count(*)', 2)} AS matched_pct
        FROM document_extracted d LEFT JOIN unified c ON TRY_CAST(d.customer_id AS DECIMAL(38,0)) = c.customer_id""",
    "vq_high_risk_premium_customers": "SELECT count(DISTINCT customer_id) AS high_risk_premium_count FROM churn_risk WHERE churn_risk_score >= 0.7 AND customer_segment = 'Premium'",
    "vq_avg_sentiment_by_segment": """
        SELECT c.customer_segment, CAST(sum(CAST(s.sentiment_score AS DECIMAL(9,4))) AS DOUBLE) / count(*) AS avg_sentiment
        FROM unified c JOIN transcript_sentiment s ON c.customer_id = s.customer_id GROUP BY 1""",
    "vq_top_churn_risk_with_nba": """
        SELECT r.customer_id, r.full_name, r.customer_segment, r.churn_risk_score, r.retention_urgency, n.action_type, n.action_description, n.priority
        FROM churn_risk r JOIN next_best_action n ON r.customer_id = n.customer_id WHERE r.churn_risk_score IS NOT NULL ORDER BY r.churn_risk_score DESC, r.customer_id LIMIT 10""",
    "vq_common_nba_negative_sentiment": "SELECT action_type, count(*) AS action_count FROM next_best_action WHERE latest_sentiment_label = 'Negative' GROUP BY 1",
    "vq_customer_count_by_segment_country": "SELECT customer_segment, country, count(*) AS customer_count FROM unified GROUP BY 1, 2",
    "vq_churn_risk_distribution": f"""
        SELECT {BUCKET.format('Critical (0.8-1.0)', 'High (0.6-0.8)', 'Medium (0.4-0.6)', 'Low (0.2-0.4)', 'Minimal (0-0.2)')} AS risk_bucket, count(*) AS customer_count
        FROM churn_risk WHERE churn_risk_score IS NOT NULL GROUP BY 1""",
    "vq_open_claims_high_churn": """
        SELECT r.customer_id, r.full_name, r.customer_segment, round(r.churn_risk_score, 3) AS churn_risk_score, u.open_claims
        FROM churn_risk r JOIN unified u ON r.customer_id = u.customer_id WHERE u.open_claims > 0 AND r.churn_risk_score >= 0.6""",
    "vq_avg_premium_by_country": f"SELECT country, {wide('total_premium', 2)} AS avg_premium, count(*) AS customer_count FROM unified WHERE total_premium > 0 GROUP BY 1",
    "vq_delinquent_loans_by_segment": f"""
        SELECT customer_segment, count(*) AS customer_count, {wide('max_days_past_due', 0)} AS avg_days_past_due FROM unified WHERE max_days_past_due >= 90 GROUP BY 1""",
    "vq_documents_by_type": "SELECT document_type, count(*) AS document_count FROM document_extracted GROUP BY 1",
    "qa_top_churn": """
        SELECT r.customer_id, r.full_name, r.customer_segment, round(r.churn_risk_score, 3) AS churn_risk, r.retention_urgency, n.action_type, n.priority
        FROM churn_risk r LEFT JOIN next_best_action n ON r.customer_id = n.customer_id WHERE r.churn_risk_score IS NOT NULL ORDER BY r.churn_risk_score DESC, r.customer_id LIMIT 10""",
    "qa_churn_distribution": f"SELECT {BUCKET.format('Critical', 'High', 'Medium', 'Low', 'Minimal')} AS bucket, count(*) AS customers FROM churn_risk WHERE churn_risk_score IS NOT NULL GROUP BY 1",
    "qa_sentiment_segment": f"""
        SELECT c.customer_segment, {avg('s.sentiment_score', 3)} AS avg_sentiment, count(*) AS calls FROM unified c JOIN transcript_sentiment s ON c.customer_id = s.customer_id GROUP BY 1""",
    "qa_claims_risk": """
        SELECT r.customer_id, r.full_name, r.customer_segment, round(r.churn_risk_score, 3) AS churn_risk, u.open_claims FROM churn_risk r JOIN unified u ON r.customer_id = u.customer_id
        WHERE u.open_claims > 0 AND r.churn_risk_score >= 0.6 ORDER BY r.churn_risk_score DESC, r.customer_id LIMIT 15""",
    "qa_premium_high": "SELECT count(*) AS cnt FROM churn_risk WHERE churn_risk_score >= 0.7 AND customer_segment = 'Premium'",
    "qa_complaints": """
        SELECT c.customer_id, c.full_name, c.customer_segment, c.complaint_count, round(r.churn_risk_score, 3) AS churn_risk, n.action_type, n.priority
        FROM unified c LEFT JOIN churn_risk r ON c.customer_id = r.customer_id LEFT JOIN next_best_action n ON c.customer_id = n.customer_id WHERE c.complaint_count > 2""",
    "qa_documents": """
        SELECT file_name, document_type, reference_number, customer_name, customer_id, amount, category, status FROM document_extracted
        ORDER BY file_modified_at DESC NULLS FIRST, document_id LIMIT 20""",
    "nb_segment_profile": f"""
        SELECT customer_segment, count(*) AS customers, {wide('credit_score', 0)} AS avg_credit, {wide('annual_income', 0)} AS avg_income, {wide('total_premium', 0)} AS avg_premium,
         {wide('estimated_clv', 0)} AS avg_clv, {share('count(*) FILTER (is_active)', 'count(*)', 1)} AS active_pct FROM unified GROUP BY 1""",
    "nb_risk_factors": f"""
        SELECT CASE WHEN r.churn_risk_score >= 0.6 THEN 'High Risk' ELSE 'Low Risk' END AS risk_group, {wide('c.complaint_count', 2)} AS avg_complaints,
         {wide('c.max_days_past_due', 0)} AS avg_dpd, {wide('c.lapsed_policies', 2)} AS avg_lapsed, {wide('c.days_since_last_interaction', 0)} AS avg_days_no_contact, count(*) AS customers
        FROM unified c JOIN churn_risk r ON c.customer_id = r.customer_id WHERE r.churn_risk_score IS NOT NULL GROUP BY 1""",
    "nb_health_distribution": f"SELECT health_grade, customer_segment, count(*) AS customers, {avg('health_score', 1)} AS avg_score FROM health GROUP BY 1, 2",
    "nb_revenue_at_risk": """
        SELECT r.retention_urgency, count(*) AS customers, CAST(round(sum(c.total_premium), 0) AS DOUBLE) AS premium_at_risk,
         CAST(round(sum(CAST(c.estimated_clv AS DECIMAL(28,4))), 0) AS DOUBLE) AS clv_at_risk
        FROM unified c JOIN churn_risk r ON c.customer_id = r.customer_id WHERE r.churn_risk_score >= 0.4 GROUP BY 1""",
    "daily_churn_digest": """
        SELECT r.customer_id, r.full_name, r.customer_segment, r.churn_risk_score, n.action_type FROM churn_risk r JOIN next_best_action n ON r.customer_id = n.customer_id
        WHERE r.churn_risk_score > 0.8 ORDER BY r.churn_risk_score DESC, r.customer_id LIMIT 5""",
    "profile_raw_customers": "SELECT count(*) AS rows, min(created_at) AS first_created, max(created_at) AS last_created FROM raw_customers",
    "recent_complaint_high_churn": """
        SELECT customer_id, full_name, customer_segment, churn_risk_score FROM churn_risk r WHERE churn_risk_score > 0.7
         AND EXISTS (SELECT 1 FROM clean_interactions i WHERE i.customer_id = r.customer_id AND interaction_type = 'Complaint' AND interaction_date >= DATE '2024-01-02')""",
    "queue_summary": """
        SELECT 'total' AS part, action_type, count(*) AS actions, CAST(NULL AS BIGINT) AS customer_id FROM next_best_action GROUP BY 2
        UNION ALL SELECT * FROM (SELECT 'top', action_type, CAST(NULL AS BIGINT), customer_id FROM next_best_action WHERE priority = 'High' ORDER BY churn_risk_score DESC, customer_id LIMIT 3)""",
    "top_premium_churn": """
        SELECT customer_id, full_name, churn_risk_score, retention_urgency FROM churn_risk WHERE customer_segment = 'Premium' AND churn_risk_score IS NOT NULL
        ORDER BY churn_risk_score DESC, customer_id LIMIT 5""",
}

ORACLES = {key: re.sub(r"\n\s+", "\n", sql).strip() for key, sql in ORACLES.items()}
