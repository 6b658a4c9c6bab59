"""DuckDB statements for text, search, governance, quality, alerts, what-if and ingest."""

from __future__ import annotations

import re

from heartwood.oracle.base import half_up, share
from heartwood.oracle.reports import avg, when

ORACLES: dict[str, str] = {}

# ------------------------------------------------------------ prompts, replies
CHURN_TEXT = (
    "Assess the churn risk of this insurance and lending customer. Reply with one JSON object only, with the keys"
    " churn_risk_score (0.0 to 1.0), risk_factors (up to 4 short strings), retention_urgency (Critical, High, Medium"
    " or Low) and confidence (0.0 to 1.0). Customer: "
)
CHURN_PROMPT = f"""
SELECT u.customer_id, '{CHURN_TEXT}' || 'segment=' || u.customer_segment || ', tenure_months=' || CAST(u.tenure_months AS VARCHAR)
 || ', credit_score=' || coalesce(CAST(u.credit_score AS VARCHAR), 'unknown') || ', active_policies=' || CAST(u.active_policies AS VARCHAR)
 || ', lapsed_policies=' || CAST(u.lapsed_policies AS VARCHAR) || ', total_premium=' || CAST(u.total_premium AS VARCHAR)
 || ', open_claims=' || CAST(u.open_claims AS VARCHAR) || ', denied_claims=' || CAST(u.denied_claims AS VARCHAR)
 || ', complaint_count=' || CAST(u.complaint_count AS VARCHAR) || ', escalation_count=' || CAST(u.escalation_count AS VARCHAR)
 || ', max_days_past_due=' || CAST(u.max_days_past_due AS VARCHAR) || ', problem_loans=' || CAST(u.problem_loans AS VARCHAR)
 || ', days_since_last_interaction=' || CAST(u.days_since_last_interaction AS VARCHAR)
 || ', avg_call_sentiment=' || coalesce(CAST(CAST(s.avg_sentiment_score AS DECIMAL(9,4)) AS VARCHAR), 'no_calls')
 || ', negative_call_count=' || CAST(coalesce(s.negative_call_count, 0) AS VARCHAR) || ', is_active=' || CAST(u.is_active AS VARCHAR) AS prompt
FROM unified u LEFT JOIN customer_sentiment s ON u.customer_id = s.customer_id"""

ORACLES |= {
    "churn_prompt": CHURN_PROMPT,
    "batch_complete": f"SELECT customer_id, '{{\"prompt_chars\": ' || CAST(length(prompt) AS VARCHAR) || '}}' AS reply FROM ({CHURN_PROMPT})",
    "nba_prompt": """
        SELECT customer_id, 'Choose the single best next action for this customer. Reply with one JSON object only, with the keys action_type'
         || ' (Retention_Offer, Policy_Review, Claims_Followup, Upsell, Payment_Assistance, Proactive_Outreach,'
         || ' Renewal_Reminder or Complaint_Resolution), action_description, priority (High, Medium or Low), channel (Email,'
         || ' Phone, InApp or Branch) and rationale. Customer: '
         || 'name=' || full_name || ', segment=' || customer_segment || ', churn_risk=' || CAST(churn_risk_score AS VARCHAR) || ', retention_urgency=' || retention_urgency
         || ', active_policies=' || CAST(active_policies AS VARCHAR) || ', total_premium=$' || CAST(total_premium AS VARCHAR) || ', open_claims=' || CAST(open_claims AS VARCHAR)
         || ', days_to_renewal=' || coalesce(CAST(next_renewal_days AS VARCHAR), 'none') || ', days_past_due=' || CAST(max_days_past_due AS VARCHAR)
         || ', estimated_clv=$' || CAST(CAST(round(estimated_clv, 0) AS BIGINT) AS VARCHAR) || ', latest_call_sentiment=' || coalesce(latest_sentiment_label, 'no_calls')
         || ', latest_call_reason=' || coalesce(latest_call_reason, 'none') || ', latest_call_summary=' || coalesce(left(latest_call_summary, 300), 'no recent calls') AS prompt
        FROM next_best_action""",
    "document_prompt": """
        SELECT document_id, 'Read this insurance document. Reply with one JSON object only, with the keys reference_number, policy_number,'
         || ' customer_name, customer_id, document_date, amount, category, status and description. Document: ' || left(parsed_text, 3000) AS prompt FROM parsed_documents""",
    "parse_model_json": r"""
        SELECT customer_id, TRY_CAST(json_extract_string(j, '$.churn_risk_score') AS DOUBLE) AS churn_risk_score, json_extract_string(j, '$.retention_urgency') AS retention_urgency,
         array_to_string(CAST(json_extract_string(j, '$.risk_factors[*]') AS VARCHAR[]), '; ') AS risk_factors, TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS confidence
        FROM (SELECT customer_id, TRY_CAST(nullif(regexp_extract(raw_text, '\{[\s\S]*\}'), '') AS JSON) AS j FROM raw_model_output)""",
    "parse_amount": """
        SELECT document_id, amount, TRY_CAST(replace(replace(amount, '$', ''), ',', '') AS DOUBLE) AS amount_value FROM document_extracted""",
    "customer_summary": """
        SELECT c.customer_id, 'Customer: ' || c.full_name || ' (' || c.customer_segment || '). Churn Risk: ' || coalesce(CAST(round(r.churn_risk_score, 2) AS VARCHAR), 'N/A')
         || '. Recommended Action: ' || coalesce(n.action_type, 'None') || ' - ' || coalesce(n.action_description, 'No recommendation')
         || '. Health Grade: ' || coalesce(h.health_grade, 'N/A') || ' (' || coalesce(CAST(h.health_score AS VARCHAR), '0') || '/100).' AS summary
        FROM unified c LEFT JOIN churn_risk r ON c.customer_id = r.customer_id LEFT JOIN next_best_action n ON c.customer_id = n.customer_id LEFT JOIN health h ON c.customer_id = h.customer_id""",
}

# ---------------------------------------------------------------------- search


ASKED = "(VALUES ('renewal', 'the error request and note'), ('dispute', 'was it with that signup'), ('rare', 'zu den kindern purchase')) v(query_id, t)"


def bm25(where: str, asked: str = ASKED) -> str:
    return f"""
        SELECT query_id, document_key, customer_id, source_type, channel, event_date, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_key) AS rank
        FROM (SELECT q.query_id, d.document_key, any_value(d.customer_id) AS customer_id, any_value(d.source_type) AS source_type, any_value(d.channel) AS channel,
          any_value(d.event_date) AS event_date,
          round(sum(ln(1 + (s.n - f.df + CAST(0.5 AS DOUBLE)) / (f.df + CAST(0.5 AS DOUBLE))) * p.tf * CAST(2.2 AS DOUBLE)
           / (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * d.len / (s.total / s.n)))), 6) AS score
         FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(t), '[a-z]+')) AS term
           FROM {asked}) q
         JOIN (SELECT document_key, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT document_key, unnest(words) AS term FROM docs) GROUP BY ALL) p ON q.term = p.term
         JOIN (SELECT term, CAST(count(DISTINCT document_key) AS DOUBLE) AS df FROM (SELECT document_key, unnest(words) AS term FROM docs) GROUP BY ALL) f ON q.term = f.term
         JOIN (SELECT *, len(words) AS len FROM docs) d ON p.document_key = d.document_key
         CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(words)) AS DOUBLE) AS total FROM docs) s
         WHERE {where} GROUP BY q.query_id, d.document_key) QUALIFY rank <= 10"""


ORACLES |= {
    "search_bm25": bm25("true"),
    "search_bm25_index": bm25("true", "(SELECT item_id AS query_id, text AS t FROM benchmark)"),
    "search_bm25_filtered": bm25("d.source_type = 'interaction_note' AND d.channel IN ('Chat', 'Web') AND d.event_date >= DATE '2024-01-10'"),
    "search_knn": """
        SELECT query_id, vec_id, label, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, vec_id) AS rank
        FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
         FROM embeddings e JOIN embeddings q ON q.vec_id IN (0, 7, 42) AND e.vec_id <> q.vec_id) QUALIFY rank <= 10""",
    "search_knn_every": """
        SELECT query_id, vec_id, label, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, vec_id) AS rank
        FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
         FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) QUALIFY rank <= 10""",
}

ORACLES["search_knn_pivots"] = ORACLES["search_knn_every"]

# ------------------------------------------------------------------ governance
ORACLES |= {
    "mask_email": r"SELECT customer_id, regexp_replace(email, '(^[^@]{2})[^@]*(@.*)', '\1***\2', 'g') AS email, email AS email_privileged FROM clean_customers",
    "mask_phone": r"SELECT customer_id, regexp_replace(phone, '(\+?\d{1,3}[-.]?)\d{6,}(\d{2})', '\1******\2', 'g') AS phone, phone AS phone_privileged FROM clean_customers",
    "mask_phone_strict": r"""
        SELECT customer_id, regexp_replace(left(phone, length(phone) - 2), '[0-9]', '*', 'g') || right(phone, 2) AS phone, phone AS phone_privileged FROM clean_customers""",
    "mask_financial": r"""
        SELECT customer_id, regexp_replace(email, '(^[^@]{2})[^@]*(@.*)', '\1***\2', 'g') AS email, regexp_replace(phone, '(\+?\d{1,3}[-.]?)\d{6,}(\d{2})', '\1******\2', 'g') AS phone,
         CAST(NULL AS DOUBLE) AS annual_income, CAST(NULL AS INT) AS credit_score FROM clean_customers""",
    "row_access_us": "SELECT customer_id, full_name, country FROM unified WHERE country IN (SELECT allowed_country FROM role_region_mapping WHERE role_name = 'US_TEAM')",
    "row_access_apac": "SELECT customer_id, full_name, country FROM unified WHERE country IN (SELECT allowed_country FROM role_region_mapping WHERE role_name = 'APAC_TEAM')",
    "row_access_none": "SELECT customer_id, full_name, country FROM unified WHERE country IN (SELECT allowed_country FROM role_region_mapping WHERE role_name = 'VISITOR')",
    "role_region_mapping": """
        SELECT m.role_name, count(DISTINCT u.customer_id) AS visible_rows FROM role_region_mapping m LEFT JOIN unified u ON m.allowed_country = 'ALL' OR m.allowed_country = u.country GROUP BY 1""",
    "pii_tag_coverage": """
        SELECT 'email' AS column_name, 'HIGH' AS pii_level, count(*) AS rows, count(email) AS filled FROM raw_customers
        UNION ALL SELECT 'phone', 'HIGH', count(*), count(phone) FROM raw_customers UNION ALL SELECT 'annual_income', 'MEDIUM', count(*), count(annual_income) FROM raw_customers
        UNION ALL SELECT 'credit_score', 'MEDIUM', count(*), count(credit_score) FROM raw_customers""",
    "table_tag_coverage": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{domain}' AS data_domain, count(*) AS rows FROM {name}"
        for name, domain in (
            ("raw_customers", "CUSTOMER"), ("raw_policies", "POLICY"), ("raw_claims", "CLAIM"), ("raw_loans", "LOAN"),
            ("raw_interactions", "INTERACTION"), ("raw_documents", "DOCUMENT"),
        )
    ),
}

# --------------------------------------------------------------------- quality
LAYERS = {
    "RAW": "raw_customers raw_policies raw_claims raw_loans raw_interactions raw_call_transcripts raw_documents",
    "CLEAN": "clean_customers clean_policies clean_claims clean_loans clean_interactions clean_call_transcripts",
    "CURATED": "customer_360_unified:unified interaction_timeline:timeline",
    "AI": "parsed_documents document_extracted transcript_sentiment churn_risk next_best_action customer_health_score:health",
}


def counts(layers: dict[str, str], skip: str = "-") -> str:
    rows = []
    for layer, names in layers.items():
        for entry in names.split():
            name, _, table = entry.partition(":")
            if name not in skip.split():
                rows.append(f"SELECT '{layer}' AS layer, '{name}' AS table_name, count(*) AS row_count FROM {table or name}")
    return "\nUNION ALL ".join(rows)


def null_rate(table: str, column: str, metric: str, limit: int, details: str) -> str:
    nulls = f"count(*) FILTER ({column} IS NULL)"
    return f"""
        SELECT 'completeness' AS check_type, '{table}' AS table_name, '{metric}' AS metric_name, {share(nulls, 'count(*)', 2)} AS metric_value, CAST({limit} AS DOUBLE) AS threshold,
         CASE WHEN {nulls} * 100.0 / nullif(count(*), 0) > {limit} THEN 'FAIL' ELSE 'PASS' END AS status, '{details}' AS details FROM {table}"""


def out_of_range(table: str, column: str, low: int, metric: str, details: str) -> str:
    return f"""
        SELECT 'range_check' AS check_type, '{table}' AS table_name, '{metric}' AS metric_name, CAST(count(*) FILTER ({column} < {low} OR {column} > 1) AS DOUBLE) AS metric_value,
         CAST(0 AS DOUBLE) AS threshold, CASE WHEN count(*) FILTER ({column} < {low} OR {column} > 1) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, '{details}' AS details FROM {table}"""


def checks(*rows: tuple[int, str, str, str, str, str, str]) -> str:
    parts = [
        f"SELECT {i} AS test_id, '{page}' AS page, '{name}' AS test_name, CASE WHEN {rule} THEN 'PASS' ELSE '{bad}' END AS status,"
        f" CAST(v AS VARCHAR) || '{detail}' AS detail, CAST(v AS BIGINT) AS row_count FROM (SELECT {value})"
        for i, page, name, value, rule, bad, detail in rows
    ]
    return "\nUNION ALL ".join(parts)


DERIVED = 14
POPULATED = " + ".join(
    f"CAST(EXISTS (SELECT 1 FROM {entry.split(':')[-1]}) AS INT)" for names in LAYERS.values() for entry in names.split()
)
PERCENT = "CAST(round({0}, 0) AS BIGINT)"

ORACLES |= {
    "layer_row_counts": counts(LAYERS),
    "layer_totals": f"SELECT layer, count(*) AS tables, CAST(sum(row_count) AS BIGINT) AS row_count FROM ({counts(LAYERS)}) GROUP BY 1",
    "refresh_mode_counts": f"""
        SELECT CASE WHEN table_name = 'clean_interactions' THEN 'INCREMENTAL' ELSE 'FULL' END AS refresh_mode, count(*) AS tables, CAST(sum(row_count) AS BIGINT) AS row_count
        FROM ({counts(LAYERS)}) WHERE layer <> 'RAW' GROUP BY 1""",
    "validation_row_counts": f"SELECT table_name, row_count FROM ({counts(LAYERS, 'raw_documents parsed_documents document_extracted customer_health_score')})",
    "check_churn_completeness": null_rate("churn_risk", "churn_risk_score", "null_churn_score_rate", 10, "Percentage of customers with NULL churn risk score"),
    "check_nba_completeness": null_rate("next_best_action", "action_type", "null_action_type_rate", 15, "Percentage of customers with NULL action type"),
    "check_churn_range": out_of_range("churn_risk", "churn_risk_score", 0, "out_of_range_scores", "Count of churn scores outside 0-1 range"),
    "check_sentiment_range": out_of_range("transcript_sentiment", "sentiment_score", -1, "out_of_range_sentiment", "Count of sentiment scores outside -1 to 1 range"),
    "orphan_policies": """
        SELECT 'Orphan policies' AS check_name, count(*) AS violations FROM raw_policies p LEFT JOIN (SELECT DISTINCT customer_id FROM raw_customers) c ON p.customer_id = c.customer_id
        WHERE c.customer_id IS NULL""",
    "orphan_loans": """
        SELECT 'Orphan loans' AS check_name, count(*) AS violations FROM raw_loans p LEFT JOIN (SELECT DISTINCT customer_id FROM raw_customers) c ON p.customer_id = c.customer_id
        WHERE c.customer_id IS NULL""",
    "orphan_claims": """
        SELECT 'Orphan claims' AS check_name, count(*) AS violations FROM raw_claims k LEFT JOIN (SELECT DISTINCT policy_id FROM raw_policies) p ON k.policy_id = p.policy_id
        LEFT JOIN (SELECT DISTINCT customer_id FROM raw_customers) c ON k.customer_id = c.customer_id WHERE p.policy_id IS NULL OR c.customer_id IS NULL""",
    "risk_buckets_validation": """
        SELECT CASE WHEN churn_risk_score >= 0.8 THEN '0.8-1.0 Critical' WHEN churn_risk_score >= 0.6 THEN '0.6-0.8 High' WHEN churn_risk_score >= 0.4 THEN '0.4-0.6 Medium'
         WHEN churn_risk_score >= 0.2 THEN '0.2-0.4 Low' WHEN churn_risk_score >= 0.0 THEN '0.0-0.2 Minimal' ELSE 'NULL/Invalid' END AS risk_bucket, count(*) AS customer_count
        FROM churn_risk GROUP BY 1""",
    "label_summary": f"SELECT sentiment_label, count(*) AS transcript_count, {avg('sentiment_score', 3)} AS avg_score FROM transcript_sentiment GROUP BY 1",
    "action_priority_counts": "SELECT action_type, priority, count(*) AS action_count FROM next_best_action WHERE action_type IS NOT NULL GROUP BY 1, 2",
    "completeness_report": f"""
        SELECT 'churn_risk' AS table_name, count(*) AS total, count(churn_risk_score) AS non_null, {share('count(churn_risk_score)', 'count(*)', 1)} AS completeness_pct FROM churn_risk
        UNION ALL SELECT 'next_best_action', count(*), count(action_type), {share('count(action_type)', 'count(*)', 1)} FROM next_best_action""",
    "end_to_end_top10": """
        SELECT c.customer_id, c.full_name, c.customer_segment, CAST(c.total_premium AS DOUBLE) AS total_premium, c.composite_risk_level, r.churn_risk_score, r.retention_urgency,
         n.action_type, n.action_description, n.priority
        FROM unified c JOIN churn_risk r ON c.customer_id = r.customer_id JOIN next_best_action n ON c.customer_id = n.customer_id WHERE r.churn_risk_score IS NOT NULL
        ORDER BY r.churn_risk_score DESC, c.customer_id LIMIT 10""",
    "churn_parse_failure": f"SELECT {share('count(*) FILTER (churn_risk_score IS NULL)', 'count(*)', 2)} AS failure_rate FROM churn_risk",
    "nba_parse_failure": f"SELECT {share('count(*) FILTER (action_type IS NULL)', 'count(*)', 2)} AS failure_rate FROM next_best_action",
    "ai_quality_dashboard": "SELECT * FROM quality_dashboard",
    "check_suite": checks(
        (1, "Infrastructure", "All tables exist", "24 AS v", "v >= 17", "FAIL", " tables (need >= 17)"),
        (2, "Infrastructure", "Dynamic tables", f"{DERIVED} AS v", "v >= 9", "FAIL", " DTs (need >= 9)"),
        (3, "Infrastructure", "Search", "1 AS v", "v >= 1", "FAIL", " service(s)"),
        (4, "Infrastructure", "Semantic view", "1 AS v", "v >= 1", "FAIL", " view(s)"),
        (5, "Home", "KPI: Total Customers", "count(*) AS v FROM unified", "v > 0", "FAIL", " customers"),
        (6, "Home", "KPI: Active Customers", "count(*) AS v FROM unified WHERE is_active", "v > 0", "FAIL", " active"),
        (7, "Home", "KPI: High Churn Risk", "count(*) AS v FROM churn_risk WHERE churn_risk_score >= 0.7", "true", "FAIL", " high-risk"),
        (8, "Home", "KPI: High Priority Actions", "count(*) AS v FROM next_best_action WHERE priority = 'High'", "true", "FAIL", " actions"),
        (9, "Home", "Chart: Churn by Segment", "count(DISTINCT customer_segment) AS v FROM churn_risk WHERE churn_risk_score IS NOT NULL", "v >= 3", "FAIL", " segments"),
        (10, "Home", "Chart: Sentiment Dist", "count(DISTINCT sentiment_label) AS v FROM transcript_sentiment", "v >= 2", "FAIL", " labels"),
        (11, "Home", "Table: Top Actions", "count(*) AS v FROM next_best_action WHERE priority = 'High' AND action_type IS NOT NULL", "v > 0", "FAIL", " rows"),
        (12, "Customer 360", "Search: smith", "count(*) AS v FROM unified WHERE full_name ILIKE '%smith%'", "v > 0", "FAIL", " matches"),
        (13, "Customer 360", "Claims data", "count(*) AS v FROM clean_claims", "v > 0", "FAIL", " rows"),
        (14, "Customer 360", "Loans data", "count(*) AS v FROM clean_loans", "v > 0", "FAIL", " rows"),
        (15, "Customer 360", "Timeline data", "count(*) AS v FROM timeline", "v > 0", "FAIL", " events"),
        (16, "Churn Risk", "Segment filters", "count(DISTINCT customer_segment) AS v FROM churn_risk WHERE churn_risk_score IS NOT NULL", "v >= 3", "FAIL", " segments"),
        (17, "Sentiment", "Transcript data", "count(*) AS v FROM transcript_sentiment", "v > 0", "FAIL", " scored"),
        (18, "Next Best Action", "Action types", "count(DISTINCT action_type) AS v FROM next_best_action", "v >= 3", "FAIL", " types"),
        (19, "AI Advisor", "Fallback: complaints", "count(*) AS v FROM unified WHERE complaint_count > 2", "true", "FAIL", " with >2"),
        (20, "Operations", "INFO_SCHEMA tables", "24 AS v", "v > 0", "FAIL", " tables"),
        (21, "Data Quality", "Churn completeness", PERCENT.format(share("count(churn_risk_score)", "count(*)", 1)) + " AS v FROM churn_risk", "v >= 90", "WARN", "% non-null"),
        (22, "Data Quality", "Churn range [0,1]", "count(*) AS v FROM churn_risk WHERE churn_risk_score < 0 OR churn_risk_score > 1", "v = 0", "FAIL", " violations"),
        (23, "Data Quality", "Sentiment range [-1,1]", "count(*) AS v FROM transcript_sentiment WHERE sentiment_score < -1 OR sentiment_score > 1", "v = 0", "FAIL", " violations"),
        (24, "Document", "Documents exist", "count(*) AS v FROM document_extracted", "v > 0", "FAIL", " documents"),
        (25, "Document", "Customer cross-reference", "count(*) AS v FROM unified WHERE total_documents > 0", "v > 0", "FAIL", " customers with docs"),
        (26, "Document", "Timeline includes documents", "count(*) AS v FROM timeline WHERE event_category = 'Document'", "v > 0", "FAIL", " doc events"),
        (27, "AI Quality", "Churn parse success", PERCENT.format(share("count(*) FILTER (churn_risk_score IS NULL)", "count(*)", 1)) + " AS v FROM churn_risk", "v < 5", "FAIL", "% null scores (need < 5%)"),
        (28, "AI Quality", "NBA parse success", PERCENT.format(share("count(*) FILTER (action_type IS NULL)", "count(*)", 1)) + " AS v FROM next_best_action", "v < 5", "FAIL", "% null actions (need < 5%)"),
        (29, "Governance", "Masking policies exist", "4 AS v", "v > 0", "FAIL", " policies"),
        (30, "Governance", "PII tags exist", "4 AS v", "v > 0", "FAIL", " PII tags"),
        (32, "Infrastructure", "AI quality dashboard view", "1 AS v", "v > 0", "FAIL", " view(s)"),
        (33, "Data Quality", "Timeline: 6 event categories", "count(DISTINCT event_category) AS v FROM timeline", "v >= 6", "FAIL", " categories (need >= 6)"),
        (34, "App Health", "DT probe query runs", f"{DERIVED} AS v", "v >= 14", "FAIL", " DTs (need >= 14)"),
        (35, "App Health", "All layers populated", f"{POPULATED} AS v", "v >= 20", "FAIL", " populated tables"),
        (36, "App Health", "Doc-customer cross-ref probe", "count(*) AS v FROM unified WHERE total_documents > 0", "v > 0", "FAIL", " customers with docs"),
    ),
}

PROBE_ROWS = (
    ("Home", "Customer count KPI", 1, "SELECT count(*) FROM unified"),
    ("Home", "High churn KPI", 0, "SELECT count(*) FROM churn_risk WHERE churn_risk_score >= 0.7"),
    ("Home", "High priority actions KPI", 0, "SELECT count(*) FROM next_best_action WHERE priority = 'High'"),
    ("Home", "Documents processed KPI", 0, "SELECT count(*) FROM document_extracted"),
    ("Customer 360", "Customer search query", 1, "SELECT customer_id FROM unified LIMIT 10"),
    ("Customer 360", "Interaction timeline", 1, "SELECT count(*) FROM timeline"),
    ("Customer 360", "Churn join", 1, "SELECT count(*) FROM churn_risk r JOIN unified c ON r.customer_id = c.customer_id"),
    ("Churn Risk", "Segment list for filter", 1, "SELECT DISTINCT customer_segment FROM churn_risk"),
    ("Churn Risk", "Urgency distribution", 1, "SELECT retention_urgency, count(*) FROM churn_risk GROUP BY 1"),
    ("Churn Risk", "Top churn customers", 1, "SELECT full_name FROM churn_risk LIMIT 10"),
    ("Sentiment", "KPI aggregation", 1, "SELECT count(*) FROM transcript_sentiment"),
    ("Sentiment", "Distribution by label", 1, "SELECT sentiment_label, count(*) FROM transcript_sentiment GROUP BY 1"),
    ("Sentiment", "Weekly trend", 1, "SELECT date_trunc('week', call_date), count(*) FROM transcript_sentiment GROUP BY 1 LIMIT 20"),
    ("Next Best Action", "Action types for filter", 1, "SELECT DISTINCT action_type FROM next_best_action WHERE action_type IS NOT NULL"),
    ("Next Best Action", "High-priority NBA rows", 1, "SELECT full_name FROM next_best_action WHERE priority = 'High' LIMIT 20"),
    ("Next Best Action", "Action mix chart", 1, "SELECT action_type, count(*) FROM next_best_action GROUP BY 1"),
    ("AI Advisor", "Customer context data", 1, "SELECT count(*) FROM unified WHERE complaint_count > 0"),
    ("AI Advisor", "Critical retention data", 0, "SELECT full_name FROM churn_risk WHERE retention_urgency = 'Critical' LIMIT 5"),
    ("Operations", "Layer row counts", 1, f"SELECT DISTINCT layer FROM ({counts(LAYERS)}) WHERE row_count > 0"),
    ("Operations", "Dynamic tables count", 1, f"SELECT count(*) FROM ({counts(LAYERS)}) WHERE layer <> 'RAW'"),
    ("Operations", "All layers populated", 1, f"SELECT count(*) FROM ({counts(LAYERS)})"),
    ("Documents", "Document count KPIs", 1, "SELECT count(*) FROM document_extracted"),
    ("Documents", "Extracted fields table", 1, "SELECT file_name FROM document_extracted LIMIT 10"),
    ("Documents", "Document-customer cross-ref", 1, "SELECT count(*) FROM unified WHERE total_documents > 0"),
    ("What-If Simulator", "Health score DT", 1, "SELECT count(*) FROM health"),
    ("What-If Simulator", "3-way join", 1, "SELECT c.full_name FROM unified c JOIN churn_risk r ON c.customer_id = r.customer_id JOIN health h ON c.customer_id = h.customer_id LIMIT 5"),
    ("Operations", "Governance tab: masking policies", 1, "SELECT count(*) FROM role_region_mapping"),
    ("Operations", "AI Quality tab: dashboard view", 1, "SELECT count(*) FROM quality_dashboard"),
    ("Operations", "Lineage tab: full object inventory", 1, f"SELECT count(*) FROM ({counts(LAYERS)})"),
)
PROBE_SQL = "\nUNION ALL ".join(
    f"SELECT '{page}' AS page, '{name}' AS probe, rows, CAST({least} AS BIGINT) AS min_rows, CASE WHEN rows >= {least} THEN 'PASS' ELSE 'WARN' END AS status"
    f" FROM (SELECT count(*) AS rows FROM ({sql}))"
    for page, name, least, sql in PROBE_ROWS
)
ORACLES |= {
    "probe_results": PROBE_SQL,
    "probe_summary": f"""
        SELECT page, count(*) AS probes, {when("status = 'PASS'")} AS passed, {when("status = 'WARN'")} AS warned, {share("count(*) FILTER (status = 'PASS')", 'count(*)', 0)} AS pct
        FROM ({PROBE_SQL}) GROUP BY 1""",
}

# ------------------------------------------------- alerts, campaign, semantics


def paged(alert: str, source: str, line: str, order: str, header: str = "") -> str:
    return f"""
        SELECT '{alert}' AS alert, page + 1 AS message_no, count(*) AS lines, {header}string_agg(line, chr(10) ORDER BY no) AS body
        FROM (SELECT {line} AS line, row_number() OVER (ORDER BY {order}) AS no, (row_number() OVER (ORDER BY {order}) - 1) // 500 AS page FROM {source}) GROUP BY page"""


CAMPAIGN = """
SELECT n.customer_id, c.full_name, c.email, c.customer_segment, n.action_type, round(r.churn_risk_score, 2) AS churn_risk,
 left('Dear ' || c.full_name || ',' || chr(10) || chr(10) || 'Thank you for being a ' || c.customer_segment || ' customer. We would like to help: ' || lower(n.action_description)
  || ' Please reply to this message and we will arrange it.' || chr(10) || chr(10) || 'Your customer team', 1000) AS email_body, 'DRAFTED' AS status
FROM next_best_action n JOIN unified c ON c.customer_id = n.customer_id JOIN churn_risk r ON r.customer_id = n.customer_id
WHERE r.churn_risk_score >= 0.6 AND n.priority = 'High' ORDER BY r.churn_risk_score DESC, n.customer_id LIMIT 10"""

ORACLES |= {
    "alert_critical_churn": paged(
        "critical_churn",
        "churn_risk WHERE churn_risk_score >= 0.8 AND retention_urgency = 'Critical'",
        "full_name || ' (' || customer_segment || ') - Score: ' || CAST(round(churn_risk_score, 2) AS VARCHAR) || ' - ' || retention_urgency",
        "churn_risk_score DESC, customer_id",
        "'Critical churn risk customers detected:' || chr(10) || chr(10) || ",
    ),
    "alert_vip_complaint": paged(
        "vip_complaint",
        "unified WHERE customer_segment IN ('VIP', 'Premium') AND complaint_count >= 3 AND composite_risk_level = 'High'",
        "full_name || ' (' || customer_segment || ') - ' || CAST(complaint_count AS VARCHAR) || ' complaints, Risk: ' || composite_risk_level",
        "complaint_count DESC, customer_id",
    ),
    "alert_quality": paged(
        "quality",
        "quality_dashboard WHERE failure_rate_pct > 1",
        "model || ': ' || CAST(failure_rate_pct AS VARCHAR) || '% failure rate (' || CAST(parse_failures AS VARCHAR) || '/' || CAST(total_records AS VARCHAR) || ')'",
        "failure_rate_pct DESC, model",
    ),
    "retention_campaign": CAMPAIGN,
    "campaign_digest": f"""
        SELECT 'campaign' AS alert, CAST(1 AS BIGINT) AS message_no, count(*) AS lines,
         string_agg(full_name || ' - Churn: ' || CAST(churn_risk AS VARCHAR) || ' - ' || action_type, chr(10) ORDER BY churn_risk DESC, customer_id) AS body FROM ({CAMPAIGN}) HAVING count(*) > 0""",
    "semantic_avg_premium_by_segment": """
        SELECT customer_segment, CAST(sum(total_premium) AS DOUBLE) / count(total_premium) AS total_premium, count(DISTINCT customer_id) AS total_customers FROM unified GROUP BY 1""",
    "semantic_docs_by_country": """
        SELECT c.country, count(d.file_name) AS total_documents FROM document_extracted d LEFT JOIN unified c ON TRY_CAST(d.customer_id AS DECIMAL(38,0)) = c.customer_id GROUP BY 1""",
    "semantic_risk_and_calls_by_segment": """
        SELECT customer_segment, churn_risk_score, sentiment_score, total_customers
        FROM (SELECT customer_segment, count(DISTINCT customer_id) AS total_customers FROM unified WHERE country IN ('USA', 'UK', 'INDIA') GROUP BY 1)
        LEFT JOIN (SELECT c.customer_segment, CAST(sum(CAST(r.churn_risk_score AS DECIMAL(28,6))) AS DOUBLE) / count(r.churn_risk_score) AS churn_risk_score
         FROM churn_risk r JOIN unified c ON r.customer_id = c.customer_id WHERE c.country IN ('USA', 'UK', 'INDIA') GROUP BY 1) USING (customer_segment)
        LEFT JOIN (SELECT c.customer_segment, CAST(sum(CAST(s.sentiment_score AS DECIMAL(28,6))) AS DOUBLE) / count(s.sentiment_score) AS sentiment_score
         FROM transcript_sentiment s JOIN unified c ON s.customer_id = c.customer_id WHERE c.country IN ('USA', 'UK', 'INDIA') GROUP BY 1) USING (customer_segment)""",
}

DOMAIN = (
    "customer|churn|risk|policy|policies|claim|loan|premium|segment|sentiment|action|complaint|escalation|retention|vip|basic|standard|score|transcript"
    "|insurance|lending|billing|coverage|payment|nba|next best|360|call|document|robert|lisa|david|donald|dorothy|kenji|barbara|sarah|joseph|tanaka|ramirez"
    "|harris|smith|martin|singh|jones|miller|brown"
)
ORACLES["route_questions"] = f"""
    SELECT conv_id, turn, CASE WHEN NOT regexp_matches(q, '{DOMAIN}') THEN 'guard' WHEN contains(q, 'top') AND contains(q, 'churn') THEN 'qa_top_churn'
     WHEN contains(q, 'distribution') AND contains(q, 'churn') THEN 'qa_churn_distribution' WHEN contains(q, 'sentiment') AND contains(q, 'segment') THEN 'qa_sentiment_segment'
     WHEN contains(q, 'claim') AND (contains(q, 'churn') OR contains(q, 'risk')) THEN 'qa_claims_risk' WHEN contains(q, 'premium') AND (contains(q, 'high') OR contains(q, 'risk')) THEN 'qa_premium_high'
     WHEN contains(q, 'complaint') THEN 'qa_complaints' WHEN contains(q, 'document') THEN 'qa_documents' ELSE 'other' END AS route
    FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user')"""

# --------------------------------------------------------------------- what-if
ORACLES |= {
    "whatif_baseline": """
        SELECT c.customer_id, c.full_name, c.customer_segment, c.active_policies, c.lapsed_policies, CAST(c.total_premium AS DOUBLE) AS total_premium, c.open_claims, c.complaint_count,
         c.max_days_past_due, CAST(c.total_outstanding_balance AS DOUBLE) AS total_outstanding_balance, c.days_since_last_interaction, coalesce(r.churn_risk_score, 0.5) AS current_churn_risk,
         r.retention_urgency, coalesce(h.health_score, 50) AS current_health_score, coalesce(h.health_grade, 'C') AS current_health_grade
        FROM unified c LEFT JOIN churn_risk r ON c.customer_id = r.customer_id LEFT JOIN health h ON c.customer_id = h.customer_id""",
    "whatif_scenarios": f"""
        SELECT customer_id, scenario_id, premium_discount, resolve_claims, outreach, clear_past_due, resolve_complaints, past_due_target, modified_premium, current_churn_risk, predicted_churn_risk,
         round(predicted_churn_risk - current_churn_risk, 4) AS delta, CASE WHEN round(predicted_churn_risk - current_churn_risk, 4) < 0 THEN 'decreased'
         WHEN round(predicted_churn_risk - current_churn_risk, 4) > 0 THEN 'increased' ELSE 'unchanged' END AS risk_change
        FROM (SELECT s.*, u.customer_id, {half_up('u.total_premium * 100 * (100 - s.premium_discount)', '10000', 2)} AS modified_premium,
          coalesce(r.churn_risk_score, 0.5) AS current_churn_risk,
          CASE WHEN u.tenure_months IS NULL THEN CAST(0.5 AS DOUBLE) ELSE round(greatest(CAST(least(greatest(15 + k.p_lapsed
           + CASE WHEN s.resolve_complaints THEN 0 ELSE k.p_complaints END + CASE WHEN s.clear_past_due THEN 0 ELSE k.p_dpd END + k.p_loans
           + CASE WHEN s.resolve_claims THEN 0 ELSE k.p_open END + k.p_denied + k.p_calls + CASE WHEN s.outreach THEN 0 ELSE k.p_contact END + k.p_inactive
           - CASE WHEN u.tenure_months >= 60 THEN 10 ELSE 0 END - CASE WHEN u.active_policies >= 8 THEN 5 ELSE 0 END, 0), 100) AS DOUBLE) / 100
           - CASE WHEN u.total_premium > 0 THEN CAST(s.premium_discount // 5 AS DOUBLE) ELSE 0 END / 100, 0), 4) END AS predicted_churn_risk
         FROM unified u JOIN churn_risk r ON u.customer_id = r.customer_id JOIN churn_points k ON u.customer_id = k.customer_id
         CROSS JOIN (SELECT CAST(row_number() OVER (ORDER BY a.d, b.v, c.v, e.v, f.v) - 1 AS INT) AS scenario_id, CAST(a.d AS INT) AS premium_discount, b.v AS resolve_claims, c.v AS outreach,
           e.v AS clear_past_due, f.v AS resolve_complaints, CAST(0 AS INT) AS past_due_target FROM (VALUES (0), (10), (50)) a(d), (VALUES (false), (true)) b(v), (VALUES (false), (true)) c(v),
           (VALUES (false), (true)) e(v), (VALUES (false), (true)) f(v)) s)""",
}

# ------------------------------------------------------- ingest and refreshing
RENEWALS = """
SELECT (SELECT max(policy_id) FROM raw_policies) + row_number() OVER (ORDER BY policy_id) AS policy_id, policy_id AS renewed_from, customer_id, policy_type
FROM clean_policies WHERE is_expired"""


def picked(salt: str, values: str) -> str:
    return f"list_extract([{values}], CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '|batch-{salt}'), 1, 8) AS BIGINT) % 6 + 1)"


ORACLES |= {
    "dedup_latest_claims": "SELECT claim_id, policy_id, CAST(claim_amount AS DOUBLE) AS claim_amount, created_at FROM clean_claims",
    "assign_batch_ids": RENEWALS,
    "batch_append": f"""
        SELECT policy_id, customer_id, policy_type, CAST(0 AS BIGINT) AS batch FROM raw_policies
        UNION ALL SELECT policy_id, customer_id, policy_type, CAST(1 AS BIGINT) FROM ({RENEWALS})""",
    "newest_customers": "SELECT DISTINCT customer_id FROM raw_customers WHERE customer_id > (SELECT max(customer_id) - 1500 FROM raw_customers)",
    "newest_policies": "SELECT policy_id, customer_id FROM raw_policies ORDER BY policy_id DESC LIMIT 30",
    "sample_by_hash": f"""
        SELECT customer_id, {picked('policy_type', "'Auto', 'Home', 'Life', 'Health', 'Travel', 'Cyber'")} AS policy_type,
         {picked('policy_status', "'Active', 'Active', 'Active', 'Renewed', 'Lapsed', 'Cancelled'")} AS policy_status
        FROM clean_customers ORDER BY md5(CAST(customer_id AS VARCHAR) || '|batch'), customer_id LIMIT 30""",
    "export_csv": """
        SELECT file_name, document_type, reference_number, policy_number, customer_name, customer_id, amount, category, status, document_date FROM document_extracted""",
    "stream_clean_interactions": "SELECT * FROM clean_interactions",
    "stream_interaction_agg": "SELECT * FROM interaction_agg",
    "stream_parse_failure": f"SELECT {share('count(*) FILTER (customer_id % 17 = 0 OR customer_id % 19 = 0)', 'count(*)', 2)} AS failure_rate FROM raw_model_output",
    "stream_alerts": """
        SELECT a.customer_id, c.customer_segment, a.complaint_count FROM interaction_agg a JOIN clean_customers c ON a.customer_id = c.customer_id
        WHERE c.customer_segment IN ('VIP', 'Premium') AND a.complaint_count >= 3""",
    "run_history_summary": """
        SELECT unnest(['refresh_interactions', 'refresh_parse_failure']) AS job, CAST(1 AS BIGINT) AS runs, CAST(1 AS BIGINT) AS succeeded,
         CAST(0 AS BIGINT) AS failed, unnest([(SELECT count(*) FROM events), (SELECT count(*) FROM customer)]) AS rows_read,
         unnest([(SELECT count(*) FROM clean_interactions), (SELECT count(DISTINCT c_custkey) FROM customer)]) AS rows_written""",
    "run_list": """
        SELECT unnest(['refresh_interactions', 'refresh_parse_failure']) AS job, 'SUCCEEDED' AS state, CAST(NULL AS VARCHAR) AS message,
         CAST(1 AS BIGINT) AS batches, unnest([(SELECT count(*) FROM events), (SELECT count(*) FROM customer)]) AS rows_read,
         unnest([(SELECT count(*) FROM clean_interactions), (SELECT count(DISTINCT c_custkey) FROM customer)]) AS rows_written,
         unnest([(SELECT count(*) FROM clean_interactions), (SELECT count(DISTINCT c_custkey) FROM customer)]) AS rows_changed""",
}
ORACLES["stream_alert_events"] = f"SELECT *, 'raised' AS state FROM ({ORACLES['stream_alerts']})"

ORACLES |= {
    "campaign_log": f"SELECT customer_id, full_name, action_type, status AS email_status FROM ({CAMPAIGN})",
    "quality_log": " UNION ALL ".join(
        f"SELECT * FROM ({ORACLES[name]})"
        for name in ("check_churn_completeness", "check_nba_completeness", "check_churn_range", "check_sentiment_range")
    )
    + " UNION ALL SELECT 'pipeline_health', 'ALL', 'health_check_run', 1, 1, 'PASS', 'Health check completed'",
}

ORACLES |= {
    "stored_check_suite": ORACLES["check_suite"],
    "stored_layer_counts": f"""{counts(LAYERS)}
        UNION ALL SELECT 'APP', 'role_region_mapping', count(*) FROM role_region_mapping
        UNION ALL SELECT 'APP', 'ai_quality_log', count(*) FROM ({ORACLES["quality_log"]})
        UNION ALL SELECT 'APP', 'nba_email_log', count(*) FROM ({CAMPAIGN})""",
}

ORACLES = {key: re.sub(r"\n\s+", "\n", sql).strip() for key, sql in ORACLES.items()}
