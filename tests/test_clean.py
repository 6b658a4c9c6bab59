from __future__ import annotations

import datetime

import pytest

from heartwood.functions.frames import dedup_latest
from heartwood.operators import clean
from heartwood.operators.documents import document_extracted, parsed_documents

AS_OF = datetime.date(2024, 2, 1)


def test_unknown_time_is_the_newest(rows):
    df = rows("k, t, v", "(1, DATE '2024-01-01', 'old'), (1, CAST(NULL AS DATE), 'null'), (2, DATE '2020-01-01', 'a'), (2, DATE '2021-01-01', 'b')")
    assert {r.k: r.v for r in dedup_latest(df, ["k"], "t").collect()} == {1: "null", 2: "b"}


def test_equal_times_are_settled_by_the_tiebreak(rows):
    df = rows("k, t, amount", "(1, 5, 10), (1, 5, 30), (1, 5, 20)")
    assert [r.amount for r in dedup_latest(df, ["k"], "t", ["amount"]).collect()] == [30]


CUSTOMER = (
    "customer_id, first_name, last_name, email, phone, dob, address, city, state, country, customer_segment,"
    " credit_score, annual_income, employment_status, is_active, created_at, updated_at"
)


def customer(**changes):
    row = {
        "customer_id": "1L", "first_name": "'  anna-maria '", "last_name": "'SMITH'", "email": "' Ann@Mail.COM'",
        "phone": "'+1 (555) 12-34'", "dob": "DATE '2000-12-31'", "address": "' 1 Road'", "city": "'new york'",
        "state": "'ny'", "country": "' usa'", "customer_segment": "NULL", "credit_score": "700",
        "annual_income": "CAST(1 AS DECIMAL(12,2))", "employment_status": "NULL", "is_active": "CAST(NULL AS BOOLEAN)",
        "created_at": "TIMESTAMP_NTZ '2023-12-31 23:00:00'", "updated_at": "TIMESTAMP_NTZ '2024-01-01 00:00:00'",
    }
    return "(" + ", ".join((row | changes).values()) + ")"


def test_customers(rows):
    row = clean.clean_customers(rows(CUSTOMER, customer()), AS_OF).first()
    assert (row.first_name, row.last_name, row.city, row.country) == ("Anna-Maria", "Smith", "New York", "USA")
    assert (row.email, row.email_domain, row.phone) == ("ann@mail.com", "mail.com", "+155512-34")
    assert (row.age, row.tenure_months) == (24, 2)
    assert (row.customer_segment, row.employment_status, row.is_active) == ("Standard", "Unknown", True)


def test_customer_with_unknown_update_time_wins(rows):
    df = rows(CUSTOMER, ", ".join([customer(), customer(updated_at="NULL", city="'old town'")]))
    assert [r.city for r in clean.clean_customers(df, AS_OF).collect()] == ["Old Town"]


POLICY = (
    "policy_id, customer_id, policy_type, policy_status, premium_amount, coverage_amount, deductible_amount, start_date,"
    " end_date, renewal_date, underwriting_score, risk_category, created_at"
)


@pytest.mark.parametrize(
    ("status", "end", "expired"),
    [("' Active'", "2024-01-31", True), ("'Active'", "2024-02-01", False), ("'Lapsed'", "2020-01-01", False), ("NULL", "2020-01-01", False)],
)
def test_expired_compares_the_normalised_status(rows, status, end, expired):
    values = f"(1L, 2L, ' auto', {status}, NULL, 1.0, NULL, DATE '2023-01-01', DATE '{end}', DATE '2024-02-03', 1.0, NULL, TIMESTAMP_NTZ '2023-01-01 00:00:00')"
    row = clean.clean_policies(rows(POLICY, values), AS_OF).first()
    assert row.is_expired is expired
    assert (row.policy_type, row.premium_amount, row.risk_category, row.days_to_renewal) == ("AUTO", 0, "Medium", 2)


CLAIM = (
    "claim_id, policy_id, customer_id, claim_type, claim_status, claim_amount, settlement_amount, filed_date,"
    " resolved_date, description, created_at"
)


def test_claims(rows):
    amount = "CAST({} AS DECIMAL(12,2))".format
    day = "DATE '2024-01-{}'".format
    made = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    df = rows(
        CLAIM,
        f"(1L, 1L, 1L, 'natural disaster ', 'Open', {amount('100')}, NULL, {day('22')}, NULL, 'd', {made}),"
        f"(2L, 1L, 1L, 'theft', 'Settled', {amount('8')}, {amount('1')}, {day('01')}, {day('11')}, 'd', {made}),"
        f"(3L, 1L, 1L, 'theft', 'Settled', {amount('0')}, {amount('1')}, {day('01')}, {day('02')}, 'd', {made})",
    )
    found = {r.claim_id: r for r in clean.clean_claims(df, AS_OF).collect()}
    assert (found[1].claim_type, found[1].settlement_ratio, found[1].days_to_resolve) == ("Natural Disaster", None, 10)
    assert (found[2].settlement_ratio, found[2].days_to_resolve) == (0.13, 10)
    assert found[3].settlement_ratio is None


LOAN = (
    "loan_id, customer_id, loan_type, loan_status, principal_amount, interest_rate, monthly_payment,"
    " outstanding_balance, origination_date, maturity_date, days_past_due, created_at"
)


@pytest.mark.parametrize(
    ("days", "category"),
    [("180", "Severe"), ("179", "High"), ("90", "High"), ("89", "Moderate"), ("30", "Moderate"), ("29", "Low"), ("1", "Low"), ("0", "Current"), ("NULL", "Current")],
)
def test_delinquency_bands(rows, days, category):
    values = f"(1L, 1L, 'auto ', 'Active', CAST(100 AS DECIMAL(14,2)), 1.0, NULL, CAST(25 AS DECIMAL(14,2)), DATE '2020-01-01', DATE '2030-01-01', CAST({days} AS INT), TIMESTAMP_NTZ '2020-01-01 00:00:00')"
    row = clean.clean_loans(rows(LOAN, values), AS_OF).first()
    assert (row.delinquency_category, row.loan_type, row.payoff_progress, row.monthly_payment) == (category, "AUTO", 0.75, 0)


def test_paid_loan_has_full_progress(rows):
    values = "(1L, 1L, 'auto', 'PaidOff', CAST(100 AS DECIMAL(14,2)), 1.0, NULL, CAST(0 AS DECIMAL(14,2)), DATE '2020-01-01', DATE '2030-01-01', 0, TIMESTAMP_NTZ '2020-01-01 00:00:00')"
    assert clean.clean_loans(rows(LOAN, values), AS_OF).first().payoff_progress == 1.0


def test_blank_transcripts_are_dropped(tables):
    raw, kept = tables["raw_call_transcripts"], tables["clean_call_transcripts"]
    blank = "transcript_text IS NULL OR length(trim(transcript_text)) = 0"
    written = raw.filter(f"NOT ({blank})")
    assert raw.filter(blank).count() > 0
    assert written.count() > written.select("transcript_id").distinct().count() == kept.count()
    assert kept.filter("call_reason = 'Unknown'").count() == 0  # older versions have lost
    assert kept.filter("length(trim(transcript_text)) = 0").count() == 0


def test_document_fields(rows):
    form = (
        "Claim Number: CLM-1\\nPolicy Number: POL-9\\nCustomer Name: Ann\\nCustomer ID: 42\\nDate Filed: 2024-01-05\\n"
        "Claim Type: Auto\\nClaim Amount: $8,500.00\\nStatus: Open\\n\\nDescription:\\nFirst line.\\nSecond line.\\n\\nNotes: x"
    )
    policy = "Policy Number: POL-2\\nEffective Date: 2023-05-01\\nAnnual Premium: $300.00\\nfree text"
    made = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    df = rows(
        "document_id, customer_id, document_type, file_name, document_text, file_size_bytes, created_at",
        f"(1L, 1L, 'Claim Form', 'a', '{form}', 9L, {made}), (2L, NULL, 'Policy Summary', 'b', '{policy}', 9L, {made}), (3L, 1L, 'x', 'c', '  ', 9L, {made})",
    )
    found = {r.document_id: r for r in document_extracted(parsed_documents(df)).collect()}
    assert sorted(found) == [1, 2]
    one, two = found[1], found[2]
    assert (one.reference_number, one.policy_number, one.customer_name, one.customer_id) == ("CLM-1", "POL-9", "Ann", "42")
    assert (one.document_date, one.amount, one.category, one.status) == ("2024-01-05", "$8,500.00", "Auto", "Open")
    assert one.description == "First line.\nSecond line."
    assert (two.reference_number, two.customer_name, two.status, two.description) == ("POL-2", None, None, None)
    assert (two.document_date, two.amount, two.source_customer_id) == ("2023-05-01", "$300.00", None)


def test_fields_beyond_any_prefix_are_found(rows):
    long_text = "x" * 20000 + "\\nStatus: Closed"
    df = rows(
        "document_id, customer_id, file_name, document_type, file_size_bytes, file_modified_at, parsed_text",
        f"(1L, 1L, 'a', 'Claim Form', 9L, TIMESTAMP_NTZ '2024-01-01 00:00:00', '{long_text}')",
    )
    assert document_extracted(df).first().status == "Closed"
