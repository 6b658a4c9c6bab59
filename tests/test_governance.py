from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heartwood.operators import governance as g


def masked(spark, kind, value, role="ANALYST"):
    return spark.range(1).select(g.MASKS[kind](F.lit(value).cast("string"), role)).first()[0]


@pytest.mark.parametrize(
    ("kind", "value", "expected"),
    [
        ("email", "anna@mail.com", "an***@mail.com"), ("email", "a@mail.com", "a@mail.com"), ("email", "ab@m.com", "ab***@m.com"),
        ("phone", "+15551234567", "+155******67"), ("phone", "+1-555-1234", "+1-555-1234"),
        ("phone_strict", "+1-555-1234", "+*-***-**34"), ("phone_strict", "12-3", "*2-3"), ("phone_strict", "5", "*"),
        ("email", None, None), ("phone_strict", None, None),
    ],
)
def test_masks(spark, kind, value, expected):
    assert masked(spark, kind, value) == expected
    assert masked(spark, kind, value, "SYSADMIN") == value


def test_financial_mask_keeps_the_type(rows):
    df = rows("annual_income, credit_score, email", "(CAST(5 AS DECIMAL(12,2)), 700, 'ann@x.y')")
    hidden = g.masked(df, "ANALYST")
    assert hidden.schema["annual_income"].dataType == df.schema["annual_income"].dataType
    assert tuple(hidden.first()) == (None, None, "an***@x.y")
    assert tuple(g.masked(df, "ACCOUNTADMIN").first())[1] == 700


def test_row_access(spark, rows):
    df = rows("id, country", "(1, 'USA'), (2, 'UK'), (3, 'INDIA'), (4, NULL)")
    mapping = g.role_region_mapping(spark, [*g.ROLE_REGIONS, ("AUDITOR", "ALL")])
    seen = lambda role: sorted(r.id for r in g.row_access(df, mapping, role).collect())
    assert seen("US_TEAM") == [1]
    assert seen("APAC_TEAM") == [3]
    assert seen("AUDITOR") == [1, 2, 3, 4]
    assert seen("SYSADMIN") == [1, 2, 3, 4]
    assert seen("VISITOR") == []


def test_tags_travel_with_the_columns(tables):
    tagged = g.tag(tables["raw_customers"], {"email": {"pii_level": "HIGH"}})
    assert tagged.select("email", "city").schema["email"].metadata == {"pii_level": "HIGH"}
    row = g.pii_tag_coverage(tagged).collect()
    assert [(r.column_name, r.pii_level, r.rows == r.filled) for r in row] == [("email", "HIGH", True)]


def test_tables_carry_their_domain(rows):
    first, second = rows("a, b", "(1, 2), (3, 4)"), rows("a", "(1)")
    tagged = {"first": g.tag_table(first, "CLAIM"), "second": second, "third": g.tag_table(second, "LOAN")}
    assert g.table_domain(tagged["first"].filter("a > 1")) == "CLAIM" and g.table_domain(second) is None
    found = sorted(tuple(r) for r in g.table_tag_coverage(tagged).collect())
    assert found == [("first", "CLAIM", 2), ("third", "LOAN", 1)]
