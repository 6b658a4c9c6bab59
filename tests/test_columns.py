from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from heartwood.functions import columns as x


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("  anna maria ", "Anna Maria"),
        ("anna-maria", "Anna-Maria"),
        ("ServiceRequest", "Servicerequest"),
        ("o.k. (yes)", "O.K. (Yes)"),
        ("", ""),
        (None, None),
    ],
)
def test_title_case(spark, text, expected):
    assert value(spark, x.title_case(F.lit(text).cast("string"))) == expected


def test_dates_count_boundaries(spark):
    a, b = x.as_date("2000-12-31"), x.as_date("2001-01-01")
    assert value(spark, x.years_apart(a, b)) == 1
    assert value(spark, x.months_apart(a, b)) == 1
    assert value(spark, x.months_apart(x.as_date("2000-01-01"), x.as_date("2000-01-31"))) == 0


def test_greatest_and_least_are_null_with_a_null(spark):
    null = F.lit(None).cast("int")
    assert value(spark, x.greatest_strict(null, F.lit(1))) is None
    assert value(spark, x.least_strict(F.lit(1), null)) is None
    assert value(spark, x.greatest_strict(F.lit(3), F.lit(1))) == 3
    assert value(spark, x.least_strict(F.lit(3), F.lit(1))) == 1


@pytest.mark.parametrize(("text", "expected"), [("12.6", 13), ("7", 7), ("unknown", None), ("", None), (None, None)])
def test_try_number_rounds(spark, text, expected):
    assert value(spark, x.try_number(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(("text", "expected"), [("$8,500.00", 8500.0), ("1200", 1200.0), ("n/a", None), (None, None)])
def test_parse_amount(spark, text, expected):
    assert value(spark, x.parse_amount(F.lit(text).cast("string"))) == expected


def test_most_common_takes_the_smallest_value_on_a_tie_and_no_null(rows):
    df = rows("k, v, n", "(1, 'b', 2), (1, 'a', 2), (1, NULL, 9), (2, NULL, 1), (3, 'z', 3), (3, 'a', 1)")
    found = df.groupBy("k").agg(x.most_common("v", "n").alias("v"))
    assert {r.k: r.v for r in found.collect()} == {1: "a", 2: None, 3: "z"}


def test_sorted_list_merges_sets(rows):
    df = rows("k, s", "(1, array('b', 'a')), (1, array('a', 'c')), (2, CAST(array() AS ARRAY<STRING>))")
    found = df.groupBy("k").agg(x.sorted_list("s").alias("s"))
    assert {r.k: r.s for r in found.collect()} == {1: "a, b, c", 2: ""}


def test_rounding_is_half_away_from_zero(rows, spark):
    df = rows("v", "(30.80), (30.90)")
    assert df.agg(x.mean_rounded(F.col("v"), 1).alias("m")).first()["m"] == 30.9
    assert value(spark, x.rounded_quotient(F.lit(-1).cast("decimal(12,2)"), F.lit(8).cast("decimal(12,2)"))) == -0.13


def test_division_by_zero_is_null(rows, spark):
    assert value(spark, x.ratio(F.lit(1), F.lit(0))) is None
    assert rows("v", "(1)").filter("v > 5").agg(x.percentage(F.sum("v"), F.count("*")).alias("p")).first()["p"] is None


def test_as_date_takes_dates(spark):
    assert value(spark, x.as_date(datetime.date(2024, 2, 1))) == datetime.date(2024, 2, 1)
