"""Column helpers for rules that Spark's built-ins do not give as they stand."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters after which a word starts, besides white space.
WORD_BREAKS = r"""[!?@"^#$&~_,.:;+\-*%/|\\\[\](){}<>]"""


def as_date(value: datetime.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def title_case(col: Column) -> Column:
    """First letter of each word upper, the rest lower; punctuation starts a word too."""
    text = F.lower(F.trim(col))
    words = F.split(text, rf"(?<=\s)|(?<={WORD_BREAKS})")
    rebuilt = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), ""
    )
    return F.when(F.regexp_like(text, F.lit(WORD_BREAKS)), rebuilt).otherwise(F.initcap(text))


def newest_first(name: str) -> Column:
    """Descending with NULL as the largest value."""
    return F.col(name).desc_nulls_first()


def years_apart(start: Column, end: Column) -> Column:
    """Year boundaries crossed, not full years."""
    return F.year(end) - F.year(start)


def months_apart(start: Column, end: Column) -> Column:
    """Month boundaries crossed, not full months."""
    return years_apart(start, end) * 12 + F.month(end) - F.month(start)


def _strict(function, cols: tuple[Column, ...]) -> Column:
    any_null = cols[0].isNull()
    for col in cols[1:]:
        any_null = any_null | col.isNull()
    return F.when(~any_null, function(*cols))


def greatest_strict(*cols: Column) -> Column:
    """Largest value, NULL as soon as one input is NULL."""
    return _strict(F.greatest, cols)


def least_strict(*cols: Column) -> Column:
    """Smallest value, NULL as soon as one input is NULL."""
    return _strict(F.least, cols)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient in double precision, NULL when the divisor is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rounded_quotient(part: Column, whole: Column, digits: int = 2) -> Column:
    """Quotient of two decimals, divided and rounded in decimals, as a double."""
    return F.round(F.try_divide(part, whole), digits).cast("double")


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded share in percent; the division is decimal, so halves round as written."""
    exact = F.try_divide((part * 100).cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return F.round(exact, digits).cast("double")


def mean_exact(col: Column, decimal: str = "decimal(28,6)") -> Column:
    """Average over an exact decimal sum, so that the result has no summation order."""
    return ratio(F.sum(col.cast(decimal)), F.count(col))


def mean_rounded(col: Column, digits: int, decimal: str = "decimal(18,2)") -> Column:
    """Average rounded in decimals. ``decimal`` names the exact type of the values."""
    return F.round(F.try_divide(F.sum(col.cast(decimal)), F.count(col)), digits).cast("double")


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def most_common(value: str, weight: str) -> Column:
    """Value with the largest weight, smallest value on a tie, over pre-counted rows."""
    return F.expr(f"min_by({value}, struct(-{weight}, {value})) FILTER (WHERE {value} IS NOT NULL)")


def sorted_list(sets: str) -> Column:
    """Distinct values of already collected sets, sorted, as one text; '' when there are none."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(sets)))), ", ")


def try_number(col: Column) -> Column:
    """Text to whole number with rounding, NULL when it is not a number."""
    return col.try_cast("decimal(38,0)")


def parse_amount(col: Column) -> Column:
    """'$8,500.00' to 8500.0, NULL when it is not an amount."""
    return F.replace(F.replace(col, F.lit("$"), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.length(F.trim(col)) == 0)
