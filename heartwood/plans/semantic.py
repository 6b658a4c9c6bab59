"""Declared business model: tables, dimensions, measures, relationships.

``semantic_query`` turns (measures, dimensions, filters) into a DataFrame. Each
table with measures is aggregated at its own grain, after pulling dimensions
over its many-to-one relationships, so joining never multiplies a measure.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.functions.columns import mean_exact, try_number
from heartwood.functions.frames import outer_key


@dataclass(frozen=True)
class Measure:
    """A column and how it aggregates. Decimal averages are exact."""

    column: str
    aggregate: str = "avg"
    value: Callable[[Column], Column] | None = None

    def over(self) -> Column:
        col = F.col(self.column)
        if self.value is not None:
            col = self.value(col)
        functions = {
            "avg": mean_exact,
            "sum": F.sum,
            "min": F.min,
            "max": F.max,
            "count": F.count,
            "count_distinct": F.count_distinct,
        }
        return functions[self.aggregate](col)


@dataclass(frozen=True)
class LogicalTable:
    """One table of the model; names are unique within the table."""

    base: str
    key: str | None
    dimensions: tuple[str, ...]
    measures: Mapping[str, Measure]
    time_dimensions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    """Many rows on the left belong to one row on the right."""

    left: str
    right: str
    left_key: Callable[[], Column]
    right_column: str


@dataclass(frozen=True)
class Model:
    tables: Mapping[str, LogicalTable]
    relationships: tuple[Relationship, ...] = field(default=())

    def parents(self, name: str) -> dict[str, Relationship]:
        return {r.right: r for r in self.relationships if r.left == name}


def _averages(*names: str) -> dict[str, Measure]:
    return {name: Measure(name) for name in names}


def _totals(*names: str) -> dict[str, Measure]:
    return {f"sum_{name}": Measure(name, "sum") for name in names}


def _same_customer() -> Column:
    return F.col("customer_id")


def _document_customer() -> Column:
    return try_number(F.col("customer_id")).cast("bigint")


CUSTOMER_MEASURES = (
    "age credit_score annual_income tenure_months total_policies active_policies total_premium total_claims open_claims"
    " total_claim_amount total_loans total_outstanding_balance max_days_past_due total_interactions complaint_count"
    " total_calls estimated_clv"
).split()

MODEL = Model(
    tables={
        "customer": LogicalTable(
            "customer_360_unified",
            "customer_id",
            tuple(
                "customer_id full_name email city state country customer_segment employment_status is_active policy_types"
                " primary_risk_category loan_types preferred_channel composite_risk_level most_common_call_reason".split()
            ),
            {
                "total_customers": Measure("customer_id", "count_distinct"),
                **_averages(*CUSTOMER_MEASURES),
                **_totals(*CUSTOMER_MEASURES[4:]),
            },
        ),
        "churn": LogicalTable(
            "churn_risk",
            "customer_id",
            ("customer_id", "full_name", "customer_segment", "retention_urgency", "is_active"),
            _averages("churn_risk_score", "model_confidence", "avg_sentiment_score", "negative_call_count"),
        ),
        "action": LogicalTable(
            "next_best_action",
            "customer_id",
            tuple(
                "customer_id full_name customer_segment action_type action_description priority recommended_channel"
                " rationale latest_call_reason".split()
            ),
            _averages("churn_risk_score", "latest_sentiment_score", "total_premium", "estimated_clv"),
        ),
        "call": LogicalTable(
            "transcript_sentiment",
            "transcript_id",
            ("transcript_id", "customer_id", "call_reason", "agent_name", "sentiment_label"),
            _averages("sentiment_score", "duration_seconds"),
            ("call_date",),
        ),
        "document": LogicalTable(
            "document_extracted",
            None,
            tuple(
                "file_name document_type reference_number policy_number customer_name customer_id category status"
                " description".split()
            ),
            {"total_documents": Measure("file_name", "count"), "amount": Measure("amount", "count")},
        ),
    },
    relationships=(
        Relationship("churn", "customer", _same_customer, "customer_id"),
        Relationship("action", "customer", _same_customer, "customer_id"),
        Relationship("call", "customer", _same_customer, "customer_id"),
        Relationship("action", "churn", _same_customer, "customer_id"),
        Relationship("document", "customer", _document_customer, "customer_id"),
    ),
)


def _split(name: str) -> tuple[str, str]:
    table, _, column = name.partition(".")
    return table, column


def _grain(model: Model, tables: Mapping[str, DataFrame], table: str, dimensions: Sequence[str]) -> DataFrame:
    """Rows of one table with the asked dimensions, its own or those of a parent, as columns ``table.column``."""
    logical = model.tables[table]
    wanted: dict[str, list[str]] = {}
    for name in dimensions:
        owner, column = _split(name)
        wanted.setdefault(owner, []).append(column)
    rows = tables[logical.base]
    for column in wanted.pop(table, []):
        rows = rows.withColumn(f"{table}.{column}", F.col(column))
    for owner, columns in wanted.items():
        link = model.parents(table).get(owner)
        if link is None:
            raise ValueError(f"no many-to-one relationship from {table} to {owner}")
        parent = tables[model.tables[owner].base].select(
            F.col(link.right_column).cast("string").alias("_key"), *[F.col(name).alias(f"{owner}.{name}") for name in columns]
        )
        rows = rows.withColumn("_key", outer_key(link.left_key())).join(parent, "_key", "left").drop("_key")
    return rows


def semantic_query(
    model: Model,
    tables: Mapping[str, DataFrame],
    measures: Sequence[str],
    dimensions: Sequence[str] = (),
    filters: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Measures by dimensions, both as ``table.name``; filters keep listed values of a dimension.

    Result columns are the plain names. A dimension has to belong to the table of
    each measure or to one it has a many-to-one relationship with.
    """
    filters = dict(filters or {})
    known = {f"{t}.{d}" for t, spec in model.tables.items() for d in (*spec.dimensions, *spec.time_dimensions)}
    unknown = [name for name in (*dimensions, *filters) if name not in known]
    if unknown:
        raise ValueError(f"unknown dimensions: {unknown}")
    by_table: dict[str, list[str]] = {}
    for name in measures:
        table, measure = _split(name)
        if measure not in model.tables[table].measures:
            raise ValueError(f"unknown measure: {name}")
        by_table.setdefault(table, []).append(name)

    names = {name: _split(name)[1] for name in (*dimensions, *measures)}
    parts = []
    for table, own in by_table.items():
        rows = _grain(model, tables, table, [*dimensions, *[f for f in filters if f not in dimensions]])
        for name, values in filters.items():
            rows = rows.filter(F.col(f"`{name}`").isin(*values))
        grouped = rows.groupBy(*[F.col(f"`{name}`").alias(names[name]) for name in dimensions]).agg(
            *[model.tables[table].measures[names[name]].over().alias(names[name]) for name in own]
        )
        parts.append(grouped)
    if len(parts) == 1:
        return parts[0]
    # Small results of one row per dimension value: stack them and keep the filled value of each measure.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*[names[name] for name in dimensions]).agg(
        *[F.max(names[name]).alias(names[name]) for name in measures]
    )
