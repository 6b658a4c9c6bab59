"""Quality checks, validation reports, the check suite and the page probes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions.columns import count_when, mean_exact, mean_rounded, percentage

c = F.col


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ------------------------------------------------------------------ checks


def _check(
    df: DataFrame, kind: str, table: str, metric: str, value: Column, limit: float, failed: Column, details: str
) -> DataFrame:
    return df.agg(value.cast("double").alias("metric_value"), F.when(failed, "FAIL").otherwise("PASS").alias("status")).select(
        F.lit(kind).alias("check_type"),
        F.lit(table).alias("table_name"),
        F.lit(metric).alias("metric_name"),
        "metric_value",
        F.lit(float(limit)).alias("threshold"),
        "status",
        F.lit(details).alias("details"),
    )


def _null_rate(df: DataFrame, name: str, table: str, metric: str, limit: int, details: str) -> DataFrame:
    nulls = count_when(c(name).isNull())
    # The unrounded rate decides: nulls * 100 > limit * rows.
    return _check(
        df, "completeness", table, metric, percentage(nulls, F.count("*")), limit, nulls * 100 > F.count("*") * limit, details
    )


def check_churn_completeness(churn: DataFrame) -> DataFrame:
    return _null_rate(
        churn, "churn_risk_score", "churn_risk", "null_churn_score_rate", 10, "Percentage of customers with NULL churn risk score"
    )


def check_nba_completeness(actions: DataFrame) -> DataFrame:
    return _null_rate(
        actions, "action_type", "next_best_action", "null_action_type_rate", 15, "Percentage of customers with NULL action type"
    )


def _out_of_range(df: DataFrame, name: str, low: float, high: float, table: str, metric: str, details: str) -> DataFrame:
    outside = count_when((c(name) < low) | (c(name) > high))
    return _check(df, "range_check", table, metric, outside, 0, outside > 0, details)


def check_churn_range(churn: DataFrame) -> DataFrame:
    return _out_of_range(
        churn, "churn_risk_score", 0, 1, "churn_risk", "out_of_range_scores", "Count of churn scores outside 0-1 range"
    )


def check_sentiment_range(sentiment: DataFrame) -> DataFrame:
    return _out_of_range(
        sentiment,
        "sentiment_score",
        -1,
        1,
        "transcript_sentiment",
        "out_of_range_sentiment",
        "Count of sentiment scores outside -1 to 1 range",
    )


def heartbeat(spark: SparkSession) -> DataFrame:
    """The constant row a health check leaves in the log."""
    row = ("pipeline_health", "ALL", "health_check_run", 1.0, 1.0, "PASS", "Health check completed")
    return spark.createDataFrame(
        [row],
        "check_type string, table_name string, metric_name string, metric_value double, threshold double,"
        " status string, details string",
    )


def write_log(checks: DataFrame, log_dir: str, run_id: str) -> None:
    """One write per run, into a folder of the run's own: a run that is tried again replaces its rows."""
    checks.withColumn("check_timestamp", F.current_timestamp()).write.mode("overwrite").parquet(f"{log_dir}/run={run_id}")


def latest_log(spark: SparkSession, log_dir: str, limit: int = 50) -> DataFrame:
    """The newest entries; rows of one run share their time and come in the order of what they check."""
    order = [c("check_timestamp").desc(), c("check_type").asc(), c("table_name").asc(), c("metric_name").asc()]
    return spark.read.parquet(log_dir).drop("run").orderBy(*order).limit(limit)


# -------------------------------------------------------------- validation


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One aggregate per table in one job; nothing is counted in a driver loop."""
    return union(
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    )


def _missing(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows per key that no parent has. Counting first leaves one row per key for the join."""
    counted = children.groupBy(key).agg(F.count("*").alias("n"))
    return counted.join(parents.select(key), key, "left_anti")


def _violations(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations"
    )


def orphan_policies(policies: DataFrame, customers: DataFrame) -> DataFrame:
    return _violations("Orphan policies", _missing(policies, customers, "customer_id"))


def orphan_loans(loans: DataFrame, customers: DataFrame) -> DataFrame:
    return _violations("Orphan loans", _missing(loans, customers, "customer_id"))


def orphan_claims(claims: DataFrame, policies: DataFrame, customers: DataFrame) -> DataFrame:
    """Claims without their policy or without their customer, each counted once."""
    has_policy = policies.select("policy_id").distinct().withColumn("has_policy", F.lit(True))
    has_customer = customers.select("customer_id").distinct().withColumn("has_customer", F.lit(True))
    # Claims meet their policies in the order the raw join leaves them in, and only customers are summed up.
    counted = claims.select("policy_id", "customer_id").join(has_policy, "policy_id", "left").groupBy("customer_id")
    counted = counted.agg(F.count("*").alias("all"), F.count_if(c("has_policy").isNull()).alias("lost"))
    joined = counted.join(has_customer, "customer_id", "left")
    found = joined.withColumn("n", F.when(c("has_customer").isNull(), c("all")).otherwise(c("lost")))
    return _violations("Orphan claims", found.filter("n > 0"))


def risk_buckets_validation(churn: DataFrame) -> DataFrame:
    score = c("churn_risk_score")
    bucket = (
        F.when(score >= 0.8, "0.8-1.0 Critical")
        .when(score >= 0.6, "0.6-0.8 High")
        .when(score >= 0.4, "0.4-0.6 Medium")
        .when(score >= 0.2, "0.2-0.4 Low")
        .when(score >= 0.0, "0.0-0.2 Minimal")
        .otherwise("NULL/Invalid")
    )
    return churn.groupBy(bucket.alias("risk_bucket")).agg(F.count("*").alias("customer_count"))


def label_summary(sentiment: DataFrame) -> DataFrame:
    return sentiment.groupBy("sentiment_label").agg(
        F.count("*").alias("transcript_count"),
        mean_rounded(c("sentiment_score"), 3, "decimal(9,4)").alias("avg_score"),
    )


def action_priority_counts(actions: DataFrame) -> DataFrame:
    known = actions.filter(c("action_type").isNotNull())
    return known.groupBy("action_type", "priority").agg(F.count("*").alias("action_count"))


def completeness_report(outputs: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, filled rows and share per (table, output column)."""
    return union(
        df.agg(
            F.count("*").alias("total"),
            F.count(name).alias("non_null"),
            percentage(F.count(name), F.count("*"), 1).alias("completeness_pct"),
        ).select(F.lit(table).alias("table_name"), "total", "non_null", "completeness_pct")
        for table, (df, name) in outputs.items()
    )


def parse_failure_rate(df: DataFrame, name: str) -> DataFrame:
    return df.agg(percentage(count_when(c(name).isNull()), F.count("*")).alias("failure_rate"))


def ai_quality_dashboard(churn: DataFrame, actions: DataFrame, documents: DataFrame) -> DataFrame:
    def branch(df: DataFrame, model: str, failed: Column, outside: Column, average: Column) -> DataFrame:
        failures = count_when(failed)
        return df.agg(
            F.count("*").alias("total_records"),
            failures.alias("parse_failures"),
            percentage(failures, F.count("*")).alias("failure_rate_pct"),
            outside.alias("out_of_range"),
            average.alias("avg_score"),
        ).select(F.lit(model).alias("model"), "*")

    score = c("churn_risk_score")
    no_field = c("reference_number").isNull() & c("customer_name").isNull()
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    return union(
        [
            branch(
                churn, "Churn Risk", score.isNull(), count_when((score < 0) | (score > 1)), mean_exact(score, "decimal(9,4)")
            ),
            branch(actions, "Next Best Action", c("action_type").isNull(), zero, none),
            branch(documents, "Document Extraction", no_field, zero, none),
        ]
    )


# ------------------------------------------------------------- check suite


@dataclass(frozen=True)
class Check:
    """One check: a metric over a table, a rule for PASS, the words around the value."""

    id: int
    page: str
    name: str
    table: str
    metric: Callable[[], Column]
    passes: Callable[[Column], Column] | None
    detail: str
    otherwise: str = "FAIL"


def at_least(n: int) -> Callable[[Column], Column]:
    return lambda v: v >= n


def rows_where(condition: Callable[[], Column] | None = None) -> Callable[[], Column]:
    return lambda: F.count("*") if condition is None else count_when(condition())


def values_of(name: str, where: Callable[[], Column] | None = None) -> Callable[[], Column]:
    """Distinct values of a column with a small domain, merged per task."""
    return lambda: F.size(F.collect_set(c(name) if where is None else F.when(where(), c(name)))).cast("bigint")


def whole_percent(part: Callable[[], Column], whole: Callable[[], Column] = rows_where()) -> Callable[[], Column]:
    return lambda: F.round(percentage(part(), whole(), 1), 0).cast("bigint")


def _scored() -> Column:
    return c("churn_risk_score").isNotNull()


def _catalog(name: str) -> Callable[[], Column]:
    return lambda: F.max(c(name))


DATA_CHECKS = (
    Check(5, "Home", "KPI: Total Customers", "scored", rows_where(), at_least(1), " customers"),
    Check(6, "Home", "KPI: Active Customers", "scored", rows_where(lambda: c("is_active")), at_least(1), " active"),
    Check(7, "Home", "KPI: High Churn Risk", "scored", rows_where(lambda: c("churn_risk_score") >= 0.7), None, " high-risk"),
    Check(8, "Home", "KPI: High Priority Actions", "scored", rows_where(lambda: c("priority") == "High"), None, " actions"),
    Check(9, "Home", "Chart: Churn by Segment", "scored", values_of("customer_segment", _scored), at_least(3), " segments"),
    Check(10, "Home", "Chart: Sentiment Dist", "transcript_sentiment", values_of("sentiment_label"), at_least(2), " labels"),
    Check(11, "Home", "Table: Top Actions", "scored", rows_where(lambda: (c("priority") == "High") & c("action_type").isNotNull()), at_least(1), " rows"),
    Check(12, "Customer 360", "Search: smith", "scored", rows_where(lambda: F.lower("full_name").contains("smith")), at_least(1), " matches"),
    Check(13, "Customer 360", "Claims data", "clean_claims", rows_where(), at_least(1), " rows"),
    Check(14, "Customer 360", "Loans data", "clean_loans", rows_where(), at_least(1), " rows"),
    Check(15, "Customer 360", "Timeline data", "interaction_timeline", rows_where(), at_least(1), " events"),
    Check(16, "Churn Risk", "Segment filters", "scored", values_of("customer_segment", _scored), at_least(3), " segments"),
    Check(17, "Sentiment", "Transcript data", "transcript_sentiment", rows_where(), at_least(1), " scored"),
    Check(18, "Next Best Action", "Action types", "scored", values_of("action_type"), at_least(3), " types"),
    Check(19, "AI Advisor", "Fallback: complaints", "scored", rows_where(lambda: c("complaint_count") > 2), None, " with >2"),
    Check(21, "Data Quality", "Churn completeness", "scored", whole_percent(lambda: F.count("churn_risk_score")), at_least(90), "% non-null", "WARN"),
    Check(22, "Data Quality", "Churn range [0,1]", "scored", rows_where(lambda: (c("churn_risk_score") < 0) | (c("churn_risk_score") > 1)), lambda v: v == 0, " violations"),
    Check(23, "Data Quality", "Sentiment range [-1,1]", "transcript_sentiment", rows_where(lambda: (c("sentiment_score") < -1) | (c("sentiment_score") > 1)), lambda v: v == 0, " violations"),
    Check(24, "Document", "Documents exist", "document_extracted", rows_where(), at_least(1), " documents"),
    Check(25, "Document", "Customer cross-reference", "scored", rows_where(lambda: c("total_documents") > 0), at_least(1), " customers with docs"),
    Check(26, "Document", "Timeline includes documents", "interaction_timeline", rows_where(lambda: c("event_category") == "Document"), at_least(1), " doc events"),
    Check(27, "AI Quality", "Churn parse success", "scored", whole_percent(lambda: count_when(c("churn_risk_score").isNull())), lambda v: v < 5, "% null scores (need < 5%)"),
    Check(28, "AI Quality", "NBA parse success", "scored", whole_percent(lambda: count_when(_scored() & c("action_type").isNull()), lambda: F.count("churn_risk_score")), lambda v: v < 5, "% null actions (need < 5%)"),
    Check(33, "Data Quality", "Timeline: 6 event categories", "interaction_timeline", values_of("event_category"), at_least(6), " categories (need >= 6)"),
    Check(35, "App Health", "All layers populated", "populated", rows_where(), at_least(20), " populated tables"),
    Check(36, "App Health", "Doc-customer cross-ref probe", "scored", rows_where(lambda: c("total_documents") > 0), at_least(1), " customers with docs"),
)

CATALOG_CHECKS = (
    Check(1, "Infrastructure", "All tables exist", "catalog", _catalog("tables"), at_least(17), " tables (need >= 17)"),
    Check(2, "Infrastructure", "Dynamic tables", "catalog", _catalog("derived"), at_least(9), " DTs (need >= 9)"),
    Check(3, "Infrastructure", "Search", "catalog", _catalog("searches"), at_least(1), " service(s)"),
    Check(4, "Infrastructure", "Semantic view", "catalog", _catalog("models"), at_least(1), " view(s)"),
    Check(20, "Operations", "INFO_SCHEMA tables", "catalog", _catalog("tables"), at_least(1), " tables"),
    Check(29, "Governance", "Masking policies exist", "catalog", _catalog("masks"), at_least(1), " policies"),
    Check(30, "Governance", "PII tags exist", "catalog", _catalog("tags"), at_least(1), " PII tags"),
    Check(32, "Infrastructure", "AI quality dashboard view", "catalog", _catalog("dashboards"), at_least(1), " view(s)"),
    Check(34, "App Health", "DT probe query runs", "catalog", _catalog("derived"), at_least(14), " DTs (need >= 14)"),
)


def check_rows(measured: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """One row per check from one row of measured values, named `m` and the check's number."""

    def row(check: Check) -> Column:
        value = c(f"m{check.id}")
        status = F.lit("PASS") if check.passes is None else F.when(check.passes(value), "PASS").otherwise(check.otherwise)
        return F.struct(
            F.lit(check.id).alias("test_id"),
            F.lit(check.page).alias("page"),
            F.lit(check.name).alias("test_name"),
            status.alias("status"),
            F.concat(value.cast("string"), F.lit(check.detail)).alias("detail"),
            value.alias("row_count"),
        )

    return measured.select(F.explode(F.array(*[row(check) for check in checks])).alias("r")).select("r.*")


def check_suite(tables: Mapping[str, DataFrame], checks: Iterable[Check]) -> DataFrame:
    """All checks as rows: one aggregate per table, whatever the number of checks on it."""
    by_table: dict[str, list[Check]] = {}
    for check in checks:
        by_table.setdefault(check.table, []).append(check)

    def rows(name: str, group: list[Check]) -> DataFrame:
        return check_rows(tables[name].agg(*[check.metric().cast("bigint").alias(f"m{check.id}") for check in group]), group)

    return union(rows(name, group) for name, group in by_table.items())


def populated(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table that holds any row. No output column is read, only what decides which rows exist."""
    return union(df.limit(1).select(F.lit(name).alias("table_name")) for name, df in tables.items())


def catalog_frame(spark: SparkSession, sizes: Mapping[str, int]) -> DataFrame:
    """The sizes of the job's own registries as one row."""
    return spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in sizes.items()])


# ------------------------------------------------------------- page probes


@dataclass(frozen=True)
class Probe:
    """The rows a page query returns: one for a count, the group count, or the rows up to a limit."""

    page: str
    name: str
    min_rows: int
    table: str
    rows: Callable[[], Column]


def one_row(condition: Callable[[], Column] | None = None) -> Callable[[], Column]:
    """A counting query answers with one row, provided that its count can be taken."""
    return lambda: F.when(rows_where(condition)().isNotNull(), 1)


def up_to(n: int, condition: Callable[[], Column] | None = None) -> Callable[[], Column]:
    return lambda: F.least(rows_where(condition)(), F.lit(n))


PROBES = (
    Probe("Home", "Customer count KPI", 1, "scored", one_row()),
    Probe("Home", "High churn KPI", 0, "scored", one_row(lambda: c("churn_risk_score") >= 0.7)),
    Probe("Home", "High priority actions KPI", 0, "scored", one_row(lambda: c("priority") == "High")),
    Probe("Home", "Documents processed KPI", 0, "document_extracted", one_row()),
    Probe("Customer 360", "Customer search query", 1, "scored", up_to(10)),
    Probe("Customer 360", "Interaction timeline", 1, "interaction_timeline", one_row()),
    Probe("Customer 360", "Churn join", 1, "scored", one_row()),
    Probe("Churn Risk", "Segment list for filter", 1, "scored", values_of("customer_segment")),
    Probe("Churn Risk", "Urgency distribution", 1, "scored", lambda: F.size(F.collect_set(F.coalesce("retention_urgency", F.lit("none"))))),
    Probe("Churn Risk", "Top churn customers", 1, "scored", up_to(10)),
    Probe("Sentiment", "KPI aggregation", 1, "transcript_sentiment", one_row()),
    Probe("Sentiment", "Distribution by label", 1, "transcript_sentiment", values_of("sentiment_label")),
    Probe("Sentiment", "Weekly trend", 1, "transcript_sentiment", lambda: F.least(F.size(F.collect_set(F.trunc("call_date", "week"))), F.lit(20))),
    Probe("Next Best Action", "Action types for filter", 1, "scored", values_of("action_type")),
    Probe("Next Best Action", "High-priority NBA rows", 1, "scored", up_to(20, lambda: c("priority") == "High")),
    Probe("Next Best Action", "Action mix chart", 1, "scored", values_of("action_type")),
    Probe("AI Advisor", "Customer context data", 1, "scored", one_row(lambda: c("complaint_count") > 0)),
    Probe("AI Advisor", "Critical retention data", 0, "scored", up_to(5, lambda: c("retention_urgency") == "Critical")),
    Probe("Operations", "Layer row counts", 1, "layers", values_of("layer")),
    Probe("Operations", "Dynamic tables count", 1, "layers", one_row(lambda: c("layer") != "RAW")),
    Probe("Operations", "All layers populated", 1, "layers", one_row()),
    Probe("Documents", "Document count KPIs", 1, "document_extracted", one_row()),
    Probe("Documents", "Extracted fields table", 1, "document_extracted", up_to(10)),
    Probe("Documents", "Document-customer cross-ref", 1, "scored", one_row(lambda: c("total_documents") > 0)),
    Probe("What-If Simulator", "Health score DT", 1, "scored", one_row(lambda: c("health_score").isNotNull())),
    Probe("What-If Simulator", "3-way join", 1, "scored", up_to(5)),
    Probe("Operations", "Governance tab: masking policies", 1, "role_region_mapping", one_row()),
    Probe("Operations", "AI Quality tab: dashboard view", 1, "layers", one_row()),
    Probe("Operations", "Lineage tab: full object inventory", 1, "layers", one_row()),
)


def probe_results(tables: Mapping[str, DataFrame], probes: Iterable[Probe] = PROBES) -> DataFrame:
    """PASS when a page query returns its minimum of rows, else WARN. An error fails the whole run."""
    by_table: dict[str, list[tuple[int, Probe]]] = {}
    for i, probe in enumerate(probes):
        by_table.setdefault(probe.table, []).append((i, probe))

    def row(i: int, probe: Probe) -> Column:
        return F.struct(
            F.lit(probe.page).alias("page"),
            F.lit(probe.name).alias("probe"),
            c(f"p{i}").alias("rows"),
            F.lit(probe.min_rows).cast("bigint").alias("min_rows"),
            F.when(c(f"p{i}") >= probe.min_rows, "PASS").otherwise("WARN").alias("status"),
        )

    def rows(name: str, group: list[tuple[int, Probe]]) -> DataFrame:
        measured = tables[name].agg(*[probe.rows().cast("bigint").alias(f"p{i}") for i, probe in group])
        return measured.select(F.explode(F.array(*[row(i, probe) for i, probe in group])).alias("r")).select("r.*")

    return union(rows(name, group) for name, group in by_table.items())


def probe_summary(results: DataFrame) -> DataFrame:
    passed = count_when(c("status") == "PASS")
    return results.groupBy("page").agg(
        F.count("*").alias("probes"),
        passed.alias("passed"),
        count_when(c("status") == "WARN").alias("warned"),
        percentage(passed, F.count("*"), 0).alias("pct"),
    )


def run_history_summary(runs: DataFrame) -> DataFrame:
    seconds = c("finished_at").cast("double") - c("started_at").cast("double")
    return runs.groupBy("job").agg(
        F.count("*").alias("runs"),
        count_when(c("state") == "SUCCEEDED").alias("succeeded"),
        count_when(c("state") == "FAILED").alias("failed"),
        F.sum("rows_read").alias("rows_read"),
        F.sum("rows_written").alias("rows_written"),
        F.round(F.avg(seconds), 1).alias("avg_seconds"),
    )
